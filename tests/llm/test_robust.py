"""Broken and very long pages, repeated rows in samples, tables with nothing to learn from."""

import time

import pytest

from knnhard.llm import html_crf, secrets, textmodel

PAGES = "page_id long, url string, html string"


def texts(page):
    return [b.text for b in html_crf.blocks(page)]


@pytest.mark.parametrize("piece", ["<!-- x> ", "<![CDATA[ x> ", "<object>", "<svg><template>", "<a <b ", "<span class='x y'>"])
def test_long_broken_pages_take_linear_time(piece):
    page = "<p>first</p>" + piece * (5_000_000 // len(piece))
    t = time.time()
    assert texts(page)[0] == "first"
    assert time.time() - t < 30


def test_skipped_elements_nest_and_unclosed_ones_skip_nothing():
    assert texts("<p>a</p><object><p>rest one</p><p>two") == ["a", "rest one", "two"]
    assert texts("<template><template>x</template>hidden</template>shown") == ["shown"]
    assert texts("<svg><g><svg>in</svg>in</g></svg><svg/>out") == ["out"]
    assert texts("<iframe><p>kept</p><canvas>gone</canvas>") == ["kept"]
    assert texts("<p>a</p><style>p{} <p>rest is raw") == ["a"]
    assert texts("<p>a</p><!-- never closed ><p>b</p>") == ["a", "b"]
    assert texts("<p>a<!-- x --><p>b<![CDATA[<c>]]></p>") == ["a", "b<c>"]


def test_a_slash_does_not_close_a_script():
    assert texts('<script src="x"/>var a=1;</script>end') == ["end"]


def test_marks_of_inline_and_custom_elements():
    def marks(page):
        return [(b.text, "c:comments" in b.above) for b in html_crf.blocks(page)]

    assert marks('<div><span class="comments">all of it</span></div>') == [("all of it", True)]
    assert marks('<div>some <span class="comments">of it</span></div><div>none</div>') == [("some of it", False), ("none", False)]
    assert marks('<user-comments class="comments">one</user-comments>two') == [("one", True), ("two", False)]
    assert marks('<span class="comments"><p>in</p><div>in</div></span><p>out</p>') == [("in", True), ("in", True), ("out", False)]
    assert marks('<div><span class="comments"><p>in</p></div><p>ended with its block</p>') == [("in", True), ("ended with its block", False)]


def test_repeated_pages_are_labelled_as_often_as_single_ones(spark):
    page = "<body><nav>Menu one two</nav><article><p>{}</p></article></body>"
    rows = [(i, "u", page.format(f"Article number {i} with a line of text that is long enough. " * 2)) for i in range(40)]
    once = html_crf.labelled_pages(spark.createDataFrame(rows, PAGES), "page_id", "html", 20, 0)
    often = html_crf.labelled_pages(spark.createDataFrame(rows * 200, PAGES), "page_id", "html", 20, 0)
    assert len(once) == len(often) == 20
    assert [[b.text for b in p] for p, _ in once] == [[b.text for b in p] for p, _ in often]


def test_sample_holds_one_row_per_id_and_any_number_of_classes(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(600)] + [(3, "text 3")] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 100) for i in range(600)], "id long, y long")
    sample, sizes = textmodel.sample_labelled(docs, labels, "doc_id", "text", 4)
    assert len(sizes) == 100 and set(sizes.values()) == {6}
    assert sample.count() == 400 and sample.distinct().count() == 400
    two, sizes = textmodel.sample_labelled(docs, labels.selectExpr("id", "id % 2 AS y"), "doc_id", "text", 10)
    assert sizes == {"0": 300, "1": 300} and {r["y"]: r["count"] for r in two.groupBy("y").count().collect()} == {"0": 10, "1": 10}


def test_no_forest_without_findings(spark):
    for rows in ([], [(1, None, "a"), (2, None, "b")], [(None, "token = \"abcdef0123456789abcdef\"", "a")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        words = secrets.dictionary(docs, "text")
        model = secrets.train(secrets.findings_from(docs, "doc_id", "text", "source"), words)
        assert model is None
        got = secrets.scan(docs, model, words, path_col="source").collect()
        assert [(r["score"], r["is_secret"]) for r in got] == [(None, False)] * sum(t is not None for _, t, _ in rows)


def test_filters_grow_with_the_largest_language(spark):
    """Random letters: nearly every n-gram is another one, so fixed cells would fill up."""
    import random

    from knnhard.llm import langid

    rnd = random.Random(1)
    rows = [(lang, "".join(rnd.choice(letters) for _ in range(3000))) for lang, letters in
            (("a", "abcdefghijklmnopqrstuvwxyzàâäçé"), ("b", "бвгдежзийклмнопрстуфхцчшщъыьэюя")) for _ in range(120)]
    model = langid.train(spark.createDataFrame(rows, "lang string, t string"))
    assert len(model.cells) >= 2 << 20 and model.fill.max() < 0.35
    assert langid.classify(model, [rows[0][1], rows[-1][1]])[0] == ["a", "b"]


def test_a_mix_that_does_not_settle_warns(spark):
    import numpy as np

    from knnhard.llm import mixing

    rows = [(int(n), [float(x), 1 - float(x)]) for n, x in zip(range(1, 200), np.linspace(0.05, 0.95, 199))]
    members = spark.createDataFrame(rows, "n_words long, p array<double>")
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.fit_rates(members, np.array([0.9, 0.1]), rounds=1)
