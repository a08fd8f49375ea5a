"""Inputs on which an operator once did less than its whole job."""

import random
import time

import numpy as np
import pytest

from conftest import SF
from knnhard.llm import html_crf, langid, mixing, secrets


@pytest.mark.parametrize("size", [3_000, 300_000])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_html_reads_attribute_values_of_any_length(size, quote):
    value = "x" * (size // 2) + "> <p>" + "y" * (size // 2)
    paragraphs = [f"paragraph {i}" for i in range(5)]
    page = f"<div><img src={quote}{value}{quote} alt={quote}a{quote}>" + "".join(f"<p class={quote}c{quote}>{t}</p>" for t in paragraphs) + "</div>"
    assert [b.text for b in html_crf.blocks(page)] == paragraphs


def test_html_stray_quotes_hide_no_text():
    page = '<p class="a"">one</p><p title=don\'t>two</p><p class="b>three</p><p x=\'>four</p>'
    assert [b.text for b in html_crf.blocks(page)] == ["one", "two", "three", "four"]


@pytest.mark.parametrize("piece", ['<a b=">"', '<a b="', "<a b='\"' ", "<a<a ", '<p x=">">'])
def test_html_reads_endless_tags_in_linear_time(piece):
    begin = time.monotonic()
    for page in (piece * 100_000, piece * 100_000 + ">", piece * 100_000 + '">'):
        html_crf.blocks(page)
    assert time.monotonic() - begin < 30


def test_html_marks_are_read_to_the_last_word_at_any_depth():
    utility = "flex mt-4 px-2 bg-white text-sm rounded shadow-md border items-center comments"
    assert "c:comments" in html_crf.blocks(f'<div class="{utility}"><p>a reader</p></div>')[0].above
    deep = "".join(f'<div class="layer{chr(97 + i // 26)}{chr(97 + i % 26)}">' for i in range(200))
    page = deep + '<nav hidden class="menu"><p>go</p></nav><aside><p>ad</p></aside><p>text</p>'
    known = {"a:nav", "a:aside", "c:menu", "hidden", "c:layeraa"}
    for marks in (None, frozenset(known)):
        nav, aside, text = html_crf.blocks(page, marks)
        assert known - {"a:aside"} <= nav.above and "a:aside" in aside.above and not text.above & (known - {"c:layeraa"})
    assert nav.above == known - {"a:aside"}
    assert html_crf.blocks(page, max_marks=1_000) == [] and len(html_crf.blocks(page, max_marks=100_000)) == 3


def test_html_model_drops_comments_under_deep_and_wordy_marks(spark):
    model = html_crf.Crf({"bias": 1.0, "c:comments": -5.0, "a:nav": -5.0}, ((0.0, 0.0), (0.0, 0.0)), 0.0)
    deep = "".join(f'<div class="layer{chr(97 + i // 26)}{chr(97 + i % 26)}">' for i in range(100))
    page = deep + '<p>story</p><nav><p>menu</p></nav><div class="flex mt px bg rounded shadow border text comments"><p>reader</p></div>'
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_crf.extract(pages, model).first().text == "story"


ASSIGNED = {  # the text and the value to be found in it
    1: ("x\nAPI_KEY=abcdef0123456789abcdef01\nDEBUG=1", "abcdef0123456789abcdef01"),
    2: ("password=QwErTyUiOpAsDfGhJkLz", "QwErTyUiOpAsDfGhJkLz"),
    3: ("DB_PASSWORD=xK4vQ9tLw\n", "xK4vQ9tLw"),
    4: ('{"password": "kR7!pa, s"}', "kR7!pa, s"),
    5: ("A_RATHER_LONG_SECRET_TOKEN=dGhpcyBpcyBhIHNlY3JldA==", "dGhpcyBpcyBhIHNlY3JldA=="),
    6: ("Authorization: Bearer aB3xZ9", "aB3xZ9"),
    7: ("the key QwErTyUiOpAsDfGh here", "QwErTyUiOpAsDfGh"),
    8: ("LEVEL=dGhpcyBpcyBhIHNlY3JldA== next", "dGhpcyBpcyBhIHNlY3JldA=="),
    9: ("GET /?token=ab12cd34&page=2", "ab12cd34"),
}


def test_secret_candidates_of_assignments(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in ASSIGNED.items()], "doc_id int, text string")
    got = {(r.id, r.cand): r for r in secrets.candidates(docs, "doc_id", "text", None).collect()}
    for i, (text, value) in ASSIGNED.items():
        found = got[i, value]
        assert text[found.start:found.end] == value and text[:found.start].endswith(found.before) and len(found.before) == min(48, found.start)
    marked = {(r.id, r.cand): r for r in secrets.with_features(secrets.candidates(docs, "doc_id", "text", None), []).collect()}
    for i in (1, 2, 3, 4, 5, 9):
        assert marked[i, ASSIGNED[i][1]].near == marked[i, ASSIGNED[i][1]].assigned == 1


def test_secret_forest_learns_what_the_scan_finds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = secrets.findings_from(docs, "doc_id", "text", "source", 200)
    assert made.where("label = 1 AND NOT cand RLIKE '[0-9]'").count() > 0 and made.where("label = 1 AND length(cand) < 16").count() > 0
    assert made.where("before LIKE '%api_key=' AND label = 1").count() > 0
    words = secrets.dictionary(docs, "text")
    model = secrets.train(made, words)
    texts = spark.createDataFrame([(i, t) for i, (t, _) in ASSIGNED.items()] + [(20, "internationalisation of the neighbourhoodliness"), (21, "the key: value")], "doc_id int, text string")
    is_secret = {(r.doc_id, r.candidate): r.is_secret for r in secrets.scan(texts, model, words).collect()}
    assert all(is_secret[i, ASSIGNED[i][1]] for i in (1, 2, 3, 5))
    assert not any(yes for (i, _), yes in is_secret.items() if i >= 20)


def test_mix_keeps_clean_documents_of_a_clean_corpus(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(5)
    vocab = {d: [f"{d}{chr(97 + i)}" for i in range(20)] for d in ("clean", "low", "toxic")}
    kind = {i: "clean" if i < 970 else "low" if i < 990 else "toxic" for i in range(1000)}

    def text(i):  # a tenth of the clean texts is unsure
        other = 9 if kind[i] == "clean" and i % 10 == 0 else 0
        return " ".join(rng.choice(vocab["low"] if k < other else vocab[kind[i]]) for k in range(20))

    docs = spark.createDataFrame([(i, text(i)) for i in range(1000)], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(d == "clean"), int(d == "toxic")) for i, d in kind.items()], "doc_id long, quality int, toxic int").repartition(1)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    got = {r.doc_id: r for r in corpus_pipeline.mix(spark, docs, "").collect()}
    assert all(i in got and got[i].rate >= 1 for i, d in kind.items() if d == "clean")


def test_rates_of_a_whole_domain_meet_the_targets(spark):
    p = np.array([[1, 0, 0]] * 97 + [[0.6, 0.4, 0]] * 5 + [[0, 1, 0]] * 2 + [[0, 0, 1]], float)
    members = spark.createDataFrame([(10, list(map(float, x))) for x in p], "n_words long, p array<double>").repartition(1).cache()
    path = mixing.fit_rates(members, np.array([0.9, 0.08, 0.02]), rounds=60, tol=1e-3, whole=0)
    r = mixing.rates(p, path, whole=0)
    assert r[:102].min() >= 1 and np.abs(r @ p / r.sum() - [0.9, 0.08, 0.02]).max() < 0.01


def test_language_size_does_not_switch_the_rule(spark):
    def words(letters, n):
        return ["".join(letters[(i // len(letters) ** k) % len(letters)] for k in range(5)) for i in range(n)]

    seen = {}
    for size in (1_600, 1_800):  # words of 6 n-grams with their spaces: under and over 10,000 n-grams
        text = " ".join(words("abcdefgh", size))
        rows = spark.createDataFrame([("rare", text), ("large", " ".join(words("nopqrstu", 8_000)))], "lang string, t string").repartition(2)
        model = langid.train(rows)
        lang, score = langid.classify(model, [" ".join(words("abcdefgh", 1_600)[::7])])
        assert lang == ["rare"]
        seen[size] = score[0]
    assert abs(seen[1_600] - seen[1_800]) < 0.02 and seen[1_800] > 0.9


def test_more_languages_than_a_mask_word_holds(spark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(130 * 6)]
    texts = {f"l{i:03}": " ".join("".join(rng.choices(letters[6 * i:6 * i + 6], k=5)) for _ in range(60)) for i in range(130)}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string").repartition(2)
    model = langid.train(docs.selectExpr("lang", "text AS t"))
    assert len(model.languages) == 130 and model.cells.shape[1] == 3
    got = langid.identify(docs, model).join(docs, "doc_id").collect()
    assert len(got) == 130 and all(r.lang_pred == r.lang and r.score > 0.9 for r in got)
    assert langid.keep_known(docs, model).count() == 130
