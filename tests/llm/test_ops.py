"""The operators against brute force, on small tables with nulls, empties, ties, repeats and clashing names."""

import collections
import hashlib
import io
import itertools
import random
import re
import zipfile

import numpy as np
import pytest
import xxhash
from conftest import SF
from oracle_check import canon

import __spark_entry__ as E
from knnhard.llm import (chat_format, components, decontaminate, exact_dedup, html_crf, langid, mixing, secrets, simhash_dedup, textmodel,
                         toxicity, warc_zip)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, score double, fp long, k string, run int, _key string, id long"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=DOCS):
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) if isinstance(r, dict) else r for r in rows], schema)
    return make


def docs_of(frame, pairs, schema=DOCS):
    return frame([{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": 1} for i, t in pairs], schema)


def edge_pairs():
    long = " ".join(random.Random(3).choice(WORDS) for _ in range(30_000))
    return [(1, None), (2, ""), (3, "A b C"), (4, "a B c"), (4, "a B c"), (None, "a b c"), (None, None), (5, long), (6, long.upper()), (7, "é É"), (8, "é é"), (9, "x")]


@pytest.mark.parametrize("name", sorted(E.llm_catalog.ORACLES))
def test_oracle(spark, duck, name):
    sc, sr = canon(E.queries()[name](spark, SF).toPandas())
    dc, dr = canon(duck.execute(E.oracle_sql()[name]).df())
    assert sc == dc
    assert sr == dr


# ---- exact dedup

def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(frame, keep):
    pairs = edge_pairs() + [(100 + i, "Hot text") for i in range(60)]
    got = exact_dedup.exact_dedup(docs_of(frame, pairs, CLASH), keep=keep, runs=16, fan_in=2).collect()
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[hashlib.sha256(low(t).encode()).hexdigest()].append(i)
    assert len(got) == len(pairs)
    kept = collections.Counter()
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256])
        assert r.keep_id == ((min if keep == "smallest" else max)(ids) if ids else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_drop_copies_keeps_columns(frame):
    docs = docs_of(frame, edge_pairs())
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(low(r.text) for r in got.collect()) == sorted({low(t) for _, t in edge_pairs()})


def test_empty_tables(spark, frame):
    none = docs_of(frame, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash_dedup.simhash_dedup(none).count() == 0
    assert decontaminate.decontaminate(none, frame([], "item_id long, text string")).count() == 0
    assert langid.identify(none, langid.train(langid.training_rows(none))).count() == 0
    labels = frame([], "id long, y int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert mixing.mix(none, labels, {"a": 1.0}).count() == 0
    assert chat_format.rotate(frame([], "conv_id long, turn long, role string, text string")).count() == 0
    pages = frame([], "page_id long, url string, html string")
    model = html_crf.train(html_crf.labelled_pages(pages, "page_id", "html", 5, 20))
    assert html_crf.extract(pages, model).count() == 0
    assert secrets.candidates(none, "doc_id", "text", None).count() == 0


# ---- SimHash

def brute_fingerprint(t):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", low(t)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(frame):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(400)]
    pairs = list(edge_pairs())
    for i in range(40):  # a chain of near copies
        base[rng.randrange(400)] = rng.choice(WORDS)
        pairs.append((1000 + i, " ".join(base)))
    pairs += [(2000 + i, " ".join(rng.choice(WORDS) for _ in range(50))) for i in range(30)]
    got = simhash_dedup.simhash_dedup(docs_of(frame, pairs, CLASH)).collect()
    fps = sorted({brute_fingerprint(t) for _, t in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, t in pairs:
        f = find(brute_fingerprint(t))
        least[f] = min(x for x in (least.get(f), i) if x is not None) if i is not None or f in least and least[f] is not None else None
    want = collections.Counter((i, f"{brute_fingerprint(t):016x}", least[find(brute_fingerprint(t))]) for i, t in pairs)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len({find(f) for f in fps}) < len(fps)
    kept = simhash_dedup.drop_near_copies(docs_of(frame, pairs)).collect()
    assert len(kept) == len({find(f) for f in fps})


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(500)] + [(-5, 7000), (9000, 9000)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(301))
    assert all(got[i] == 1000 for i in range(1000, 1501))
    assert got[7000] == got[-5] == -5 and 9000 not in got


# ---- decontamination

def test_decontamination_offsets(frame):
    item = "One two THREE four five six seven eight nine ten eleven"
    text = "Ünïcode ¡ zero;  one, two three-four five\nsix seven eight nine ten! eleven twelve one"
    docs = docs_of(frame, [(1, text), (2, "one two three four five six seven eight nine, TEN"), (3, "short item"), (4, None), (5, ""), (6, "a short  item."), (1, text)], CLASH)
    items = frame([(7, item), (10, item), (8, "short, Item"), (9, None), (11, " "), (None, "a")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert [got[1].n_words, got[1].n_hit, got[1].n_items] == [16, 11, 2]
    assert [text[s.start:s.end] for s in got[1].spans] == ["one, two three-four five\nsix seven eight nine ten! eleven"]
    assert got[1].items_sha256 == hashlib.sha256(b"10,7").hexdigest()
    assert (got[2].n_hit, got[3].n_hit, got[6].n_hit, got[4].n_words, got[5].n_words) == (10, 2, 2, 0, 0)
    assert got[4].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[5].contaminated
    left = decontaminate.drop_contaminated(docs_of(frame, [(1, text), (4, None), (12, "item short")]), items)
    assert sorted(r.doc_id for r in left.collect()) == [4, 12]


# ---- language ID

def test_language_id(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = E.queries()["op7_langid"](spark, SF).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    model = langid.train(langid.training_rows(docs))
    odd = docs_of(frame, [(1, None), (2, ""), (3, "123 !! 4"), (4, "é"), (None, "the and of"), (5, "日本語")], CLASH)
    out = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred in model.languages and out[5].score == 0.0
    assert sorted(r.doc_id for r in langid.keep_known(docs_of(frame, [(1, None), (3, "12"), (6, "the and of that with the")]), model, min_score=0.3).collect()) == [6]


def test_bloom_filter_holds_every_member_and_is_corrected():
    g = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    cells = np.zeros(1 << 14, np.uint8)
    for p in langid._positions(g, len(cells), 3):
        np.bitwise_or.at(cells, p.astype(np.int64), np.uint8(2))
    model = langid.LanguageFilters(("a", "b"), cells, np.array([0.0, np.count_nonzero(cells) / len(cells)]), 4, 3)
    assert (langid.lookup(model, g) == 2).all()
    other = langid.lookup(model, np.arange(10 ** 6, 10 ** 6 + 20_000, dtype=np.uint64))
    assert abs((other == 2).mean() - model.fill[1] ** 3) < 0.02


def test_long_text_in_blocks_equals_whole():
    text = " ".join(random.Random(2).choice(WORDS) for _ in range(120_000))
    whole = np.concatenate([g for g, _ in langid.ngrams([text, "ab cd"], 4)])
    cp = langid._letters_only(text)
    assert len(whole) == len(cp) - 3 + len(langid._letters_only("ab cd")) - 3


# ---- toxicity

def test_toxicity_counterfactuals_lower_the_gap(frame):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        ws = [rng.choice(WORDS) for _ in range(20)] + (["scum"] if toxic else [])
        if rng.random() < (0.7 if toxic else 0.02):
            ws.append("muslims")  # a biased sample
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs, lab = docs_of(frame, rows, CLASH), frame(labels, "id long, y int")
    neutral = docs_of(frame, [(i, f"{' '.join(rng.choice(WORDS) for _ in range(20))} muslims") for i in range(40)])
    gap = []
    for weight in (0.0, 20.0):
        model = toxicity.train(docs, lab, pair_weight=weight)
        gap.append(np.mean([r.score for r in toxicity.score(neutral, model).collect()]))
        got = toxicity.score(docs, model).toPandas().merge(lab.toPandas(), left_on="doc_id", right_on="id")
        assert (got.predicted == got.y).mean() > 0.95
    assert gap[1] < 0.8 * gap[0]
    edge = toxicity.score(docs_of(frame, edge_pairs()), model).collect()
    assert len(edge) == len(edge_pairs()) and all(0 <= r.score <= 1 for r in edge)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = E.queries()["op2_toxicity"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3
    assert (held.predicted == held.toxic).mean() > 0.9


# ---- mixing

def test_mixing_meets_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.mix(docs, mixing.domain_labels(labels), mixing.TARGETS).toPandas()
    p = np.stack(got.posteriors)
    total = (got.rate * got.n_tokens).to_numpy() @ p
    want = np.array([mixing.TARGETS[d] for d in got.domains[0]]) * got.n_tokens.sum()
    assert (got.rate >= 0).all() and np.abs(total - want).sum() < 0.01 * want.sum()
    assert (np.abs(got.copies - got.rate) < 1).all()


def test_projected_gradient_with_active_bounds(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 50, 400)
    members = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_words long, p array<double>").repartition(5)
    goal = np.array([0.85, 0.15, 0.0])
    path = mixing.fit_rates(members, goal)
    r = mixing.rates(p, path)
    # brute force: the same problem by many small projected steps
    A, G = (p * t[:, None]).T, np.linalg.inv((p * t[:, None]).T @ p)
    x, b = np.ones(400), goal * t.sum()
    for _ in range(3000):
        x = np.maximum(0, x - 0.5 * p @ (G @ (A @ x - b)))
    f = lambda v: (A @ v - b) @ G @ (A @ v - b)
    assert (r == 0).any() and f(r) <= 1.05 * f(x) + 1e-6


# ---- secrets, chat, HTML, WARC

def test_secret_forest(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = secrets.dictionary(docs, "text")
    made = secrets.findings_from(docs, "doc_id", "text", "source", 200)
    rows = made.toPandas()
    assert set(rows.label) == {0, 1}
    model = secrets.train(made.where("pmod(xxhash64(cand, before), 5) <> 0"), words, trees=20)
    texts = {1: 'set token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and pay 4785380592391139 now', 2: None, 3: "", 4: "see commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff for more",
             5: "ab12 " + "x" * 50_000 + "1"}
    got = secrets.scan(docs_of(frame, list(texts.items()), CLASH), model, words).collect()
    assert all(texts[r.doc_id][r.start:r.end] == r.candidate for r in got)
    assert {(r.doc_id, r.nth): r.is_secret for r in got if r.doc_id != 5} == {(1, 0): True, (1, 1): False, (4, 0): False}
    from pyspark.ml.feature import VectorAssembler

    held = secrets.with_features(made.where("pmod(xxhash64(cand, before), 5) = 0"), words)
    held = model.transform(VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(held)).select("label", "prediction").toPandas()
    assert (held.label == held.prediction).mean() > 0.9


def test_chat_rotation_parts_and_masks(frame):
    turns = [(1, i, ["ann", "bob", "system", None][i % 4], f"words {i}") for i in range(150)] + [(1, 3, None, "words 3"), (2, 0, "ann", None), (None, None, "bob", "adrift"), (3, 0, "system", "x"),
                                                                                      (2, None, "o b!", ""), (2, 1, "o b!", "<é>")]
    df = frame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, part long, conv string")
    got = chat_format.rotate(df, span=32).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (2, "o b!"), (None, "bob")}
    for me in ("ann", "bob", "unknown"):
        parts = sorted((r for r in got if r.conv_id == 1 and r.perspective == me), key=lambda r: r.part)
        whole, spans = "", []
        for r in parts:
            assert r.char_start == len(whole)
            spans += [r.text[m.start:m.end] for m in r.mask]
            whole += r.text
        want = "".join(f"<|im_start|>{'system' if w == 'system' else 'assistant' if (w or 'unknown') == me else 'user name=' + (w or 'unknown')}\n{t}<|im_end|>\n" for _, _, w, t in turns[:150])
        assert whole == want
        assert spans == [f"{t}<|im_end|>\n" for _, _, w, t in turns[:150] if (w or "unknown") == me]


def test_html_extraction(spark, frame):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pairs = html_crf.labelled_pages(pages, "page_id", "html", 50, 500)
    model = html_crf.train(pairs)
    rng, lines, phrases = random.Random(123), ["A sentence of the story, long enough to count as one, number %d." % i for i in range(50)], ["Short words %d" % i for i in range(30)]
    cases = [html_crf.compose(rng, lines, phrases) for _ in range(100)]
    odd = [(900, None), (901, ""), (902, "<p"), (903, "<article><p>a &amp; b&nbsp; c</article><script>x"), (904, "<div>" * 3000 + "deep"), (905, "<a " * 2000), (906, "plain")]
    df = frame([(i, "u", h, 0) for i, (h, _) in enumerate(cases)] + [(i, None, h, 0) for i, h in odd], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_crf.extract(df, model).collect()}
    assert sum(got[i].text == "\n\n".join(main) for i, (_, main) in enumerate(cases)) >= 90
    assert got[903].text in ("a & b c", "") and got[900].text == got[901].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    ours = {r.page_id: r.text for r in html_crf.extract(pages, model).collect()}
    for r in pages.collect():
        blocks = html_crf.blocks(r.html)
        assert ours[r.page_id] == "\n\n".join(b.text for b, y in zip(blocks, html_crf.label_by_markup(blocks)) if y)


def test_viterbi_is_the_best_labelling():
    model = html_crf.Crf({"bias": 0.3, "t:p": 0.8, "t:li": -1.1, "first": 0.4, "closed": 0.2}, ((0.5, -0.7), (-0.2, 0.9)), -0.6)
    page = [html_crf.Block("x. " * n, t, frozenset(), 0) for n, t in ((1, "p"), (3, "li"), (2, "p"), (5, "li"), (1, "li"), (4, "p"))]
    u = model.scores(page, {})

    def total(ys):
        return (model.first if ys[0] else 0) + sum(x for x, y in zip(u, ys) if y) + sum(model.step[a][b] for a, b in zip(ys, ys[1:]))

    assert tuple(model.decode(page, {})) == max(itertools.product((0, 1), repeat=6), key=total)


def test_packages_round_trip(spark, frame, tmp_path):
    big = "<p>" + "é" * 300_000 + "</p>"
    same = "<html>" + "s" * 120
    rows = [(i, f"http://x/{i}\r\nx", same) for i in range(5, 40)] + [(1, None, None), (2, "u", ""), (3, "u", "short"), (4, "u", "short"), (50, "u", big), (51, "u", big), (None, "u", same), (60, "u", same), (60, "u", same)]
    pages = frame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, digest int, key string").repartition(3)
    folder = str(tmp_path / "packages")
    warc_zip.package_pages(pages, folder, package_bytes=2000)
    got = warc_zip.read_packages(spark, folder, records_per_stretch=3).collect()
    assert len(got) == len(rows)
    first = {same: 5, big: 50}
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h) if h in first and i != first[h] else None
        want[("-" if i is None else str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", str(refers) if refers else None)] += 1
    assert collections.Counter((r.key, r.payload_bytes, r.digest, r.kind, r.refers) for r in got) == want
    assert {r.payload.decode() for r in got if r.kind == "response"} >= {same, big, "short", ""}
    one = next(p for p in (tmp_path / "packages").iterdir() if p.name.startswith("part-"))
    assert zipfile.ZipFile(one).testzip() is None


def test_reads_zip64_and_misleading_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"stored bytes")
        z.writestr("other", b"more")
        z.comment = b"x PK\x05\x06 " + b"y" * 30
    data = out.getvalue()
    read = lambda a, n: data[a:a + n]
    inside = warc_zip.members(len(data), read)
    m = inside["wide"]
    at = warc_zip.stored_at(m, read)
    assert data[at:at + m.size] == b"stored bytes" and set(inside) == {"wide", "other"}
    # the same archive with ZIP64 end records
    place = warc_zip._directory_place(len(data), read)
    import struct

    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 2, 2, place[1], place[0])
    body = data[:place[0] + place[1]]
    wide = body + end64 + struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body), 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    again = warc_zip.members(len(wide), lambda a, n: wide[a:a + n])
    assert again == inside
    with zipfile.ZipFile(io.BytesIO(wide)) as z:
        assert z.namelist() == ["wide", "other"]


# ---- pipeline

def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["language", "exact", "near", "benchmark", "mix"]
    at = docs
    for name, stage in P.STAGES:
        before = at.collect()
        out = P.materialise(stage(spark, at, SF), f"test-{name}")
        got = {r.doc_id for r in out.collect()}
        assert out.count() == len(got) and got <= {r.doc_id for r in before}
        if name == "exact":
            best = {}
            for r in before:
                best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
            assert got == set(best.values())
        if name == "near":
            fps = collections.defaultdict(list)
            for r in before:
                fps[brute_fingerprint(r.text)].append(r.doc_id)
            keep, todo = set(), set(fps)
            while todo:
                group, grow = set(), [todo.pop()]
                while grow:
                    f = grow.pop()
                    group.add(f)
                    near = {g for g in todo if (f ^ g).bit_count() <= 2}
                    todo -= near
                    grow += near
                keep.add(min(i for f in group for i in fps[f]))
            assert got == keep
        if name == "benchmark":
            auto, _ = decontaminate.build_automaton([(str(i), t.encode()) for i, t in enumerate(items)])
            windows = {w for t in items for w in decontaminate._windows(decontaminate.words_of(t.encode()), 10)}

            def clean(t):
                line = f" {' '.join(w.decode() for w in decontaminate.words_of((t or '').encode()))} "
                return not any(f" {w.decode()} " in line for w in windows)

            assert got == {r.doc_id for r in before if clean(r.text)}
        if name != "mix":
            assert out.columns == docs.columns
        else:
            assert out.columns == [*docs.columns, "rate", "copies"] and len(got) > 0.7 * len(before)
        at = out
    assert textmodel.softmax(np.zeros((1, 2))).sum() == 1
