"""Tokenizer alignment, conversation repair and embedding near-dedup against brute force."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from knnhard.llm import conversation_repair as repair
from knnhard.llm import hnsw_dedup as hnsw
from knnhard.llm import token_align as align

# ---- alignment


@pytest.fixture(scope="module")
def tok():
    return align.tokenizers_of(f"{align.FOLDER}/byte_bpe_50k.json", f"{align.FOLDER}/piece_bpe_32k.model")


def cut_groups(tok, text):
    """Groups of a text by the offsets at which both sides end."""
    both = tok.both(text)
    if both is None:
        return None
    ends = [set(itertools.accumulate(len(t[i]) for i in ids)) for ids, t in zip(both, (tok.bytes_a, tok.bytes_b))]
    out = []
    at, pos = [0, 0], [0, 0]
    for cut in sorted(ends[0] & ends[1]):
        group = ([], [])
        for side, t in enumerate((tok.bytes_a, tok.bytes_b)):
            while pos[side] < cut:
                i = both[side][at[side]]
                group[side].append(i)
                pos[side] += len(t[i])
                at[side] += 1
        out.append(group)
    return out


def align_brute(tok, texts):
    groups = [cut_groups(tok, t) for t in texts]
    n = collections.Counter()
    for g in groups:
        n.update({p for x, y in g or [] for p in itertools.product(x, y)})
    top = collections.Counter()
    for (a, _), k in n.items():
        top[a] = max(top[a], k)
    out = []
    for g in groups:
        links = [p for x, y in g or [] for p in itertools.product(x, y)]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(links),
                    sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if g else "", text if g else None))
    return out


TEXTS = [None, "", " ", "a", "Hello, world's <|endoftext|> end", "<s> piece </s> ▁ mark", "naïve Ελλάδα \U0001F600\U0001F468‍\U0001F469 \x00\t\r\n  x",
         "the the the the", "the the the the", "　ﬁ ligature", "x" * 5000 + " " + "ab" * 3000, "1234567890 12345 1.5e-7", "\n\n\n   \n"]


@pytest.mark.parametrize("block, slices", [(4_000_000, 16_000_000), (50, 100)])
def test_align(spark, tok, block, slices):
    rnd = random.Random(5)
    letters = "abcdeABC  .,'é中\U0001F600\n12"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400))) for _ in range(60)] + ["hot text"] * 40
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, "hot text", "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a double").repartition(3)
    got = align.align_tokenizers(df, block_bytes=block, slice_bytes=slices).collect()
    want = align_brute(tok, [r[1] for r in rows])
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == [(r[0], *w) for r, w in zip(rows, want)]
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def test_align_empty_table(spark):
    for rows in ([], [(1, None), (None, "")]):
        got = align.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), keep_groups=False).collect()
        assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "", None)] * len(rows)


def test_encoders_agree(tok):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(f"{align.FOLDER}/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    for t in filter(None, TEXTS):
        assert tok.a(" " + t) == plain.encode(" " + t, add_special_tokens=False).ids


def test_long_groups_by_distinct_ids():
    a, b = np.array([1, 2, 1] * 50), np.array([3, 4] * 40)
    doc, pair, n = align._links(a, b, np.zeros(150, "i8"), np.zeros(80, "i8"), np.zeros(150, "i8"), 10)
    assert dict(zip(pair, n)) == {13: 4000, 14: 4000, 23: 2000, 24: 2000} and not doc.any()


def test_packed_numbers_and_hash():
    for x in ([], [0], [5, 0, 255], [1 << 40, 3], list(range(1000))):
        assert align.unpack(align.pack(np.array(x, "i8"))).tolist() == x
    h = align.PairHash(50_257, 32_000, 7)
    pairs = np.random.default_rng(1).integers(0, 50_257 * 32_000, 5000)
    s = h.scramble(pairs)
    assert (h.id_a(s) == pairs // 32_000).all() and np.bincount(h.slice_of(s), minlength=7).min() > 500
    assert (np.diff(h.slice_of(np.sort(s))) >= 0).all()


# ---- repair

def all_edits(rows, entry, leave):
    """Least (cost, audit) of every state, row after row; None if the state cannot be reached."""
    def insert(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to = 3 if state == 2 else 2
                best[to] = min(best.get(to, (10 ** 9, "")), (cost + 5, audit + "I"))
        return best

    best = insert({entry: (0, "")})
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            want = "ua"[state == 2]
            more = 5 if fault == 2 else 0
            ways = [(cost + 2, audit + "D", state)]
            if fault != 1 and (initial == want or initial == "s" and state == 0):
                ways.append((cost + more, audit + "K", "sua".index(initial) + 1))
            if fault != 1 and initial != want:
                ways.append((cost + 1 + more, audit + "R", "sua".index(want) + 1))
            for c, t, to in ways:
                new[to] = min(new.get(to, (10 ** 9, "")), (c, t))
        best = insert(new)
    return best.get(leave)


def test_cheapest_edits():
    rnd = random.Random(1)
    for _ in range(150):
        rows = [(rnd.choice("suauax"), rnd.choice([0, 0, 0, 1, 2])) for _ in range(rnd.randint(1, 5))]
        for entry, leave in itertools.product(range(4), range(4)):
            got = repair.cheapest_edits(rows, entry, leave)
            if got is not None:
                assert got == all_edits(rows, entry, leave), (rows, entry, leave)
            else:
                assert leave < 2


def test_chain_equals_one_search():
    rnd = random.Random(2)
    for _ in range(60):
        rows = [(rnd.choice("suaua"), rnd.choice([0, 0, 0, 0, 1, 2])) for _ in range(rnd.randint(2, 14))]
        whole = min(f for x in (0, 3) if (f := repair.cheapest_edits(rows, 0, x)))
        parts = []
        for s in range(0, len(rows), 4):
            found = [repair.cheapest_edits(rows[s:s + 4], e, x) for e in range(4) for x in range(4)]
            order = {a: i for i, a in enumerate(sorted({f[1] for f in found if f}))}
            parts.append({"costs": [f and f[0] for f in found], "ranks": [f and order[f[1]] for f in found], "audits": [f and f[1] for f in found]})
        cost, path = repair.chain(parts)
        assert (cost, "".join(p["audits"][4 * e + x] for p, (e, x) in zip(parts, path))) == whole


def test_long_searches_stay_short():
    rnd = random.Random(3)
    rows = [(rnd.choice("suaua"), rnd.choice([0, 0, 0, 1, 2])) for _ in range(4096)]
    bounds = repair.suffix_bounds(rows)
    assert max(len(repair.cheapest_edits(rows, 0, x, bounds)[1]) for x in (0, 3)) == 4096


def repair_brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))
    seen, marked = set(), []
    counts = collections.Counter()
    for _, role, text, _ in rows:
        last = text.strip(" \t\n\x0b\f\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role[:1], 0 if not fault else 2 if fault == "truncated" else 1))
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(marked))
    cost, audit = min(f for x in (0, 3) if (f := all_edits(marked, 0, x)))
    state, lines, it = "", [], iter(rows)
    for e in audit:
        want = "assistant" if state == "u" else "user"
        if e == "I":
            lines.append(f"{want}:")
            state = want[0]
            continue
        _, role, text, _ = next(it)
        if e != "D":
            role = want if e == "R" else role
            lines.append(f"{role}:{text}")
            state = role[0]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair(spark):
    rnd = random.Random(4)
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rnd.randint(1, 7)):
            rows.append((conv, rnd.choice([None, turn, turn, turn, turn + 3]), rnd.choice(["user", "assistant", "system", "tool", "", None]),
                         rnd.choice(["Yes.", "No!", "cut", " \t\n", "", None, "é?\r\n", "long " * 3000 + "."]), 1, 2, "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, seg int, conv string")
    report, new = repair.repair(df)
    got = {r["conv"]: tuple(r)[1:] for r in report.join(repair.digests(new), "conv", "left").collect()}
    convs = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        c = "-" if conv is None else f"+{conv}"
        digest = hashlib.sha256("\n".join([str(len(c)), str(len(role)), c, role, text]).encode()).hexdigest()
        convs[c].append((turn, role, text, digest))
    assert set(got) == set(convs)
    none = hashlib.sha256(b"").hexdigest()
    for c, r in convs.items():
        assert (*got[c][:-1], got[c][-1] or none) == repair_brute(r), (c, r)


def test_repair_across_segments(spark, monkeypatch):
    """One conversation with nearly all rows: many segments, of four rows each."""
    monkeypatch.setattr(repair, "_SEGMENT_BITS", 2)
    rnd = random.Random(6)
    rows = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", f"Row {t}.", f"Cut {t}"])) for t in range(40)] + [(8, 0, "user", "Hi.")]
    report, new = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv"]: tuple(r)[1:] for r in report.join(repair.digests(new), "conv", "left").collect()}
    for c in (7, 8):
        want = repair_brute([(t, role, text, hashlib.sha256(f"2\n{len(role)}\n+{c}\n{role}\n{text}".encode()).hexdigest())
                             for conv, t, role, text in rows if conv == c])
        assert (*got[f"+{c}"][:-1], got[f"+{c}"][-1] or hashlib.sha256(b"").hexdigest()) == want


def test_repair_empty_table(spark):
    report, new = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == new.count() == repair.digests(new).count() == 0


# ---- near-duplicate vectors

def exact_links(vecs, min_cos=0.9):
    """(links, component as the smallest position reachable) of every vector, by all pairs."""
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vecs]
    links = [set() for _ in vecs]
    for i, j in itertools.combinations([i for i, g in enumerate(good) if g], 2):
        a, b = np.array(vecs[i], "f8"), np.array(vecs[j], "f8")
        if len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= min_cos:
            links[i].add(j)
            links[j].add(i)
    root = list(range(len(vecs)))
    for i in range(len(vecs)):
        todo, seen = [i], {i}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        root[i] = min(seen)
    return [len(x) for x in links], root


def clusters(rng, dim=24):
    """Single vectors, copies, chains of links, near copies of one vector (a third of all), and ones about the threshold."""
    out = list(rng.standard_normal((150, dim)))
    out += [out[0], out[0] * 3, out[1]]
    for spread, n in ((0.02, 150), (0.08, 60), (0.14, 60)):
        middle = rng.standard_normal(dim)
        middle /= np.linalg.norm(middle)
        out += list(middle + spread * rng.standard_normal((n, dim)))
    step = rng.standard_normal((2, dim))
    out += [math.cos(0.4 * k) * step[0] + math.sin(0.4 * k) * step[1] for k in range(7)]
    return [list(map(float, np.float32(v))) for v in out]


def test_links_and_components(spark):
    rng = np.random.default_rng(11)
    vecs = clusters(rng)
    order = rng.permutation(len(vecs))
    vecs = [vecs[i] for i in order] + [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23, [1.0, 0.0], [0.9, 0.1]]
    rows = [(i + 5, v, 0.5, "x") for i, v in enumerate(vecs)]
    rows += [(rows[3][0], rows[3][1], 0.5, "again"), (None, rows[4][1], 0.5, "no id"), (None, None, 0.5, "neither")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node double, weight string").repartition(5)
    n, root = exact_links([r[1] for r in rows])
    want = [(r[0], k, rows[c][0], r[0] is not None and r[0] == rows[c][0]) for r, k, c in zip(rows, n, root)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for most in (131_072, 60):  # one shard, and many
        got = sorted(map(tuple, hnsw.embedding_dedup(df, max_rows=most).collect()), key=key)
        off = sum(abs(a[1] - b[1]) for a, b in zip(got, sorted(want, key=key)))
        assert off <= 0.005 * sum(n), off
        if off == 0:
            assert got == sorted(want, key=key)
        assert all(a[1] <= b[1] for a, b in zip(got, sorted(want, key=key)))


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [0.0, 0.0])], [(3, [1.0, 2.0])]):
        got = hnsw.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert sorted(map(tuple, got)) == [(r[0], 0, r[0], True) for r in rows]


def test_graph_recall():
    """Neighbours at the linking angle among thousands of unrelated vectors, by the beams and not by the widest one."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.91 * x + math.sqrt(1 - 0.91 ** 2) * side
    make = lambda v, s: hnsw.Shard(hnsw.pack_shard(np.arange(len(v)), np.ones(len(v), "i8"), v, math.cos(math.acos(0.9) / 2), s))
    a, b = make(x, 0), make(near, 1)
    n_a, n_b, pairs = hnsw.link_shards(a, b, 0.9)
    assert (n_a == 1).mean() > 0.97 and (n_a <= 1).all() and len(pairs) == n_a.sum() == n_b.sum()
    ids, _ = hnsw.search(a.graph, a.x, a.x[:-1], 8)
    assert (ids[:, 0] == np.arange(len(a.leader))).mean() > 0.95


def test_audit_widens(monkeypatch):
    """A graph cut into pieces fails its audit, and the widest beam, the shard itself, still finds every link."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    x = np.concatenate([x, x + 0.05 * rng.standard_normal(x.shape)])
    s = hnsw.Shard(hnsw.pack_shard(np.arange(800), np.ones(800, "i8"), x, 0.99, 0))
    s.graph["adj0"][:] = -1
    n, _, _ = hnsw.link_shards(s, s, 0.9)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert (n == (unit @ unit.T >= 0.9).sum(1) - 1).all()
