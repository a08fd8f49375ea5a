"""Pruned search against brute force where bounds equal distances, and the walk over root groups."""

import numpy as np
import pytest

from knnhard.operators import sax


def series_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def search(spark, rows, queries, k, w, leaf, **more):
    summary = sax.summarise(series_of(spark, rows), w).checkpoint()
    leaves = sax.build_leaves(summary, w, leaf)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid long, qv array<double>")
    ans, counters = sax.sax_search(summary, leaves, q, k, w, **more)
    got = {}
    for r in sorted(ans.collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["id"])
    return got, {r["qid"]: r for r in counters.collect()}


def brute(rows, queries, k, exclude_self=False):
    out = {}
    for qid, q in enumerate(queries):
        d = [(float(np.sqrt(((np.asarray(v, float) - np.asarray(q, float)) ** 2).sum())), i) for i, v in enumerate(rows)
             if not (exclude_self and i == qid)]
        out[qid] = [i for _, i in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("sign", [1, -1])
def test_ties_at_the_bound(spark, sign):
    """Piecewise constant series: the bound of a bucket is the distance itself, and equal ones go to the smaller id."""
    rows = [[0] * 8, [sign] * 8, [-sign] * 8]
    got, _ = search(spark, rows[1:], [[0] * 8], 1, 2, 1)
    assert got == {0: [0]}
    got, _ = search(spark, rows, rows, 1, 2, 1, exclude_self=True)
    assert got == brute(rows, rows, 1, True)


@pytest.mark.parametrize("tight", [True, False])
@pytest.mark.parametrize("leaf", [1, 3])
def test_piecewise_constant_series(spark, tight, leaf):
    rng = np.random.default_rng(7)
    rows = [np.repeat(rng.integers(-2, 3, 4), 4) for _ in range(60)]
    rows += rows[:10]
    got, counters = search(spark, rows, rows, 4, 4, leaf, exclude_self=True, tight=tight)
    assert got == brute(rows, rows, 4, True)
    assert all(4 <= c["n_dist"] <= len(rows) - 1 for c in counters.values())


def test_rounding_of_a_bound_loses_no_neighbour(spark):
    """Values whose segment means are not exact, each with its copy: the best so far is 0."""
    rng = np.random.default_rng(8)
    rows = list(np.repeat(rng.standard_normal((20, 3)) * 1e6 / 3, 5, axis=1))
    got, _ = search(spark, rows + rows, rows, 2, 3, 1)
    assert got == {i: [i, i + 20] for i in range(20)}


def test_search_without_bounds_and_more_neighbours_than_series(spark):
    rng = np.random.default_rng(9)
    rows = list(rng.standard_normal((12, 8)))
    for lower in (True, False):
        got, counters = search(spark, rows, rows[:3], 20, 4, 2, lower_bounding=lower)
        assert got == brute(rows, rows[:3], 20)
        assert {c["n_dist"] for c in counters.values()} == {12}


def test_no_pair_of_a_query_and_a_series_is_a_row(spark):
    """Noise, of which bounds prune little: the answers come from written lists, not from a join of queries and series."""
    rng = np.random.default_rng(10)
    rows = list(rng.standard_normal((150, 16)))
    summary = sax.summarise(series_of(spark, rows), 4).checkpoint()
    leaves = sax.build_leaves(summary, 4, 20)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "qid long, qv array<double>")
    ans, counters = sax.sax_search(summary, leaves, q, 3, 4, exclude_self=True)
    assert "Join" not in ans._jdf.queryExecution().optimizedPlan().toString()
    want, got = brute(rows, rows, 3, True), {}
    for r in sorted(ans.collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want
    assert all(3 <= c["n_dist"] <= 149 and c["n_buckets"] >= 1 for c in counters.collect())


def test_wide_words_are_refused(spark):
    with pytest.raises(ValueError, match="at most"):
        search(spark, [[0.0] * 34], [[0.0] * 34], 1, 17, 1)


def test_symbols_are_the_number_of_breakpoints_not_above(spark):
    bp = sax.fixed_breakpoints()
    values = [float("-inf"), *bp, *[b + 1e-12 for b in bp], *[b - 1e-12 for b in bp], 0.0, 9.0, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, [x, x]) for i, x in enumerate(values)], "id long, paa array<double>")
    got = {r["id"]: r["s"] for r in df.select("id", sax.sax_expr("paa", sax.breakpoints_fixed(2)).alias("s")).collect()}
    for i, x in enumerate(values):
        want = 0 if x is None else len(bp) if x != x else sum(b <= x for b in bp)
        assert got[i] == [want, want]
