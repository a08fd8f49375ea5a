"""Positions, average ranks and Kendall's tau against numpy and pandas, over blocks of few rows."""

import math

import numpy as np
import pandas as pd

from knnhard.operators import ranks as RK


def _pairs_tau(x, y):
    i, j = np.triu_indices(len(x), 1)
    s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    den = math.sqrt(np.abs(np.sign(x[i] - x[j])).sum() * np.abs(np.sign(y[i] - y[j])).sum())
    return s.sum() / den if den else None


def test_earlier_larger_counts_by_weight():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 8, 9, 100):
        v, w = rng.permutation(n), rng.integers(1, 5, n).astype(float)
        want = [w[:j][v[:j] > v[j]].sum() for j in range(n)]
        assert list(RK.earlier_larger(v, w)) == want


def test_positions_follow_the_order(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(a), i) for i, a in enumerate(rng.integers(0, 50, 1000))], "a int, i int").repartition(7)
    got = RK.positions(df, ["a", "i"], "p").toPandas().sort_values(["a", "i"])
    assert list(got.p) == list(range(1000))
    assert RK.positions(df.where("a < 0"), ["a"], "p").count() == 0


def test_kendall_over_many_blocks(spark):
    """Groups of one block and of many, a null key, a third of all rows the same point, a constant column, negative zero."""
    rng = np.random.default_rng(3)
    rows = [("big", float(a), float(b), float(c)) for a, b, c in rng.integers(0, 40, (400, 3))]
    rows += [("big", 7.0, 7.0, 7.0)] * 250
    rows += [(None, float(a), float(-a + b), 1.0) for a, b in rng.integers(0, 9, (60, 2))]
    rows += [("few", 0.0, 1.0, 2.0), ("few", -0.0, 2.0, 1.0), ("few", 1.0, 3.0, None), ("few", float("inf"), 0.0, 0.0)]
    rows += [("none", None, 1.0, float("nan"))] * 5
    df = spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(5)
    pairs = [("a", "b"), ("a", "c"), ("c", "b")]
    pdf = pd.DataFrame(rows, columns=["g", "a", "b", "c"]).astype({"a": float, "b": float, "c": float})
    for block in (4, 37, 1 << 18):
        got = {(r.g, r.x, r.y): r.tau for r in RK.kendall(df, ["g"], pairs, block=block).collect()}
        assert len(got) == 4 * 3
        for (g, x, y), tau in got.items():
            sub = pdf[pdf.g.isna() if g is None else pdf.g == g]
            sub = sub[np.isfinite(sub[x]) & np.isfinite(sub[y])]
            want = _pairs_tau(sub[x].to_numpy(), sub[y].to_numpy()) if len(sub) > 1 else None
            assert (tau is None) == (want is None) and (tau is None or abs(tau - want) < 1e-12), (block, g, x, y)
    assert RK.kendall(df.where("a = 99"), ["g"], pairs).count() == 0
    assert RK.kendall(df, [], pairs, block=50).count() == 3


def test_average_ranks_and_spearman(spark):
    rng = np.random.default_rng(4)
    rows = [(["u", "v", None][i % 3], i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (300, 2)))]
    rows += [("u", 1000 + i, 5.0, float(i % 4)) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double").repartition(6)
    pdf = pd.DataFrame(rows, columns=["g", "i", "a", "b"])
    want = pdf.assign(r=pdf.groupby("g", dropna=False).a.rank(method="average")).set_index("i").r
    got = RK.average_ranks(df, ["g"], "a", "r").toPandas().set_index("i").r
    assert len(got) == len(want) and (got.sort_index() == want.sort_index()).all()
    rho = {r.g: r.rho for r in RK.spearman(df, ["g"], ["a", "b"]).collect()}
    for g, sub in pdf.groupby("g", dropna=False):
        key = None if g is None or g != g else g
        assert abs(rho[key] - sub.a.rank().corr(sub.b.rank())) < 1e-12
