"""Bucket splits beyond the last bit of a segment, and bounds and budgets of all pairs by blocks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from knnhard.operators import sax


@pytest.fixture
def ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    yield
    spark.conf.set("spark.sql.ansi.enabled", "false")


@pytest.mark.parametrize("policy", ["next_bit", "distribution"])
def test_buckets_split_after_a_segment_has_all_its_bits(spark, ansi, policy):
    """Series that differ in one segment only: it takes all its bits while the bucket is still over-full."""
    rows = [(i, [0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(30 + i, [1.0 + i / 500, 1.0 + i / 500, 0.0, 0.0]) for i in range(30)]
    s = sax.summarise(spark.createDataFrame(rows, "id long, v array<double>"), 2)
    got = {r["id"]: tuple(r["bits"]) for r in sax.build_leaves(s, 2, 3, policy).collect()}
    assert sorted(got) == list(range(60))
    assert {got[i] for i in range(30)} == {(8, 8)}  # copies: no bucket can part them
    assert max(np.unique([got[i] for i in range(30, 60)], axis=0)[:, 0]) > 1


def _series(spark, n, w=4):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 3 * w)).cumsum(1)
    x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    x[5] = x[6] = x[7]  # copies: equal bounds go by id
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)]
    rows.append((n, [None] * 3 + rows[0][1][3:]))  # a segment without a value has no gap
    rows.append((None, rows[1][1]))
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_bounds_and_budget_of_all_pairs_are_no_joined_rows(spark):
    w, n = 4, 60
    s = sax.summarise(_series(spark, n, w), w).checkpoint()
    q = s.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    lens, bps = sax.segment_lengths(3 * w, w), sax.breakpoints_fixed(w)
    every = s.crossJoin(q.select("qid", sax.paa_expr("qv", w).alias("qpaa")))
    full = F.array_repeat(F.lit(sax.CARD_BITS), w)
    want = every.select("qid", "id", F.sqrt(sax.cell_lb_expr(F.col("qpaa"), full, F.col("sax"), lens, bps)).alias("lb")).checkpoint()
    assert sorted(map(tuple, sax.series_lower_bounds(s, q, w, lens).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    met = sax.series_lower_bounds(s, q, w, lens, exclude_self=True)
    assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, want.where("qid <> id").collect()))
    for m in (3, 200):
        order = Window.partitionBy("qid").orderBy("lb", "id")
        least = want.where("qid <> id").withColumn("o", F.row_number().over(order)).where(F.col("o") <= m).select("qid", "id")
        got = sax.least_bounds(s, q, w, lens, bps, m, exclude_self=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, least.collect()))
