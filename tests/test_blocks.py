"""Query tables that meet the vectors block by block give the rows of the broadcast scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnhard.operators import distance as D
from knnhard.operators import hardness as H
from knnhard.operators import scan
from knnhard.plans import fixtures as fx
from conftest import SF


@pytest.fixture
def small_blocks(monkeypatch):
    """Nothing may be broadcast, blocks are a few dozen rows."""
    def use():
        monkeypatch.setattr(scan, "MAX_QUERY_BYTES", -1)
        monkeypatch.setattr(scan, "_QUERY_BLOCK", 200 * 64 * 8)
        monkeypatch.setattr(scan, "_VECTOR_BLOCK", 180 * 64 * 8)
        monkeypatch.setattr(scan, "collect_queries", None)
    return use


def rows(df):
    out = [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()]
    return sorted(out, key=repr)


def test_same_rows(spark, small_blocks):
    v, q = fx.vectors(spark, SF), fx.queries(spark, SF)

    def every():
        near = q.join(v.withColumnRenamed("id", "qid"), "qid").withColumn("r", F.lit(1.2))
        thr = near.withColumn("thr", F.array(F.lit(1.0), F.lit(1.3)))
        g = scan.gradient_partials(v, q, m=3, exclude_self=True).select("qid", "n", F.expr("transform(top, t -> t.id)"))
        return [rows(D.knn(v, q, 5, exclude_self=True)), rows(D.knn(v, q, 5, "angular")), rows(D.range_join(v, near, "r")),
                rows(scan.within_counts(v, thr)), rows(scan.within_counts(v.withColumn("c", F.col("id") % 3), thr, cell_col="c")),
                rows(H.ground_truth(v, q, maxk=20).select("qid", "topk", "hist_counts")), rows(g)]

    one = every()
    small_blocks()
    for a, b in zip(one, every()):
        assert a == b
    assert rows(D.knn_batched(v, q, 5, exclude_self=True, batch_size=60)) == one[0]


def test_empty_sides(spark, small_blocks):
    v, q = fx.vectors(spark, SF), fx.queries(spark, SF)
    small_blocks()
    assert D.knn(v, q.where("qid < 0"), 3).count() == 0
    assert D.knn(v.where("id < 0"), q, 3).count() == 0
    assert D.range_join(v.where("id < 0"), q.withColumn("r", F.lit(1.0)), "r").count() == 0


def test_few_files_are_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(scan, "merge_profiles", lambda parts, m, salts: parts)
    monkeypatch.setattr(scan, "_DEAL_QUERIES", 10, raising=False)
    parts = scan.profile(fx.vectors(spark, SF), fx.queries(spark, SF), m=3)
    assert parts.select("pid").distinct().count() == spark.sparkContext.defaultParallelism


def test_batches_do_not_repeat_the_vectors(spark, monkeypatch):
    blocks, numbers = [], scan._numbers
    monkeypatch.setattr(scan, "_numbers", lambda n: blocks.append(n) or numbers(n))
    v, q = fx.vectors(spark, SF), fx.queries(spark, SF)
    D.knn_batched(v, q, 5, batch_size=10)
    assert blocks and max(blocks) <= 2 * spark.sparkContext.defaultParallelism


def test_gradient_bound_counts_what_a_task_holds(spark, monkeypatch):
    asked = {}

    def meet(vectors, queries, body, schema, **how):
        asked.update(how)
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(scan, "_meet", meet)
    scan.gradient_partials(fx.vectors(spark, SF), fx.queries(spark, SF), m=11)
    assert asked["row_bytes"](64) >= 2 * 11 * (64 + 2) * 8 + 64 * 8  # the lists twice while they grow, and the gradient


def test_many_queries_are_paired_by_the_scan(spark, monkeypatch):
    v, q = fx.vectors(spark, SF), fx.queries(spark, SF).where("qid < 40")
    joined = [rows(D.pair_distances(v, q, m, exclude_self=True)) for m in ("euclidean", "angular")]
    monkeypatch.setattr(scan, "_DEAL_QUERIES", 10)
    many = D.pair_distances(v, q, "euclidean", exclude_self=True)
    assert "MapInArrow" in many._jdf.queryExecution().executedPlan().toString()
    assert [rows(many), rows(D.pair_distances(v, q, "angular", exclude_self=True))] == joined
    holes = v.withColumn("v", F.when(F.col("id") == 3, F.lit(None)).otherwise(F.col("v")))
    assert D.pair_distances(holes, q, exclude_self=True).where("d IS NULL").count() == 39


def test_counts_of_copies_and_odd_thresholds(spark):
    """copies at the threshold, a point that is no number, thresholds that are none, negative and infinite."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 8))
    X[20:40] = X[3]
    X[59, 0] = np.nan
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    d = np.array([[np.sqrt(sum((b - a) ** 2 for a, b in zip(p, q))) for q in X] for p in X])
    thr = [[0.0, float(d[i, 7]), None if i == 2 else 1e9, -1.0, float("inf")] for i in range(60)]
    q = spark.createDataFrame([(i, x.tolist(), t) for (i, x), t in zip(enumerate(X), thr)], "qid long, qv array<double>, thr array<double>")
    got = {(r.qid, r.j): r.cnt for r in scan.within_counts(v, q, exclude_self=True).collect()}
    parts = scan.within_counts(v.withColumn("c", F.col("id") % 3), q, exclude_self=True, cell_col="c").collect()
    cells = {(r.qid, r.j, r.cell): r.cnt for r in parts}
    for i, ts in enumerate(thr):
        for j, t in enumerate(ts):
            in_ = [p for p in range(60) if p != i and t is not None and d[i, p] <= t]
            assert got[i, j] == len(in_)
            for c in range(3):
                assert cells.get((i, j, c), 0) == sum(p % 3 == c for p in in_)


def test_long_lists_are_not_broadcast(spark):
    """ground truth joins lists of up to 10,000 distances a query, whatever Spark guesses of their size."""
    g = H.ground_truth(fx.vectors(spark, SF), fx.queries(spark, SF), maxk=20)
    joins = [x for x in g._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftOuter" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_nearest_lists_with_copies_holes_and_short_tiles(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(scan, "_TILE", 16)
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 4)).round(1)
    x[20:45] = x[7]  # 26 copies
    x[50, 1], x[51, 2] = np.nan, np.inf
    v = spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(1)
    q = v.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    for metric in ("euclidean", "angular"):
        for m in (5, 80):
            for own in (True, False):
                want = scan.profile(v, q, metric, m, own).select("qid", F.expr("transform(top, t -> t.id)").alias("i"), F.expr("transform(top, t -> t.d)").alias("d"))
                got = scan.nearest_lists(v, q, metric, m, own).select("qid", F.expr("transform(top, t -> t.id)").alias("i"), F.expr("transform(top, t -> t.d)").alias("d"))
                assert rows(got) == rows(want), (metric, m, own)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {(a, b) for a, b, _ in scan.pairs_within(v, q.withColumn("thr", F.lit(1.0)), exclude_self=True).collect()}
    assert got == {(a, b) for a in range(60) for b in range(60) if a != b and near[a, b] <= 1.0}
    assert scan.pairs_within(v, q.withColumn("thr", F.lit(-1.0))).count() == 0
