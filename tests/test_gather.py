"""Ground-truth lists: gathered where the query is, no distance is a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnhard.operators import hardness as H
from knnhard.operators import scan
from knnhard.session import keep


def _points(spark, n=150, dim=5):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[20:60] = x[20]
    return x, keep(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>"))


@pytest.mark.parametrize("metric", ["euclidean", "angular"])
@pytest.mark.parametrize("in_blocks", [False, True])
@pytest.mark.parametrize("m", [7, 400])
def test_lists_of_distances(spark, monkeypatch, metric, in_blocks, m):
    x, v = _points(spark)
    if in_blocks:
        monkeypatch.setattr(scan, "MAX_QUERY_BYTES", 100)
        monkeypatch.setattr(scan, "_VECTOR_BLOCK", 2000)
    monkeypatch.setattr(scan, "_TILE", 16)
    monkeypatch.setattr(scan, "_DENSE", 0.3 if m == 7 else 2.0)
    d = scan._fold(x[:, None], x[None], metric)
    thr = np.sort(d, axis=1)[:, 70]
    q = v.select(F.col("id").alias("qid"), F.col("v").alias("qv")).join(
        spark.createDataFrame([(i, float(t), i * 2) for i, t in enumerate(thr)], "qid long, thr double, more long"), "qid")
    got = scan.with_distances_within(v, q, m, metric, exclude_self=True)
    assert got.columns == ["qid", "topk", "more"]
    rows = got.collect()
    assert sorted(r["qid"] for r in rows) == list(range(len(x)))
    for r in rows:
        i = r["qid"]
        mine = np.sort(np.delete(d[i], i))
        assert r["topk"] == list(mine[mine <= thr[i]][:m]) and r["more"] == 2 * i


def test_ground_truth_of_repeated_queries_is_that_of_both(spark):
    _, v = _points(spark, 30)
    q = v.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    twice = q.unionByName(q.where("qid = 3"))
    one, two = ({r["qid"]: r["topk"] for r in H.ground_truth(v, x, 8).collect()} for x in (q, twice))
    assert len(two) == len(one) == 30
    assert two[3] == sorted(one[3] * 2)[:8] and all(two[i] == one[i] for i in one if i != 3)


def test_ground_truth_joins_no_lists(spark):
    """After the histogram the lists are neither rows of a window nor sorted for a join."""
    _, v = _points(spark)
    plan = H.ground_truth(v, v.select(F.col("id").alias("qid"), F.col("v").alias("qv")), 20)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Window" not in plan and "Join" not in above and "Exchange" not in above
