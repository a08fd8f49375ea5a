"""Search state as tables: Adam steps against numpy, and runs that end as the step-by-step rule says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from knnhard.operators import generate as G
from knnhard.plans import fixtures as fx
from knnhard.session import keep


def direction(x, g, score, high, metric, by_score):
    if metric == "angular":
        g = g - (g * x).sum(1, keepdims=True) * x
        n = np.linalg.norm(g, axis=1, keepdims=True)
        g = g / np.where(n > 0, n, 1.0)
    flip = score > high if by_score else score < high
    return np.where(flip[:, None], -g, g)


@pytest.mark.parametrize("metric", ["euclidean", "angular", "ip"])
@pytest.mark.parametrize("by_score", [False, True])
def test_adam_on_columns_equals_numpy(spark, metric, by_score):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m, v = np.zeros_like(x), np.zeros_like(x)
    as_lists = lambda a: [[float(z) for z in r] for r in a]
    state = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*map(as_lists, (x, m, v))))],
                                  "qid long, x array<double>, m array<double>, v array<double>")
    for t in (1, 2, 3):
        g = rng.standard_normal(x.shape)
        g[0] = 0.0
        score = rng.uniform(1.0, 1.2, len(x))
        more = spark.createDataFrame([(i, r, float(s)) for i, (r, s) in enumerate(zip(as_lists(g), score))], "qid long, grad array<double>, s double")
        d = G.direction_expr(F.col("x"), F.col("grad"), F.col("s"), 1.1, metric, by_score)
        state = G.adam_columns(state.join(more, "qid").withColumn("d", d), t, 0.05, metric).select("qid", "x", "m", "v").checkpoint()
        x, m, v = G.adam_update(x, direction(x, g, score, 1.1, metric, by_score), m, v, t, 0.05)
        if metric == "angular":
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        if metric == "ip":
            x[:, -1] = 0.0
        rows = state.orderBy("qid").collect()
        for name, want in (("x", x), ("m", m), ("v", v)):
            assert np.abs(np.array([r[name] for r in rows]) - want).max() < 1e-12


def test_searches_keep_every_query_once(spark):
    v = fx.vectors(spark, SF)
    starts = G.start_points(v, 6, 3)
    final, trace = G.gradient_search(v, starts, 5, 1.05, 1.12, 0.1, max_iter=4, keep_trajectory=True)
    rows, tr = final.collect(), trace.collect()
    assert sorted(r["qid"] for r in rows) == list(range(6))
    for r in rows:
        mine = sorted((t["iteration"], t["rc"]) for t in tr if t["qid"] == r["qid"])
        assert [i for i, _ in mine] == list(range(r["iterations"] + 1)) and mine[-1][1] == r["rc"]
        assert r["reached"] == (1.05 <= r["rc"] <= 1.12) and (r["reached"] or r["iterations"] == 3)
    final, trace = G.anneal_search(v, starts, 5, -0.12, -0.05, 0.3, max_steps=4)
    rows = final.collect()
    assert sorted(r["qid"] for r in rows) == list(range(6))
    assert all(r["reached"] == (-0.12 <= r["score"] <= -0.05) for r in rows)
    assert trace.where("iteration < 0").count() == 0


def test_searches_without_queries(spark):
    v = fx.vectors(spark, SF)
    none = G.start_points(v, 3, 3).where("qid < 0")
    assert G.gradient_search(v, none, 5, 1.0, 1.1, max_iter=3)[0].count() == 0
    assert G.anneal_search(v, none, 5, 0.0, 0.1, 0.3, max_steps=3)[0].count() == 0


def test_annealing_step_computes_its_state_once(spark):
    v = fx.vectors(spark, SF)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    q = keep(fx.queries(spark, SF).where("qid < 40").withColumn("y", F.lit(-0.2)))
    state = q.mapInArrow(counted, q.schema)
    got = G.anneal_step(v, state, 10, -0.1, -0.05, 0.05, 0, exclude_self=True)
    assert got.select("decision").where("decision IS NOT NULL").collect() and got.count() == q.count()
    assert seen.value == q.count()
