"""Searches inside a task: the same points as step by step, without a job for each step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from knnhard.functions import rand
from knnhard.operators import chains, ivf
from knnhard.operators import generate as G
from knnhard.plans import fixtures as fx
from knnhard.session import keep


def test_draws_are_those_of_the_columns(spark):
    got = spark.range(3).select(rand.uniform(7, "s", F.concat_ws(":", "id", F.lit("4")), 2).alias("u"), rand.normal_vec(7, "s", F.col("id"), F.lit(5)).alias("n")).collect()
    for i, r in enumerate(got):
        assert r["u"] == chains.uniform(7, "s", f"{i}:4", 2)
        assert np.allclose(r["n"], chains.normal_vec(7, "s", str(i), 5), rtol=1e-12, atol=1e-14)


@pytest.mark.parametrize("metric", ["euclidean", "angular", "ip"])
def test_neighbours_are_those_of_the_columns(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "qid long, qv array<double>")
    got = np.array([r["qv"] for r in G.perturb(df, metric, 0.1, 3, 6).orderBy("qid").collect()])
    assert np.allclose(got, chains.perturb(range(4), x, metric, 0.1, 3, 6), atol=1e-10)


def _both(monkeypatch, run):
    fast = run()
    with monkeypatch.context() as m:
        m.setattr(chains, "points", lambda *a: None)
        return fast, run()


def _same(a, b, cols):
    a, b = (sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) for df in (a, b))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or np.allclose(p, q, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "angular"])
@pytest.mark.parametrize("by_index", [False, True])
def test_searches_in_a_task_equal_those_step_by_step(spark, monkeypatch, metric, by_index):
    v = keep(fx.vectors(spark, SF).where("id < 300"))
    starts = keep(G.start_points(v, 3, 9).select("qid", "qv"))
    score = G.index_score(v, ivf.build_index(v, 12, 2, metric=metric), 5, metric) if by_index else None
    low, high = (0.15, 0.3) if by_index else (1.2, 1.25)
    fast, slow = _both(monkeypatch, lambda: G.gradient_search(v, starts, 5, low, high, 0.05, 4, metric, score_fn=score, keep_trajectory=True))
    _same(fast[0], slow[0], ("qid", "qv", "rc", "score", "reached", "iterations"))
    _same(fast[1], slow[1], ("qid", "iteration", "rc", "score", "qv"))
    low, high = (0.15, 0.3) if by_index else (-0.3, -0.25)
    fast, slow = _both(monkeypatch, lambda: G.anneal_search(v, starts, 5, low, high, 0.2, 6, metric=metric, score_fn=score))
    _same(fast[0], slow[0], ("qid", "qv", "rc", "score", "reached", "best_score"))
    _same(fast[1], slow[1], ("qid", "iteration", "rc", "score"))


def test_many_steps_are_no_jobs(spark):
    """A search that never reaches its interval: the number of Spark jobs does not grow with the steps."""
    v = keep(fx.vectors(spark, SF))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "annealing")
    final, _ = G.anneal_search(v, G.start_points(v, 2, 3), 5, 8.0, 9.0, 0.3, max_steps=300)
    assert final.count() == 2
    assert len(tracker.getJobIdsForGroup("chain")) < 60
    spark.sparkContext.setJobGroup("", "")
