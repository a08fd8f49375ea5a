"""Workload generation.

Queries of a chosen hardness are produced by batch-synchronous searches. Where
all vectors fit into every task, a task takes its queries through all their
steps (``chains``); else
every step is ONE Spark pass over the vector table for all queries of the
batch (per-query partial aggregates come back), so a step costs one scan
however many queries are searched. The state of a search (points, moments,
scores) is a table of its own: a step joins it with what the scan found and
writes it as the next part, which also cuts the lineage between steps.

Randomness is hash-derived (``knnhard.functions.rand``): a step is a pure
function of (seed, query, step), so re-executed tasks and other engines
draw the same numbers.
"""

from __future__ import annotations

import json
import math
import time

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knnhard.functions import rand, vec
from knnhard.operators import chains, scan
from knnhard.operators import hardness as H
from knnhard.operators import vectors as vops
from knnhard.session import keep, scratch

# Target-RC factors per class, (r - 1) * factor + 1
CLASS_FACTORS = {
    "angular": {"easy": 1.5, "medium": 1.0, "hard": 0.5, "hard+": 0.25},
    "other": {"easy": 1 / 2, "medium": 1 / 10, "hard": 1 / 100, "hard+": 1 / 500},
}
# Named noise scales as a fraction of the diameter estimate
NOISE_LEVELS = {"easy": 1e-5, "medium": 1e-4, "hard": 1e-3}
ADAM_B1, ADAM_B2, ADAM_EPS = chains.ADAM_B1, chains.ADAM_B2, chains.ADAM_EPS


# ------------------------------------------------------------- noise

def _finish(x: Column, metric: str) -> Column:
    if metric == "angular":
        return vec.normalise(x)
    if metric == "ip":
        return vec.zero_last(x)
    return x


def noise_queries(vectors: DataFrame, q: int, scale: float, seed: int = 1234, metric: str = "euclidean") -> DataFrame:
    """Gaussian-noise queries (G1): q rows sampled without replacement plus
    N(0, scale) per coordinate (stream seed ``int(seed * scale)``)."""
    s = int(seed * scale)
    base = vops.sample_without(vectors, q, seed)
    noise = rand.normal_vec(s, "noise", F.col("id"), F.size("v"))
    x = F.zip_with(vec.dvec("v"), noise, lambda a, e: a + F.lit(float(scale)) * e)
    return base.select(F.col("id").alias("qid"), _finish(x, metric).alias("qv"))


def noise_scaled(vectors: DataFrame, q: int, level: str, seed: int = 1234, metric: str = "euclidean") -> DataFrame:
    """Named scales easy/medium/hard = diameter x 1e-5/1e-4/1e-3."""
    d = H.diameter(vectors, metric).first()["diameter"]
    return noise_queries(vectors, q, d * NOISE_LEVELS[level], seed, metric)


def noise_series(series: DataFrame, q: int, level: float, seed: int = 1234) -> DataFrame:
    """Series noise (G3): draws with replacement, noise x level, z-normalised."""
    draws = vops.sample_with(series, q, seed)
    noise = rand.normal_vec(seed, "snoise", F.col("draw"), F.size("v"))
    x = F.zip_with(vec.dvec("v"), noise, lambda a, e: a + F.lit(float(level)) * e)
    return draws.select(F.col("draw").alias("qid"), F.col("id").alias("source"), vec.znorm(x).alias("qv"))


# ----------------------------------------------------- perturbations

def _direction(seed, stream, key, dim) -> Column:
    return vec.normalise(rand.normal_vec(seed, stream, key, dim))


def perturb(df: DataFrame, metric: str, scale: float, seed: int, step=0, col: str = "qv") -> DataFrame:
    """One neighbour of every query.

    Euclidean: random unit direction x Exp(scale); ip: the same with the
    last coordinate reset; angular: a random direction orthogonal to x (by
    projection, Q5) scaled by ``tan(arccos(d))`` with ``d = 1 - Beta(a, 1)``,
    ``a = scale / (1 - scale)``, then renormalised, so that ``x . y = d``.
    """
    key = F.concat_ws(":", F.col("qid").cast("string"), F.lit(step).cast("string") if not isinstance(step, Column) else step.cast("string"))
    x = vec.dvec(col)
    dim = F.size(x)
    if metric in ("euclidean", "ip"):
        u = rand.uniform(seed, "amount", key, 0)
        amount = -F.lit(float(scale)) * F.log(u)
        y = vec.let(amount, lambda am: F.zip_with(x, _direction(seed, "dir", key, dim), lambda a, b: a + am * b))
        return df.withColumn(col, vec.zero_last(y) if metric == "ip" else y)
    if metric == "angular":
        a = scale / (1.0 - scale)
        beta = F.pow(rand.uniform(seed, "beta", key, 0), F.lit(1.0 / a))
        t = F.tan(F.acos(F.lit(1.0) - beta))

        def move(xv, r):
            proj = vec.vsum(F.zip_with(xv, r, lambda p, e: p * e))
            ortho = vec.normalise(F.zip_with(r, xv, lambda e, p: e - proj * p))
            return vec.let(ortho, lambda o: vec.normalise(F.zip_with(xv, o, lambda p, oo: p + t * oo)))
        y = vec.let(x, lambda xv: vec.let(rand.normal_vec(seed, "dir", key, dim), lambda r: move(xv, r)))
        return df.withColumn(col, y)
    raise ValueError(metric)


# ----------------------------------------------------------- targets

def target_interval(avg_rc: float, metric: str, target_class: str, width: float = 0.05) -> tuple[float, float]:
    f = CLASS_FACTORS["angular" if metric == "angular" else "other"][target_class]
    t = (avg_rc - 1.0) * f + 1.0
    return t - width * t, t + width * t


def target_table(avg_rc_df: DataFrame, metric: str, width: float = 0.05) -> DataFrame:
    """Target RC interval per class from the dataset's average RC."""
    fac = CLASS_FACTORS["angular" if metric == "angular" else "other"]
    cls = F.array(*[F.struct(F.lit(c).alias("target_class"), F.lit(v).alias("f")) for c, v in fac.items()])
    t = avg_rc_df.select("avg_rc", F.explode(cls).alias("c")).select(
        "avg_rc", "c.target_class", ((F.col("avg_rc") - 1) * F.col("c.f") + 1).alias("target_rc"))
    return t.select("target_class", "target_rc", (F.col("target_rc") * (1 - width)).alias("target_low"),
                    (F.col("target_rc") * (1 + width)).alias("target_high"))


# ------------------------------------------------------------ scoring

def rc_scores(vectors: DataFrame, cands: DataFrame, k: int, metric: str = "euclidean",
              exclude_self: bool = False) -> DataFrame:
    """RC (index k) and score ``-ln RC`` of candidate queries ``(qid, qv)`` (D2 + D12)."""
    p = scan.profile(vectors, cands, metric, m=k + 1, exclude_self=exclude_self)
    rc = (F.col("sum_d") / F.col("n")) / H.dk(k)
    return p.select("qid", rc.alias("rc"), H.score_rc(rc).alias("score"))


def rc_gradient(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean",
                exclude_self: bool = False) -> DataFrame:
    """RC and its gradient w.r.t. the query (G9), closed form from one scan:
    ``grad = mean'/d_k - mean * d_k'/d_k^2`` with ``mean' = g/n`` and
    ``d_k' = (x - p_k)/d_k`` (angular: ``-p_k``)."""
    p = scan.gradient_partials(vectors, queries, metric, m=k + 1, exclude_self=exclude_self)
    p = p.join(queries.select("qid", vec.dvec("qv").alias("x")), "qid")
    kth = F.element_at("top", k + 1)
    dkc, pk = kth.getField("d"), kth.getField("v")
    mean = F.col("sum_d") / F.col("n")
    if metric == "angular":
        ddk = F.transform(pk, lambda a: -a)
    else:
        ddk = F.zip_with("x", pk, lambda a, b: (a - b) / dkc)
    grad = F.zip_with(F.col("g"), ddk, lambda gi, di: (gi / F.col("n")) / dkc - mean * di / (dkc * dkc))
    if metric == "ip":
        grad = vec.zero_last(grad)
    return p.select("qid", (mean / dkc).alias("rc"), grad.alias("grad"))


# -------------------------------------------------------- single steps

def adam_update(x, g, m, v, t, lr):
    """One Adam step (numpy, q x dim): returns new x, m, v."""
    m = ADAM_B1 * m + (1 - ADAM_B1) * g
    v = ADAM_B2 * v + (1 - ADAM_B2) * g * g
    mh = m / (1 - ADAM_B1 ** t)
    vh = v / (1 - ADAM_B2 ** t)
    return x - lr * mh / (np.sqrt(vh) + ADAM_EPS), m, v


def direction_expr(x: Column, grad: Column, score: Column, high: float, metric: str, steer_by_score: bool = False) -> Column:
    """Tangent projection (angular) and sign rule of the reference: descend
    RC unless the score is below the interval (then ascend); for an
    empirical score the rule is reversed (G10/G12)."""
    flip = score > high if steer_by_score else score < high
    sign = F.when(flip, F.lit(-1.0)).otherwise(F.lit(1.0))
    if metric != "angular":
        return vec.let(sign, lambda s: F.transform(grad, lambda g: s * g))

    def tangent(g: Column) -> Column:
        return vec.let(vec.dot(g, x), lambda along: F.zip_with(g, x, lambda a, b: a - along * b))

    def scaled(t: Column) -> Column:
        return vec.let(F.sqrt(F.aggregate(t, F.lit(0.0), lambda acc, a: acc + a * a)), lambda n: F.transform(
            t, lambda a: sign * (a / F.when(n > 0, n).otherwise(F.lit(1.0)))))

    return vec.let(tangent(grad), scaled)


def adam_columns(state: DataFrame, t: int, lr: float, metric: str) -> DataFrame:
    """One Adam step of every row of ``state(x, m, v, d)`` along the direction ``d``: new ``x``, ``m``, ``v``.

    Element by element in the order of ``adam_update``."""
    c1, c2 = 1 - ADAM_B1 ** t, 1 - ADAM_B2 ** t
    moved = state.withColumn("m", F.zip_with("m", "d", lambda m, g: F.lit(ADAM_B1) * m + F.lit(1 - ADAM_B1) * g)).withColumn(
        "v", F.zip_with("v", "d", lambda v, g: F.lit(ADAM_B2) * v + F.lit(1 - ADAM_B2) * g * g))
    step = F.zip_with("m", "v", lambda m, v: F.lit(lr) * (m / F.lit(c1)) / (F.sqrt(v / F.lit(c2)) + F.lit(ADAM_EPS)))
    moved = moved.withColumn("x", F.zip_with("x", step, lambda x, s: x - s))
    return moved.withColumn("x", _post_col("x", metric))


def _zeros(like: str) -> Column:
    return F.transform(like, lambda _: F.lit(0.0))


def gradient_step(vectors: DataFrame, state: DataFrame, k: int, low: float, high: float, lr: float,
                  metric: str = "euclidean", exclude_self: bool = False) -> DataFrame:
    """One Adam step from a fresh optimiser state for every query (G10):
    ``(qid, rc, in_target, qv)`` where ``qv`` is the moved query (unchanged
    when already inside the interval)."""
    g = rc_gradient(vectors, state, k, metric, exclude_self).join(state.select("qid", vec.dvec("qv").alias("x")), "qid")
    g = g.withColumn("in_target", (F.col("rc") >= low) & (F.col("rc") <= high)).withColumn("start", F.col("x"))
    g = g.withColumns({"m": _zeros("x"), "v": _zeros("x"), "d": direction_expr(F.col("x"), F.col("grad"), F.col("rc"), high, metric)})
    moved = adam_columns(g, 1, lr, metric)
    return moved.select("qid", "rc", "in_target", F.when(F.col("in_target"), F.col("start")).otherwise(F.col("x")).alias("qv"))


def anneal_accept(y: Column, y_next: Column, low: float, high: float, temp: Column, u: Column) -> Column:
    """Annealing acceptance (G5): 'target' if the candidate is inside the
    interval, 'closer' if it is at least as close to the interval bounds,
    'metropolis' if ``u < exp(-|y - y'| / t)``, else 'reject'."""
    dist_next = F.least(F.abs(y_next - F.lit(low)), F.abs(y_next - F.lit(high)))
    dist_cur = F.least(F.abs(y - F.lit(low)), F.abs(y - F.lit(high)))
    p = F.exp(-F.abs(y - y_next) / temp)
    return (F.when((y_next >= low) & (y_next <= high), F.lit("target"))
            .when(dist_next <= dist_cur, F.lit("closer"))
            .when(u < p, F.lit("metropolis")).otherwise(F.lit("reject")))


def temperature(t1: float, step) -> Column:
    """Fast annealing schedule ``t1 / (step + 1)``."""
    return F.lit(float(t1)) / (F.lit(step) + 1) if not isinstance(step, Column) else F.lit(float(t1)) / (step + 1)


def anneal_step(vectors: DataFrame, state: DataFrame, k: int, low: float, high: float, scale: float, step: int,
                seed: int = 1234, t1: float = 1.0, metric: str = "euclidean", exclude_self: bool = False,
                score_fn=None) -> DataFrame:
    """One annealing step for every query of the batch (G5):
    ``state(qid, qv, y)`` with ``y = -ln RC`` (or the score of ``score_fn``) -> ``(qid, y, y_next, decision, qv_next)``."""
    # written once: the state may be a scan of its own, and the candidates are counted, sent and joined
    cand = keep(perturb(state.select("qid", "qv", "y"), metric, scale, seed, step))
    scored = rc_scores(vectors, cand.select("qid", "qv"), k, metric, exclude_self) if score_fn is None else score_fn(cand.select("qid", "qv"))
    sc = scored.select("qid", F.col("score").alias("y_next"))
    u = rand.uniform(seed, "metropolis", F.concat_ws(":", F.col("qid").cast("string"), F.lit(str(step))), 0)
    j = cand.select("qid", "y", F.col("qv").alias("qv_next")).join(sc, "qid")
    return j.select("qid", "y", "y_next", anneal_accept(F.col("y"), F.col("y_next"), low, high,
                                                        temperature(t1, step), u).alias("decision"), "qv_next")


# -------------------------------------------------------------- loops

def gradient_search(vectors: DataFrame, starts: DataFrame, k: int, low: float, high: float, lr: float = 1.0,
                    max_iter: int = 200, metric: str = "euclidean", seed: int = 1234, score_fn=None,
                    start_noise: float = 1e-3, exclude_self: bool = False, keep_trajectory: bool = False):
    """Adam search of queries with RC (or ``score_fn``) inside [low, high].

    ``starts(qid, qv)``: start points (a data row; N(0, start_noise) is
    added by hash normals). Returns ``(final, trace)``: final
    ``(qid, qv, rc, score, reached, iterations)`` and the trace rows
    ``(iteration, rc, score, elapsed_s, qid[, qv])``.

    The queries and their moments are a table: an iteration is one scan of the vectors for the queries not yet inside, joined
    with their state and written as the next part of one table, which cuts the lineage. Queries inside the interval
    stay behind in the part of their iteration, so the parts together are both the trace and the result.
    """
    spark = vectors.sparkSession
    s0 = starts.select("qid", F.zip_with(vec.dvec("qv"), rand.normal_vec(seed, "start", F.col("qid"), F.size("qv")),
                                         lambda a, e: a + F.lit(start_noise) * e).alias("x"))
    s0 = s0.select("qid", _post_col("x", metric).alias("x"))
    live = keep(s0.withColumns({"m": _zeros("x"), "v": _zeros("x")}))
    sent = chains.points(vectors, live, k, metric, exclude_self, score_fn)
    if sent is not None:
        return _gradient_result(chains.descend(live, sent, low, high, lr, max_iter, metric, score_fn is not None), max_iter - 1, keep_trajectory)
    root = scratch(spark)
    t0 = time.time()
    last = -1
    for it in range(max_iter):
        cur = live.select("qid", F.col("x").alias("qv"))
        g = rc_gradient(vectors, cur, k, metric, exclude_self).select("qid", "rc", "grad")
        g = g.withColumn("score", F.col("rc")) if score_fn is None else g.join(score_fn(cur).select("qid", "score"), "qid")
        seen = live.join(g, "qid").withColumn("inside", F.coalesce((F.col("score") >= low) & (F.col("score") <= high), F.lit(False)))
        seen = seen.withColumn("elapsed_s", F.lit(time.time() - t0))
        seen.write.parquet(f"{root}/iteration={it}")
        last = it
        seen = spark.read.schema(seen.schema).parquet(f"{root}/iteration={it}").where("NOT inside")
        if it == max_iter - 1 or seen.isEmpty():
            break
        d = direction_expr(F.col("x"), F.col("grad"), F.col("score"), high, metric, steer_by_score=score_fn is not None)
        live = adam_columns(seen.select("qid", "x", "m", "v", d.alias("d")), it + 1, lr, metric).select("qid", "x", "m", "v")
    kind = live.schema["qid"].dataType.simpleString()
    shape = f"qid {kind}, x array<double>, rc double, score double, inside boolean, elapsed_s double, iteration long"
    return _gradient_result(spark.read.schema(shape).parquet(root) if last >= 0 else spark.createDataFrame([], shape), last, keep_trajectory)


def _gradient_result(parts: DataFrame, last: int, keep_trajectory: bool) -> tuple[DataFrame, DataFrame]:
    final = parts.where(F.col("inside") | (F.col("iteration") == last)).select(
        "qid", F.col("x").alias("qv"), "rc", "score", F.col("inside").alias("reached"), F.col("iteration").alias("iterations"))
    trace = parts.select("iteration", "rc", "score", "elapsed_s", "qid", *([F.col("x").alias("qv")] if keep_trajectory else []))
    return final, trace


def _post_col(c, metric) -> Column:
    if metric == "angular":
        return vec.normalise(c)
    if metric == "ip":
        return vec.zero_last(c)
    return F.col(c)


def anneal_search(vectors: DataFrame, starts: DataFrame, k: int, low: float, high: float, scale: float,
                  max_steps: int = 100, t1: float = 1.0, metric: str = "euclidean", seed: int = 1234,
                  exclude_self: bool = False, score_fn=None):
    """Simulated annealing towards the score interval [low, high] of
    ``-ln RC``, or of ``score_fn(cands) -> (qid, score)`` (G5, G6, G14); ``rc`` is NULL for the latter. Returns ``(final, trace)``; ``reached`` is
    False for queries that did not enter the interval (Q17), ``best_score``
    is kept beside the reference's "last closer" point (Q18)."""
    spark = vectors.sparkSession
    start = keep(starts.select("qid", vec.dvec("qv").alias("x")))

    def result(parts: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
        def rc_of(score: str) -> Column:
            return F.exp(-F.col(score)) if score_fn is None else F.lit(None).cast("double")

        final = parts.where(F.col("reached") | (F.col("iteration") == last)).select(
            "qid", F.col("x").alias("qv"), rc_of("y").alias("rc"), F.col("y").alias("score"), "reached", "best_score")
        trace = parts.where("iteration >= 0").select("iteration", rc_of("from_y").alias("rc"), F.col("from_y").alias("score"), "elapsed_s", "qid")
        return final, trace

    sent = chains.points(vectors, start, k, metric, exclude_self, score_fn)
    if sent is not None:
        return result(chains.anneal(start, sent, low, high, scale, max_steps, t1, metric, seed, score_fn is not None), max_steps - 1)
    cur = start.select("qid", F.col("x").alias("qv"))
    scored = rc_scores(vectors, cur, k, metric, exclude_self) if score_fn is None else score_fn(cur)
    inside = F.coalesce((F.col("y") >= low) & (F.col("y") <= high), F.lit(False))
    state = start.join(scored.select("qid", F.col("score").alias("y")), "qid").select(
        "qid", "x", "y", F.col("x").alias("best_x"), F.col("y").alias("best_y"), F.col("y").alias("best_score"),
        F.lit(0).alias("stale"), inside.alias("reached"), F.lit(None).cast("double").alias("from_y"), F.lit(0.0).alias("elapsed_s"))
    threshold = max(max_steps // 100, 10)
    root = scratch(spark)
    t0 = time.time()
    last = -1

    def written(df: DataFrame, step: int) -> DataFrame:
        """The state after a step, as one part of the table of all steps; what is inside the interval stays behind in it."""
        df.write.parquet(f"{root}/iteration={step}")
        return spark.read.schema(df.schema).parquet(f"{root}/iteration={step}").where("NOT reached")

    def gap(c: str) -> Column:
        return F.least(F.abs(F.col(c) - F.lit(low)), F.abs(F.col(c) - F.lit(high)))

    live = written(state, last)
    for step in range(max_steps):
        if live.isEmpty():
            break
        back = F.col("stale") >= threshold
        now = live.select("qid", F.when(back, F.col("best_x")).otherwise(F.col("x")).alias("x"),
                          F.when(back, F.col("best_y")).otherwise(F.col("y")).alias("y"), "best_x", "best_y", "best_score",
                          F.when(back, 0).otherwise(F.col("stale")).alias("stale"))
        st = now.select("qid", F.col("x").alias("qv"), "y")
        res = anneal_step(vectors, st, k, low, high, scale, step, seed, t1, metric, exclude_self, score_fn)
        j = now.join(res.select("qid", "y_next", "decision", "qv_next"), "qid")
        hit, closer = F.col("decision") == "target", F.col("decision") == "closer"
        moves = F.col("decision") != "reject"
        live = written(j.select(
            "qid", F.when(moves, F.col("qv_next")).otherwise(F.col("x")).alias("x"), F.when(moves, F.col("y_next")).otherwise(F.col("y")).alias("y"),
            F.when(closer, F.col("qv_next")).otherwise(F.col("best_x")).alias("best_x"), F.when(closer, F.col("y_next")).otherwise(F.col("best_y")).alias("best_y"),
            F.when(gap("y_next") < gap("best_score"), F.col("y_next")).otherwise(F.col("best_score")).alias("best_score"),
            F.when(closer, 0).otherwise(F.col("stale") + 1).alias("stale"), hit.alias("reached"), F.col("y").alias("from_y"),
            F.lit(time.time() - t0).alias("elapsed_s")), step)
        last = step
    kind = start.schema["qid"].dataType.simpleString()
    parts = spark.read.schema(f"qid {kind}, x array<double>, y double, best_score double, reached boolean, from_y double, "
                              "elapsed_s double, iteration long").parquet(root)
    return result(parts, last)


def start_points(vectors: DataFrame, q: int, seed: int = 1234) -> DataFrame:
    """Start rows of a search: q draws with replacement from all rows (Q6)."""
    d = vops.sample_with(vectors, q, seed)
    return d.select(F.col("draw").alias("qid"), F.col("v").alias("qv"), F.col("id").alias("source"))


def trace_table(trace: DataFrame, dataset: str, method: str, params: dict, data_limit: int | None = None) -> DataFrame:
    """Convergence-trace rows with the reference's columns."""
    out = trace.select("iteration", "rc", "elapsed_s", F.col("qid").alias("query_index"), F.lit(dataset).alias("dataset"))
    if data_limit is not None:
        out = out.withColumn("data_limit", F.lit(int(data_limit)))
    return out.withColumn("method", F.lit(method)).withColumn("method_params", F.lit(json.dumps(params, sort_keys=True)))


# ------------------------------------------------------------ workloads

def _avg_rc(vectors, k, metric):
    return H.average_rc(vectors, k, metric=metric).first()["avg_rc"]


def gradient_workload(vectors: DataFrame, k: int, target_class: str, q: int, lr: float = 1.0, max_steps: int = 1000,
                      seed: int = 1234, metric: str = "euclidean"):
    """Gradient workload by class (G11): RC interval from the average RC."""
    low, high = target_interval(_avg_rc(vectors, k, metric), metric, target_class)
    return gradient_search(vectors, start_points(vectors, q, seed), k, low, high, lr, max_steps, metric, seed)


def anneal_starts(vectors: DataFrame, q: int, seed: int, first: int = 0) -> DataFrame:
    """Start rows of an annealing round: q different rows, numbered from ``first`` in the order of their digest."""
    picked = vops.sample_without(vectors, q, seed)
    w = Window.orderBy(rand.hash_order(seed, F.col("id")), "id")  # q rows only
    return picked.select((F.row_number().over(w) - 1 + first).cast("long").alias("qid"), F.col("v").alias("qv"))


def anneal_workload(vectors: DataFrame, k: int, target_class: str | None, q: int, max_steps: int = 2000, t1: float = 1.0,
                    seed: int = 1234, metric: str = "euclidean", scale: float | None = None, max_rounds: int | str = 3,
                    score_fn=None, interval: tuple[float, float] | None = None):
    """Annealing workload with rounds (G7, G13): the score interval is ``-ln`` of the class's RC interval, or
    ``interval`` as it stands for a ``score_fn`` (``index_score``). Queries that did not reach it are
    regenerated from new starts; when fewer than half succeed, the scale
    grows (x10, angular +0.1). Failures stay as rows with ``reached=False``. ``max_rounds='return-any'`` is one
    round of which every query is returned."""
    if score_fn is not None:
        if interval is None:
            raise ValueError("a score function needs its interval")
        low, high = interval
    else:
        low_rc, high_rc = interval or target_interval(_avg_rc(vectors, k, metric), metric, target_class)
        low, high = -math.log(high_rc), -math.log(low_rc)
    max_rounds = 1 if max_rounds == "return-any" else max_rounds
    if scale is None:
        scale = 0.1 if metric == "angular" else H.diameter(vectors, metric).first()["diameter"] / 100
    done, trace_all, need = None, None, q
    for rnd in range(max_rounds):
        starts = anneal_starts(vectors, need, seed + rnd, rnd * q)  # ids stay apart over the rounds
        fin, tr = anneal_search(vectors, starts, k, low, high, scale, max_steps, t1, metric, seed + rnd, score_fn=score_fn)
        fin = fin.withColumn("round", F.lit(rnd))
        ok = fin.where("reached")
        done = ok if done is None else done.unionByName(ok)
        trace_all = tr if trace_all is None else trace_all.unionByName(tr)
        got = ok.count()
        need = need - got
        if need <= 0:
            break
        if got < (need + got) / 2:
            scale = scale + 0.1 if metric == "angular" else scale * 10
        if rnd == max_rounds - 1:
            done = done.unionByName(fin.where("NOT reached").limit(need))
    return done, trace_all


def index_score(vectors: DataFrame, index, k: int, metric: str = "euclidean", target_recall: float = 0.95):
    """Score of candidate queries by an index's empirical hardness, ``cands -> (qid, score)`` (G12, G13):
    ``index`` is IVF's ``(centroids, assignment)`` or SAX's ``(summary, leaves, segments)``."""
    from knnhard.operators import ivf, sax

    def by_ivf(cur: DataFrame) -> DataFrame:
        h = ivf.hardness(vectors, cur, index[0], index[1], k, target_recall, metric)
        return h.select("qid", F.col("distcomp").alias("score"))

    def by_sax(cur: DataFrame) -> DataFrame:
        _, counters = sax.sax_search(index[0], index[1], cur, k, index[2])
        return counters.select("qid", F.col("hardness").alias("score"))

    if len(index) != 2:
        return by_sax
    by_ivf.cells = (*index, target_recall)  # for searches inside a task
    return by_ivf


def build_index(vectors: DataFrame, name: str, metric: str = "euclidean", segments: int = 16, leaf_size: int = 2000):
    """The index of a catalogue row for ``index_score``, by its name."""
    from knnhard.operators import ivf, sax

    if name.lower() in ("ivf", "faiss_ivf", "faiss-ivf"):
        return ivf.build_index(vectors, metric=metric)
    if name.lower() in ("sax", "messi"):
        summary = keep(sax.summarise(vectors.select("id", "v"), segments))
        return summary, keep(sax.build_leaves(summary, segments, leaf_size)), segments
    raise ValueError(f"no index {name!r}: ivf and sax are built")


def empirical_workload(vectors: DataFrame, k: int, low: float, high: float, q: int, index, lr: float = 1.0,
                       max_steps: int = 1000, seed: int = 1234, metric: str = "euclidean", target_recall: float = 0.95):
    """Gradient search steered by an index's empirical hardness in [low, high] (G12); ``index`` as in ``index_score``."""
    return gradient_search(vectors, start_points(vectors, q, seed), k, low, high, lr, max_steps, metric, seed,
                           score_fn=index_score(vectors, index, k, metric, target_recall))


def dispatch_workload(vectors: DataFrame, config: dict, metric: str = "euclidean") -> DataFrame:
    """Generate the workload of one catalogue row by its type (G16), with the catalogue's step limits unless
    the row has ``max_steps``. A file-based row names its table of queries by ``queries`` (a frame) or
    ``queries_filename`` (a vector file)."""
    t = config["workload_type"]
    k, q = int(config.get("k", 10)), int(config.get("num_queries", 10))
    if t == "synthetic-gaussian-noise":
        return noise_scaled(vectors, q, config["scale"], metric=metric)
    if t == "synthetic-sgd":
        return gradient_workload(vectors, k, config["target_class"], q, metric=metric, max_steps=config.get("max_steps", 1000))[0]
    if t == "synthetic-simulated-annealing":
        index = config.get("difficulty", "rc")
        by_index = {} if index == "rc" else {"score_fn": index_score(vectors, build_index(vectors, index, metric), k, metric),
                                             "interval": (config["target_low"], config["target_high"])}
        return anneal_workload(vectors, k, config.get("target_class"), q, metric=metric, max_steps=config.get("max_steps", 2000),
                               max_rounds="return-any", **by_index)[0]
    if t == "empirical-difficulty-based":
        index = build_index(vectors, config["index"], metric)
        return empirical_workload(vectors, k, config["target_low"], config["target_high"], q, index, lr=0.01,
                                  max_steps=config.get("max_steps", 1000), metric=metric)[0]
    if t == "file-based":
        if config.get("queries") is not None:
            return config["queries"]
        from knnhard.sources.tables import load_vectors

        return load_vectors(vectors.sparkSession, config["queries_filename"], "test", metric=metric,
                            names=config.get("names"))[0].select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    raise ValueError(f"unknown workload type {t}")


def dispatch_with_truth(vectors: DataFrame, config: dict, metric: str = "euclidean", maxk: int = 10000) -> tuple[DataFrame, DataFrame]:
    """A catalogue row's workload and its ground truth."""
    queries = keep(dispatch_workload(vectors, config, metric))
    return queries, H.ground_truth(vectors, queries.select("qid", "qv"), maxk, metric)
