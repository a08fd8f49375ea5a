"""Hardness measures.

Index convention is the reference's: distances ascending, 0-based index
``k`` (``d[k]`` is the (k+1)-th smallest distance). All measures are array
expressions over one per-query profile produced by the bulk scan, so a
measure never ranks all ``n`` distances of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import scan
from knnhard.session import keep

EPSILONS = (0.05, 0.1, 0.5, 1.0)
HIST_BINS = 1000


def eps_name(e: float) -> str:
    return "eps_" + (f"{e:g}".replace(".", "_"))


def dk(i) -> Column:
    """``d[i]`` (0-based) of the profile's top list, NULL when out of range."""
    i = (F.lit(i) if not isinstance(i, Column) else i).cast("int")
    return F.when(i < F.size("top"), F.element_at("top", i + 1).getField("d"))


def lid_expr(k: int) -> Column:
    """Maximum-likelihood LID: ``-cnt / sum(ln(d/w))`` over d[0..k] > 1e-5,
    ``w = d[min(n-1, k)]``; NULL when the sum is 0 (reference divides by 0)."""
    w = dk(F.least(F.col("n") - 1, F.lit(k)))
    head = F.filter(F.transform(F.slice("top", 1, k + 1), lambda t: t.getField("d")), lambda x: x > F.lit(1e-5))
    s = F.aggregate(head, F.lit(0.0), lambda acc, x: acc + F.log(x / w))
    return F.when(s != 0, -F.size(head) / s)


def rc_expr(k: int) -> Column:
    return vec.ratio(F.col("sum_d") / F.col("n"), dk(k))


def expansion_expr(k: int) -> Column:
    return vec.ratio(dk(2 * k), dk(k))


def query_profile(vectors, queries, k: int, metric="euclidean", exclude_self=False, m: int | None = None):
    return scan.profile(vectors, queries, metric, m=m or (2 * k + 1), exclude_self=exclude_self)


def measures(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "euclidean",
             exclude_self: bool = False) -> DataFrame:
    """``(qid, lid, rc, expansion)`` in linear scale."""
    p = query_profile(vectors, queries, k, metric, exclude_self)
    return p.select("qid", lid_expr(k).alias("lid"), rc_expr(k).alias("rc"), expansion_expr(k).alias("expansion"))


def log_measures(vectors, queries, k=10, metric="euclidean", exclude_self=False,
                 names=("lid", "loglid", "rc", "logrc", "expansion", "logexpansion")) -> DataFrame:
    """Measure dispatch with linear/log scale: long form ``(qid, measure, value)``."""
    base = measures(vectors, queries, k, metric, exclude_self)
    cols = []
    for nme in names:
        raw = nme[3:] if nme.startswith("log") else nme
        c = F.col(raw)
        cols.append(F.struct(F.lit(nme).alias("measure"), (F.log(c) if nme.startswith("log") else c).alias("value")))
    return base.select("qid", F.explode(F.array(*cols)).alias("m")).select("qid", "m.measure", "m.value")


def score_rc(rc: Column) -> Column:
    """Score transform ``-ln(RC)``: higher = harder."""
    return -F.log(rc)


def eps_hardness(vectors: DataFrame, queries: DataFrame, eps=EPSILONS, k: int = 1, metric="euclidean",
                 exclude_self=False, profile: DataFrame | None = None) -> DataFrame:
    """Share of points with ``d <= (1+eps) * d[k-1]``: long form ``(qid, eps, eps_hardness)``.

    Two passes: the threshold is known only after the profile pass.
    """
    p = profile if profile is not None else keep(query_profile(vectors, queries, k, metric, exclude_self, m=k))
    thr = p.select("qid", "n", F.array(*[F.lit(1.0 + e) * dk(k - 1) for e in eps]).alias("thr"))
    qthr = queries.join(thr, "qid")
    cnt = scan.within_counts(vectors, qthr, "thr", metric, exclude_self)
    eps_arr = F.array(*[F.lit(float(e)) for e in eps])
    return (cnt.join(thr.select("qid", "n"), "qid")
            .select("qid", F.element_at(eps_arr, F.col("j") + 1).alias("eps"),
                    (F.col("cnt") / F.col("n")).alias("eps_hardness")))


def eps_calibrate(vectors, queries, metric="euclidean", exclude_self=False,
                  quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """Mean over queries of ``d_max/d_min - 1`` times fixed quantiles."""
    p = scan.profile(vectors, queries, metric, m=1, exclude_self=exclude_self)
    mean = p.agg(F.avg(vec.ratio(F.col("max_d"), F.col("min_d")) - 1).alias("mean_max_eps"))
    qs = F.array(*[F.lit(float(x)) for x in quantiles])
    return mean.select("mean_max_eps", F.explode(qs).alias("quantile")).select(
        "quantile", (F.col("mean_max_eps") * F.col("quantile")).alias("eps"))


def diameter(vectors: DataFrame, metric="euclidean", first_id: int | None = None) -> DataFrame:
    """Diameter estimate: 2 x the largest distance from the first row."""
    if first_id is None:
        first_id = vectors.agg(F.min("id")).first()[0]
    q = vectors.where(F.col("id") == first_id).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    p = scan.profile(vectors, q, metric, m=1)
    return p.select((F.lit(2.0) * F.col("max_d")).alias("diameter"))


def ground_truth(vectors: DataFrame, queries: DataFrame, maxk: int = 10000, metric="euclidean",
                 exclude_self=False, bins: int = HIST_BINS) -> DataFrame:
    """Per query: ``topk`` distances (ascending, ``least(n, maxk)`` of them),
    ``avg_d`` and an equal-width ``bins``-bin histogram between min and max
    (last bin closed) (D9).

    Three scans, none shipping ``maxk`` candidates per task: (1) count, sum,
    min, max; (2) the histogram as dense per-task count vectors; (3) the
    distances below the upper edge of the bin where the cumulative count reaches
    ``maxk`` (a threshold that is certain to include the ``maxk`` nearest),
    gathered where the query is.
    """
    p = scan.profile(vectors, queries, metric, m=1, exclude_self=exclude_self)
    p = p.select("qid", "n", (F.col("sum_d") / F.col("n")).alias("avg_d"), "min_d", "max_d")
    rng = keep(p.select("qid", "n", "avg_d",
                        F.when(F.col("max_d") > F.col("min_d"), F.col("min_d")).otherwise(F.col("min_d") - 0.5).alias("lo"),
                        F.when(F.col("max_d") > F.col("min_d"), F.col("max_d")).otherwise(F.col("max_d") + 0.5).alias("hi")))
    hist = scan.histogram(vectors, queries.join(rng.select("qid", "lo", "hi"), "qid"), bins, metric, exclude_self)
    need = F.least(F.col("n"), F.lit(maxk))
    zero = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(0).alias("i"), F.lit(0).alias("first"))

    def reach(acc: Column, c: Column) -> Column:
        cum, i = acc["cum"] + c, acc["i"] + 1
        return F.struct(cum.alias("cum"), i.alias("i"),
                        F.when((acc["first"] == 0) & (cum >= need), i).otherwise(acc["first"]).alias("first"))

    first = F.aggregate("counts", zero, reach, lambda acc: acc["first"])  # 1-based bin reaching maxk
    thr = F.when(first >= bins, F.col("hi")).otherwise(F.col("lo") + first * (F.col("hi") - F.col("lo")) / F.lit(bins))
    h = keep(rng.join(hist, "qid").select("qid", "lo", "hi", "avg_d", F.col("counts").alias("hist_counts"),
                                          (thr * (1 + 1e-9) + 1e-12).alias("thr")))
    # the histogram's columns pass through the scan that gathers the lists: a join would sort and shuffle lists of maxk distances
    # (every histogram has its query; the hint keeps histograms, small as Spark may guess them, from being broadcast)
    asked = h.join(queries.select("qid", "qv").hint("merge"), "qid", "left")
    out = scan.with_distances_within(vectors, asked, maxk, metric, exclude_self)
    return out.select(
        "qid", "topk", "avg_d", "hist_counts",
        F.transform(F.sequence(F.lit(0), F.lit(bins)),
                    lambda i: F.when(i == bins, F.col("hi")).otherwise(
                        F.col("lo") + i * (F.col("hi") - F.col("lo")) / F.lit(bins))).alias("hist_edges"))


def count_within(gt: DataFrame, threshold: Column) -> Column:
    """Points within ``threshold`` from the histogram: sum of counts[0..pos]
    with ``pos`` = number of edges < threshold (includes one extra bin; the
    reference's upper bound) (D10)."""
    pos = F.size(F.filter("hist_edges", lambda e: e < threshold))
    return F.aggregate(F.slice("hist_counts", 1, pos + 1), F.lit(0).cast("long"), lambda a, x: a + x)


def metric_table(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "euclidean",
                 exclude_self: bool = False, eps=EPSILONS, eps_k: int = 1, distcomp: DataFrame | None = None,
                 consts: dict | None = None, profile: DataFrame | None = None) -> DataFrame:
    """One row per query: LID, RC, expansion, [distcomp], eps-hardness.

    ``distcomp``: optional ``(qid, distcomp)`` (e.g. ``ivf.ivf_hardness``).
    ``consts``: constant columns (dataset, workload description ...). ``profile``: that of ``query_profile`` with at least
    ``2 k + 1`` and ``eps_k`` neighbours, if the caller has it.
    """
    m = max(2 * k + 1, eps_k)
    # q rows, read by both branches below
    p = profile if profile is not None else keep(query_profile(vectors, queries, k, metric, exclude_self, m=m))
    base = p.select("qid", F.lit(k).alias("k"), lid_expr(k).alias("lid"), rc_expr(k).alias("rc"),
                    expansion_expr(k).alias("expansion"))
    eh = eps_hardness(vectors, queries, eps, eps_k, metric, exclude_self, profile=p)
    wide = eh.groupBy("qid").pivot("eps", [float(e) for e in eps]).agg(F.first("eps_hardness"))
    wide = wide.select("qid", *[F.col(f"`{float(e)}`").alias(eps_name(e)) for e in eps])
    out = base.join(wide, "qid")
    if distcomp is not None:
        out = out.join(distcomp, "qid", "left")
    for kk, vv in (consts or {}).items():
        out = out.withColumn(kk, F.lit(vv))
    return out


def hardness_grid(points: DataFrame, steps: int = 500, k: int = 1, padding: float = 1.0) -> DataFrame:
    """RC (index ``k-1``) on a regular ``steps x steps`` grid over 2-D points.

    ``points(id, v)`` with 2-D ``v``. Grid bounds are the data bounds +/- padding.
    """
    b = points.agg(F.min(F.element_at("v", 1)).alias("x0"), F.max(F.element_at("v", 1)).alias("x1"),
                   F.min(F.element_at("v", 2)).alias("y0"), F.max(F.element_at("v", 2)).alias("y1")).first()
    x0, x1 = b["x0"] - padding, b["x1"] + padding
    y0, y1 = b["y0"] - padding, b["y1"] + padding
    spark = points.sparkSession
    seq = spark.range(steps).select(F.col("id").alias("i"))
    gx = seq.select("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("j"))
    gx = gx.select((F.col("i") * steps + F.col("j")).alias("qid"), "i", "j",
                   F.array((F.lit(x0) + F.col("i") * F.lit((x1 - x0) / (steps - 1))).cast("double"),
                           (F.lit(y0) + F.col("j") * F.lit((y1 - y0) / (steps - 1))).cast("double")).alias("qv"))
    p = scan.profile(points, gx.select("qid", "qv"), "euclidean", m=k)
    return (p.select("qid", rc_expr(k - 1).alias("rc"))
            .join(gx.select("qid", "i", "j", F.element_at("qv", 1).alias("x"), F.element_at("qv", 2).alias("y")), "qid")
            .select("i", "j", "x", "y", "rc"))


def average_rc(vectors: DataFrame, k: int = 10, sample_size: int = 100, seed: int = 1234,
               metric: str = "euclidean") -> DataFrame:
    """Average RC of a dataset (D7): ``sample_size`` rows drawn with
    replacement (B9), held out of the data (B10), RC with index ``k`` of
    each draw, draws with ``d[k] <= 0`` skipped, mean."""
    from knnhard.operators import vectors as vops

    draws = vops.sample_with(vectors, sample_size, seed)
    q = draws.select(F.col("draw").alias("qid"), F.col("v").alias("qv"))
    if metric == "ip":
        q = q.select("qid", vec.zero_last("qv").alias("qv"))
    data = vops.holdout(vectors, draws.select("id"))
    p = scan.profile(data, q, metric, m=k + 1)
    rc = p.select(((F.col("sum_d") / F.col("n")) / dk(k)).alias("rc"), dk(k).alias("dk"))
    return rc.where(F.col("dk") > 0).agg(F.avg("rc").alias("avg_rc"), F.count(F.lit(1)).alias("n_used"))
