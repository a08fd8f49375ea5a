"""Registered queries D1-D13 (hardness measures)."""

from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import hardness as H
from knnhard.plans import fixtures as fx
from knnhard.plans import sqlgen as S
from knnhard.plans.registry import register
from knnhard.session import scratch
from knnhard.sources import tables as TB

K = 10
_CTE = {"pairs": S.pairs(), "ranked": S.RANKED}


def _vq(spark, sf):
    return fx.vectors(spark, sf), fx.queries(spark, sf)


def _sql(body, extra=None, fixt=("vectors", "queries")):
    ctes = dict(_CTE)
    ctes.update(extra or {})
    return fx.with_fixtures(list(fixt), body, ctes)


LID_SQL = f"""SELECT t.qid, CASE WHEN sum(ln(t.d / w.w)) <> 0 THEN -count(*) / sum(ln(t.d / w.w)) END AS lid
  FROM ranked t JOIN (SELECT qid, d AS w FROM ranked WHERE r = least(n - 1, {K})) w USING (qid)
  WHERE t.r <= {K} AND t.d > 1e-5 GROUP BY t.qid"""
RC_SQL = f"SELECT qid, mean_d / d AS rc FROM ranked WHERE r = {K}"
EXP_SQL = f"""SELECT a.qid, b.d / a.d AS expansion FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.r = {K} AND b.r = {2 * K}"""


@register("lid", _sql(f"SELECT qid, {S.r6('lid')} AS lid FROM lidt", {"lidt": LID_SQL}))
def q_lid(spark, sf):
    m = H.measures(*_vq(spark, sf), k=K, exclude_self=True)
    return m.select("qid", vec.rnd("lid").alias("lid"))


@register("relative_contrast", _sql(f"SELECT qid, {S.r6('rc')} AS rc, {S.r6('-ln(rc)')} AS score FROM rct", {"rct": RC_SQL}))
def q_relative_contrast(spark, sf):
    m = H.measures(*_vq(spark, sf), k=K, exclude_self=True)
    return m.select("qid", vec.rnd("rc").alias("rc"), vec.rnd(H.score_rc(F.col("rc"))).alias("score"))


@register("expansion", _sql(f"SELECT qid, {S.r6('expansion')} AS expansion FROM expt", {"expt": EXP_SQL}))
def q_expansion(spark, sf):
    m = H.measures(*_vq(spark, sf), k=K, exclude_self=True)
    return m.select("qid", vec.rnd("expansion").alias("expansion"))


EPS_SQL = """SELECT p.qid, e.eps, count(*) FILTER (WHERE p.d <= (1 + e.eps) * t.d)::DOUBLE / count(*) AS eps_hardness
  FROM pairs p JOIN (SELECT qid, d FROM ranked WHERE r = 0) t USING (qid)
  CROSS JOIN (SELECT unnest([0.05, 0.1, 0.5, 1.0])::DOUBLE AS eps) e GROUP BY p.qid, e.eps"""


@register("eps_hardness", _sql(f"SELECT qid, eps, {S.r6('eps_hardness')} AS eps_hardness FROM epst", {"epst": EPS_SQL}))
def q_eps_hardness(spark, sf):
    e = H.eps_hardness(*_vq(spark, sf), exclude_self=True)
    return e.select("qid", "eps", vec.rnd("eps_hardness").alias("eps_hardness"))


@register("eps_calibrate", _sql(f"""SELECT qn AS quantile, {S.r6('m * qn')} AS eps FROM
  (SELECT avg(mx / mn - 1) AS m FROM (SELECT qid, max(d) AS mx, min(d) AS mn FROM pairs GROUP BY qid)),
  (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS qn)"""))
def q_eps_calibrate(spark, sf):
    e = H.eps_calibrate(*_vq(spark, sf), exclude_self=True)
    return e.select("quantile", vec.rnd("eps").alias("eps"))


@register("hardness_log", _sql(f"""SELECT qid, measure, {S.r6('value')} AS value FROM (
  SELECT qid, 'lid' AS measure, lid AS value FROM lidt UNION ALL SELECT qid, 'loglid', ln(lid) FROM lidt
  UNION ALL SELECT qid, 'rc', rc FROM rct UNION ALL SELECT qid, 'logrc', ln(rc) FROM rct
  UNION ALL SELECT qid, 'expansion', expansion FROM expt UNION ALL SELECT qid, 'logexpansion', ln(expansion) FROM expt)""",
                                  {"lidt": LID_SQL, "rct": RC_SQL, "expt": EXP_SQL}))
def q_hardness_log(spark, sf):
    m = H.log_measures(*_vq(spark, sf), k=K, exclude_self=True)
    return m.select("qid", "measure", vec.rnd("value").alias("value"))


SEED = 1234
_AVG_RC_SQL = fx.with_fixtures(["vectors"], f"""
SELECT {S.r6('avg(rc)')} AS avg_rc, count(*)::BIGINT AS n_used FROM (
  SELECT draw, mean_d / d AS rc, d FROM (
    SELECT draw, d, r, avg(d) OVER (PARTITION BY draw) AS mean_d FROM (
      SELECT draw, d, row_number() OVER (PARTITION BY draw ORDER BY d, id) - 1 AS r FROM (
        SELECT q.draw, x.id, {S.dist('euclidean', 'q.v', 'x.v')} AS d
        FROM (SELECT dr.draw, v.v FROM draws dr JOIN vectors v USING (id)) q
        JOIN (SELECT * FROM vectors WHERE id NOT IN (SELECT id FROM draws)) x ON TRUE)))
  WHERE r = {K}) WHERE d > 0""", {"draws": f"""SELECT range AS draw, floor({S.uniform(SEED, 'pick', '0', 'range')} * (SELECT max(id) + 1 FROM vectors))::BIGINT AS id FROM range(100)"""})


@register("avg_rc", _AVG_RC_SQL)
def q_avg_rc(spark, sf):
    a = H.average_rc(fx.vectors(spark, sf), k=K, sample_size=100, seed=SEED)
    return a.select(vec.rnd("avg_rc").alias("avg_rc"), F.col("n_used").cast("long"))


@register("diameter", fx.with_fixtures(["vectors"], f"""
SELECT {S.r6('2 * max(' + S.dist('euclidean', 'q.v', 'x.v') + ')')} AS diameter
FROM (SELECT v FROM vectors WHERE id = (SELECT min(id) FROM vectors)) q, vectors x"""))
def q_diameter(spark, sf):
    return H.diameter(fx.vectors(spark, sf)).select(vec.rnd("diameter").alias("diameter"))


GT_BINS = 1000
GT_MAXK = 10_000
_GT_SQL = _sql(f"""
SELECT s.qid, b.range::INT AS bin, coalesce(c.cnt, 0)::BIGINT AS cnt,
  {S.r6(f's.lo + b.range * (s.hi - s.lo) / {GT_BINS}')} AS edge_lo, {S.r6('s.avg_d')} AS avg_d,
  {S.r6('t.d')} AS top_d
FROM stats s CROSS JOIN range({GT_BINS}) b
LEFT JOIN cnts c ON c.qid = s.qid AND c.bin = b.range
LEFT JOIN (SELECT qid, r, d FROM ranked WHERE r < {GT_MAXK}) t ON t.qid = s.qid AND t.r = b.range""", {
    "stats": """SELECT qid, avg(d) AS avg_d, CASE WHEN max(d) > min(d) THEN min(d) ELSE min(d) - 0.5 END AS lo,
                CASE WHEN max(d) > min(d) THEN max(d) ELSE max(d) + 0.5 END AS hi FROM pairs GROUP BY qid""",
    "cnts": f"""SELECT p.qid, least({GT_BINS - 1}, floor((p.d - s.lo) / (s.hi - s.lo) * {GT_BINS}))::BIGINT AS bin, count(*) AS cnt
                FROM pairs p JOIN stats s USING (qid) GROUP BY 1, 2"""})


@register("ground_truth", _GT_SQL)
def q_ground_truth(spark, sf):
    g = H.ground_truth(*_vq(spark, sf), maxk=GT_MAXK, exclude_self=True, bins=GT_BINS)
    ex = g.select("qid", "avg_d", "topk", "hist_edges", F.posexplode("hist_counts").alias("bin", "cnt"))
    return ex.select("qid", F.col("bin").cast("int"), F.col("cnt").cast("long"),
                     vec.rnd(F.element_at("hist_edges", F.col("bin") + 1)).alias("edge_lo"),
                     vec.rnd("avg_d").alias("avg_d"),
                     vec.rnd(F.when(F.col("bin") < F.size("topk"), F.element_at("topk", F.col("bin") + 1))).alias("top_d"))


@register("ground_truth_saved", _GT_SQL[:_GT_SQL.rindex("SELECT s.qid, b.range::INT")] + f"""
SELECT s.qid, t.n::BIGINT AS n_top, {S.r6('t.nearest')} AS nearest, {S.r6('t.farthest')} AS farthest, {S.r6('t.total')} AS top_sum,
  {S.r6('s.avg_d')} AS avg_d, h.n::BIGINT AS n_counted, h.filled::BIGINT AS n_filled, {S.r6('s.lo')} AS edge_lo, {S.r6('s.hi')} AS edge_hi
FROM stats s
JOIN (SELECT qid, count(*) AS n, min(d) AS nearest, max(d) AS farthest, sum(d) AS total FROM ranked WHERE r < {GT_MAXK} GROUP BY qid) t USING (qid)
JOIN (SELECT qid, sum(cnt) AS n, count(*) AS filled FROM cnts GROUP BY qid) h USING (qid)""")
def q_ground_truth_saved(spark, sf):
    """Ground truth written and read back (A10): the whole distance list, the mean and the histogram of every query."""
    path = scratch(spark)
    TB.save_ground_truth(H.ground_truth(*_vq(spark, sf), maxk=GT_MAXK, exclude_self=True, bins=GT_BINS), path)
    g = spark.read.parquet(path)
    return g.select("qid", F.size("topk").cast("long").alias("n_top"), vec.rnd(F.array_min("topk")).alias("nearest"),
                    vec.rnd(F.array_max("topk")).alias("farthest"), vec.rnd(vec.vsum("topk")).alias("top_sum"), vec.rnd("avg_d").alias("avg_d"),
                    vec.vsum(F.transform("hist_counts", lambda c: c.cast("double"))).cast("long").alias("n_counted"),
                    F.size(F.filter("hist_counts", lambda c: c > 0)).cast("long").alias("n_filled"),
                    vec.rnd(F.element_at("hist_edges", 1)).alias("edge_lo"), vec.rnd(F.element_at("hist_edges", -1)).alias("edge_hi"))


_CW_SQL = _GT_SQL.replace(_GT_SQL[_GT_SQL.rindex("SELECT s.qid, b.range::INT"):], f"""
SELECT s.qid, {S.r6('t.d')} AS t, sum(coalesce(c.cnt, 0))::BIGINT AS cnt_within
FROM stats s JOIN (SELECT qid, d FROM ranked WHERE r = {K}) t USING (qid)
CROSS JOIN range({GT_BINS}) b LEFT JOIN cnts c ON c.qid = s.qid AND c.bin = b.range
WHERE b.range <= (SELECT count(*) FROM range({GT_BINS + 1}) e
                  WHERE CASE WHEN e.range = {GT_BINS} THEN s.hi ELSE s.lo + e.range * (s.hi - s.lo) / {GT_BINS} END < t.d)
GROUP BY s.qid, t.d""")


@register("count_within", _CW_SQL)
def q_count_within(spark, sf):
    g = H.ground_truth(*_vq(spark, sf), maxk=GT_MAXK, exclude_self=True, bins=GT_BINS)
    t = F.element_at("topk", K + 1)
    return g.select("qid", vec.rnd(t).alias("t"), H.count_within(g, t).cast("long").alias("cnt_within"))


GRID = 500
PAD = 0.1


@register("hardness_grid", fx.with_fixtures([], f"""
WITH pts AS (SELECT vec_id AS id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS v FROM embeddings),
b AS (SELECT min(v[1]) - {PAD} AS x0, max(v[1]) + {PAD} AS x1, min(v[2]) - {PAD} AS y0, max(v[2]) + {PAD} AS y1 FROM pts),
g AS (SELECT i.range AS i, j.range AS j, b.x0 + i.range * ((b.x1 - b.x0) / {GRID - 1}) AS x,
             b.y0 + j.range * ((b.y1 - b.y0) / {GRID - 1}) AS y FROM b, range({GRID}) i, range({GRID}) j),
d AS (SELECT g.i, g.j, sqrt((g.x - p.v[1]) * (g.x - p.v[1]) + (g.y - p.v[2]) * (g.y - p.v[2])) AS d FROM g, pts p)
SELECT i::BIGINT AS i, j::BIGINT AS j, {S.r6('avg(d) / min(d)')} AS rc FROM d GROUP BY i, j"""))
def q_hardness_grid(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    pts = e.select(F.col("vec_id").alias("id"),
                   F.array(F.element_at("embedding", 1).cast("double"), F.element_at("embedding", 2).cast("double")).alias("v"))
    g = H.hardness_grid(pts, steps=GRID, k=1, padding=PAD)
    return g.select(F.col("i").cast("long"), F.col("j").cast("long"), vec.rnd("rc").alias("rc"))
