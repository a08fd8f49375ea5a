"""Registered queries E1-E5, C8 and the metric table with IVF hardness."""

from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import distance as dist
from knnhard.operators import hardness as H
from knnhard.operators import ivf
from knnhard.plans import fixtures as fx
from knnhard.plans import sqlgen as S
from knnhard.plans.q_hardness import EPS_SQL, EXP_SQL, LID_SQL, RC_SQL
from knnhard.plans.registry import register
from knnhard.session import scratch

K = 10
SEED = 1234
ITERS = 2
NPROBE = 2
TARGET = 0.95
DIST_XC = S.dist("euclidean", "x.v", "c.v")
DIST_QC = S.dist("euclidean", "q.qv", "c.v")


def _assign_sql(i):
    return (f"SELECT id, cid FROM (SELECT x.id, c.cid, row_number() OVER (PARTITION BY x.id ORDER BY {DIST_XC}, c.cid) AS rn "
            f"FROM vectors x, c{i} c) WHERE rn = 1")


def ivf_ctes(iters=ITERS):
    ctes = {
        "nl": "SELECT ceil(sqrt(count(*)))::BIGINT AS nl FROM vectors",
        "c0": f"""SELECT cid, v FROM (SELECT (row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', id::VARCHAR)), id) - 1)::BIGINT AS cid,
                 list_transform(v, lambda x: x::DOUBLE) AS v FROM vectors) WHERE cid < (SELECT nl FROM nl)""",
        "elems": "SELECT id, unnest(v)::DOUBLE AS val, generate_subscripts(v, 1) AS pos FROM vectors",
    }
    for i in range(1, iters + 1):
        ctes[f"a{i}"] = _assign_sql(i - 1)
        ctes[f"m{i}"] = f"SELECT a.cid, e.pos, avg(e.val) AS val FROM a{i} a JOIN elems e USING (id) GROUP BY a.cid, e.pos"
        ctes[f"c{i}"] = (f"SELECT cid, list(val ORDER BY pos) AS v FROM m{i} GROUP BY cid "
                         f"UNION ALL SELECT cid, v FROM c{i - 1} WHERE cid NOT IN (SELECT cid FROM a{i})")
    ctes["cf"] = f"SELECT * FROM c{iters}"
    ctes["af"] = f"SELECT x.id, c.cid, d FROM (SELECT x.id, c.cid, {DIST_XC} AS d, row_number() OVER (PARTITION BY x.id ORDER BY {DIST_XC}, c.cid) AS rn FROM vectors x, cf c) WHERE rn = 1".replace(
        "SELECT x.id, c.cid, d FROM", "SELECT id, cid, d FROM")
    return ctes


def sweep_ctes(k=K, sfx=""):
    c = ivf_ctes()
    c.update({
        "pairs": S.pairs(), "ranked": S.RANKED,
        "sizes": "SELECT cid, count(*) AS size FROM af GROUP BY cid",
        "own": "SELECT id AS qid, cid AS own FROM af",
        "po": f"SELECT q.qid, c.cid, row_number() OVER (PARTITION BY q.qid ORDER BY {DIST_QC}, c.cid) AS probe FROM queries q, cf c",
        f"tq{sfx}": f"SELECT qid, d + 0.001 AS thr, n FROM ranked WHERE r = {k - 1}",
        f"hits{sfx}": f"SELECT p.qid, a.cid, count(*) AS hits FROM pairs p JOIN tq{sfx} USING (qid) JOIN af a ON a.id = p.id WHERE p.d <= tq{sfx}.thr GROUP BY 1, 2",
        f"cur{sfx}": f"""SELECT po.qid, po.probe, coalesce(sizes.size, 0) - CASE WHEN own.own = po.cid THEN 1 ELSE 0 END AS size,
                  coalesce(h.hits, 0) AS hits FROM po LEFT JOIN sizes USING (cid) LEFT JOIN hits{sfx} h USING (qid, cid) JOIN own USING (qid)""",
        f"sw{sfx}": f"""SELECT qid, probe AS nprobe, scanned, hits, least(hits, {k}) / {float(k)} AS recall,
                  (scanned + (SELECT count(*) FROM cf)) / n AS distcomp FROM (
                  SELECT qid, probe, sum(size) OVER w AS scanned, sum(hits) OVER w AS hits FROM cur{sfx}
                  WINDOW w AS (PARTITION BY qid ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) JOIN tq{sfx} USING (qid)""",
        f"hard{sfx}": f"""SELECT qid, nprobe, distcomp, recall FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY nprobe) AS rn
                    FROM sw{sfx} WHERE recall >= {TARGET}) WHERE rn = 1""",
    })
    return c


def index(spark, sf):
    v = fx.vectors(spark, sf)
    return v, ivf.build_index(v, iters=ITERS, seed=SEED)


@register("ivf_train_lloyd", fx.with_fixtures(["vectors"], f"""
SELECT cid, len(v)::BIGINT AS dim, {S.r6(S.vsum('v'))} AS vsum, {S.r6(S.norm2('v'))} AS norm2 FROM cf""", ivf_ctes()))
def q_ivf_train_lloyd(spark, sf):
    v = fx.vectors(spark, sf)
    c = ivf.train_lloyd(v, ivf.n_lists(v.count()), ITERS, SEED)
    return c.select("cid", F.size("v").cast("long").alias("dim"), vec.rnd(vec.vsum("v")).alias("vsum"),
                    vec.rnd(vec.norm2("v")).alias("norm2"))


@register("ivf_train_converged", f"""SELECT range::BIGINT AS cid, true AS settled, true AS at_mean
FROM range((SELECT ceil(sqrt(count(*)))::BIGINT FROM embeddings))""")
def q_ivf_train_converged(spark, sf):
    """Training to its tolerance: every centroid is the mean of the rows that all pairs say are nearest to it, and a further
    step leaves it where it is."""
    v = fx.vectors(spark, sf)
    c = ivf.train_lloyd(v, ivf.n_lists(v.count()), seed=SEED)
    near = dist.knn(c.select(F.col("cid").alias("id"), "v"), v.select(F.col("id").alias("qid"), F.col("v").alias("qv")), 1)
    mean = (v.join(near.select(F.col("qid").alias("id"), F.col("id").alias("cid")), "id")
            .select("cid", F.posexplode(vec.dvec("v")).alias("j", "x")).groupBy("cid", "j").agg(F.avg("x").alias("x"))
            .groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda t: t["x"]).alias("mean")))
    again = ivf.lloyd_step(v, c).withColumnRenamed("v", "again")
    return c.join(mean, "cid", "left").join(again, "cid").select(
        "cid", (vec.euclidean("v", "again") < 1e-6).alias("settled"),
        F.coalesce(vec.euclidean("v", "mean") < 1e-6, F.lit(True)).alias("at_mean"))


@register("ivf_assign", fx.with_fixtures(["vectors"], f"SELECT id, cid, {S.r6('d')} AS d FROM af", ivf_ctes()))
def q_ivf_assign(spark, sf):
    v, (c, a) = index(spark, sf)
    return a.select("id", "cid", vec.rnd("d").alias("d"))


@register("ivf_search", fx.with_fixtures(["vectors", "queries"], f"""
SELECT qid, rank::BIGINT AS rank, id, {S.r6('d')} AS d FROM (
  SELECT p.qid, p.id, p.d, row_number() OVER (PARTITION BY p.qid ORDER BY p.d, p.id) AS rank
  FROM pairs p JOIN af a ON a.id = p.id JOIN po ON po.qid = p.qid AND po.cid = a.cid AND po.probe <= {NPROBE})
WHERE rank <= {K}""", sweep_ctes()))
def q_ivf_search(spark, sf):
    v, (c, a) = index(spark, sf)
    cells = ivf.write_cells(v, a, c, scratch(spark))
    r = ivf.search(v, a, c, fx.queries(spark, sf), NPROBE, K, exclude_self=True, cells=cells)
    return r.select("qid", F.col("rank").cast("long"), "id", vec.rnd("d").alias("d"))


@register("recall_at_k", fx.with_fixtures(["vectors", "queries"], f"""
, run AS (SELECT p.qid, p.d, row_number() OVER (PARTITION BY p.qid ORDER BY p.d, p.id) AS rank
  FROM pairs p JOIN af a ON a.id = p.id JOIN po ON po.qid = p.qid AND po.cid = a.cid AND po.probe <= {NPROBE})
SELECT run.qid, {S.r6(f'sum(CASE WHEN run.d <= t.d + 0.001 THEN 1 ELSE 0 END) / {float(K)}')} AS recall
FROM run JOIN (SELECT qid, d FROM ranked WHERE r = {K - 1}) t USING (qid) WHERE run.rank <= {K} GROUP BY run.qid""",
                                               sweep_ctes()).replace("\n, run AS", ",\nrun AS"))
def q_recall_at_k(spark, sf):
    v, (c, a) = index(spark, sf)
    q = fx.queries(spark, sf)
    truth = dist.knn(v, q, K, exclude_self=True)
    run = ivf.search(v, a, c, q, NPROBE, K, exclude_self=True)
    return dist.recall_at_k(truth, run, K).select("qid", vec.rnd("recall").alias("recall"))


@register("ivf_sweep", fx.with_fixtures(["vectors", "queries"], f"""
SELECT qid, nprobe::BIGINT AS nprobe, scanned::BIGINT AS scanned, hits::BIGINT AS hits, {S.r6('recall')} AS recall,
  {S.r6('distcomp')} AS distcomp FROM sw""", sweep_ctes()))
def q_ivf_sweep(spark, sf):
    v, (c, a) = index(spark, sf)
    s = ivf.sweep(v, fx.queries(spark, sf), c, a, K, exclude_self=True)
    return s.select("qid", F.col("nprobe").cast("long"), F.col("scanned").cast("long"), F.col("hits").cast("long"),
                    vec.rnd("recall").alias("recall"), vec.rnd("distcomp").alias("distcomp"))


@register("ivf_hardness", fx.with_fixtures(["vectors", "queries"], f"""
SELECT qid, nprobe::BIGINT AS nprobe, {S.r6('distcomp')} AS distcomp, {S.r6('recall')} AS recall FROM hard""", sweep_ctes()))
def q_ivf_hardness(spark, sf):
    v, (c, a) = index(spark, sf)
    h = ivf.hardness(v, fx.queries(spark, sf), c, a, K, TARGET, exclude_self=True)
    return h.select("qid", F.col("nprobe").cast("long"), vec.rnd("distcomp").alias("distcomp"), vec.rnd("recall").alias("recall"))


def _mt_ctes():
    c = sweep_ctes()
    c.update({"lidt": LID_SQL, "rct": RC_SQL, "expt": EXP_SQL, "epst": EPS_SQL})
    return c


@register("metric_table", fx.with_fixtures(["vectors", "queries"], f"""
SELECT l.qid, {K}::INT AS k, {S.r6('l.lid')} AS lid, {S.r6('r.rc')} AS rc, {S.r6('x.expansion')} AS expansion,
  {S.r6('h.distcomp')} AS distcomp,
  {', '.join(S.r6(f"max(e.eps_hardness) FILTER (WHERE e.eps = {e})") + f' AS {H.eps_name(e)}' for e in H.EPSILONS)}
FROM lidt l JOIN rct r USING (qid) JOIN expt x USING (qid) JOIN epst e USING (qid) LEFT JOIN hard h USING (qid)
GROUP BY l.qid, l.lid, r.rc, x.expansion, h.distcomp""", _mt_ctes()))
def q_metric_table(spark, sf):
    v, (c, a) = index(spark, sf)
    q = fx.queries(spark, sf)
    hard = ivf.hardness(v, q, c, a, K, TARGET, exclude_self=True).select("qid", "distcomp")
    m = H.metric_table(v, q, k=K, exclude_self=True, distcomp=hard)
    return m.select("qid", F.col("k").cast("int"), *[vec.rnd(col).alias(col) for col in
                                                    ["lid", "rc", "expansion", "distcomp"] + [H.eps_name(e) for e in H.EPSILONS]])
