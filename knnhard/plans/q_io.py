"""Registered queries A1-A4, A6-A9, A11-A14 (files written to the shared scratch folder and read back)."""

import os

from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import catalog as C
from knnhard.operators import generate as G
from knnhard.operators import vectors as vops
from knnhard.operators.ranks import positions
from knnhard.plans import fixtures as fx
from knnhard.plans import results as RS
from knnhard.plans import sqlgen as S
from knnhard.plans.registry import register
from knnhard.session import scratch
from knnhard.sources import tables as TB
from knnhard.sources import vecfile as VF

LIMIT = 300
SEED = 1234
NQ = 20


def _digest(col="v"):
    return [F.size(col).cast("long").alias("dim"), vec.rnd(vec.vsum(vec.dvec(col))).alias("vsum"),
            vec.rnd(vec.norm2(col)).alias("norm2")]


def _sdigest(col):
    return f"len({col})::BIGINT AS dim, {S.r6(S.vsum(col))} AS vsum, {S.r6(S.norm2(col))} AS norm2"


def _norm_sql(col):
    return f"list_transform({col}, lambda x: x::DOUBLE / sqrt({S.norm2(col)}))"


@register("load_limit", fx.with_fixtures([], f"""SELECT vec_id AS id, {_sdigest('w')} FROM (
  SELECT vec_id, {_norm_sql('embedding')} AS w FROM embeddings
  WHERE vec_id < {LIMIT} AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""))
def q_load_limit(spark, sf):
    """Write the embeddings as raw parts, load the first LIMIT rows back as an
    angular dataset (repair, zero-drop, normalise) (A1, A4, A6)."""
    v = fx.vectors(spark, sf)
    n = v.count()
    path = os.path.join(TB.scratch_dir(spark, "load"), f"emb-angular-{v.select(F.size('v')).first()[0]}-{n}.bin")
    VF.write_vectors(v, path)
    df, metric = TB.load_vectors(spark, path, limit=LIMIT)
    return df.select("id", *_digest())


@register("verify_roundtrip", fx.with_fixtures(["vectors_ip"], """SELECT count(*)::BIGINT AS n_a, count(*)::BIGINT AS n_b,
  0::BIGINT AS n_mismatch, 0.0::DOUBLE AS max_abs_diff FROM vectors_ip"""))
def q_verify_roundtrip(spark, sf):
    """Pad to a multiple of 8, write raw float32, read back, strip the padding
    and compare with the input like ``isclose`` (A6, A7, A13)."""
    v = fx.vectors_ip(spark, sf)
    dim = v.select(F.size("v")).first()[0]
    path = os.path.join(TB.scratch_dir(spark, "verify"), f"ip-{dim}-x.bin")
    padded = vops.pad8(v)
    VF.write_vectors(padded, path)
    back = VF.read_vectors(spark, path, dim=dim + (-dim) % 8).select("id", F.slice("v", 1, dim).alias("v"))
    r = TB.verify_roundtrip(v, back)
    return r.select(F.col("n_a").cast("long"), F.col("n_b").cast("long"), F.col("n_mismatch").cast("long"),
                    vec.rnd("max_abs_diff").alias("max_abs_diff"))


@register("union_results", RS.sql(f"SELECT i, dataset, {S.r6('rc')} AS rc, {S.r6('distcomp')} AS distcomp, workload_description FROM mrows"))
def q_union_results(spark, sf):
    """Metric rows written as per-dataset CSV folders, stacked back with an
    explicit schema and the dataset taken from the path (A8, A9, A11)."""
    m = RS.metric_rows(spark, sf)
    root = scratch(spark)
    TB.write_metrics_csv(m, root)
    r = TB.read_results_csv(spark, root, TB.METRIC_SCHEMA.replace(", dataset string", ""))
    return r.select("i", F.col("source").alias("dataset"), vec.rnd("rc").alias("rc"), vec.rnd("distcomp").alias("distcomp"),
                    "workload_description")


@register("stack_traces", RS.sql(f"""SELECT 'ev-' || (query_index % 3)::VARCHAR AS source, iteration, query_index, {S.r6('rc')} AS rc,
  {S.r6('elapsed_s')} AS elapsed_s, CASE WHEN query_index % 3 = 1 THEN 5000 END::BIGINT AS data_limit,
  CASE WHEN query_index % 3 <> 2 THEN method END AS method FROM trace""", False))
def q_stack_traces(spark, sf):
    """Convergence traces of three datasets as CSVs of three kinds, columns missing, added and in another order, stacked by name."""
    t = RS.trace(spark, sf)
    root = scratch(spark)
    kinds = {"ev-0": ["iteration", "rc", "elapsed_s", "query_index", "method"],
             "ev-1": ["iteration", "rc", "elapsed_s", "query_index", "data_limit", "method"],
             "ev-2": ["query_index", "elapsed_s", "iteration", "rc"]}
    for d, cols in kinds.items():
        one = t.where(F.col("dataset") == d).withColumn("data_limit", F.lit(5000)).select(*cols)
        one.write.option("header", True).csv(f"{root}/dataset={d}")
    r = TB.read_results_csv(spark, root, "iteration long, rc double, elapsed_s double, query_index long, data_limit long, method string")
    return r.select("source", "iteration", "query_index", vec.rnd("rc").alias("rc"), vec.rnd("elapsed_s").alias("elapsed_s"), "data_limit", "method")


@register("load_text", f"""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, {_sdigest('embedding')} FROM embeddings""")
def q_load_text(spark, sf):
    """The embeddings as lines of text, read back under their line numbers (A3), by a symbolic name (A4)."""
    path = scratch(spark) + ".txt"
    TB.write_txt(fx.vectors(spark, sf), path)
    df, _ = TB.load_vectors(spark, "emb", names={"train": {"emb": path}})
    return df.select("id", *_digest())


_AS_FILED = "SELECT row_number() OVER (ORDER BY id) - 1 AS id, list_transform(v, lambda x: x::FLOAT) AS v FROM vectors_ip"


@register("convert", fx.with_fixtures(["vectors_ip"], f"""SELECT id, {_sdigest('w')}, true AS whole FROM (
  SELECT id, list_concat(v, list_transform(range((8 - len(v) % 8) % 8), lambda i: 0::FLOAT)) AS w FROM filed)""", {"filed": _AS_FILED}))
def q_convert(spark, sf):
    """A text file of vectors converted to raw float32: padded, the name checked, written, read back and compared."""
    text = scratch(spark) + ".txt"
    v = fx.vectors_ip(spark, sf)
    TB.write_txt(v, text)
    size = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    wide = size["dim"] + -size["dim"] % 8
    path = os.path.join(TB.scratch_dir(spark, "convert"), f"ip-euclidean-{wide}-{size['n']}.bin")
    report = TB.convert(spark, text, path).select((F.col("n_mismatch") + F.abs(F.col("n_a") - F.col("n_b")) == 0).alias("whole"))
    return VF.read_vectors(spark, path).select("id", *_digest()).join(F.broadcast(report))  # one row


@register("layout", f"""SELECT dataset, label, count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS ids, {S.r6('sum(s)')} AS vsum FROM (
  SELECT *, 'set-' || label::VARCHAR AS dataset, {S.vsum('embedding')} AS s FROM embeddings) GROUP BY ALL""")
def q_layout(spark, sf):
    """Rows written as ``dataset=X/workload_key=Y`` folders; each dataset is read back by its partition filter."""
    e = fx.table(spark, sf, "embeddings")
    path = scratch(spark)
    TB.write_layout(e.withColumn("dataset", F.concat(F.lit("set-"), F.col("label").cast("string")))
                    .withColumn("workload_key", F.sha2(F.col("label").cast("string"), 256)), path)
    names = [r["dataset"] for r in TB.read_layout(spark, path).select("dataset").distinct().orderBy("dataset").collect()]
    out = None
    for name in names:  # one row per dataset
        one = TB.read_layout(spark, path, dataset=name).groupBy("dataset", "label").agg(
            F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"), vec.rnd(F.sum(vec.vsum(vec.dvec("embedding")))).alias("vsum"))
        out = one if out is None else out.unionByName(one)
    return out


@register("file_workload", f"""SELECT dataset, k, qid, {_sdigest('w')} FROM (
  SELECT 'emb' || label::VARCHAR || '-angular-' || max(len(embedding)) OVER (PARTITION BY label, k) || '-' || count(*) OVER (PARTITION BY label, k) AS dataset,
    k, row_number() OVER (PARTITION BY label, k ORDER BY vec_id) - 1 AS qid, {_norm_sql('embedding')} AS w
  FROM embeddings, (VALUES (10), (1)) ks(k))""")
def q_file_workload(spark, sf):
    """The file-based rows of the catalogue, each with a query file of its own that the row's file name stands for."""
    e = fx.table(spark, sf, "embeddings")
    rows = C.catalogue(C.dataset_table(e)).where("workload_type = 'file-based'").select("dataset", "k", "queries_filename").collect()
    root = TB.scratch_dir(spark, "workloads")
    names, out = {}, None
    for r in rows:  # two rows per dataset
        name = r["queries_filename"]
        if name not in names:
            own = e.where(F.col("label").cast("string") == r["dataset"].partition("-")[0][len("emb"):])
            names[name] = os.path.join(root, f"{name}.bin")
            VF.write_vectors(positions(own.select("vec_id", F.col("embedding").alias("v")), ["vec_id"], "id"), names[name])
        config = {"workload_type": "file-based", "queries_filename": name, "names": {"test": names}}
        q = G.dispatch_workload(own, config, metric=r["dataset"].split("-")[1])
        one = q.select(F.lit(r["dataset"]).alias("dataset"), F.lit(r["k"]).alias("k"), "qid", *_digest("qv"))
        out = one if out is None else out.unionByName(one)
    return out


@register("emit_queries", """SELECT count(*)::BIGINT AS n_a, count(*)::BIGINT AS n_b, 0::BIGINT AS n_mismatch,
  max(list_max(list_transform(v, lambda x: abs(x - x::FLOAT::DOUBLE)))) < 1e-6 AS close FROM (
  SELECT list_transform(embedding, lambda x: x::DOUBLE * 0.9) AS v FROM embeddings)""")
def q_emit_queries(spark, sf):
    """A query set as large as the table emitted to raw float32, read back and compared."""
    q = fx.vectors(spark, sf).select("id", F.transform(vec.dvec("v"), lambda x: x * 0.9).alias("v"))
    path = os.path.join(TB.scratch_dir(spark, "emit"), "queries-64-all.bin")
    r = TB.write_queries_checked(q, path)
    return r.select("n_a", "n_b", F.col("n_mismatch").cast("long"), (F.col("max_abs_diff") < 1e-6).alias("close"))


@register("load_range", f"""SELECT vec_id AS id, {_sdigest('embedding')} FROM embeddings
WHERE vec_id >= (SELECT count(*) // 4 FROM embeddings) AND vec_id < (SELECT count(*) // 2 FROM embeddings)""")
def q_load_range(spark, sf):
    """The second quarter of the rows of an ``.fbin`` file, read by its byte range alone (A2)."""
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    n = e.count()
    path = os.path.join(TB.scratch_dir(spark, "range"), f"rows-64-{n}.fbin")
    VF.write_fbin(e, path)
    part = VF.read_vectors(spark, path, rows_per_partition=100, start=n // 4, limit=n // 2 - n // 4)
    return part.select("id", *_digest())


_PAD = "(8 - (len(v) + 1) % 8) % 8"
_DRAWS = f"""SELECT range AS qid, floor({S.uniform(SEED, 'pick', '0', 'range')} * (SELECT max(vec_id) + 1 FROM embeddings))::BIGINT AS id FROM range({NQ})"""


@register("prepare_variants", fx.with_fixtures([], f"""
, base AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
mx AS (SELECT greatest(1.0, max(sqrt({S.norm2('v')}))) AS m FROM base),
padded AS (SELECT id, list_transform(list_concat(v, list_transform(range({_PAD}), lambda i: 0.0)), lambda x: x / mx.m) AS y FROM base, mx),
qs AS (SELECT d.qid, b.v FROM ({_DRAWS}) d JOIN base b USING (id))
SELECT 'data' AS role, 'euclidean' AS variant, id, {_sdigest('v')} FROM base
UNION ALL SELECT 'data', 'angular', id, {_sdigest('w')} FROM (SELECT id, {_norm_sql('v')} AS w FROM base)
UNION ALL SELECT 'data', 'ip', id, {_sdigest('w')} FROM (SELECT id, list_concat(y, [sqrt(greatest(0.0, 1.0 - {S.norm2('y')}))]) AS w FROM padded)
UNION ALL SELECT 'query', 'euclidean', qid, {_sdigest('v')} FROM qs
UNION ALL SELECT 'query', 'angular', qid, {_sdigest('w')} FROM (SELECT qid, {_norm_sql('v')} AS w FROM qs)
UNION ALL SELECT 'query', 'ip', qid, {_sdigest('w')} FROM (
  SELECT qid, list_concat(list_concat(v, list_transform(range({_PAD}), lambda i: 0.0)), [0.0]) AS w FROM qs)""".replace(
    "\n, base AS", "WITH base AS", 1)))
def q_prepare_variants(spark, sf):
    """Three variants of one raw dataset (A14): euclidean as is, angular
    normalised, ip padded so that dim+pad+1 is a multiple of 8 and lifted
    (data scaled by the maximum norm, Q11); a query set of NQ draws with
    replacement goes through an ``.fbin`` file (A2) and gets the matching
    treatment (ip queries: padding and a 0 appended)."""
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vec.dvec("embedding").alias("v"))
    dim = e.select(F.size("v")).first()[0]
    pad = (8 - (dim + 1) % 8) % 8
    draws = vops.sample_with(e, NQ, SEED).select(F.col("draw").alias("id"), "v")
    fpath = os.path.join(TB.scratch_dir(spark, "fbin"), f"queries-{dim}-{NQ}.fbin")
    VF.write_fbin(draws, fpath)
    q = VF.read_vectors(spark, fpath).select("id", vec.dvec("v").alias("v"))
    padded = e.select("id", F.concat("v", F.array_repeat(F.lit(0.0), pad)).alias("v"))
    ip = vops.ip_lift(padded, "v", "data")
    out = [e.select(F.lit("data").alias("role"), F.lit("euclidean").alias("variant"), "id", *_digest()),
           vops.l2_normalise(e).select(F.lit("data"), F.lit("angular"), "id", *_digest()),
           ip.select(F.lit("data"), F.lit("ip"), "id", *_digest()),
           q.select(F.lit("query"), F.lit("euclidean"), "id", *_digest()),
           vops.l2_normalise(q).select(F.lit("query"), F.lit("angular"), "id", *_digest()),
           vops.ip_lift(q.select("id", F.concat("v", F.array_repeat(F.lit(0.0), pad)).alias("v")), "v", "query").select(
               F.lit("query"), F.lit("ip"), "id", *_digest())]
    res = out[0]
    for o in out[1:]:
        res = res.union(o)
    return res
