"""Registered queries H1-H7 and A5 (catalogue, descriptors).

Datasets are derived from the data: one per ``embeddings`` label, named by
its descriptor ``emb<label>-angular-<dim>-<rows>``.
"""

from pyspark.sql import functions as F

from knnhard.operators import catalog as C
from knnhard.plans import fixtures as fx
from knnhard.plans.registry import register


def _datasets(spark, sf):
    return C.dataset_table(fx.table(spark, sf, "embeddings"))


def _cat(spark, sf):
    return C.catalogue(_datasets(spark, sf))


# ----------------------------------------------------------------- SQL

DATASETS_SQL = ("SELECT 'emb' || label::VARCHAR || '-angular-' || max(len(embedding))::VARCHAR || '-' || count(*)::VARCHAR AS dataset "
                "FROM embeddings GROUP BY label")


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return f"'{v}'"
    return repr(v)


def _desc_sql(col):
    base = f"split_part(regexp_replace({col}, '^.*/', ''), '.', 1)"
    parts = f"string_split({base}, '-')"
    s = f"{parts}[-1]"
    mult = f"CASE upper(right({s}, 1)) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'B' THEN 1000000000 ELSE 1 END"
    return {
        "name": f"{parts}[1]",
        "samples": f"CASE WHEN regexp_matches({s}, '^[0-9]+$') THEN {s}::BIGINT ELSE trunc(regexp_extract({s}, '^([0-9.]+)', 1)::DOUBLE * {mult})::BIGINT END",
        "features": f"{parts}[-2]::INT",
        "metric": f"CASE WHEN len({parts}) >= 4 THEN {parts}[-3] ELSE 'euclidean' END",
    }


def _expand_sql():
    parts = []
    types = {"k": "INT", "num_queries": "INT", "difficulty": "VARCHAR", "target_class": "VARCHAR", "scale": "VARCHAR",
             "index": "VARCHAR", "target_low": "DOUBLE", "target_high": "DOUBLE", "queries_filename": "VARCHAR"}
    d = _desc_sql("d.dataset")
    for wtype, params in C.FAMILIES.items():
        cols, froms = [], ["datasets d"]
        for name, values in params.items():
            if name == "target":
                vals = ", ".join(f"({lo!r}, {hi!r})" for lo, hi in values)
                froms.append(f"(VALUES {vals}) t(target_low, target_high)")
            else:
                vals = ", ".join(f"({_lit(v)})" for v in values)
                froms.append(f"(VALUES {vals}) {name}_t({name})")
        sel = [f"'{wtype}' AS workload_type", "d.dataset"]
        for c, t in types.items():
            if c in params or (c in ("target_low", "target_high") and "target" in params):
                sel.append(f"{c}::{t} AS {c}")
            elif c == "queries_filename" and wtype == "file-based":
                sel.append(f"('queries_' || {d['name']} || '-' || {d['metric']} || '-' || ({d['features']})::VARCHAR || '-1K')::VARCHAR AS queries_filename")
            else:
                sel.append(f"NULL::{t} AS {c}")
        parts.append(f"SELECT {', '.join(sel)} FROM {', '.join(froms)}")
    return " UNION ALL ".join(parts)


_KEY = "sha256(concat_ws(':', " + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in C.CONFIG_COLS) + "))"
_FILE = _desc_sql("dataset")
CAT_CTES = {
    "datasets": DATASETS_SQL,
    "expand": _expand_sql(),
    "cat0": f"""SELECT *, {_KEY} AS workload_key,
        CASE workload_type WHEN 'synthetic-simulated-annealing' THEN 'Annealing(' || difficulty || ', ' || target_class || ')'
          WHEN 'synthetic-sgd' THEN 'SGD(' || difficulty || ', ' || target_class || ')'
          WHEN 'synthetic-gaussian-noise' THEN 'GaussianNoise(' || scale || ')'
          WHEN 'file-based' THEN 'File(' || queries_filename || ')'
          WHEN 'empirical-difficulty-based' THEN 'Empirical(' || "index" || ',' || target_low::VARCHAR || ',' || target_high::VARCHAR || ')' END AS description,
        CASE WHEN workload_type = 'file-based' THEN queries_filename
          ELSE {_FILE['name']} || '-' || {_FILE['metric']} || '-' || ({_FILE['features']})::VARCHAR || '-' || num_queries::VARCHAR || '.bin' END AS workload_file
      FROM expand""",
    "cat": "SELECT *, 'dataset~' || dataset || '/workload_key~' || workload_key || '/' || workload_file AS path FROM cat0",
}


def _sql(body):
    return fx.with_fixtures([], body, CAT_CTES)


@register("config_expand", _sql("SELECT " + ", ".join(f'"{c}"' for c in C.CONFIG_COLS) + " FROM expand"))
def q_config_expand(spark, sf):
    return C.expand(_datasets(spark, sf))


@register("config_key", _sql("SELECT workload_key, workload_type, dataset FROM cat"))
def q_config_key(spark, sf):
    return _cat(spark, sf).select("workload_key", "workload_type", "dataset")


@register("config_describe", _sql("SELECT workload_key, description FROM cat"))
def q_config_describe(spark, sf):
    return _cat(spark, sf).select("workload_key", "description")


@register("config_filename", _sql("SELECT workload_key, workload_file, path FROM cat"))
def q_config_filename(spark, sf):
    return _cat(spark, sf).select("workload_key", "workload_file", "path")


@register("config_lookup", _sql("""SELECT p.path, regexp_extract(p.path, 'workload_key~([a-z0-9]+)/', 1) AS workload_key,
  c.workload_type IS NOT NULL AS known, c.workload_type, c.dataset
FROM (SELECT path FROM cat UNION ALL SELECT replace(path, workload_key, reverse(workload_key)) FROM cat) p
LEFT JOIN cat c ON c.workload_key = regexp_extract(p.path, 'workload_key~([a-z0-9]+)/', 1)"""))
def q_config_lookup(spark, sf):
    cat = _cat(spark, sf)
    paths = cat.select("path").unionByName(
        cat.select(F.expr("replace(path, workload_key, reverse(workload_key))").alias("path")))
    r = C.lookup(paths, cat)
    return r.select("path", "workload_key", "known", "workload_type", "dataset")


@register("config_missing", _sql("""SELECT workload_key, CASE WHEN workload_type IN ('file-based', 'synthetic-gaussian-noise')
  THEN 'present' ELSE 'missing' END AS status, starts_with(workload_key, 'a') AS prefix_a FROM cat"""))
def q_config_missing(spark, sf):
    cat = _cat(spark, sf)
    listing = cat.where(F.col("workload_type").isin("file-based", "synthetic-gaussian-noise")).select("path")
    m = C.missing(cat, listing)
    pa = C.prefix_search(cat, "a").select("workload_key", F.lit(True).alias("prefix_a"))
    return m.join(pa, "workload_key", "left").select("workload_key", "status",
                                                      F.coalesce("prefix_a", F.lit(False)).alias("prefix_a"))


@register("index_match", _sql("""SELECT c.workload_key, i.run_index FROM cat c,
  (VALUES """ + ", ".join(f"('{i}')" for i in C.INDEXES) + """) i(run_index)
WHERE c."index" IS NULL OR c."index" = i.run_index"""))
def q_index_match(spark, sf):
    return C.index_match(_cat(spark, sf)).select("workload_key", "run_index")


_D = _desc_sql("file")


@register("descriptor_parse", _sql(f"""SELECT file, {_D['name']} AS name, {_D['samples']} AS samples, {_D['features']} AS features,
  {_D['metric']} AS metric FROM (
  SELECT '/data/' || dataset || '.bin' AS file FROM datasets
  UNION ALL SELECT '/data/' || {_desc_sql('dataset')['name']} || '-' || ({_desc_sql('dataset')['features']})::VARCHAR || '-' ||
    ({_desc_sql('dataset')['samples']} / 1000)::VARCHAR || 'K.bin' FROM datasets)"""))
def q_descriptor_parse(spark, sf):
    ds = _datasets(spark, sf)
    d = C.parse_descriptor(F.col("dataset"))
    files = ds.select(F.concat(F.lit("/data/"), "dataset", F.lit(".bin")).alias("file")).unionByName(
        ds.select(F.concat(F.lit("/data/"), d["name"], F.lit("-"), d["features"].cast("string"), F.lit("-"),
                           (d["samples"] / 1000).cast("string"), F.lit("K.bin")).alias("file")))
    p = C.parse_descriptor(F.col("file"))
    return files.select("file", p["name"].alias("name"), p["samples"].alias("samples"), p["features"].alias("features"),
                        p["metric"].alias("metric"))
