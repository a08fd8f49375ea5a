"""Derived fixture tables, built by query from the driver tables.

Each fixture exists twice with the same definition: a Spark DataFrame
(``spark_fixture``) and a DuckDB CTE (``SQL``) used by the oracles. All of
them read whole tables; no id subsets, prefixes or caps.

* ``vectors``  (id, v)    every ``embeddings`` row.
* ``queries``  (qid, qv)  every ``embeddings`` row; query/data pairs with
  ``qid = id`` are excluded ("leave one out"), see ``PAIR_EXCLUDE_SELF``.
* ``vectors_ip`` / ``queries_ip``: 0.9-scaled vectors lifted with
  ``sqrt(1-|x|^2)`` / queries with 0 appended.
* ``vectors_dirty``: embeddings plus four literal rows (zero, NaN, duplicate
  of id 1, norm 2).
* ``series_walk``: per ``user_id`` the 32 equal time bins of the whole events
  period (sum of ``value``, empty = 0), minus the row mean, cumulative sum,
  z-normalised.
* ``series_month``: per ``l_suppkey`` 80 equal time bins of the whole ship
  period over ``l_quantity``, same treatment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knnhard.functions import vec

PAIR_EXCLUDE_SELF = True
SERIES_WALK_LEN = 32
SERIES_MONTH_LEN = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def vectors_ip(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = F.transform(vec.dvec("embedding"), lambda a: a * F.lit(0.9))
    return e.select(F.col("vec_id").alias("id"), vec.lift_ip(x).alias("v"))


def queries_ip(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("qid"),
                    F.concat(vec.dvec("embedding"), F.array(F.lit(0.0))).alias("qv"))


def vectors_dirty(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    base = e.where(F.col("id").isin(1, 2, 3))
    zero = base.where("id = 1").select(F.lit(1000001).cast("bigint").alias("id"),
                                       F.transform("v", lambda x: x * F.lit(0.0).cast("float")).alias("v"))
    nan = base.where("id = 2").select(F.lit(1000002).cast("bigint").alias("id"),
                                      F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("v", 2, 1 << 20)).alias("v"))
    dup = base.where("id = 1").select(F.lit(1000003).cast("bigint").alias("id"), "v")
    big = base.where("id = 3").select(F.lit(1000004).cast("bigint").alias("id"),
                                      F.transform("v", lambda x: x * F.lit(2.0).cast("float")).alias("v"))
    return e.unionByName(zero).unionByName(nan).unionByName(dup).unionByName(big)


def _series(df: DataFrame, key: str, ts: str, val: str, length: int) -> DataFrame:
    """Fixed-length series per key from all rows: equal time bins over the
    whole period, empty bin = 0, minus row mean, prefix sum, z-normalised."""
    sec = F.unix_timestamp(F.col(ts))
    # two scalars (period bounds) become literals of the plan
    t0, t1 = df.agg(F.min(sec), F.max(sec)).first()
    bucket = F.expr(f"(unix_timestamp({ts}) - {t0}) * {length} div {t1 - t0 + 1}").cast("int")
    binned = (df.select(F.col(key).alias("id"), bucket.alias("b"), F.col(val).cast("double").alias("x"))
              .groupBy("id", "b").agg(F.sum("x").alias("x")))
    # dense grid: every key explodes its own bins (no join of keys x bins)
    grid = binned.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("b"))
    dense = grid.join(binned, ["id", "b"], "left").select("id", "b", F.coalesce("x", F.lit(0.0)).alias("x"))
    per = Window.partitionBy("id")
    run = Window.partitionBy("id").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = dense.withColumn("x", F.col("x") - F.avg("x").over(per))
    c = c.withColumn("x", F.sum("x").over(run))
    c = c.withColumn("x", (F.col("x") - F.avg("x").over(per)) / F.stddev_pop("x").over(per))
    arr = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("b", "x"))).alias("bx"))
    return arr.select("id", F.transform("bx", lambda t: t.getField("x")).alias("v"))


def series_walk(spark, sf_dir) -> DataFrame:
    return _series(table(spark, sf_dir, "events"), "user_id", "ts", "value", SERIES_WALK_LEN)


def series_month(spark, sf_dir) -> DataFrame:
    return _series(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity", SERIES_MONTH_LEN)


FIXTURES = {
    "vectors": vectors, "queries": queries, "labelled": labelled, "vectors_ip": vectors_ip,
    "queries_ip": queries_ip, "vectors_dirty": vectors_dirty, "series_walk": series_walk,
    "series_month": series_month,
}


def spark_fixture(spark, sf_dir, name) -> DataFrame:
    return FIXTURES[name](spark, sf_dir)


# --------------------------------------------------------------------------
# DuckDB side (oracles). Lambdas use the DuckDB 2 ``lambda x: ...`` syntax.
# --------------------------------------------------------------------------

def _series_sql(src: str, key: str, ts: str, val: str, length: int) -> str:
    return f"""(
  WITH b AS (SELECT min(floor(epoch({ts})))::BIGINT AS t0, max(floor(epoch({ts})))::BIGINT AS t1 FROM {src}),
  s AS (SELECT {key} AS id,
          ((floor(epoch({ts}))::BIGINT - b.t0) * {length}) // (b.t1 - b.t0 + 1) AS bi,
          sum({val}::DOUBLE) AS x
        FROM {src}, b
        WHERE TRUE
        GROUP BY 1, 2),
  keys AS (SELECT DISTINCT id FROM s),
  g AS (SELECT k.id, r.range AS bi, coalesce(s.x, 0.0) AS x
        FROM keys k CROSS JOIN range({length}) r LEFT JOIN s ON s.id = k.id AND s.bi = r.range),
  c AS (SELECT id, bi, x - avg(x) OVER (PARTITION BY id) AS x FROM g),
  p AS (SELECT id, bi, sum(x) OVER (PARTITION BY id ORDER BY bi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM c),
  z AS (SELECT id, bi, (x - avg(x) OVER (PARTITION BY id)) / stddev_pop(x) OVER (PARTITION BY id) AS x FROM p)
  SELECT id, list(x ORDER BY bi) AS v FROM z GROUP BY id)"""


SQL = {
    "vectors": "(SELECT vec_id AS id, embedding AS v FROM embeddings)",
    "queries": "(SELECT vec_id AS qid, embedding AS qv FROM embeddings)",
    "labelled": "(SELECT vec_id AS id, label FROM embeddings)",
    "vectors_ip": """(SELECT vec_id AS id,
        list_concat(list_transform(embedding, lambda x: 0.9 * x::DOUBLE),
          [sqrt(greatest(0.0, 1.0 - list_sum(list_transform(embedding, lambda x: (0.9 * x::DOUBLE) * (0.9 * x::DOUBLE)))))]) AS v
      FROM embeddings)""",
    "queries_ip": "(SELECT vec_id AS qid, list_concat(list_transform(embedding, lambda x: x::DOUBLE), [0.0::DOUBLE]) AS qv FROM embeddings)",
    "vectors_dirty": """(SELECT vec_id AS id, embedding AS v FROM embeddings
      UNION ALL SELECT 1000001, list_transform(embedding, lambda x: x * 0.0::FLOAT) FROM embeddings WHERE vec_id = 1
      UNION ALL SELECT 1000002, list_concat(['nan'::FLOAT], embedding[2:]) FROM embeddings WHERE vec_id = 2
      UNION ALL SELECT 1000003, embedding FROM embeddings WHERE vec_id = 1
      UNION ALL SELECT 1000004, list_transform(embedding, lambda x: x * 2.0::FLOAT) FROM embeddings WHERE vec_id = 3)""",
    "series_walk": _series_sql("events", "user_id", "ts", "value", SERIES_WALK_LEN),
    "series_month": _series_sql("lineitem", "l_suppkey", "l_shipdate", "l_quantity", SERIES_MONTH_LEN),
}


def with_fixtures(names, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH name AS (...) , ... body`` for the listed fixtures (+ extra CTEs, in order)."""
    parts = [f"{n} AS {SQL[n]}" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
