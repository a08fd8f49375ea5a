"""Vector preparation, validation and sampling.

All row-local: plain projections/filters that stay in the scan stage.
Sampling is hash-seeded (portable, retry-safe) instead of RNG-state based.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnhard.functions import rand, vec
from knnhard.session import keep


def nan_repair(df: DataFrame, col: str = "v") -> DataFrame:
    """Replace NaN elements by 0 and report how many were replaced (B1)."""
    return df.withColumn("n_nan", vec.nan_count(col)).withColumn(col, vec.nan_to_zero(col))


def finite_violations(df: DataFrame, col: str = "v") -> DataFrame:
    """Rows with a non-finite element, as a count (B2)."""
    return df.agg(F.sum((~vec.all_finite(col)).cast("int")).alias("n_not_finite"))


def assert_finite(df: DataFrame, col: str = "v") -> DataFrame:
    """``df``, raising where a vector has a non-finite element or is null (B2). It is a filter, since a checked
    column that nothing reads would be pruned and never run."""
    return df.where(F.when(vec.all_finite(col), F.lit(True)).otherwise(F.raise_error(F.lit("non-finite vector element")).cast("boolean")))


def drop_zero(df: DataFrame, col: str = "v") -> DataFrame:
    """Drop all-zero vectors (needed before angular normalisation)."""
    return df.where(vec.any_nonzero(col))


def l2_normalise(df: DataFrame, col: str = "v") -> DataFrame:
    """Unit-norm vectors."""
    return df.withColumn(col, vec.normalise(col))


def pad8(df: DataFrame, col: str = "v") -> DataFrame:
    """Zero-pad to a multiple of 8 dimensions."""
    return df.withColumn(col, vec.pad8(col))


def ip_lift(df: DataFrame, col: str = "v", role: str = "data", scale: float | None = None) -> DataFrame:
    """Inner product -> Euclidean (B6): data get ``sqrt(1-|x/s|^2)``
    appended, queries get 0. ``scale`` defaults to the maximum norm (Q11)."""
    if role == "query":
        return df.withColumn(col, F.concat(vec.dvec(col), F.array(F.lit(0.0))))
    if scale is None:
        scale = df.agg(F.max(vec.norm(col))).first()[0] or 1.0
        scale = max(scale, 1.0)
    return df.withColumn(col, vec.lift_ip(col, scale))


def validate(df: DataFrame, metric: str, col: str = "v", role: str = "data", k: int | None = None,
             tol: float = 1e-5) -> DataFrame:
    """One aggregate with a violation count per rule."""
    n2 = vec.norm2(col)
    rules = {
        "n_rows": F.count(F.lit(1)),
        "n_dims_min": F.min(F.size(col)),
        "n_dims_max": F.max(F.size(col)),
        "n_not_finite": F.sum((~vec.all_finite(col)).cast("int")),
    }
    if metric == "angular":
        rules["n_not_unit"] = F.sum((F.abs(F.sqrt(n2) - 1) > tol).cast("int"))
    if metric == "ip":
        if role == "data":
            head = F.slice(vec.dvec(col), 1, F.size(col) - 1)
            last = F.element_at(vec.dvec(col), -1)
            rules["n_bad_lift"] = F.sum((F.abs(F.sqrt(F.greatest(F.lit(0.0), 1 - vec.norm2(head))) - last) > tol).cast("int"))
        else:
            rules["n_bad_lift"] = F.sum((F.element_at(col, -1) != 0).cast("int"))
    out = df.agg(*[v.alias(k_) for k_, v in rules.items()])
    if k is not None:
        out = out.withColumn("k_out_of_range", ((F.lit(k) < 1) | (F.lit(k) >= F.col("n_rows"))).cast("int"))
    return out


def sample_without(df: DataFrame, q: int, seed: int = 1234, key: str = "id") -> DataFrame:
    """q rows without replacement, seeded: the q smallest ``md5(seed:id)``.

    A global top-q (``TakeOrderedAndProject``: per-partition top-q, then merge).
    """
    return df.withColumn("_h", rand.hash_order(seed, F.col(key))).orderBy("_h", key).limit(q).drop("_h")


def sample_with(df: DataFrame, q: int, seed: int = 1234, key: str = "id", n: int | None = None) -> DataFrame:
    """q draws with replacement, seeded (B9): draw ``j`` picks positional id
    ``floor(u(seed,'pick',j) * n)``; joined back on the positional id.
    Output keeps ``draw`` (0..q-1) so repeated picks stay separate rows."""
    spark = df.sparkSession
    if n is None:
        got = df.agg(F.count(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        n = got["n"]
        if n and (got["lo"], got["hi"]) != (0, n - 1):  # ids with gaps: a draw picks the id of that rank
            draws = sample_with(_ranks(df, key), q, seed, "_rank").select("draw", key)
            return draws.join(df, key)
    draws = spark.range(q).select(F.col("id").alias("draw"),
                                  F.floor(rand.uniform(seed, "pick", F.lit(0), F.col("id")) * F.lit(n)).cast("long").alias("_pos"))
    return draws.join(df, draws["_pos"] == df[key]).drop("_pos")


def _ranks(df: DataFrame, key: str) -> DataFrame:
    """``(key, _rank)``: the rank of every id from 0, from sorted ranges and the sizes of the ranges before."""
    part = keep(df.where(F.col(key).isNotNull()).select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return part.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(
        key, (own + F.col("_before")).alias("_rank"))


def holdout(df: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Remove sampled rows from the data before measuring."""
    return df.join(removed.select(key).distinct(), key, "left_anti")


def reset_last(df: DataFrame, col: str = "qv") -> DataFrame:
    """Set the last coordinate to 0 (ip queries)."""
    return df.withColumn(col, vec.zero_last(col))


def znorm(df: DataFrame, col: str = "v") -> DataFrame:
    """Per-row z-normalisation, population std."""
    return df.withColumn(col, vec.znorm(col))
