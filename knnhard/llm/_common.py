"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knnhard.session import ensure_checkpoint_dir

_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir`` (shared by driver and executors).

    It is removed when the session's file system is closed.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SCRATCH[app] = root
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back: it cuts the lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(m)


def attach(rows: DataFrame, key: str, lookup: DataFrame, spread: Column, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (unique on ``key``) that holds for a hot key.

    Each key of ``rows`` is split over ``salts`` by ``spread``; only the distinct (key, salt) pairs,
    at most ``salts`` per key, meet the lookup row, and the rows meet those pairs.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    pairs = salted.select(key, "_salt").distinct().join(lookup, key)
    return salted.join(pairs, [key, "_salt"]).drop("_salt")


def few(df: DataFrame, n: int, total: int, *key: str) -> DataFrame:
    """At most ``n`` rows of ``df`` by smallest digest of ``key``; ``total`` is its number of rows.

    Rows whose digest cannot be among them are left out first, so tasks hand over about 4 n rows together,
    not n each.
    """
    h = F.xxhash64(*key)
    if total > 4 * n:
        df = df.where(h <= int(-(1 << 63) + (1 << 64) * (4 * n / total)))
    return df.orderBy(h, *key).limit(n)


def top(df: DataFrame, n: int, *order: Column | str) -> list:
    """The first ``n`` rows on the driver; they are merged by a task, so the driver gets n rows and not n of every task."""
    return materialise(df.orderBy(*order).limit(n), "top").collect()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, keys: DataFrame, make_key: Callable[[], Column]) -> DataFrame:
    """Rows of ``docs`` whose key is in ``keys`` (one column); of rows repeating a key, one stays."""
    k, n = fresh(docs, "_key"), fresh(docs, "_nth")
    names = [col(c) for c in docs.columns]
    wanted = keys.toDF(k).distinct()
    kept = docs.withColumn(k, make_key()).join(wanted, k, "left_semi")
    nth = F.row_number().over(Window.partitionBy(k).orderBy(k))
    return kept.withColumn(n, nth).where(col(n) == 1).select(*names)
