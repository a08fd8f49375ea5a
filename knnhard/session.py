"""Spark session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int = 8, app: str = "knnhard") -> SparkSession:
    """Session for tests and the bench; on a cluster use the existing session."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = (
        SparkSession.builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.ansi.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package, once, to the executors of a cluster, which may not have it on their PYTHONPATH. A
    single-process master (``local[n]``) reads it where the driver does."""
    sc = spark.sparkContext
    if sc.master == "local" or sc.master.startswith("local[") or sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="knnhard-pkg-"), "knnhard")  # served by the driver, not shared
    sc.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(root), os.path.basename(root)))
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder in its configuration; it is only set here
    when unset *and* the master is local (tests), never on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="knnhard-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path below this application's folder in the shared checkpoint folder; the folder goes when the application ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/knnhard-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{root}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and return the table read back: what reads it
    more than once does not compute it again, and a lost executor does not lose it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
