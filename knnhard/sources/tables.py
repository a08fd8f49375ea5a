"""Text vectors, the dataset loader, conversion, and result tables."""

from __future__ import annotations

import csv
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knnhard.functions import vec
from knnhard.operators import vectors as vops
from knnhard.operators.ranks import positions
from knnhard.session import ensure_checkpoint_dir, keep
from knnhard.sources import vecfile

METRIC_SCHEMA = ("i long, k int, lid double, rc double, expansion double, distcomp double, eps_0_05 double, "
                 "eps_0_1 double, eps_0_5 double, eps_1 double, dataset string, workload_description string")


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    base = "/" + base[len("file:"):].lstrip("/") if base.startswith("file:") else base
    if "://" in base:  # os.makedirs would make a machine-local folder of that name
        raise ValueError(f"vector files need a mounted shared folder; spark.checkpoint.dir is {base!r}")
    path = os.path.join(base, f"knnhard-{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated floats, one vector per line (A3); the positional id is the line number across the
    input, files in path order.

    A line's place in its split comes from ``monotonically_increasing_id``, the lines before its split from a running
    sum over the splits (one row each); the splits join the lines, and only their count is read twice.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_file", "_from").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_from", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    toks = F.filter(F.split(F.trim("value"), r"\s+"), lambda s: s != "")
    return lines.join(splits, ["_file", "_from"]).select((F.col("_before") + F.col("_m") - F.col("_first")).alias("id"),
                                                         F.transform(toks, lambda s: s.cast("float")).alias("v"))


def write_txt(df: DataFrame, path: str) -> None:
    """Vectors as whitespace-separated text in id order, as ``read_txt`` takes them."""
    line = F.concat_ws(" ", F.transform(df["v"].cast("array<float>"), lambda x: x.cast("string")))
    df.select("id", line.alias("value")).orderBy("id").select("value").write.mode("overwrite").text(path)


def resolve(name: str, role: str, names: dict[str, dict[str, str]] | None) -> str:
    """Path of a symbolic data or query set name (A4): ``names`` maps the roles ``train`` and ``test`` to
    ``{name: path}``. What is no known name is a path."""
    if role not in ("train", "test"):
        raise ValueError(f"role is 'train' or 'test', not {role!r}")
    return (names or {}).get(role, {}).get(name, name)


def load_vectors(spark: SparkSession, path: str, role: str = "train", limit: int | None = None, repair: bool = True,
                 metric: str | None = None, names: dict[str, dict[str, str]] | None = None) -> tuple[DataFrame, str]:
    """Read a vector file by path or symbolic name, and by extension (A4): ``.bin``/``.fbin`` via the Data
    Source (first ``limit`` rows, by position), ``.txt`` (metric euclidean).
    NaN repaired to 0 (B1), finite check (B2), and for angular data zero rows
    dropped (B3) before normalisation (B4)."""
    path = resolve(path, role, names)
    if path.endswith(".txt"):
        df, m = read_txt(spark, path), "euclidean"
        if limit is not None:
            df = df.where(F.col("id") < limit)
    else:
        m = metric or (vecfile.parse_name(path)[3] if path.endswith(".bin") else "euclidean")
        df = vecfile.read_vectors(spark, path, limit=limit)
    if repair:
        df = vops.nan_repair(df).drop("n_nan")
    df = vops.assert_finite(df)
    if m == "angular":
        df = vops.l2_normalise(vops.drop_zero(df))
    return df, m


def convert(spark: SparkSession, source: str, target: str, role: str = "train", name_check: bool = True,
            padding: bool = True, names: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Convert a vector file to raw float32 (A7): load, pad to a multiple of 8, check the name of the target, write,
    read back and compare.

    The target is named ``name-[metric-]features-samples.bin``; its features count the padding. With ``name_check`` a
    name that differs from the rows, the dimension or the metric raises before anything is written. Rows get
    the positions 0, 1, ... in id order, as the file holds no ids. Returns the ``verify_roundtrip`` row; a row that
    does not come back equal raises.
    """
    data, metric = load_vectors(spark, source, role, names=names)
    data = keep(positions(data.select("id", "v"), ["id"], "at").select(F.col("at").alias("id"), "v"))
    found = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = found["dim"] or 0
    pad = -dim % 8 if padding else 0
    if name_check:
        _, rows, features, named = vecfile.parse_name(target)
        if (rows, features, named) != (found["n"], dim + pad, metric):
            raise ValueError(f"{target} is named {rows} x {features} {named}, but holds {found['n']} x {dim + pad} {metric}")
    vecfile.write_vectors(vops.pad8(data) if pad else data, target)
    back = vecfile.read_vectors(spark, target, dim=dim + pad).select("id", F.slice("v", 1, dim).alias("v"))
    report = keep(verify_roundtrip(data, back))
    if report.first()["n_mismatch"]:
        raise ValueError(f"{target} differs from {source}: {report.first()}")
    return report


def verify_roundtrip(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Compare two vector tables by id like ``numpy.isclose`` (A7, A13):
    ``(n_a, n_b, n_mismatch, max_abs_diff)``."""
    j = a.select("id", F.col("v").alias("va")).join(b.select("id", F.col("v").alias("vb")), "id", "full_outer")
    close = F.forall(F.zip_with(vec.dvec("va"), vec.dvec("vb"), lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)),
                     lambda t: t)
    diff = F.array_max(F.zip_with(vec.dvec("va"), vec.dvec("vb"), lambda x, y: F.abs(x - y)))
    return j.agg(F.count("va").alias("n_a"), F.count("vb").alias("n_b"),
                 F.sum(F.when(F.col("va").isNull() | F.col("vb").isNull() | ~close, 1).otherwise(0)).alias("n_mismatch"),
                 F.max(diff).alias("max_abs_diff"))


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Metric rows as CSV with a header, one folder per dataset."""
    df.write.mode("overwrite").option("header", True).partitionBy("dataset").csv(path)


def read_results_csv(spark: SparkSession, path: str | list[str], schema: str | list[str] = METRIC_SCHEMA) -> DataFrame:
    """Stack all result CSVs below ``path``, whose columns may differ in number and order (A9): columns go by the
    name in each file's own header, those a file lacks are NULL, those not in ``schema`` (one, or several
    whose columns are taken together) are left out; ``source`` is the dataset of the path. A field holds no line break.

    One scan reads all files. The distinct headers (one row per kind of file) become the cases of one parsing
    expression; a file's header is its first line.
    """
    types = {f.name: f.dataType for one in ([schema] if isinstance(schema, str) else schema) for f in T.StructType.fromDDL(one)}
    want = T.StructType([T.StructField(c, t) for c, t in types.items()])
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_m"))
    first = lines.where("_from = 0").groupBy("_file").agg(F.min_by("value", "_m").alias("_header"), F.min("_m").alias("_top"))
    parsed = F.lit(None).cast(want)
    for (header,) in first.select("_header").distinct().collect():
        names = [c.strip() for c in next(csv.reader([header]))]
        row = F.from_csv("value", ", ".join(f"`{c}` {types[c].simpleString() if c in types else 'string'}" for c in names))
        cols = [(row[c] if c in names else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
        parsed = F.when(F.col("_header") == header, F.struct(*cols)).otherwise(parsed)
    body = lines.join(first, "_file").where("NOT (_from = 0 AND _m = _top) AND value <> ''")
    return body.select(parsed.alias("_row"), F.regexp_extract("_file", r"dataset=([^/]+)/", 1).alias("source")).select("_row.*", "source")


def save_ground_truth(gt: DataFrame, path: str) -> None:
    """Persist a ground-truth table ``(qid, topk, avg_d, hist_counts,
    hist_edges)`` as Parquet (A10)."""
    gt.write.mode("overwrite").parquet(path)


def write_layout(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result layout ``dataset~X/workload_key~Y/`` (A11): Hive-style
    partition folders named ``dataset=X/workload_key=Y`` so that readers
    prune partitions by filters on the two keys."""
    df.write.mode("overwrite").partitionBy("dataset", "workload_key").format(fmt).save(path)


def read_layout(spark: SparkSession, path: str, dataset: str | None = None, workload_key: str | None = None,
                fmt: str = "parquet") -> DataFrame:
    """Read the layout back; key filters become partition filters (only the
    matching folders are listed and read)."""
    df = spark.read.format(fmt).load(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if workload_key is not None:
        df = df.where(F.col("workload_key") == workload_key)
    return df


def write_queries_checked(df: DataFrame, path: str) -> DataFrame:
    """Emit a generated query set ``(id, v)``, read it back and compare (A13): the ``verify_roundtrip`` row.

    A ``.fbin`` path is a single file (small sets), any other a folder of raw parts written by Spark. The file has no
    ids, so rows go by position; values that are not finite raise.
    """
    rows = keep(positions(vops.assert_finite(df.select("id", "v")), ["id"], "at").select(F.col("at").alias("id"), "v"))
    if path.endswith(".fbin"):
        vecfile.write_fbin(rows, path)
        back = vecfile.read_vectors(df.sparkSession, path)
    else:
        vecfile.write_vectors(rows, path)
        one = rows.first()
        back = vecfile.read_vectors(df.sparkSession, path, dim=len(one["v"]) if one else 1)
    return verify_roundtrip(rows, back)
