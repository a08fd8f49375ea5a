"""Exact deduplication by tree-merge of sorted digest runs (DataFrame functions only).

Every row gets a digest (SHA-256 of the normalised text), verified by a second, independent hash
and the length, and belongs to one of ``runs`` leaf runs. A leaf run is its digests, sorted, each
with the identifier that stays and the number of rows. In every round ``fan_in`` neighbouring runs
exchange their digests and are merged: equal, verified digests become one entry that keeps the
better identifier and the sum of the counts. After log(runs) rounds one logical run is left,
spread over the cluster by digest. The winners then go back down the same tree, so an entry meets at most
``fan_in`` children and a row only its own leaf's entry: a text that a third of all rows share
never gathers in one task, on the way up or down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import ascii_lower, col, keep_rows, materialise, table

_KEY = ["digest", "check", "length"]


def _digests(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    norm = F.coalesce(ascii_lower(col(text_col).cast("string")), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), norm.alias("t")).select(
        "id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        F.xxhash64("t").alias("check"), F.octet_length("t").alias("length"),
        F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("run", F.pmod(F.xxhash64("row", "id"), F.lit(runs)).cast("int"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                runs: int = 256, fan_in: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` is
    'smallest' or 'largest': which identifier of a group stays; an id of null never wins over
    another. Rows that repeat both id and text form a group too, of which exactly one row is
    kept. An empty table gives an empty result; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    rows = materialise(_digests(docs, id_col, text_col, runs), "dedup-rows")

    def best(who: Column) -> Column:
        # nulls sort first: largest passes over them; for smallest they are flagged behind
        return F.max(who) if keep == "largest" else F.min(who)

    who = F.struct(F.col("id").isNotNull().alias("known"), "id", "row") if keep == "largest" else \
        F.struct(F.col("id").isNull().alias("unknown"), "id", "row")
    level = rows.groupBy(*_KEY, "run").agg(best(who).alias("who"), F.count(F.lit(1)).alias("n"))
    levels = [materialise(level.sortWithinPartitions(*_KEY), "dedup-run")]
    width = runs
    while width > 1:
        width = -(-width // fan_in)
        merged = (levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                  .groupBy(*_KEY, "run").agg(best(F.col("who")).alias("who"), F.sum("n").alias("n")))
        levels.append(materialise(merged.sortWithinPartitions(*_KEY), "dedup-run"))
    winners = levels[-1]
    for below in reversed(levels[:-1]):
        up = winners.withColumnRenamed("run", "up")
        winners = (below.select(*_KEY, "run", F.floor(F.col("run") / fan_in).cast("int").alias("up"))
                   .join(up, [*_KEY, "up"]).drop("up"))
    out = rows.join(winners, [*_KEY, "run"])
    return out.select(
        F.col("id").alias(id_col), F.col("who.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("who.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``: of equal texts the row with the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns."""
    found = exact_dedup(docs, id_col, text_col, keep).where("kept")

    def key(i: Column, digest: Column) -> Column:
        return F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("-")), digest)

    text = F.coalesce(ascii_lower(col(text_col).cast("string")), F.lit(""))
    return keep_rows(docs, found.select(key(F.col(id_col), F.col("text_sha256"))),
                     lambda: key(col(id_col), F.sha2(text.cast("binary"), 256)))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
