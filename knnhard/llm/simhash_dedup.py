"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``radius`` bits have a common point within half the
radius of each. So every distinct fingerprint emits all points of that ball (for radius 2: itself
and its 64 single flips), and fingerprints that meet on a point are candidates, verified by their
own distance. The work is per distinct fingerprint, and a point meets at most as many fingerprints
as the ball has points, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knnhard.llm._common import attach, col, keep_rows, materialise, table
from knnhard.llm.components import components

_CHUNK = 4096
_SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of the word shingles (repeats count), as an unsigned integer.

    Words are split at ASCII white space after lower-casing A-Z; fewer words than a shingle are
    one shingle; a text without words has fingerprint 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        hashes: Iterator[int] | list[int] = [digest(line, _SEED)]
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = (digest(line[a:b], _SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist()))
    h = np.fromiter(hashes, np.uint64, n).astype("<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        ones += np.unpackbits(h[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, key, fp): the id, a 64-bit digest of the text, the fingerprint as a signed long."""
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("key"),
                       col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=["id", "key", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key long, fp long")


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed integers."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near_pairs(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``radius`` bits, from distinct ``classes.fp``.

    The members of a point's bucket lie within half the radius of the point, so within the radius
    of each other (verified again); a star on the smallest member carries all links of the bucket.
    """
    if radius % 2:
        raise ValueError("the radius must be even: it is met in the middle")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    points = classes.select("fp", F.explode(masks).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp")
    least = F.min("fp").over(Window.partitionBy("point"))
    pairs = points.select(least.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  radius: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, group_size,
    representative, text_key (xxhash64 of the text).

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits
    (null only if no row of the component has an id). ``representative`` marks the component's
    smallest (id, text digest); rows that repeat both are all marked. Null and empty texts have
    fingerprint 0 and are linked like any other. An empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    who = F.struct(F.col("id").isNull().alias("unknown"), "id", "key")
    classes = materialise(rows.groupBy("fp").agg(F.min(who).alias("who"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = materialise(components(near_pairs(classes.select("fp"), radius)), "simhash-roots")
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "who", "n", F.coalesce("root", "fp").alias("root"))
    best = linked.groupBy("root").agg(F.min("who").alias("best"), F.sum("n").alias("group_size"))
    found = materialise(attach(linked.select("fp", "root"), "root", best, F.col("fp")).drop("root"), "simhash-found")
    out = attach(rows, "fp", found, F.xxhash64("id", "key"))
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"), "group_size",
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))).alias("representative"),
        F.col("key").alias("text_key"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     radius: int = 2) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component of simhash_dedup."""
    def key(i: Column, k: Column) -> Column:
        return F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("-")), k.cast("string"))

    found = simhash_dedup(docs, id_col, text_col, shingle, radius).where("representative")
    return keep_rows(docs, found.select(key(col(id_col), F.col("text_key"))),
                     lambda: key(col(id_col), F.xxhash64(col(text_col))))
