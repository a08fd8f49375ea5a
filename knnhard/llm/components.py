"""Connected components of a distributed edge table (alternating large and small stars)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knnhard.llm._common import attach, materialise

_MAX_ROUNDS = 200


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by a spanning star of every component they form."""
    for b in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            ru, rv = find(u), find(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
        pairs = [(x, find(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns): root is the smallest node reachable.

    The edges never leave the executors; each round is cut by a written table, and the driver sees
    two numbers of it. A round: every node hands its larger neighbours to its smallest neighbour
    (large star), then all its smaller ones (small star). A node with very many edges is split by
    salt (``attach``), its smallest neighbour comes from a map-side combined minimum.
    """
    e = edges.toDF("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long")
    now = materialise(e.distinct(), "cc-edges")
    mark = None
    for _ in range(_MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attach(both, "u", least, F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "cc-large")
        # every edge now points from the larger to the smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, "u", least, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(least.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct(), "cc-edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {_MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
