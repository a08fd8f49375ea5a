"""Positions in a sorted order, average ranks and Kendall's tau for groups of any size.

A global order is a range-partitioned sort written once. Each row then knows its sorted part and its place
there, so a position is that place plus the rows of earlier parts: one row per part, no pass over the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knnhard.session import keep

_PLACE_BITS = 33  # monotonically_increasing_id: part number above, place in the part below


def sorted_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted by ``order`` over all parts and written, with ``_part`` and ``_at``, the place in that part."""
    numbered = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    return keep(numbered.select(*df.columns, F.shiftright("_m", _PLACE_BITS).alias("_part"),
                                F.col("_m").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_at")))


def _from_parts(rows: DataFrame, weight) -> DataFrame:
    """Adds ``_start``: the weight of all earlier parts. One row per part (at most the shuffle partitions) is broadcast."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy("_part").agg(weight.alias("_t"))
    start = total.select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(start), "_part")


def positions(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the 0-based position of each row in ``order`` over all rows."""
    placed = _from_parts(sorted_rows(df, order), F.count(F.lit(1)))
    return placed.select(*df.columns, (F.col("_start") + F.col("_at")).alias(out))


def average_ranks(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Adds ``out``: the 1-based rank of ``col`` within its group, ties averaged; rows with a null ``col`` go.

    Ranks belong to the distinct values, which are counted before they are sorted, so a value held by a
    third of all rows is one row of the sort; the rows then look their value up by a join.
    """
    values = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    rows = _from_parts(sorted_rows(values, [*keys, col]), F.sum("_c"))
    earlier = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_g", F.col("_start") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    names = {c: f"_k{i}" for i, c in enumerate([*keys, col])}
    group = [names[k] for k in keys]
    rows = rows.withColumnsRenamed(names).select(*names.values(), "_c", "_g")
    first = rows.groupBy(*group).agg(F.min("_g").alias("_s")).withColumnsRenamed({k: f"{k}s" for k in group})
    same = F.lit(True)
    for k in group:
        same &= F.col(k).eqNullSafe(F.col(f"{k}s"))
    ranks = rows.join(first, same).select(*names.values(), (F.col("_g") - F.col("_s") + (F.col("_c") + 1) / 2).alias(out))
    found = F.lit(True)
    for c, k in names.items():
        found &= df[c].eqNullSafe(F.col(k))
    return df.join(ranks, found).drop(*names.values())


def spearman(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Spearman matrix per group: Pearson correlation of average ranks (I7), all pairs in one aggregate."""
    r = df.select(*keys, *cols)
    for i, c in enumerate(cols):
        r = average_ranks(r, keys, c, f"_r{i}")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    wide = r.groupBy(*keys).agg(*[F.corr(f"_r{i}", f"_r{j}").alias(f"_c{n}") for n, (i, j) in enumerate(pairs)])
    long = F.array(*[F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), F.col(f"_c{n}").alias("rho"))
                     for n, (i, j) in enumerate(pairs)])
    return wide.select(*keys, F.explode(long).alias("_p")).select(*keys, "_p.*")


# ------------------------------------------------------------- Kendall

def earlier_larger(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each element of the permutation ``v`` of 0..m-1 the weight of the earlier elements that are larger.

    From the highest bit down, elements that agree in all higher bits lie side by side in their first order;
    one whose bit is 0 then meets, among those before it with bit 1, exactly the larger ones that first
    differ from it here.
    """
    m = len(v)
    out, at, place = np.zeros(m), np.arange(m), np.arange(m)
    v, w = v.astype(np.int64), w.astype(float)
    for bit in reversed(range(max(m - 1, 0).bit_length())):
        one = (v >> bit) & 1
        start = (v >> (bit + 1)) << (bit + 1)  # where the elements of the same higher bits begin
        weight = np.cumsum(one * w) - one * w
        ones = np.cumsum(one) - one
        ones -= ones[start]
        gain = weight - weight[start]
        zero = one == 0
        out[at[zero]] += gain[zero]
        to = np.where(zero, place - ones, start + (1 << bit) + ones)
        moved_v, moved_w, moved_at = np.empty_like(v), np.empty_like(w), np.empty_like(at)
        moved_v[to], moved_w[to], moved_at[to] = v, w, at
        v, w, at = moved_v, moved_w, moved_at
    return out


def _rank_of(a: np.ndarray) -> np.ndarray:
    """Position of each element in the sorted order, equal elements in their given order."""
    r = np.empty(len(a), dtype=np.int64)
    r[np.argsort(a, kind="stable")] = np.arange(len(a))
    return r


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall tau-b of two arrays: discordant pairs are the inversions of y in (x, y) order (Knight)."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    n = len(x)
    if n < 2:
        return float("nan")
    o = np.lexsort((y, x))
    x, y = x[o], y[o]

    def ties(*cols):
        _, c = np.unique(np.stack(cols, 1), axis=0, return_counts=True)
        return float((c * (c - 1) / 2).sum())
    n0, n1, n2, n3 = n * (n - 1) / 2, ties(x), ties(y), ties(x, y)
    nd = earlier_larger(_rank_of(y), np.ones(n)).sum()
    den = math.sqrt((n0 - n1) * (n0 - n2))
    return (n0 - n1 - n2 + n3 - 2 * nd) / den if den > 0 else float("nan")


def kendall(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], block: int = 1 << 18) -> DataFrame:
    """Kendall tau-b per group for each (x, y) column pair (I6): ``(keys..., x, y, tau)``; NULL when undefined.

    Equal points of a group are counted once, with their number as weight, before anything is sorted. A point has
    two positions over all points: ``_g`` by (group, x, y) and ``_h`` by (group, y, _g). A pair is discordant
    exactly when the two positions order it differently, and no pair of two groups is. Positions are cut into
    blocks of ``block`` points, whatever the groups, and each discordant pair is counted once:

    * both in one block of ``_g``: inside that block;
    * in different blocks of ``_g``, one block of ``_h``: inside the block of ``_h``;
    * different in both: from the weights of (block of _g, block of _h) cells by two running sums.

    A task holds one block. The cells of a group of n points are (n / block)^2, fewer than its points up to block^2.
    """
    group = [*keys, "x", "y"]

    def finite(c):
        v = F.col(c).cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def point(a, b):
        ok = finite(a) & finite(b)
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.when(ok, F.col(a).cast("double") + 0.0).alias("_x"),
                        F.when(ok, F.col(b).cast("double") + 0.0).alias("_y"))  # + 0.0: no negative zero
    long = df.select(*keys, F.explode(F.array(*[point(a, b) for a, b in pairs])).alias("_p")).select(*keys, "_p.*")
    points = keep(long.groupBy(*group, "_x", "_y").agg(F.count(F.lit(1)).alias("_w")))
    by_x = positions(points.where("_x IS NOT NULL"), [*group, "_x", "_y"], "_g")
    by_y = positions(by_x.select(*group, "_y", "_w", "_g"), [*group, "_y", "_g"], "_h")
    placed = by_y.select(*group, "_w", "_g", "_h", F.floor(F.col("_g") / block).alias("_p"), F.floor(F.col("_h") / block).alias("_r"))
    schema = T.StructType([placed.schema[c] for c in group] + [T.StructField("nd", T.DoubleType())])

    def inside(first: str):
        """Discordant weight of the points of one block, taken by ``first`` and then by ``_h``."""
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.iloc[np.lexsort((pdf["_h"].to_numpy(), pdf[first].to_numpy()))]
            w = pdf["_w"].to_numpy(float)
            nd = w * earlier_larger(_rank_of(pdf["_h"].to_numpy()), w)
            return pdf[group].assign(nd=nd).groupby(group, dropna=False, sort=False, as_index=False)["nd"].sum()
        return count
    same_g = placed.groupBy("_p").applyInPandas(inside("_g"), schema)
    same_h = placed.groupBy("_r").applyInPandas(inside("_p"), schema)

    cells = keep(placed.groupBy(*group, "_p", "_r").agg(F.sum(F.col("_w").cast("double")).alias("_n")))
    span = cells.groupBy(*group).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi")).where("_lo < _hi")
    blocks = F.sequence("_lo", "_hi")  # a group takes the same blocks in both orders
    empty = span.select(*group, F.explode(blocks).alias("_p"), "_lo", "_hi").select(
        *group, "_p", F.explode(blocks).alias("_r"), F.lit(0.0).alias("_n"))
    grid = cells.unionByName(empty).groupBy(*group, "_p", "_r").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*group, "_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    larger = Window.partitionBy(*group, "_p").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_e", F.sum("_n").over(earlier)).withColumn("_f", F.sum("_e").over(larger))
    apart = grid.groupBy(*group).agg(F.sum(F.col("_n") * F.coalesce("_f", F.lit(0.0))).alias("nd"))

    def two_of(c):
        return F.col(c).cast("double") * (F.col(c).cast("double") - 1) / 2

    def tied(col, name):
        held = points.where("_x IS NOT NULL").groupBy(*group, col).agg(F.sum("_w").alias("_c"))
        return held.groupBy(*group).agg(F.sum(two_of("_c")).alias(name))
    real = F.col("_x").isNotNull()
    parts = [points.groupBy(*group).agg(F.sum(F.when(real, F.col("_w")).otherwise(0)).cast("double").alias("n"),
                                        F.sum(F.when(real, two_of("_w")).otherwise(0.0)).alias("n3")),
             tied("_x", "n1"), tied("_y", "n2"), same_g, same_h, apart]
    sums = ["n", "n1", "n2", "n3", "nd"]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    t = every.groupBy(*group).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums])
    n0 = F.col("n") * (F.col("n") - 1) / 2
    s = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("nd")
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return t.select(*group, F.when((F.col("n") >= 2) & (den > 0), s / den).alias("tau"))
