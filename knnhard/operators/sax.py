"""Data-series summaries and pruned exact search.

A SAX index is expressed as tables rather than a tree in memory:

* ``summary(id, v, paa, sax)``: PAA means per segment and 8-bit SAX symbols;
* ``leaves(id, bits, prefix, bucket)``: the leaf ("bucket") of each series.
  A bucket is a vector of per-segment bit depths and symbol prefixes; buckets
  are produced level-synchronously (every over-full bucket of a level is
  split in the same Spark job), so the result does not depend on insertion
  order or threads.

Pruned exact k-NN is a two-phase plan: phase 1 computes the distances to
the series of the bucket(s) nearest to the query and takes the k-th as the
best-so-far; phase 2 keeps only buckets, then series, whose lower bound does
not exceed it (equal ones may hold an equal distance with a smaller id).
Counting the series whose distance was computed gives the hardness (share of
the data compared).

Queries and buckets meet through the root groups (at most ``2^w``, whatever
the number of series): a query orders the groups by the bound of their
envelope, and only the groups it enters are joined, on the root key, with
their buckets. Phase 1 walks the groups in rounds of doubling size, one job
each, until the buckets found certainly hold the nearest ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import scan
from knnhard.operators.quantiles import exact_quantiles
from knnhard.session import keep

CARD_BITS = 8
# bytes of probe keys sent to every task
_PROBE_BYTES = 128 * 1024 * 1024


def _shl(c, n):
    return F.call_function("shiftleft", c, n if isinstance(n, Column) else F.lit(n))


def _shr(c, n):
    return F.call_function("shiftright", c, n if isinstance(n, Column) else F.lit(n))

N_SYMBOLS = 1 << CARD_BITS  # 256 cells, 255 breakpoints

# The reference's fixed 8-bit breakpoint table is, to 5e-15, the
# odd cubic  bp(t) = A*t^3 + B*t  at t = j - 128 for j = 1..255.
FIXED_A = 5.418101402335389e-07
FIXED_B = 0.007796887414798071


def fixed_breakpoints() -> list[float]:
    """The 255 fixed breakpoints (ascending)."""
    return [FIXED_A * (j - 128) ** 3 + FIXED_B * (j - 128) for j in range(1, N_SYMBOLS)]


def segment_lengths(length: int, w: int) -> list[int]:
    """``w`` segments; the first ``length % w`` are one longer."""
    base, rem = divmod(length, w)
    return [base + (1 if i < rem else 0) for i in range(w)]


# ------------------------------------------------------------------ PAA

def paa_expr(col, w: int) -> Column:
    """PAA means of ``w`` segments for any row length (F1)."""
    v = vec.dvec(col)
    n = F.size(v)
    base = F.floor(n / w).cast("int")
    rem = (n - base * w).cast("int")

    def seg(i):
        ln = base + F.when(i < rem, 1).otherwise(0)
        off = i * base + F.least(i, rem)
        return vec.vsum(F.slice(v, off + 1, ln)) / ln
    return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), seg)


def paa(df: DataFrame, w: int, col: str = "v") -> DataFrame:
    return df.withColumn("paa", paa_expr(col, w))


def exploded_paa(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("paa").alias("seg", "x"))


# ----------------------------------------------------------- breakpoints

def breakpoints_fixed(w: int) -> list[list[float]]:
    """Fixed table for every segment (F2)."""
    b = fixed_breakpoints()
    return [b for _ in range(w)]


def breakpoints_adhoc(summary: DataFrame, w: int) -> DataFrame:
    """Data-driven breakpoints per segment: quantiles j/256 of the PAA
    values of that segment (F3); ``(seg, j, bp)``."""
    probs = [j / N_SYMBOLS for j in range(1, N_SYMBOLS)]
    q = exact_quantiles(exploded_paa(summary), ["seg"], "x", probs)
    return q.select("seg", F.round(F.col("p") * N_SYMBOLS).cast("int").alias("j"), F.col("q").alias("bp"))


def breakpoints_shared(summary: DataFrame) -> DataFrame:
    """Shared data-driven breakpoints over all segments (F4); ``(j, bp)``."""
    probs = [j / N_SYMBOLS for j in range(1, N_SYMBOLS)]
    q = exact_quantiles(exploded_paa(summary), [], "x", probs)
    return q.select(F.round(F.col("p") * N_SYMBOLS).cast("int").alias("j"), F.col("q").alias("bp"))


def bp_matrix(bp: DataFrame, w: int) -> list[list[float]]:
    """Collect a (small, w x 255) breakpoint table to literal form."""
    rows = bp.collect()
    if "seg" in bp.columns:
        m = [[0.0] * (N_SYMBOLS - 1) for _ in range(w)]
        for r in rows:
            m[r["seg"]][r["j"] - 1] = float(r["bp"])
        return m
    one = [0.0] * (N_SYMBOLS - 1)
    for r in rows:
        one[r["j"] - 1] = float(r["bp"])
    return [one for _ in range(w)]


def breakpoint_profile(summary: DataFrame) -> DataFrame:
    """Mean and population variance of the PAA values per segment."""
    return exploded_paa(summary).groupBy("seg").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def _bp_lit(bps: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in bps])


# ------------------------------------------------------------------ SAX

def sax_expr(paa_col, bps: list[list[float]]) -> Column:
    """8-bit symbol per segment: number of breakpoints <= value (F6), by binary search, one bit at a time."""
    B = _bp_lit(bps)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(CARD_BITS))])

    def symbol(x: Column, i: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(
            F.element_at(F.element_at(B, i + 1), at + step) <= x, step).otherwise(F.lit(0)))

    return F.transform(F.col(paa_col) if isinstance(paa_col, str) else paa_col, symbol)


def summarise(series: DataFrame, w: int, bps: list[list[float]] | None = None) -> DataFrame:
    """``(id, v, paa, sax)`` with fixed breakpoints unless given."""
    s = paa(series, w)
    return s.withColumn("sax", sax_expr("paa", bps or breakpoints_fixed(w)))


def root_key(sax_col="sax") -> Column:
    """Most significant bit of every segment packed into an int."""
    return F.aggregate(F.col(sax_col), F.lit(0), lambda a, s: a * 2 + _shr(s, CARD_BITS - 1))


def prefix_expr(sax_col="sax", bits_col="bits") -> Column:
    return F.zip_with(F.col(sax_col), F.col(bits_col), lambda s, b: _shr(s, F.lit(CARD_BITS) - b))


def bucket_name(bits_col="bits", prefix_col="prefix") -> Column:
    """Readable bucket key ``'b0:p0,b1:p1,...'``."""
    return F.concat_ws(",", F.zip_with(F.col(bits_col), F.col(prefix_col),
                                       lambda b, p: F.concat(b.cast("string"), F.lit(":"), p.cast("string"))))


# ------------------------------------------------------ bucket splitting

def _split_choice_next_bit(w: int) -> Column:
    """Segment whose next bit is most balanced; ties: fewer bits, then lower index (F8)."""
    cands = F.array(*[F.struct(F.abs(F.lit(2) * F.col(f"ones{i}") - F.col("size")).alias("diff"),
                               F.element_at("bits", i + 1).alias("b"), F.lit(i).alias("i")) for i in range(w)])
    ok = F.filter(cands, lambda s: s.getField("b") < CARD_BITS)
    return F.array_min(ok).getField("i")


def _split_choice_distribution(w: int, bps: list[list[float]]) -> Column:
    """Segment whose next-level breakpoint is closest to the PAA mean in
    standard deviations ``|bp - mean| / std``; ties: fewer bits (F9)."""
    B = _bp_lit(bps)
    items = []
    for i in range(w):
        b = F.element_at("bits", i + 1)
        p = F.element_at("prefix", i + 1)
        # 1-based breakpoint position; a segment with all its bits has none left and is filtered out below
        pos = _shl(p * 2 + 1, F.greatest(F.lit(CARD_BITS - 1) - b, F.lit(0)))
        bp = F.element_at(F.element_at(B, i + 1), F.least(pos, F.lit(N_SYMBOLS - 1)))
        mean = F.col(f"sx{i}") / F.col("size")
        std = F.sqrt(F.greatest(F.lit(0.0), F.col(f"sxx{i}") / F.col("size") - mean * mean))
        score = F.when(std > 0, F.abs(bp - mean) / std).otherwise(F.lit(float("inf")))
        items.append(F.struct(score.alias("score"), b.alias("b"), F.lit(i).alias("i")))
    ok = F.filter(F.array(*items), lambda s: s.getField("b") < CARD_BITS)
    return F.array_min(ok).getField("i")


def words(summary: DataFrame, w: int, policy: str = "next_bit") -> DataFrame:
    """Distinct SAX words with their numbers of series (and the sums of their PAA, which the
    distribution policy needs) and the root bucket: splitting needs no more of the series."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if policy != "next_bit":
        for i in range(w):
            x = F.element_at("paa", i + 1)
            aggs += [F.sum(x).alias(f"wx{i}"), F.sum(x * x).alias(f"wxx{i}")]
    return (summary.groupBy("sax").agg(*aggs).withColumn("bits", F.array_repeat(F.lit(1), w))
            .withColumn("prefix", prefix_expr("sax", "bits")))


def _node_stats(state: DataFrame, w: int, policy: str) -> DataFrame:
    aggs = [F.sum("n").alias("size")]
    for i in range(w):
        b = F.element_at("bits", i + 1)
        s = F.element_at("sax", i + 1)
        if policy == "next_bit":
            nb = F.when(b < CARD_BITS, _shr(s, F.lit(CARD_BITS - 1) - b).bitwiseAND(1)).otherwise(0)
            aggs.append(F.sum(nb * F.col("n")).alias(f"ones{i}"))
        else:
            aggs += [F.sum(f"wx{i}").alias(f"sx{i}"), F.sum(f"wxx{i}").alias(f"sxx{i}")]
    return state.groupBy("bits", "prefix").agg(*aggs)


def split_level(state: DataFrame, w: int, leaf_size: int, policy: str = "next_bit",
                bps: list[list[float]] | None = None) -> DataFrame:
    """One level over ``words``: every bucket with more than ``leaf_size`` series and a segment left to
    refine gets one more bit in the chosen segment. Adds ``moved``: whether the word's bucket was split."""
    st = _node_stats(state, w, policy)
    over = st.where((F.col("size") > leaf_size) & F.exists("bits", lambda b: b < CARD_BITS))
    choice = _split_choice_next_bit(w) if policy == "next_bit" else _split_choice_distribution(w, bps or breakpoints_fixed(w))
    dec = over.select("bits", "prefix", choice.alias("split_seg")).where(F.col("split_seg").isNotNull())
    j = state.join(dec, ["bits", "prefix"], "left")
    nb = F.transform("bits", lambda b, i: F.when(F.col("split_seg") == i, b + 1).otherwise(b))
    j = j.withColumn("moved", F.col("split_seg").isNotNull()).withColumn("bits", nb).drop("split_seg")
    return j.withColumn("prefix", prefix_expr("sax", "bits"))


def split_words(summary: DataFrame, w: int, leaf_size: int, policy: str = "next_bit",
                bps: list[list[float]] | None = None, max_levels: int | None = None) -> DataFrame:
    """Adaptive buckets of the distinct words, ``(sax, bits, prefix)`` (F8/F9): start from the root
    buckets (1 bit per segment) and split level by level until no bucket is over-full or
    splittable (a bucket whose rows agree on all bits stays over-full, Q25).

    A level is one written table (which cuts the lineage) of the words whose bucket was split
    at the level before; words that come to rest are not read again.
    """
    levels = max_levels if max_levels is not None else w * (CARD_BITS - 1)
    rest, live = None, keep(words(summary, w, policy))
    for _ in range(levels):
        now = keep(split_level(live, w, leaf_size, policy, bps))
        still = now.where("NOT moved").select("sax", "bits", "prefix")
        rest = still if rest is None else rest.unionByName(still)
        live = now.where("moved").drop("moved")
        if live.isEmpty():
            return rest
    last = live.select("sax", "bits", "prefix")
    return last if rest is None else rest.unionByName(last)


def build_leaves(summary: DataFrame, w: int, leaf_size: int, policy: str = "next_bit",
                 bps: list[list[float]] | None = None, max_levels: int | None = None,
                 ) -> DataFrame:
    """The bucket of every series ``(id, bits, prefix, bucket)``: the series' words meet the split words once."""
    leaf = keep(split_words(summary, w, leaf_size, policy, bps, max_levels))
    return summary.select("id", "sax").join(leaf, "sax").select("id", "bits", "prefix", bucket_name().alias("bucket"))


def bucket_stats(leaves: DataFrame) -> DataFrame:
    """Series per leaf, number of leaves, used roots, deepest bits."""
    root = F.aggregate(F.zip_with("prefix", "bits", lambda p, b: _shr(p, b - 1)), F.lit(0),
                       lambda a, s: a * 2 + s)
    per = leaves.groupBy("bucket", "bits", "prefix").agg(F.count(F.lit(1)).alias("size"))
    return per.agg(F.count(F.lit(1)).alias("n_leaves"), F.sum("size").alias("n_series"),
                   F.max("size").alias("max_leaf"), F.min("size").alias("min_leaf"),
                   F.max(F.aggregate("bits", F.lit(0), lambda a, b: a + b)).alias("max_total_bits"),
                   F.count_distinct(root).alias("n_roots"))


def bucket_envelope(summary: DataFrame, leaves: DataFrame) -> DataFrame:
    """Tight bucket summary (a): min/max of the PAA per segment."""
    e = summary.select("id", F.posexplode("paa").alias("seg", "x")).join(leaves.select("id", "bucket"), "id")
    return e.groupBy("bucket", "seg").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def bucket_prefix(summary: DataFrame, leaves: DataFrame) -> DataFrame:
    """Tight bucket summary (b): longest common SAX prefix (bits) per segment."""
    e = summary.select("id", F.posexplode("sax").alias("seg", "s")).join(leaves.select("id", "bucket"), "id")
    g = e.groupBy("bucket", "seg").agg(F.bit_and("s").alias("a"), F.bit_or("s").alias("o"))
    diff = F.col("a").bitwiseXOR(F.col("o"))
    # leading equal bits of an 8-bit symbol = 8 - bit_length(a xor o)
    bl = F.when(diff == 0, 0).otherwise(F.floor(F.log2(diff)) + 1)
    return g.select("bucket", "seg", (F.lit(CARD_BITS) - bl).cast("int").alias("common_bits"))


def bucket_compactness(summary: DataFrame, leaves: DataFrame, metric: str = "euclidean",
                       block: int = 512) -> DataFrame:
    """Mean pairwise distance inside each bucket; 0 for one series.

    Exact over all pairs of a bucket, but the pair work of a bucket is split
    into hashed sub-blocks of about ``block`` series: the join key is
    ``(bucket, block_a, block_b)``, so a bucket that could not be split (and
    may hold a large share of the rows) is spread over ``nb^2`` tasks
    instead of landing in one.
    """
    s = summary.select("id", "v").join(leaves.select("id", "bucket"), "id")
    sizes = leaves.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(block))).cast("int")
    s = s.join(sizes.select("bucket", nb.alias("nb")), "bucket")
    blk = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    a = s.select("bucket", blk.alias("ba"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"),
                 F.col("id").alias("i"), F.col("v").alias("vi"))
    b = s.select("bucket", blk.alias("bb"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("ba"),
                 F.col("id").alias("j"), F.col("v").alias("vj"))
    # key (bucket, ba, bb): about block x block rows per side and task
    pairs = a.join(b, ["bucket", "ba", "bb"]).where(F.col("i") < F.col("j"))
    m = pairs.groupBy("bucket").agg(F.avg(vec.metric_distance("vi", "vj", metric)).alias("compactness"))
    return sizes.join(m, "bucket", "left").select(
        "bucket", "size", F.when(F.col("size") == 1, F.lit(0.0)).otherwise(F.col("compactness")).alias("compactness"))


# ---------------------------------------------------------- lower bounds

def cell_lb_expr(qpaa: Column, bits: Column, prefix: Column, seglens: list[int], bps: list[list[float]]) -> Column:
    """Squared lower bound between a query PAA and a SAX cell given by
    per-segment ``bits``/``prefix`` (F12): ``sum len_i * gap_i^2`` with the
    gap to the cell interval; each segment weighted by its own length (Q7)."""
    B = _bp_lit(bps)
    L = F.array(*[F.lit(float(x)) for x in seglens])
    inf = F.lit(float("inf"))

    def term(acc, i):
        b = F.element_at(bits, i + 1)
        p = F.element_at(prefix, i + 1)
        x = F.element_at(qpaa, i + 1)
        row = F.element_at(B, i + 1)
        lo_pos = _shl(p, F.lit(CARD_BITS) - b)
        hi_pos = _shl(p + 1, F.lit(CARD_BITS) - b)
        lo = F.when(lo_pos == 0, -inf).otherwise(F.element_at(row, F.greatest(lo_pos, F.lit(1))))
        hi = F.when(hi_pos >= N_SYMBOLS, inf).otherwise(F.element_at(row, F.least(hi_pos, F.lit(N_SYMBOLS - 1))))
        gap = F.greatest(lo - x, x - hi, F.lit(0.0))
        return acc + F.element_at(L, i + 1) * gap * gap
    return F.aggregate(F.sequence(F.lit(0), F.size(qpaa) - 1), F.lit(0.0), term)


def cell_bounds_expr(bits: Column, prefix: Column, bps: list[list[float]]) -> Column:
    """Per-segment interval ``struct(lo array, hi array)`` of a SAX cell."""
    B = _bp_lit(bps)
    inf = F.lit(float("inf"))

    def bound(upper: bool):
        def f(b, i):
            p = F.element_at(prefix, i + 1) + (1 if upper else 0)
            pos = _shl(p, F.lit(CARD_BITS) - b)
            row = F.element_at(B, i + 1)
            if upper:
                return F.when(pos >= N_SYMBOLS, inf).otherwise(F.element_at(row, F.least(pos, F.lit(N_SYMBOLS - 1))))
            return F.when(pos == 0, -inf).otherwise(F.element_at(row, F.greatest(pos, F.lit(1))))
        return F.transform(bits, f)
    return F.struct(bound(False).alias("lo"), bound(True).alias("hi"))


def envelope_lb_expr(qpaa: Column, lo: Column, hi: Column, seglens: list[int]) -> Column:
    """Squared lower bound to a PAA min/max envelope (F12, envelope level)."""
    L = F.array(*[F.lit(float(x)) for x in seglens])
    return F.aggregate(F.sequence(F.lit(0), F.size(qpaa) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(L, i + 1) * F.pow(
        F.greatest(F.element_at(lo, i + 1) - F.element_at(qpaa, i + 1),
                   F.element_at(qpaa, i + 1) - F.element_at(hi, i + 1), F.lit(0.0)), 2))


def _cell_bounds(x: np.ndarray, known: np.ndarray, lo: np.ndarray, hi: np.ndarray, lens: list[float]) -> np.ndarray:
    """Lower bound of every query PAA to every cell, in the order of ``cell_lb_expr``; a segment that is not ``known`` (NULL) has no gap."""
    acc = np.zeros((len(x), len(lo)))
    for i, length in enumerate(lens):
        at = x[:, i, None]
        gap = np.maximum(np.maximum(lo[:, i] - at, at - hi[:, i]), 0.0)
        gap[known[:, i] == 0] = 0.0
        acc += length * gap * gap
    return np.sqrt(acc)


def _met_bounds(summary: DataFrame, queries: DataFrame, w: int, seglens: list[int], bps: list[list[float]], body, schema: str,
                row_bytes: int = 0) -> DataFrame:
    """Rows that ``body(side, part, tiles)`` yields where queries and the cells of series meet block by block; ``tiles`` are
    ``(ids, bounds of a block's queries to them as a function of rows)``. Rows without an id are left out."""
    lens = [float(x) for x in seglens]
    cells = summary.where(F.col("id").isNotNull()).select(
        "id", cell_bounds_expr(F.array_repeat(F.lit(CARD_BITS), w), F.col("sax"), bps).alias("cb")).select("id", F.concat("cb.lo", "cb.hi").alias("v"))
    q = queries.where(F.col("qid").isNotNull()).select("qid", paa_expr("qv", w).alias("p")).select("qid", F.concat(
        F.transform("p", lambda x: F.coalesce(x, F.lit(0.0))), F.transform("p", lambda x: x.isNotNull().cast("double"))).alias("qv"))

    def tiles(Q, batches):
        for ids, row in scan._tiles(batches, "id", "v"):
            yield ids, lambda rows, row=row: _cell_bounds(Q[rows, :w], Q[rows, w:], row[:, :w], row[:, w:], lens)

    def met(side, pid, batches):
        qids, Q = side
        if len(qids):
            yield from body(qids, pid, tiles(Q, batches))

    return scan._meet(keep(cells), keep(q), met, schema, row_bytes=row_bytes)


def series_lower_bounds(summary: DataFrame, queries: DataFrame, w: int, seglens: list[int],
                        bps: list[list[float]] | None = None, exclude_self: bool = False) -> DataFrame:
    """Series-level bound ``(qid, id, lb)`` (sqrt of the squared bound) of every pair; ``exclude_self``: but those of a series with itself
    (and, as of any comparison, those without an id). A task holds one tile of pairs at once."""
    def body(qids, pid, tiles):
        for ids, bounds in tiles:
            step = max(1, scan._CHUNK_ELEMS // len(ids))
            for a in range(0, len(qids), step):
                rows = slice(a, a + step)
                lb = bounds(rows)
                ok = ~scan._self_mask(qids, ids, rows) if exclude_self else np.ones(lb.shape, dtype=bool)
                rr, cc = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows][rr], pa.int64()), pa.array(ids[cc], pa.int64()), pa.array(lb[ok])],
                                                 names=["qid", "id", "lb"])

    bps = bps or breakpoints_fixed(w)
    met = _met_bounds(summary, queries, w, seglens, bps, body, "qid long, id long, lb double")
    if exclude_self:
        return met
    # rows without an id have bounds as well
    full = F.array_repeat(F.lit(CARD_BITS), w)
    q = queries.select("qid", paa_expr("qv", w).alias("qpaa"))
    rest = summary.select("id", "sax").join(q, F.col("id").isNull() | F.col("qid").isNull())
    lb = F.sqrt(cell_lb_expr(F.col("qpaa"), full, F.col("sax"), seglens, bps)).alias("lb")
    return met.unionByName(rest.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id"), lb))


def least_bounds(summary: DataFrame, queries: DataFrame, w: int, seglens: list[int], bps: list[list[float]], m: int,
                 exclude_self: bool = False) -> DataFrame:
    """The ``m`` series of the least bounds of every query by (lb, id): ``(qid, id)``. A block hands over m rows a query, not its pairs."""
    def body(qids, pid, tiles):
        best_d, best_i = np.full((len(qids), m), np.inf), np.zeros((len(qids), m), dtype=np.int64)
        for ids, bounds in tiles:
            step = max(1, scan._CHUNK_ELEMS // max(len(ids), 2 * m))
            for a in range(0, len(qids), step):
                rows = slice(a, a + step)
                lb = bounds(rows)
                lb[~np.isfinite(lb)] = np.finfo(float).max  # what is no number comes last, by id
                may = ~scan._self_mask(qids, ids, rows) if exclude_self else np.ones(lb.shape, dtype=bool)
                limit = best_d[rows, -1].copy()
                open_ = np.flatnonzero(np.isinf(limit))
                if len(open_) and len(ids) > m:  # the pair with itself may be one of the m + 1 least
                    limit[open_] = np.partition(lb[open_], m, axis=1)[:, m]
                may &= lb <= limit[:, None]
                rr, cc = scan._true(may)
                scan._enter_lists(best_d, best_i, rr + a, lb[rr, cc], ids[cc])
        step = max(1, scan._CHUNK_ELEMS // m)
        for a in range(0, len(qids), step):
            d, i = best_d[a:a + step], best_i[a:a + step]
            yield pa.RecordBatch.from_arrays([pa.array(qids[a:a + step], pa.int64()), pa.array(np.full(len(d), pid), pa.int32()), scan._top(d, i)],
                                             names=["qid", "pid", "top"])

    parts = _met_bounds(summary, queries, w, seglens, bps, body, f"qid long, pid int, top {scan.TOP_TYPE}", row_bytes=40 * m)

    def top() -> Column:
        return F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, m).alias("top")

    lists = parts.groupBy("qid", F.pmod("pid", F.lit(scan.SALTS)).alias("salt")).agg(top()).groupBy("qid").agg(top())
    return lists.select("qid", F.explode("top").alias("t")).select("qid", "t.id")


# ------------------------------------------------------ pruned search

# widest word whose root groups (2^w envelopes) go to every task
MAX_WORD = 16
# share of the distances' scale by which rounding may lift a bound over the distance it bounds
_ROUNDING = 1e-12


def bucket_table(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("bucket", "bits", "prefix").agg(F.count(F.lit(1)).alias("size"))


def reach_expr(bsf: Column, q_norm: Column) -> Column:
    """Largest bound that may belong to a distance of ``bsf`` or less: ``bsf`` and the rounding of both."""
    return bsf + F.lit(_ROUNDING) * (bsf + q_norm)


def _seed_buckets(qb: DataFrame, k: int) -> DataFrame:
    """Buckets by ascending lower bound until they hold k series. Every
    bucket holds at least one series, so only the k lowest bounds can be
    needed: a ``row_number <= k`` filter (limited per map partition before
    the shuffle) bounds the window, then the running size is taken over at
    most k rows per query."""
    w = Window.partitionBy("qid").orderBy("blb", "bucket")
    top = qb.withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= k)
    cum = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.withColumn("cum", cum).where(F.col("cum") - F.col("size") < k).select("qid", "bucket")


def sax_search(summary: DataFrame, leaves: DataFrame, queries: DataFrame, k: int, w: int,
               bps: list[list[float]] | None = None, lower_bounding: bool = True,
               exclude_self: bool = False, tight: bool = True) -> tuple[DataFrame, DataFrame]:
    """Exact k-NN with SAX pruning (F13) -> ``(answers, counters)``.

    answers ``(qid, rank, id, d)``; counters ``(qid, n_buckets, n_lb,
    n_dist, bsf, hardness)``: buckets entered, series lower bounds computed,
    distances computed (each id once), and ``n_dist / n``.
    Phase 1 (approximate answer, F14): buckets by ascending lower bound,
    the resident one first, until they hold k series; their k-th distance
    is the best-so-far. Phase 2: only buckets and series whose lower bound does
    not exceed it are compared. ``lower_bounding=False`` compares every series (F15).
    """
    side = _Side(summary, leaves, queries, k, w, bps, exclude_self, tight)
    seed_b = side.seeds()
    w1 = Window.partitionBy("qid").orderBy("d", "id")
    p1 = side.probed(seed_b).select("qid", "id", vec.euclidean("qv", "v").alias("d"))
    p1 = p1.withColumns({"r": F.row_number().over(w1), "n1": F.count(F.lit(1)).over(Window.partitionBy("qid"))})
    p1 = keep(p1.where(F.col("r") <= k))  # at most k rows a query, read four times below
    bsf = p1.where(F.col("r") == k).select("qid", F.col("d").alias("bsf"))
    p2 = keep(side.compared(bsf, seed_b, k, lower_bounding))  # q rows
    comp = p1.select("qid", "id", "d").unionByName(p2.select("qid", F.explode("top").alias("t")).select("qid", "t.id", "t.d"))
    ans = comp.withColumn("rank", F.row_number().over(w1)).where(F.col("rank") <= k).select("qid", "rank", "id", "d")
    n = side.data.count() - (1 if exclude_self else 0)
    counters = (p2.where("n_buckets > 0").join(p1.where("r = 1").select("qid", "n1"), "qid", "left").join(bsf, "qid", "left")
                .withColumn("n_dist", F.col("n_dist") + F.coalesce("n1", F.lit(0)))
                .select("qid", "n_buckets", "n_lb", F.when(F.col("n_dist") > 0, F.col("n_dist")).alias("n_dist"), "bsf"))
    return ans, counters.withColumn("hardness", F.col("n_dist") / F.lit(float(n)))


def _bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, lens: list[float]) -> np.ndarray:
    """Lower bound of every query PAA to every envelope, summed in the order of ``envelope_lb_expr``."""
    acc = np.zeros((len(x), len(lo)))
    for i, length in enumerate(lens):
        at = x[:, i, None]
        gap = np.maximum(np.maximum(lo[:, i] - at, at - hi[:, i]), 0.0)
        acc += length * (gap * gap)
    return np.sqrt(acc)


def _compared_body(lens: list[float], k: int, exclude_self: bool, lower_bounding: bool):
    """What phase 2 does with a block of queries and the series they meet: the bounds of a tile's buckets, then of the series of
    those entered, are compared as matrices; a task hands over counts and k nearest, not pairs."""
    w = len(lens)

    def body(side, pid, batches):
        qids, Q, info = side
        q, dim = Q.shape
        if q == 0:
            return
        reach, bsf, qpaa, seeds = info[:, 0], info[:, 1], info[:, 2:2 + w], info[:, 2 + w:]
        qn2 = np.einsum("qd,qd->q", Q, Q)
        n_buckets, n_lb, n_dist = (np.zeros(q, dtype=np.int64) for _ in range(3))
        best_d, best_i = np.full((q, k), np.inf), np.zeros((q, k), dtype=np.int64)
        by_id = np.argsort(qids, kind="stable")
        for ids, row, bucket, lead in scan._tiles(batches, "id", "v", ("bno", "lead")):
            X = np.ascontiguousarray(row[:, :dim])
            clo, chi, blo, bhi = np.split(row[:, dim:], 4, axis=1)
            xn2 = np.einsum("bd,bd->b", X, X)
            known, at, of = np.unique(bucket, return_index=True, return_inverse=True)
            first = np.bincount(of, lead, len(known)) > 0  # a bucket is counted where its first series is
            own_r, own_c = scan._own_pairs(qids, by_id, ids) if exclude_self else (by_id[:0], by_id[:0])
            step = max(1, scan._SCORES // len(ids))
            for a in range(0, q, step):
                rows = slice(a, min(q, a + step))
                seen = np.zeros((len(Q[rows]), len(known)), dtype=bool)
                for b in seeds[rows].T:
                    seen |= b[:, None] == known
                enter = _bounds(qpaa[rows], blo[at], bhi[at], lens) <= reach[rows, None] if lower_bounding else np.ones_like(seen)
                n_buckets[rows] += ((enter | seen) & first).sum(1)
                may = enter[:, of]
                cut = slice(*np.searchsorted(own_r, (a, a + step)))
                may[own_r[cut] - a, own_c[cut]] = False
                if lower_bounding:
                    n_lb[rows] += may.sum(1)
                may &= ~seen[:, of]
                rr, cc = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                if len(rr) == 0:
                    continue
                may, to = may[np.ix_(rr, cc)], rr + a
                if lower_bounding:
                    may &= _bounds(qpaa[to], clo[cc], chi[cc], lens) <= reach[to, None]
                n_dist[to] += may.sum(1)
                limit = np.minimum(best_d[to, -1], bsf[to])
                may &= scan._scores("euclidean", Q[to], X[cc], xn2[cc]) >= scan._least_score("euclidean", limit, qn2[to], xn2[cc])[:, None]
                r, c = scan._true(may)
                d = scan._exact_pairs("euclidean", Q[to], X[cc], r, c)
                ok = np.isfinite(d) & (d <= limit[r])
                scan._enter_lists(best_d, best_i, to[r[ok]], d[ok], ids[cc[c[ok]]])
        step = max(1, scan._CHUNK_ELEMS // k)
        for a in range(0, q, step):
            rows = slice(a, a + step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[rows], pa.int64()), pa.array(np.full(len(qids[rows]), pid), pa.int32()), pa.array(n_buckets[rows]), pa.array(n_lb[rows]),
                 pa.array(n_dist[rows]), scan._top(best_d[rows], best_i[rows])], names=["qid", "pid", "n_buckets", "n_lb", "n_dist", "top"])

    return body


class _Side:
    """What a search reads: ``data(id, v, cb, bucket)`` (the series meet their buckets once, in a written
    table), ``buckets(bucket, bno, lead, root, size, lo, hi)`` with their number and smallest id, the queries ``q(qid, qv, qpaa, q_norm)`` and their
    ``walk``: the root groups of every query by ascending bound."""

    def __init__(self, summary: DataFrame, leaves: DataFrame, queries: DataFrame, k: int, w: int,
                 bps: list[list[float]] | None, exclude_self: bool, tight: bool = True):
        if w > MAX_WORD:
            raise ValueError(f"pruned search takes words of at most {MAX_WORD} segments")
        bps = bps or breakpoints_fixed(w)
        self.exclude_self = exclude_self
        self.k = k + 1 if exclude_self else k  # the query itself may be among the seeds
        # per-series cell bounds (8-bit cells) computed once per series, not per pair
        full8 = F.array_repeat(F.lit(CARD_BITS), w)
        cells = summary.select("id", "v", "paa", cell_bounds_expr(full8, F.col("sax"), bps).alias("cb"))
        # as many parts as a shuffle has: a pair costs far more than a row, so small tables are spread as well
        self.tasks = int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        data = keep(cells.join(leaves.select("id", "bits", "prefix", "bucket"), "id").repartition(self.tasks, "id"))
        first = data.select(F.size("v")).first()
        self.seglens = segment_lengths(first[0] if first else 0, w)
        root = F.aggregate(F.zip_with("prefix", "bits", lambda p, b: _shr(p, b - 1)), F.lit(0), lambda a, s: a * 2 + s)
        sides = [F.array(*[f(F.element_at("paa", i + 1)) for i in range(w)]).alias(name) for name, f in (("elo", F.min), ("ehi", F.max))]
        bt = data.groupBy("bucket", "bits", "prefix").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("lead"), *sides)
        bt = bt.withColumn("bno", F.monotonically_increasing_id())
        if tight:
            # tight bucket summary (F11a): the PAA envelope lies inside the SAX
            # cell, so its bound is valid and never looser
            bt = bt.select("bucket", "bno", "lead", root.alias("root"), "size", F.col("elo").alias("lo"), F.col("ehi").alias("hi"))
        else:
            bt = bt.withColumn("cell", cell_bounds_expr(F.col("bits"), F.col("prefix"), bps)).select(
                "bucket", "bno", "lead", root.alias("root"), "size", "cell.lo", "cell.hi")
        self.buckets = keep(bt)
        norm = F.sqrt(F.aggregate("qv", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        self.q = keep(queries.select("qid", "qv", paa_expr("qv", w).alias("qpaa"), norm.alias("q_norm")))
        self.walk = keep(self._walk(w))
        self.data = data.select("id", "v", "cb", "bucket")

    def _walk(self, w: int) -> DataFrame:
        """(qid, qpaa, steps): every root group with its bound, nearest first."""
        sides = [F.array(*[f(F.element_at(c, i + 1)) for i in range(w)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        groups = self.buckets.groupBy("root").agg(*sides).orderBy("root").collect()  # at most 2^w, w <= MAX_WORD
        roots = np.array([g["root"] for g in groups], dtype=np.int32)
        lo, hi = (np.array([g[c] for g in groups], dtype=np.float64).reshape(-1, w) for c in ("lo", "hi"))
        sent = self.buckets.sparkSession.sparkContext.broadcast((roots, lo, hi, [float(x) for x in self.seglens]))

        def order(batches):
            roots_, lo_, hi_, lens = sent.value
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
                for a in range(0, len(x), 256):
                    part = x[a:a + 256]
                    bound = np.zeros((len(part), len(roots_)))
                    for i in range(w):  # summed in the order of envelope_lb_expr, so no bucket's bound is below its group's
                        at = part[:, i, None]
                        gap = np.maximum(np.maximum(lo_[:, i] - at, at - hi_[:, i]), 0.0)
                        bound += lens[i] * (gap * gap)
                    bound = np.sqrt(bound)
                    at = np.argsort(bound, axis=1, kind="stable")
                    offs = pa.array(np.arange(0, at.size + 1, max(1, at.shape[1]), dtype=np.int32)[:len(part) + 1]
                                    if at.shape[1] else np.zeros(len(part) + 1, np.int32))
                    steps = pa.StructArray.from_arrays([pa.array(np.take_along_axis(bound, at, 1).ravel()), pa.array(roots_[at].ravel())],
                                                       names=["rb", "root"])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(part)), b.column(1).slice(a, len(part)),
                                                      pa.ListArray.from_arrays(offs, steps)], names=["qid", "qpaa", "steps"])

        kind = self.q.schema["qid"].dataType.simpleString()
        return self.q.select("qid", "qpaa").mapInArrow(order, f"qid {kind}, qpaa array<double>, steps array<struct<rb:double,root:int>>")

    def _buckets_of(self, steps: DataFrame) -> DataFrame:
        """Bounds of the buckets of the (qid, qpaa, root) given."""
        met = steps.join(self.buckets, "root")
        blb = F.sqrt(envelope_lb_expr(F.col("qpaa"), F.col("lo"), F.col("hi"), self.seglens))
        return met.select("qid", "bucket", "size", blb.alias("blb"))

    def seeds(self) -> DataFrame:
        """(qid, bucket): the buckets nearest by bound that together hold k series.

        A round takes the next groups of every open query, twice as many as the round before. A query is settled when
        the buckets found below the bound of its next group hold k series: no bucket of the groups left can precede them.
        """
        found, live, at, take = None, self.walk, 0, 1
        while True:
            steps = live.select("qid", "qpaa", F.explode(F.slice("steps", at + 1, take)).alias("s")).select("qid", "qpaa", "s.root")
            new = keep(self._buckets_of(steps))
            found = new if found is None else found.unionByName(new)
            at, take = at + take, take * 2
            live = live.where(F.size("steps") > at)
            nxt = live.select("qid", F.element_at("steps", at + 1)["rb"].alias("rb"))
            held = found.join(nxt, "qid").where(F.col("blb") < F.col("rb")).groupBy("qid").agg(F.sum("size").alias("held"))
            live = keep(live.join(held.where(F.col("held") >= self.k), "qid", "left_anti"))
            if live.isEmpty():
                return keep(_seed_buckets(found, self.k))

    def compared(self, bsf: DataFrame, seeds: DataFrame, k: int, lower_bounding: bool) -> DataFrame:
        """Phase 2, ``(qid, n_buckets, n_lb, n_dist, top)``: every bucket, then every series of a bucket entered, whose bound does not
        exceed the reach of the query's ``bsf`` is compared, but for those of its seed buckets (all series without bounds).

        Queries and series meet block by block, and no pair is a row: where bounds prune little there are as many as queries times series."""
        inf = F.lit(float("inf"))
        near = self.buckets.select("bucket", F.col("bno").cast("double").alias("bno"))
        mine = seeds.join(near, "bucket").groupBy("qid").agg(F.collect_list("bno").alias("mine"))  # at most self.k of them
        pad = F.concat(F.coalesce("mine", F.array().cast("array<double>")), F.array_repeat(F.lit(-1.0), self.k))
        q = self.q.join(bsf, "qid", "left").join(mine, "qid", "left")
        q = q.withColumn("reach", F.coalesce(reach_expr(F.col("bsf"), F.col("q_norm")), inf))
        q = q.select("qid", "qv", F.concat(F.array("reach", F.coalesce("bsf", inf)), "qpaa", F.slice(pad, 1, self.k)).alias("info"))
        rows = self.data.join(self.buckets.select("bucket", "bno", "lead", "lo", "hi"), "bucket").select(
            "id", F.concat(vec.dvec("v"), "cb.lo", "cb.hi", "lo", "hi").alias("v"), "bno", (F.col("id") == F.col("lead")).cast("long").alias("lead"))
        lens = [float(x) for x in self.seglens]
        parts = scan._meet(keep(rows), keep(q), _compared_body(lens, k, self.exclude_self, lower_bounding),
                           f"qid long, pid int, n_buckets long, n_lb long, n_dist long, top {scan.TOP_TYPE}", ("info",), ("bno", "lead"),
                           row_bytes=40 * k, by="bno")

        def merged() -> list[Column]:
            return [*[F.sum(c).alias(c) for c in ("n_buckets", "n_lb", "n_dist")], F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")]

        return parts.groupBy("qid", F.pmod("pid", F.lit(scan.SALTS)).alias("salt")).agg(*merged()).groupBy("qid").agg(*merged())

    def probed(self, probes: DataFrame) -> DataFrame:
        """Series of the probed buckets with their queries. The probe keys (no vectors) are broadcast when
        their bytes are bounded, else joined by a shuffle on the bucket (AQE splits skewed buckets); the
        queries join afterwards by their id."""
        size = probes.agg(F.sum(F.octet_length("bucket") + 64)).first()[0] or 0
        j = self.data.join(F.broadcast(probes) if size <= _PROBE_BYTES else probes, "bucket").join(self.q, "qid")
        return j.where(F.col("qid") != F.col("id")) if self.exclude_self else j


def sax_approx(summary: DataFrame, leaves: DataFrame, queries: DataFrame, k: int, w: int,
               bps: list[list[float]] | None = None, exclude_self: bool = False) -> DataFrame:
    """Approximate answer from the nearest bucket(s) only (F14): ``(qid, rank, id, d)``."""
    side = _Side(summary, leaves, queries, k, w, bps, exclude_self)
    p = side.probed(side.seeds()).select("qid", "id", vec.euclidean("qv", "v").alias("d"))
    w1 = Window.partitionBy("qid").orderBy("d", "id")
    return p.withColumn("rank", F.row_number().over(w1)).where(F.col("rank") <= k).select("qid", "rank", "id", "d")


def sax_budget(summary: DataFrame, queries: DataFrame, k: int, w: int, budget: int,
               bps: list[list[float]] | None = None, exclude_self: bool = False) -> DataFrame:
    """Search budget (F15): compare only the ``budget`` series with the
    smallest series-level lower bound (ties by id), answer their k best."""
    first = summary.select(F.size("v")).first()
    pick = least_bounds(summary, queries, w, segment_lengths(first[0] if first else 0, w), bps or breakpoints_fixed(w), budget, exclude_self)
    j = pick.join(summary.select("id", "v"), "id").join(queries.select("qid", "qv"), "qid")
    p = j.select("qid", "id", vec.euclidean("qv", "v").alias("d"))
    w1 = Window.partitionBy("qid").orderBy("d", "id")
    return p.withColumn("rank", F.row_number().over(w1)).where(F.col("rank") <= k).select("qid", "rank", "id", "d")
