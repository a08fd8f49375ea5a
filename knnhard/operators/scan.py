"""Bulk distance scan: query matrix x partitioned vector table.

This is the scalable physical path for every hardness measure. A query side
of at most ``MAX_QUERY_BYTES`` (a few hundred to a few thousand vectors) is
broadcast and the vector table is never moved. A larger one, or one asked for
in blocks, is a table as the vectors are: both sides get block numbers, and
every pair of blocks meets as one cogroup (``_meet``), so neither side passes
the driver and a task holds one block of each. Either way a task
streams Arrow batches through numpy (``X @ Q.T``) and keeps only
per-query partials: count, sum, min/max and a top-``m`` list. It emits
one row per query, so the volume of results is ``q x tasks`` rows independent
of the table size; the per-query merge is a two-level (salted) aggregate so
that no single group ever holds all partials of a query.

Candidates entering a top list and points near a counting threshold are
re-measured with the direct formula ``sqrt(sum((x-q)^2))`` so that the
results equal the SQL expression path to the last bits that matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

METRICS = ("euclidean", "angular", "ip")
# largest query matrix we accept to broadcast (bytes, float64)
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
# largest query side that goes to every task; a larger one meets the vectors block by block
MAX_QUERY_BYTES = 64 * 1024 * 1024
# bytes of one block of queries, and of vectors, that a task holds when blocks meet
_QUERY_BLOCK = 32 * 1024 * 1024
_VECTOR_BLOCK = 64 * 1024 * 1024
# distance-matrix elements computed at once inside a task
_CHUNK_ELEMS = 1_000_000
# scores computed at once inside a task that only compares them
_SCORES = 1_000_000
# vector rows of one tile of a distance matrix; tiles after the first are filtered by the lists found so far
_TILE = 2_048
# queries from which a scan deals the vectors to all cores, however few files they come in
_DEAL_QUERIES = 1_000
# bytes of top lists (distance and id) a task holds at once; more queries take further scans
_LIST_BYTES = 128 * 1024 * 1024
# relative error bound of squared norms and products from the matrix product (up to about 1,000 dimensions)
_REL = 1e-12
# partials of one query are merged in this many groups first
SALTS = 256

TOP_TYPE = "array<struct<d:double,id:bigint>>"
PROFILE_TYPE = f"qid long, pid int, n long, sum_d double, min_d double, max_d double, top {TOP_TYPE}"


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def collect_queries(queries: DataFrame, qid: str = "qid", qv: str = "qv", extra: tuple[str, ...] = (),
                    max_bytes: int = MAX_BROADCAST_BYTES):
    """Collect the (small) query side after checking its size bound.

    Returns ``(qids int64[q], Q float64[q, dim], extras dict)``.
    """
    stats = queries.agg(F.count(F.lit(1)).alias("q"), F.max(F.size(qv)).alias("dim"),
                        F.min(F.size(qv)).alias("dmin")).first()
    q, dim, dmin = stats["q"], stats["dim"] or 0, stats["dmin"] or 0
    if q and dim != dmin:
        raise ValueError(f"queries have ragged dimensions ({dmin}..{dim})")
    est = q * max(dim, 1) * 8
    if est > max_bytes:
        raise ValueError(
            f"this side is {est} bytes > {max_bytes}, too large for every task")
    cols = [F.col(qid).cast("long").alias("qid"), F.col(qv).cast("array<double>").alias("qv")]
    cols += [F.col(c) for c in extra]
    pdf = queries.select(*cols).toPandas()
    qids = pdf["qid"].to_numpy(dtype=np.int64)
    Q = np.array(pdf["qv"].tolist(), dtype=np.float64).reshape(len(pdf), dim)
    ext = {c: pdf[c].to_numpy() for c in extra}
    return qids, Q, ext


Body = Callable[[tuple, int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _meet(vectors: DataFrame, queries: DataFrame, body: Body, schema: str, extra: tuple[str, ...] = (), more: tuple[str, ...] = (),
          vid: str = "id", vcol: str = "v", qid: str = "qid", qv: str = "qv", row_bytes: int | Callable[[int], int] = 0,
          in_blocks: bool = False, by: str | None = None) -> DataFrame:
    """Rows that ``body(side, part, batches)`` yields for every block of queries and part of the vectors.

    ``side`` is ``(qids, Q, *extra)``; ``more`` are further vector columns (long). ``row_bytes`` is what a task
    holds for every query besides its vector (or that by dimension), and bounds the queries taken at once. ``in_blocks`` asks for blocks
    at any size. Either way the work is dealt to all cores: by a digest of the ids where there are many queries. ``by``: a column of
    ``more`` by which a task should meet the vectors sent to it.
    """
    st = queries.agg(F.count(F.lit(1)).alias("q"), F.max(F.size(qv)).alias("dim"), F.min(F.size(qv)).alias("dmin")).first()
    q, dim, dmin = st["q"], max(st["dim"] or 0, 1), st["dmin"] or 0
    if q and dim != max(dmin, 1):
        raise ValueError(f"queries have ragged dimensions ({dmin}..{dim})")
    if callable(row_bytes):
        row_bytes = row_bytes(dim)
    cols = [F.col(vid).cast("long").alias(vid), F.col(vcol), *[F.col(c).cast("long").alias(c) for c in more]]
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    if not in_blocks and q * dim * 8 <= MAX_QUERY_BYTES:
        qids, Q, ext = collect_queries(queries, qid, qv, extra)
        step = max(1, _LIST_BYTES // row_bytes) if row_bytes else max(1, q)
        source = vectors.select(*cols)
        if q >= _DEAL_QUERIES:
            source = source.repartition(max(cores, math.ceil(vectors.count() * dim * 8 / _VECTOR_BLOCK)), vid)
        if by is not None:
            source = source.sortWithinPartitions(by)
        out = None
        for a in range(0, max(1, q), step):
            rows = slice(a, a + step)
            sent = vectors.sparkSession.sparkContext.broadcast((qids[rows], Q[rows], *[_column(ext[c][rows]) for c in extra]))
            part = source.mapInArrow(
                lambda batches, sent=sent: body(sent.value, TaskContext.get().partitionId(), batches), schema)
            out = part if out is None else out.unionByName(part)
        return out
    held = max(q * dim * 8 / _QUERY_BLOCK, q * row_bytes / _LIST_BYTES)
    n_q = max(1, math.ceil(held))
    n_v = max(1, math.ceil(vectors.count() * dim * 8 / _VECTOR_BLOCK), math.ceil(2 * cores / n_q))
    # ids are dealt by digest, so that blocks are about equal; each side is repeated once per block of the other
    v = vectors.select(*cols, F.pmod(F.xxhash64(vid), F.lit(n_v)).alias("_vb"), F.explode(_numbers(n_q)).alias("_qb"))
    qs = queries.select(F.col(qid).cast("long").alias("_qid"), F.col(qv).cast("array<double>").alias("_qv"), *[F.col(c).alias(f"_x_{c}") for c in extra],
                        F.explode(_numbers(n_v)).alias("_vb"), F.pmod(F.xxhash64(F.col(qid).cast("long")), F.lit(n_q)).alias("_qb"))
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks()
        flat = right.column("_qv").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        side = (right.column("_qid").to_numpy(), flat.reshape(right.num_rows, dim), *[_column(right.column(f"_x_{c}").to_pylist()) for c in extra])
        got = body(side, key[0].as_py(), iter(left.to_batches(max_chunksize=10_000)))
        return pa.Table.from_batches([b.cast(shape) for b in got], shape)

    return v.groupBy("_vb", "_qb").cogroup(qs.groupBy("_vb", "_qb")).applyInArrow(pair, schema)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _lists(A: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(A) + 1, dtype=np.int32) * np.int32(A.shape[1])), pa.array(A.ravel()))


def _column(values) -> np.ndarray:
    """A query column as an array: numbers, or rows of equally many numbers."""
    return np.array([np.asarray(x, dtype=np.float64) for x in values]) if len(values) else np.zeros(0)


def _matrix(batch: pa.RecordBatch, col: str) -> np.ndarray:
    arr = batch.column(batch.schema.get_field_index(col))
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    lens = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    dim = int(lens[0])
    if not np.all(lens == dim):
        raise ValueError("vectors have ragged dimensions")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, dim)


def _tiles(batches: Iterator[pa.RecordBatch], vid: str, vcol: str, more: Sequence[str] = ()) -> Iterator[tuple[np.ndarray, ...]]:
    """``(ids, matrix)``, and the columns of ``more``, of at most ``_TILE`` rows at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, _TILE):
            part = batch.slice(a, _TILE)
            ids, *rest = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (vid, *more))
            yield ids, _matrix(part, vcol), *rest


def _approx(metric: str, Qc: np.ndarray, qn2: np.ndarray, X: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    G = Qc @ X.T
    if metric == "angular":
        np.subtract(1.0, G, out=G)
        return np.maximum(G, 0.0, out=G)
    G *= -2.0
    G += qn2[:, None] + xn2[None, :]
    np.maximum(G, 0.0, out=G)
    return np.sqrt(G, out=G)


def _fold(A: np.ndarray, B: np.ndarray, metric: str) -> np.ndarray:
    """Distance along the last axis summed left to right, i.e. the same
    operation order as the SQL array fold ``aggregate(zip_with(..), 0, +)``,
    so that both physical paths agree bit for bit on threshold tests."""
    acc = np.zeros(np.broadcast_shapes(A.shape, B.shape)[:-1])
    if metric == "angular":
        for j in range(A.shape[-1]):
            acc = acc + A[..., j] * B[..., j]
        return np.maximum(0.0, 1.0 - acc)
    for j in range(A.shape[-1]):
        t = A[..., j] - B[..., j]
        acc = acc + t * t
    return np.sqrt(acc)


def _exact_pairs(metric: str, Qc: np.ndarray, X: np.ndarray, rr: np.ndarray, cc: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs (row, column), summed in the order of ``_fold`` without a vector for each pair."""
    acc = np.zeros(len(rr))
    for x, y in zip(np.ascontiguousarray(Qc.T), np.ascontiguousarray(X.T)):
        if metric == "angular":
            acc += x[rr] * y[cc]
        else:
            t = x[rr] - y[cc]
            acc += t * t
    return np.maximum(0.0, 1.0 - acc) if metric == "angular" else np.sqrt(acc)


def _exact_rows(metric: str, Qc: np.ndarray, XT: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Exact distances of query row r to column idx[r, j] of ``XT``, summed in the order of ``_fold``;
    the temporaries have the size of ``idx``, whatever the dimension."""
    acc = np.zeros(idx.shape)
    for j, x in enumerate(XT):
        if metric == "angular":
            acc += Qc[:, j, None] * x[idx]
        else:
            t = Qc[:, j, None] - x[idx]
            acc += t * t
    return np.maximum(0.0, 1.0 - acc) if metric == "angular" else np.sqrt(acc)


def _slack(metric: str, D: np.ndarray, qn2: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    """Bound of the error of ``_approx`` for every pair: the squared norms bound the error of the square."""
    e = _REL * (qn2[:, None] + xn2[None, :])
    return e if metric == "angular" else e / np.maximum(np.maximum(D, np.sqrt(e)), np.finfo(float).tiny)


def _limit(metric: str, t: np.ndarray, qn2: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    """For every row the approximate distance that no pair of an exact distance ``<= t`` exceeds."""
    e = 2 * _REL * (qn2 + xn2.max(initial=0.0, where=np.isfinite(xn2)))
    return t + e if metric == "angular" else np.sqrt(t * t + e)


def _floor(metric: str, t: np.ndarray, qn2: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    """For every row the approximate distance below which every pair has an exact distance ``<= t``."""
    e = 2 * _REL * (qn2 + xn2.max(initial=0.0, where=np.isfinite(xn2)))
    return t - e if metric == "angular" else np.sqrt(np.maximum(np.where(t < 0, 0.0, t * t - e), 0.0))


def _scores(metric: str, Qc: np.ndarray, X: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    """One number for every pair, larger for nearer ones: ``q.x``, less half of ``x.x`` unless the metric is angular."""
    if metric == "angular":
        return Qc @ X.T
    return np.column_stack([Qc, np.ones(len(Qc))]) @ np.column_stack([X, -0.5 * xn2]).T


def _least_score(metric: str, t: np.ndarray, qn2: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    """For every row the score that no pair of an exact distance ``<= t`` falls below."""
    limit = _limit(metric, t, qn2, xn2)
    if metric == "angular":
        return np.where(t < 0, np.inf, 1.0 - limit)
    return np.where(t < 0, np.inf, (qn2 - limit * limit) / 2)


def _sure_score(metric: str, t: np.ndarray, qn2: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    """For every row the score above which every pair has an exact distance ``<= t``."""
    e = 2 * _REL * (qn2 + xn2.max(initial=0.0, where=np.isfinite(xn2)))
    if metric == "angular":
        return np.where(t < 0, np.inf, 1.0 - (t - e))
    with np.errstate(invalid="ignore"):
        return np.where((t < 0) | (t * t < e), np.inf, (qn2 - (t * t - e)) / 2)


def _true(may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) where ``may`` is true, row by row: of few true ones much faster found in the flat array."""
    return np.divmod(np.flatnonzero(may), may.shape[1])


def _nearest(metric: str, Qc: np.ndarray, qn2: np.ndarray, X: np.ndarray, XT: np.ndarray, xn2: np.ndarray,
             ids: np.ndarray, D: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(exact distances, columns) of the ``k`` smallest (d, id) of every row of the approximate ``D``.

    Where more than ``k`` columns lie within the error of the k-th, as copies of a vector do, all of
    them are measured, so that equal distances go to the smaller ids.
    """
    b = D.shape[1]
    if b <= k:
        idx = np.tile(np.arange(b), (len(D), 1))
        return _exact_rows(metric, Qc, XT, idx), idx
    idx = np.argpartition(D, k - 1, axis=1)[:, :k]
    kth = np.take_along_axis(D, idx, 1).max(1)
    limit = _limit(metric, kth, qn2, xn2)
    limit[~np.isfinite(kth)] = -1.0  # fewer than k columns that count: idx has them all
    d = _exact_rows(metric, Qc, XT, idx)
    for r in np.nonzero((D <= limit[:, None]).sum(1) > k)[0]:
        c = np.nonzero(D[r] <= limit[r])[0]
        dd = _fold(Qc[r][None, :], X[c], metric)
        order = np.lexsort((ids[c], dd))[:k]
        d[r], idx[r] = dd[order], c[order]
    return d, idx


def _merge_top(d0: np.ndarray, i0: np.ndarray, d1: np.ndarray, i1: np.ndarray, m: int):
    """The ``m`` smallest (d, id) per row of two lists, and their order in the concatenation."""
    d, i = np.concatenate([d0, d1], 1), np.concatenate([i0, i1], 1)
    order = np.lexsort((i, d), axis=1)[:, :m]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1), order


def _enter_lists(best_d: np.ndarray, best_i: np.ndarray, rr: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
    """Enter the pairs (row, distance, id) into the lists of their rows, in place."""
    if len(rr) == 0:
        return
    m = best_d.shape[1]
    order = np.lexsort((i, d, rr))
    rr, d, i = rr[order], d[order], i[order]
    at, first, count = np.unique(rr, return_index=True, return_counts=True)
    nth = np.arange(len(rr)) - np.repeat(first, count)
    row = np.repeat(np.arange(len(at)), count)
    new = nth < m
    shape = (len(at), min(m, count.max()))
    nd, ni = np.full(shape, np.inf), np.zeros(shape, dtype=np.int64)
    nd[row[new], nth[new]], ni[row[new], nth[new]] = d[new], i[new]
    best_d[at], best_i[at], _ = _merge_top(best_d[at], best_i[at], nd, ni, m)


def _top(d: np.ndarray, i: np.ndarray) -> pa.ListArray:
    """Sorted lists as ``TOP_TYPE``; places that hold no distance are last and left out."""
    fin = np.isfinite(d)
    offs = np.concatenate([[0], np.cumsum(fin.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays([pa.array(d[fin]), pa.array(i[fin])], names=["d", "id"]))


def _closer(metric: str, Qc: np.ndarray, qn2: np.ndarray, X: np.ndarray, XT: np.ndarray, xn2: np.ndarray, ids: np.ndarray,
            D: np.ndarray, best_d: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, exact distances, columns) of what may enter the lists ``best_d``: all rows and their ``m`` nearest while the lists
    are short, later only the rows with a column that is no farther than the last of their list."""
    every = np.arange(len(D))
    if best_d.shape[1] == m:
        rr, cc = _true(D <= _limit(metric, best_d[:, -1], qn2, xn2)[:, None])
        if len(rr) == 0:
            return every[:0], np.zeros((0, 1)), np.zeros((0, 1), dtype=np.int64)
        rows, first, count = np.unique(rr, return_index=True, return_counts=True)
        if count.max() <= m:
            at = np.arange(len(rr)) - np.repeat(first, count)
            row = np.repeat(np.arange(len(rows)), count)
            ex, idx = np.full((len(rows), count.max()), np.inf), np.zeros((len(rows), count.max()), dtype=np.int64)
            ex[row, at], idx[row, at] = _exact_pairs(metric, Qc, X, rr, cc), cc
            ex[row, at] = np.where(np.isfinite(D[rr, cc]), ex[row, at], np.inf)
            return rows, ex, idx
    ex, idx = _nearest(metric, Qc, qn2, X, XT, xn2, ids, D, m)
    ex[~np.isfinite(np.take_along_axis(D, idx, 1))] = np.inf
    return every, ex, idx


def _own_pairs(qids: np.ndarray, order: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows ascending, columns) of the pairs of a query with itself; ``order`` sorts ``qids``."""
    lo, hi = np.searchsorted(qids, ids, "left", order), np.searchsorted(qids, ids, "right", order)
    count = hi - lo
    cols = np.repeat(np.arange(len(ids)), count)
    rows = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    by = np.argsort(rows, kind="stable")
    return rows[by], cols[by]


def _self_mask(qids: np.ndarray, ids: np.ndarray, rows: slice) -> np.ndarray:
    """Boolean (qc, b): pair is the query itself."""
    return qids[rows][:, None] == ids[None, :]


# ---------------------------------------------------------------- profile

def _profile_body(metric: str, m: int, exclude_self: bool, vid: str, vcol: str, block_rows: int | None = None) -> Body:
    """What ``profile`` does with a block of queries and the batches of vectors they meet."""
    def body(side, pid, batches):
        qids_, Q_ = side
        q = len(qids_)
        if q == 0:
            return
        qn2 = np.einsum("qd,qd->q", Q_, Q_)
        n = np.zeros(q, dtype=np.int64)
        s = np.zeros(q)
        mx = np.full(q, -np.inf)
        best_d = np.full((q, 0), np.inf)
        best_i = np.zeros((q, 0), dtype=np.int64)
        by_id = np.argsort(qids_, kind="stable")
        for ids, X in _tiles(batches, vid, vcol):
            XT = np.ascontiguousarray(X.T)
            xn2 = np.einsum("bd,bd->b", X, X)
            own_r, own_c = _own_pairs(qids_, by_id, ids) if exclude_self else (by_id[:0], by_id[:0])
            width = min(m, best_d.shape[1] + len(ids))
            if width > best_d.shape[1]:
                more = ((0, 0), (0, width - best_d.shape[1]))
                best_d, best_i, short = np.pad(best_d, more, constant_values=np.inf), np.pad(best_i, more), True
            else:
                short = False
            step = max(1, _CHUNK_ELEMS // max(len(ids), 2 * width))
            step = min(step, block_rows or step)
            for a in range(0, q, step):
                rows = slice(a, min(q, a + step))
                D = _approx(metric, Q_[rows], qn2[rows], X, xn2)
                cut = slice(*np.searchsorted(own_r, (a, a + step)))
                own = own_r[cut] - a, own_c[cut]
                out = ~np.isfinite(D) if not (np.isfinite(xn2).all() and np.isfinite(qn2[rows]).all()) else None
                n[rows] += len(ids)
                D[own] = 0.0
                if out is not None:  # pairs that are no numbers count nowhere
                    out[own] = False
                    n[rows] -= out.sum(1)
                    D[out] = 0.0
                n[rows] -= np.bincount(own[0], minlength=len(D))
                s[rows] += D.sum(1)
                D[own] = -np.inf
                if out is not None:
                    D[out] = -np.inf
                am = D.argmax(1)
                exm = _fold(Q_[rows], X[am], metric)
                exm[np.isneginf(D[np.arange(len(am)), am])] = -np.inf
                mx[rows] = np.maximum(mx[rows], exm)
                D[own] = np.inf
                if out is not None:
                    D[out] = np.inf
                at, ex, idx = _closer(metric, Q_[rows], qn2[rows], X, XT, xn2, ids, D, best_d[rows, :0] if short else best_d[rows], m)
                best_d[at + a], best_i[at + a], _ = _merge_top(best_d[at + a], best_i[at + a], ex, ids[idx], width)
        step = max(1, _CHUNK_ELEMS // max(1, best_d.shape[1]))
        for a in range(0, q, step):  # rows are sorted by (d, id); excluded ones are not finite and last
            rows = slice(a, min(q, a + step))
            sd, si = best_d[rows], best_i[rows]
            fin = np.isfinite(sd)
            offs = np.concatenate([[0], np.cumsum(fin.sum(1))]).astype(np.int32)
            top = pa.ListArray.from_arrays(
                pa.array(offs, type=pa.int32()),
                pa.StructArray.from_arrays([pa.array(sd[fin], type=pa.float64()), pa.array(si[fin], type=pa.int64())],
                                           names=["d", "id"]))
            mn = sd[:, 0] if sd.shape[1] else np.full(len(sd), np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids_[rows], pa.int64()), pa.array(np.full(len(sd), pid), pa.int32()), pa.array(n[rows], pa.int64()),
                 pa.array(s[rows]), pa.array(mn, mask=~np.isfinite(mn)),
                 pa.array(mx[rows], mask=~np.isfinite(mx[rows])), top],  # a task without rows has no extremes: NULL, which min and max pass over
                names=["qid", "pid", "n", "sum_d", "min_d", "max_d", "top"])

    return body


def _lists_body(metric: str, m: int, exclude_self: bool, vid: str, vcol: str, block_rows: int | None = None) -> Body:
    """What ``nearest_lists`` does with a block of queries and the batches of vectors they meet. The pairs of a tile are one
    product and one comparison; those that may enter a list are measured exactly."""
    def body(side, pid, batches):
        qids_, Q_ = side
        q = len(qids_)
        if q == 0:
            return
        qn2 = np.einsum("qd,qd->q", Q_, Q_)
        best_d, best_i, n = np.full((q, m), np.inf), np.zeros((q, m), dtype=np.int64), np.zeros(q, dtype=np.int64)
        by_id = np.argsort(qids_, kind="stable")
        for ids, X in _tiles(batches, vid, vcol):
            xn2 = np.einsum("bd,bd->b", X, X)
            n += np.isfinite(xn2).sum()
            error = _REL * (qn2 + xn2.max(initial=0.0, where=np.isfinite(xn2)))
            own_r, own_c = _own_pairs(qids_, by_id, ids) if exclude_self else (by_id[:0], by_id[:0])
            step = max(1, _SCORES // max(len(ids), 2 * m))
            step = min(step, block_rows or step)
            for a in range(0, q, step):
                rows = slice(a, min(q, a + step))
                S = _scores(metric, Q_[rows], X, xn2)
                cut = slice(*np.searchsorted(own_r, (a, a + step)))
                own = own_r[cut] - a, own_c[cut]
                n[rows] -= np.bincount(own[0][np.isfinite(xn2[own[1]])], minlength=len(S))
                least = _least_score(metric, best_d[rows, -1], qn2[rows], xn2)
                open_ = np.nonzero(~np.isfinite(best_d[rows, -1]))[0]
                if len(open_):  # short lists take the m best of the tile
                    some = S[open_]
                    some[~np.isfinite(some)] = -np.inf
                    mine = np.isin(own[0], open_)
                    some[np.searchsorted(open_, own[0][mine]), own[1][mine]] = -np.inf
                    last = np.partition(some, -m, axis=1)[:, -m] if len(ids) > m else np.full(len(some), -np.inf)
                    # products over 1 are all at an angular distance of 0
                    least[open_] = (np.minimum(last, 1.0) if metric == "angular" else last) - 2 * error[rows][open_]
                may = S >= least[:, None]
                may[own] = False
                rr, cc = _true(may)
                if len(rr) == 0:
                    continue
                ex = _exact_pairs(metric, Q_[rows], X, rr, cc)
                ok = np.isfinite(ex) & (ex <= best_d[rows, -1][rr])
                if metric != "angular":
                    ok &= np.isfinite(qn2[rows][rr]) & np.isfinite(xn2[cc])
                rr, cc, ex = rr[ok], cc[ok], ex[ok]
                _enter_lists(best_d, best_i, rr + a, ex, ids[cc])
        n[~np.isfinite(qn2)] = 0  # pairs that are no numbers count nowhere
        step = max(1, _CHUNK_ELEMS // m)
        for a in range(0, q, step):
            sd, si = best_d[a:a + step], best_i[a:a + step]
            yield pa.RecordBatch.from_arrays([pa.array(qids_[a:a + step], pa.int64()), pa.array(np.full(len(sd), pid), pa.int32()), pa.array(n[a:a + step]),
                                              _top(sd, si)], names=["qid", "pid", "n", "top"])

    return body


def nearest_lists(vectors: DataFrame, queries: DataFrame, metric: str = "euclidean", m: int = 10, exclude_self: bool = False,
                  block_rows: int | None = None) -> DataFrame:
    """``n`` and the ``m`` nearest of every query as ``top``, ordered by (d, id): those of ``profile`` without its sums and extremes, which
    need the distance of every pair."""
    _check_metric(metric)
    body = _lists_body(metric, m, exclude_self, "id", "v", block_rows)
    parts = _meet(vectors, queries, body, f"qid long, pid int, n long, top {TOP_TYPE}", row_bytes=40 * m, in_blocks=block_rows is not None)

    def merged() -> list[Column]:
        return [F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, m).alias("top")]

    return parts.groupBy("qid", F.pmod(F.col("pid"), F.lit(SALTS)).alias("salt")).agg(*merged()).groupBy("qid").agg(*merged())


def profile(vectors: DataFrame, queries: DataFrame, metric: str = "euclidean", m: int = 21,
            exclude_self: bool = False, vid: str = "id", vcol: str = "v",
            qid: str = "qid", qv: str = "qv", block_rows: int | None = None) -> DataFrame:
    """Per query: ``n, sum_d, min_d, max_d`` over all points and the ``m``
    nearest as ``top array<struct<d,id>>`` ordered by (d, id). ``block_rows``: the queries stay a
    table, and a task takes that many of its block at once."""
    _check_metric(metric)
    body = _profile_body(metric, m, exclude_self, vid, vcol, block_rows)
    parts = _meet(vectors, queries, body, PROFILE_TYPE, vid=vid, vcol=vcol, qid=qid, qv=qv, row_bytes=40 * m, in_blocks=block_rows is not None)
    return merge_profiles(parts, m, SALTS)


def profile_in_cells(cells: DataFrame, probes: DataFrame, sizes: DataFrame, metric: str = "euclidean", m: int = 21,
                     exclude_self: bool = False) -> DataFrame:
    """``profile`` of every query over the cells it probes: ``cells(id, cid, v)``, ``probes(qid, cid, qv)``.

    A cell's vectors and the queries that probe it meet as cogroups of at most about ``_VECTOR_BLOCK`` and ``_QUERY_BLOCK`` bytes, so
    a cell with much of the data, or one that all queries probe, is many of them. ``sizes(cid, size)`` has one row for each cell, as does
    the table of blocks, which goes to every task. Only probed cells are read."""
    _check_metric(metric)
    dim = max(probes.agg(F.max(F.size("qv"))).first()[0] or 0, 1)
    v_rows, q_rows = max(1, _VECTOR_BLOCK // (8 * dim)), max(1, _QUERY_BLOCK // (8 * dim + 40 * m))
    blocks = probes.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / q_rows).alias("_nq")).join(sizes, "cid", "left").select(
        "cid", "_nq", F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce("size", F.lit(0)) / v_rows)).alias("_nv"))
    blocks = F.broadcast(blocks)

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    spark = probes.sparkSession
    # a row is short but stands for all it meets: the number is given, or adaptive planning would join tasks by the rows' bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["cid", "_vb", "_qb"]
    v = cells.join(blocks, "cid").select("cid", F.col("id").cast("long").alias("id"), "v", F.pmod(F.xxhash64("id"), F.col("_nv")).alias("_vb"),
                                         numbers("_nq").alias("_qb")).repartition(tasks, *keys)
    qs = probes.join(blocks, "cid").select("cid", F.col("qid").cast("long").alias("_qid"), F.col("qv").cast("array<double>").alias("_qv"),
                                           numbers("_nv").alias("_vb"), F.pmod(F.xxhash64("qid"), F.col("_nq")).alias("_qb")).repartition(tasks, *keys)
    body = _profile_body(metric, m, exclude_self, "id", "v")
    shape = to_arrow_schema(StructType.fromDDL(PROFILE_TYPE))

    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:  # a block without vectors, or without queries
            return shape.empty_table()
        right = right.combine_chunks()
        flat = right.column("_qv").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        got = body((right.column("_qid").to_numpy(), flat.reshape(right.num_rows, -1)), key[0].as_py() % SALTS, iter(left.to_batches(max_chunksize=10_000)))
        return pa.Table.from_batches([b.cast(shape) for b in got], shape)

    return merge_profiles(v.groupBy(*keys).cogroup(qs.groupBy(*keys)).applyInArrow(pair, PROFILE_TYPE), m, SALTS)


def merge_profiles(parts: DataFrame, m: int, salts: int) -> DataFrame:
    def aggs():
        return [F.sum("n").alias("n"), F.sum("sum_d").alias("sum_d"), F.min("min_d").alias("min_d"),
                F.max("max_d").alias("max_d"),
                F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, m).alias("top")]
    lvl1 = parts.groupBy("qid", F.pmod(F.col("pid"), F.lit(salts)).alias("salt")).agg(*aggs())
    return lvl1.groupBy("qid").agg(*aggs())


# ------------------------------------------------------- threshold counts

def _trues(may: np.ndarray) -> np.ndarray:
    """How many are true in every row."""
    return np.bitwise_count(np.packbits(may, axis=1)).sum(1, dtype=np.int64)


def _counts(metric: str, Qc: np.ndarray, qn2: np.ndarray, X: np.ndarray, xn2: np.ndarray, thr: np.ndarray, own: tuple) -> np.ndarray:
    """Points of a tile with ``d <= thr[r, j]`` for every row and threshold. The scores of a row lie between two numbers, which settle
    the thresholds that all or none of its points reach; pairs close to a threshold are measured again with the direct formula."""
    S = _scores(metric, Qc, X, xn2)
    S[own] = -np.inf  # within no threshold
    low, high = S.min(1), S.max(1)
    out = np.zeros(thr.shape, dtype=np.int64)
    for j in range(thr.shape[1]):
        t = thr[:, j]
        least, sure = _least_score(metric, t, qn2, xn2), _sure_score(metric, t, qn2, xn2)
        whole = low > sure
        out[whole, j] = S.shape[1]
        rows = np.flatnonzero(~whole & ~(high < least))
        if len(rows) == 0:
            continue
        some = S if len(rows) == len(S) else S[rows]
        may = some >= least[rows, None]
        most, n = _trues(may), _trues(some > sure[rows, None])
        near = np.flatnonzero(most != n)
        if len(near):
            at, cc = _true(may[near] & ~(some[near] > sure[rows[near], None]) & ~np.isneginf(some[near]))
            rr = rows[near[at]]
            ok = _exact_pairs(metric, Qc, X, rr, cc) <= t[rr]
            n += np.bincount(near[at][ok], minlength=len(rows))
        out[rows, j] = n
    return out


def within_counts(vectors: DataFrame, queries: DataFrame, thr_col: str = "thr", metric: str = "euclidean",
                  exclude_self: bool = False, cell_col: str | None = None, vid: str = "id", vcol: str = "v",
                  qid: str = "qid", qv: str = "qv") -> DataFrame:
    """Count points with ``d <= thr[j]`` per query and threshold index ``j``.

    ``queries`` carries ``thr ARRAY<DOUBLE>`` (same length for all rows).
    With ``cell_col`` the counts are also split by that vector column
    (e.g. the inverted-list cell): output ``(qid, j, cell, cnt)``; else
    ``(qid, j, cnt)``. Partial counts are summed by a map-side combined
    aggregate.
    """
    _check_metric(metric)

    def body(side, pid, batches):
        qids_, Q_, T_ = side
        T_ = T_.reshape(len(qids_), -1 if len(qids_) else 0)
        q, t = T_.shape if T_.size else (len(qids_), 0)
        if q == 0:
            return
        qn2 = np.einsum("qd,qd->q", Q_, Q_)
        by_id = np.argsort(qids_, kind="stable")
        tot = np.zeros((q, t), dtype=np.int64)
        more = [cell_col] if cell_col else []
        for ids, X, *cells in _tiles(batches, vid, vcol, more):
            xn2 = np.einsum("bd,bd->b", X, X)
            own_r, own_c = _own_pairs(qids_, by_id, ids) if exclude_self else (by_id[:0], by_id[:0])
            step = max(1, _CHUNK_ELEMS // len(ids))
            if not cells:
                for a in range(0, q, step):
                    rows = slice(a, min(q, a + step))
                    cut = slice(*np.searchsorted(own_r, (a, a + step)))
                    tot[rows] += _counts(metric, Q_[rows], qn2[rows], X, xn2, T_[rows], (own_r[cut] - a, own_c[cut]))
                continue
            step = max(1, _CHUNK_ELEMS // len(ids))
            for a in range(0, q, step):
                rows = slice(a, min(q, a + step))
                D = _approx(metric, Q_[rows], qn2[rows], X, xn2)
                cut = slice(*np.searchsorted(own_r, (a, a + step)))
                D[own_r[cut] - a, own_c[cut]] = np.nan  # within no threshold
                for j in range(t):
                    thr = T_[rows, j]
                    sure, may = D < _floor(metric, thr, qn2[rows], xn2)[:, None], D <= _limit(metric, thr, qn2[rows], xn2)[:, None]
                    # points close to the threshold are measured again with the direct formula
                    least, most = np.count_nonzero(sure, axis=1), np.count_nonzero(may, axis=1)
                    near = np.nonzero(least != most)[0]
                    at, cc = np.nonzero(may[near] & ~sure[near])
                    rr = near[at]
                    ok = _exact_pairs(metric, Q_[rows], X, rr, cc) <= thr[rr]
                    sure[rr[ok], cc[ok]] = True
                    rr, cc = np.nonzero(sure)
                    known, of = np.unique(cells[0], return_inverse=True)
                    key, cnt = np.unique(rr * len(known) + of[cc], return_counts=True)
                    if len(key):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(qids_[rows][key // len(known)], pa.int64()), pa.array(np.full(len(key), j), pa.int32()),
                             pa.array(known[key % len(known)], pa.int64()), pa.array(cnt, pa.int64())],
                            names=["qid", "j", "cell", "cnt"])
        if cell_col is None:
            rr, jj = np.nonzero(tot >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids_[rr], pa.int64()), pa.array(jj, pa.int32()), pa.array(tot[rr, jj], pa.int64())],
                names=["qid", "j", "cnt"])

    if cell_col:
        schema, keys = "qid long, j int, cell long, cnt long", ["qid", "j", "cell"]
    else:
        schema, keys = "qid long, j int, cnt long", ["qid", "j"]
    parts = _meet(vectors, queries, body, schema, (thr_col,), (cell_col,) if cell_col else (), vid, vcol, qid, qv)
    return parts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


# ------------------------------------------------------ nearest centre

def collect_centres(centres: DataFrame, cid: str = "cid", cv: str = "v", max_bytes: int = MAX_BROADCAST_BYTES):
    ids, C, _ = collect_queries(centres, cid, cv, max_bytes=max_bytes)
    order = np.argsort(ids, kind="stable")
    return ids[order], C[order]


def nearest_centre(vectors: DataFrame, centres: DataFrame, metric: str = "euclidean", vid: str = "id",
                   vcol: str = "v", with_sums: bool = False, keep_vectors: bool = False) -> DataFrame:
    """Assign every vector to its nearest centre (ties: smaller ``cid``).

    Centres ``(cid, v)`` are size-checked and broadcast. Output
    ``(id, cid, d)``; with ``with_sums`` instead the per-task sums of a Lloyd update,
    ``(cid, pid, s, cnt)``: one array for every centre that the task met.
    """
    _check_metric(metric)
    cids, C = collect_centres(centres)
    sc = vectors.sparkSession.sparkContext
    bC = sc.broadcast((cids, C))

    def body(batches):
        cids_, C_ = bC.value
        c = len(cids_)
        cn2 = np.einsum("cd,cd->c", C_, C_)
        CT = np.ascontiguousarray(C_.T)
        sums = None
        cnts = np.zeros(c, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0 or c == 0:
                continue
            X = _matrix(batch, vcol)
            ids = batch.column(batch.schema.get_field_index(vid)).to_numpy(zero_copy_only=False).astype(np.int64)
            xn2 = np.einsum("bd,bd->b", X, X)
            bi, bd = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
            step = max(1, _CHUNK_ELEMS // c)
            for a in range(0, len(ids), step):
                rows = slice(a, a + step)
                D = _approx(metric, X[rows], xn2[rows], C_, cn2)
                ex, idx = _nearest(metric, X[rows], xn2[rows], C_, CT, cn2, cids_, D, 1)
                bi[rows], bd[rows] = idx[:, 0], ex[:, 0]
            if with_sums:
                if sums is None:
                    sums = np.zeros((c, X.shape[1]))
                np.add.at(sums, bi, X)
                cnts += np.bincount(bi, minlength=c)
            elif keep_vectors:
                vc = batch.column(batch.schema.get_field_index(vcol))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cids_[bi], pa.int64()), pa.array(bd), vc],
                    names=["id", "cid", "d", vcol])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cids_[bi], pa.int64()), pa.array(bd)],
                    names=["id", "cid", "d"])
        if with_sums and sums is not None:
            nz = np.nonzero(cnts)[0]
            dim = sums.shape[1]
            offs = pa.array(np.arange(0, (len(nz) + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids_[nz], pa.int64()), pa.array(np.full(len(nz), TaskContext.get().partitionId()), pa.int32()),
                 pa.ListArray.from_arrays(offs, pa.array(sums[nz].ravel())), pa.array(cnts[nz], pa.int64())],
                names=["cid", "pid", "s", "cnt"])

    src = vectors.select(F.col(vid).cast("long").alias(vid), F.col(vcol))
    if with_sums:
        return src.mapInArrow(body, "cid long, pid int, s array<double>, cnt long")
    if keep_vectors:
        vtype = src.schema[vcol].dataType.simpleString()
        return src.mapInArrow(body, f"id long, cid long, d double, {vcol} {vtype}")
    return src.mapInArrow(body, "id long, cid long, d double")


# ------------------------------------------------------- RC gradient

def gradient_partials(vectors: DataFrame, queries: DataFrame, metric: str = "euclidean", m: int = 11,
                      exclude_self: bool = False, vid: str = "id", vcol: str = "v") -> DataFrame:
    """Per query: ``n, sum_d``, the gradient sum ``g = sum_i dd_i/dx``
    (Euclidean: ``(x - p_i)/d_i``, zero-distance points skipped; angular:
    ``-p_i``) and the ``m`` nearest with their vectors
    ``top array<struct<d,id,v>>``; merged by the same salted two-level
    aggregate as ``profile``."""
    _check_metric(metric)

    def body(side, pid, batches):
        qids_, Q_ = side
        q, dim = Q_.shape
        qn2 = np.einsum("qd,qd->q", Q_, Q_)
        if q == 0:
            return
        n = np.zeros(q, dtype=np.int64)
        s = np.zeros(q)
        g = np.zeros((q, dim))
        best_d = np.full((q, 0), np.inf)
        best_i = np.zeros((q, 0), dtype=np.int64)
        best_v = np.zeros((q, 0, dim))
        by_id = np.argsort(qids_, kind="stable")
        for ids, X in _tiles(batches, vid, vcol):
            xn2 = np.einsum("bd,bd->b", X, X)
            XT = np.ascontiguousarray(X.T)
            own_r, own_c = _own_pairs(qids_, by_id, ids) if exclude_self else (by_id[:0], by_id[:0])
            width = min(m, best_d.shape[1] + len(ids))
            short = width > best_d.shape[1]
            if short:
                more = ((0, 0), (0, width - best_d.shape[1]))
                best_d, best_i, best_v = np.pad(best_d, more, constant_values=np.inf), np.pad(best_i, more), np.pad(best_v, (*more, (0, 0)))
            step = max(1, _CHUNK_ELEMS // max(len(ids), 2 * width * dim))
            for a in range(0, q, step):
                rows = slice(a, min(q, a + step))
                Qc = Q_[rows]
                D = _approx(metric, Qc, qn2[rows], X, xn2)
                cut = slice(*np.searchsorted(own_r, (a, a + step)))
                D[own_r[cut] - a, own_c[cut]] = np.inf
                fin = np.isfinite(D)
                n[rows] += fin.sum(1)
                s[rows] += np.where(fin, D, 0.0).sum(1)
                if metric == "angular":
                    g[rows] -= fin.astype(float) @ X
                else:
                    inv = np.where(fin & (D > 0), 1.0 / np.where(D > 0, D, 1.0), 0.0)  # (rows, b)
                    g[rows] += inv.sum(1)[:, None] * Qc - inv @ X
                D[~fin] = np.inf
                at, ex, idx = _closer(metric, Qc, qn2[rows], X, XT, xn2, ids, D, best_d[rows, :0] if short else best_d[rows], m)
                to = at + a
                near = np.concatenate([best_v[to], X[idx]], 1)
                best_d[to], best_i[to], order = _merge_top(best_d[to], best_i[to], ex, ids[idx], width)
                best_v[to] = np.take_along_axis(near, order[:, :, None], 1)
        step = max(1, _CHUNK_ELEMS // max(1, best_d.shape[1] * dim))
        for a in range(0, q, step):  # rows are sorted by (d, id); excluded ones are not finite and last
            rows = slice(a, min(q, a + step))
            fin = np.isfinite(best_d[rows])
            offs = np.concatenate([[0], np.cumsum(fin.sum(1))]).astype(np.int32)
            top = pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays(
                [pa.array(best_d[rows][fin]), pa.array(best_i[rows][fin]), _lists(best_v[rows][fin])], names=["d", "id", "v"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids_[rows], pa.int64()), pa.array(np.full(len(fin), pid), pa.int32()), pa.array(n[rows], pa.int64()),
                 pa.array(s[rows]), _lists(g[rows]), top],
                names=["qid", "pid", "n", "sum_d", "g", "top"])

    schema = ("qid long, pid int, n long, sum_d double, g array<double>, "
              "top array<struct<d:double,id:bigint,v:array<double>>>")
    # a task holds m vectors per query, once more while their array grows, and the gradient
    parts = _meet(vectors, queries, body, schema, vid=vid, vcol=vcol, row_bytes=lambda dim: 16 * m * (dim + 2) + 8 * dim)
    salts = SALTS

    def aggs():
        gsum = F.aggregate(F.collect_list("g"), F.array_repeat(F.lit(0.0), F.size(F.first("g"))),
                           lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
        return [F.sum("n").alias("n"), F.sum("sum_d").alias("sum_d"), gsum.alias("g"),
                F.slice(F.array_sort(F.flatten(F.collect_list("top")),
                                     lambda a, b: F.when(a.getField("d") < b.getField("d"), -1)
                                     .when(a.getField("d") > b.getField("d"), 1)
                                     .when(a.getField("id") < b.getField("id"), -1)
                                     .when(a.getField("id") > b.getField("id"), 1).otherwise(0)), 1, m).alias("top")]
    lvl1 = parts.groupBy("qid", F.pmod(F.col("pid"), F.lit(salts)).alias("salt")).agg(*aggs())
    return lvl1.groupBy("qid").agg(*aggs())


# ------------------------------------------------------------ histogram

def histogram(vectors: DataFrame, queries: DataFrame, bins: int, metric: str = "euclidean",
              exclude_self: bool = False, vid: str = "id", vcol: str = "v") -> DataFrame:
    """Equal-width distance histogram per query between its ``lo`` and ``hi``
    (query columns): ``(qid, counts array<bigint>)``, the last bin closed;
    dense per-task count vectors summed by the salted two-level aggregate. Points near
    an edge are measured by the left-to-right fold, bit-identical to the SQL expression, so bin
    edges are decided exactly as a SQL engine decides them."""
    _check_metric(metric)

    def body(side, pid, batches):
        qids_, Q_, lo_, hi_ = side
        q = len(qids_)
        qn2 = np.einsum("qd,qd->q", Q_, Q_)
        counts = np.zeros((q, bins), dtype=np.int64)
        by_id = np.argsort(qids_, kind="stable")
        for ids, X in _tiles(batches if q else (), vid, vcol):
            xn2 = np.einsum("bd,bd->b", X, X)
            own_r, own_c = _own_pairs(qids_, by_id, ids) if exclude_self else (by_id[:0], by_id[:0])
            step = max(1, _CHUNK_ELEMS // len(ids))
            for a in range(0, q, step):
                rows = slice(a, min(q, a + step))
                lo, width = lo_[rows], hi_[rows] - lo_[rows]
                D = _approx(metric, Q_[rows], qn2[rows], X, xn2)
                per = bins / width
                # the error of D, at most that of the least distance, in bins
                e = _REL * (qn2[rows] + xn2.max(initial=0.0, where=np.isfinite(xn2)))
                error = (e if metric == "angular" else e / np.maximum(np.maximum(lo - np.sqrt(e), np.sqrt(e)), np.finfo(float).tiny)) * per + 1e-9
                D -= lo[:, None]
                D *= per[:, None]
                off = np.rint(D)
                np.subtract(D, off, out=off)
                np.abs(off, out=off)
                # re-measure points close to the edge of a bin with the direct formula
                rr, cc = _true(off <= error[:, None])
                d = np.floor((_exact_pairs(metric, Q_[rows], X, rr, cc) - lo[rr]) / width[rr] * bins)
                D[rr, cc] = d
                cut = slice(*np.searchsorted(own_r, (a, a + step)))
                out = ~np.isfinite(D)
                np.clip(D, 0, bins - 1, out=D)
                D[out] = bins  # counted nowhere, as a pair of a query with itself
                D[own_r[cut] - a, own_c[cut]] = bins
                b = D.astype(np.int64)
                b += np.arange(len(b))[:, None] * (bins + 1)
                counts[rows] += np.bincount(b.ravel(), minlength=len(b) * (bins + 1)).reshape(-1, bins + 1)[:, :bins]
        if q == 0:
            return
        offs = np.arange(0, (q + 1) * bins, bins, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids_, pa.int64()), pa.array(np.full(q, pid), pa.int32()),
             pa.ListArray.from_arrays(pa.array(offs), pa.array(counts.ravel(), pa.int64()))],
            names=["qid", "pid", "counts"])

    parts = _meet(vectors, queries, body, "qid long, pid int, counts array<bigint>", ("lo", "hi"), vid=vid, vcol=vcol, row_bytes=8 * bins)
    salts = SALTS

    def agg():
        zero = F.array_repeat(F.lit(0).cast("long"), F.lit(bins))
        return F.aggregate(F.collect_list("counts"), zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)).alias("counts")
    lvl1 = parts.groupBy("qid", F.pmod(F.col("pid"), F.lit(salts)).alias("salt")).agg(agg())
    return lvl1.groupBy("qid").agg(agg())


# ----------------------------------------------------- threshold pairs

def pairs_within(vectors: DataFrame, queries: DataFrame, thr_col: str = "thr", metric: str = "euclidean",
                 exclude_self: bool = False, vid: str = "id", vcol: str = "v") -> DataFrame:
    """All pairs with ``d <= thr`` (per-query threshold column): ``(qid, id, d)``,
    distances by the SQL-identical fold. Emits only the qualifying pairs."""
    _check_metric(metric)

    def body(side, pid, batches):
        qids_, Q_, T_ = side
        q = len(qids_)
        qn2 = np.einsum("qd,qd->q", Q_, Q_)
        by_id = np.argsort(qids_, kind="stable")
        for ids, X in _tiles(batches, vid, vcol):
            if q == 0:
                return
            xn2 = np.einsum("bd,bd->b", X, X)
            own_r, own_c = _own_pairs(qids_, by_id, ids) if exclude_self else (by_id[:0], by_id[:0])
            step = max(1, _SCORES // len(ids))
            for a in range(0, q, step):
                rows = slice(a, min(q, a + step))
                cand = _scores(metric, Q_[rows], X, xn2) >= _least_score(metric, T_[rows], qn2[rows], xn2)[:, None]
                cut = slice(*np.searchsorted(own_r, (a, a + step)))
                cand[own_r[cut] - a, own_c[cut]] = False
                rr, cc = _true(cand)
                if len(rr) == 0:
                    continue
                d = _exact_pairs(metric, Q_[rows], X, rr, cc)
                ok = d <= T_[rows][rr]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids_[rows][rr[ok]], pa.int64()), pa.array(ids[cc[ok]], pa.int64()), pa.array(d[ok])],
                    names=["qid", "id", "d"])

    return _meet(vectors, queries, body, "qid long, id long, d double", (thr_col,), vid=vid, vcol=vcol)


# queries whose distances a task gathers at once
_GATHER = 256
# share of a tile's pairs from which all of them are measured rather than the chosen ones
_DENSE = 0.3


def _gather(metric: str, Q: np.ndarray, thr: np.ndarray, qids: np.ndarray, ids: np.ndarray, X: np.ndarray, xn2: np.ndarray, m: int,
            exclude_self: bool) -> list[np.ndarray]:
    """For every query its ``m`` smallest distances of at most ``thr``, ascending."""
    qn2 = np.einsum("qd,qd->q", Q, Q)
    by_id = np.argsort(qids, kind="stable")
    rows, found, held = [], [], 0

    def sorted_lists() -> list[np.ndarray]:
        row, d = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(row, kind="stable")
        row, d = row[order], d[order]
        cut = np.searchsorted(row, np.arange(len(Q) + 1))
        return [np.sort(d[lo:hi])[:m] for lo, hi in zip(cut[:-1], cut[1:])]

    for a in range(0, len(ids), _TILE):
        to = slice(a, a + _TILE)
        may = _scores(metric, Q, X[to], xn2[to]) >= _least_score(metric, thr, qn2, xn2[to])[:, None]
        if exclude_self:
            may[_own_pairs(qids, by_id, ids[to])] = False
        if np.count_nonzero(may) > _DENSE * may.size:
            acc = np.zeros(may.shape)
            for x, y in zip(Q.T, X[to].T):
                if metric == "angular":
                    acc += x[:, None] * y[None, :]
                else:
                    t = x[:, None] - y[None, :]
                    t *= t
                    acc += t
            d = np.maximum(0.0, 1.0 - acc) if metric == "angular" else np.sqrt(acc)
            rr, cc = _true(may & (d <= thr[:, None]))
            d = d[rr, cc]
        else:
            rr, cc = _true(may)
            d = _exact_pairs(metric, Q, X[to], rr, cc)
            ok = d <= thr[rr]
            rr, d = rr[ok], d[ok]
        rows.append(rr.astype(np.int16))  # at most _GATHER of them: sorted by digits
        found.append(d)
        held += len(d)
        if held > 4 * m * len(Q) + _TILE * len(Q):  # many distances that are alike
            lists = sorted_lists()
            rows, found = [np.repeat(np.arange(len(Q), dtype=np.int16), list(map(len, lists)))], lists
            held = len(rows[0])
    return sorted_lists() if rows else [np.zeros(0)] * len(Q)


def _as_lists(lists: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0)))


def with_distances_within(vectors: DataFrame, queries: DataFrame, m: int, metric: str = "euclidean", exclude_self: bool = False) -> DataFrame:
    """``queries(qid, qv, thr, ...)`` with ``topk``, the ``m`` smallest distances of at most ``thr``, ascending, in place of ``qv`` and ``thr``.

    A query's list is gathered in the task that holds the query, for a few queries at once: vectors of at most ``MAX_QUERY_BYTES`` go to
    every task, and no distance is a row or shuffled. Larger ones meet the queries block by block, and the blocks' lists are merged, as are
    those of repeated ids; the lists of all blocks together have little more than ``m`` distances, as ``thr`` is near the m-th."""
    _check_metric(metric)
    spark = vectors.sparkSession
    st = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    ks = queries.agg(F.count("qid").alias("n"), F.count_distinct("qid").alias("keys")).first()
    rest = [c for c in queries.columns if c not in ("qid", "qv", "thr")]
    rows = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qv").cast("array<double>").alias("qv"), F.col("thr").cast("double").alias("thr"), *rest)
    if ks["n"] == ks["keys"] and st["n"] * max(st["dim"] or 0, 1) * 8 <= MAX_QUERY_BYTES:
        ids, X, _ = collect_queries(vectors, "id", "v")
        sent = spark.sparkContext.broadcast((ids, X, np.einsum("bd,bd->b", X, X)))
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
        schema = f"qid long, topk array<double>{', ' if rest else ''}{kinds}"
        shape = to_arrow_schema(StructType.fromDDL(schema))

        def body(batches):
            ids_, X_, xn2 = sent.value
            for whole in batches:
                for a in range(0, whole.num_rows, _GATHER):
                    b = whole.slice(a, _GATHER)
                    qids, thr = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                    lists = _gather(metric, _matrix(b, "qv"), thr, qids, ids_, X_, xn2, m, exclude_self)
                    yield pa.RecordBatch.from_arrays([b.column(0), _as_lists(lists), *[b.column(3 + i) for i in range(len(rest))]], names=shape.names)

        # a row is short but stands for all it meets: it is dealt to all cores
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(ks["n"] * m * 8 / _LIST_BYTES / 4))
        return rows.repartition(tasks, "qid").mapInArrow(body, schema)

    def blocks(side, pid, batches):
        ids_, X_ = side
        xn2 = np.einsum("bd,bd->b", X_, X_) if len(ids_) else np.zeros(0)
        for whole in batches:
            for a in range(0, whole.num_rows if len(ids_) else 0, _GATHER):
                b = whole.slice(a, _GATHER)
                qids, Q = b.column(b.schema.get_field_index("qid")).to_numpy(), _matrix(b, "w")
                lists = _gather(metric, np.ascontiguousarray(Q[:, :-1]), Q[:, -1], qids, ids_, X_, xn2, m, exclude_self)
                yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), _as_lists(lists)], names=["qid", "ds"])

    parts = _meet(rows.select("qid", F.concat("qv", F.array("thr")).alias("w")), vectors, blocks, "qid long, ds array<double>",
                  vid="qid", vcol="w", qid="id", qv="v")
    top = parts.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ds"))), 1, m).alias("topk"))
    # lists of m distances: Spark takes them for as small as the vectors they come from, and would broadcast them
    one = rows.select("qid", *rest).dropDuplicates(["qid"])
    return one.join(top.hint("merge"), "qid", "left").select("qid", F.coalesce("topk", F.array().cast("array<double>")).alias("topk"), *rest)


# ------------------------------------------------------------ all pairs

def all_pairs(vectors: DataFrame, queries: DataFrame, metric: str = "euclidean", exclude_self: bool = False,
              vid: str = "id", vcol: str = "v", qid: str = "qid", qv: str = "qv") -> DataFrame:
    """Every pair ``(qid, id, d)``, distances by the SQL-identical fold; a task holds one tile of pairs at once."""
    _check_metric(metric)

    def body(side, pid, batches):
        qids_, Q_ = side
        if len(qids_) == 0:
            return
        for ids, X in _tiles(batches, vid, vcol):
            step = max(1, _CHUNK_ELEMS // len(ids))
            for a in range(0, len(qids_), step):
                rows = slice(a, a + step)
                acc = np.zeros((len(qids_[rows]), len(ids)))
                for x, y in zip(Q_[rows].T, X.T):
                    if metric == "angular":
                        acc += x[:, None] * y[None, :]
                    else:
                        t = x[:, None] - y[None, :]
                        acc += t * t
                d = np.maximum(0.0, 1.0 - acc) if metric == "angular" else np.sqrt(acc)
                ok = ~_self_mask(qids_, ids, rows) if exclude_self else np.ones(d.shape, dtype=bool)
                rr, cc = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids_[rows][rr], pa.int64()), pa.array(ids[cc], pa.int64()), pa.array(d[ok])], names=["qid", "id", "d"])

    return _meet(vectors, queries, body, "qid long, id long, d double", vid=vid, vcol=vcol, qid=qid, qv=qv)
