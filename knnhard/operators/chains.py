"""Searches whose every step needs all vectors, run to their end inside one task.

Where the vectors fit into ``scan.MAX_QUERY_BYTES`` they are sent to every task, and a task takes its queries through
all steps of an annealing or gradient search: the steps of ``generate.anneal_search`` and ``generate.gradient_search``
with the same hash draws, without a Spark job for each. Larger tables, and vectors or starts with holes or repeated
query ids, are searched step by step there.
"""

from __future__ import annotations

import hashlib
import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from knnhard.operators import scan
from knnhard.session import keep

ADAM_B1, ADAM_B2, ADAM_EPS = 0.9, 0.999, 1e-8
# distances a task holds at once
_HELD = 4_000_000
# rows of a search handed over at once
_ROWS = 512


def uniform(seed, stream: str, key: str, j: int = 0) -> float:
    """``rand.uniform``, the same number."""
    return (int(hashlib.md5(f"{seed}:{stream}:{key}:{j}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32


def normal_vec(seed, stream: str, key: str, dim: int) -> np.ndarray:
    """``rand.normal_vec``, to the rounding of ``log`` and ``cos``."""
    u1, u2 = (np.array([uniform(seed, stream + s, key, j) for j in range(dim)]) for s in ("a", "b"))
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2 * math.pi * u2)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a * a).sum(-1, keepdims=True))


def post(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "angular":
        return _unit(x)
    if metric == "ip":
        x = x.copy()
        x[:, -1] = 0.0
    return x


def perturb(qids, x: np.ndarray, metric: str, scale: float, seed: int, step: int) -> np.ndarray:
    """One neighbour of every row of ``x``, as ``generate.perturb``."""
    keys = [f"{q}:{step}" for q in qids]
    r = np.array([normal_vec(seed, "dir", key, x.shape[1]) for key in keys])
    if metric != "angular":
        amount = -scale * np.log([uniform(seed, "amount", key) for key in keys])
        return post(x + amount[:, None] * _unit(r), metric)
    beta = np.array([uniform(seed, "beta", key) for key in keys]) ** (1.0 / (scale / (1.0 - scale)))
    ortho = _unit(r - (x * r).sum(1, keepdims=True) * x)
    return _unit(x + np.tan(np.arccos(1.0 - beta))[:, None] * ortho)


class Cells:
    """An inverted-list index in one task: centroids by id, their sizes, and the place of every vector's cell."""

    def __init__(self, C: np.ndarray, sizes: np.ndarray, place: np.ndarray, target_recall: float):
        self.C, self.sizes, self.place, self.target = C, sizes, place, target_recall


class Points:
    """All vectors in one task, and what a scan finds of a few queries among them."""

    def __init__(self, ids: np.ndarray, X: np.ndarray, metric: str, k: int, exclude_self: bool, cells: Cells | None):
        self.ids, self.X, self.metric, self.k, self.exclude_self, self.cells = ids, X, metric, k, exclude_self, cells
        self.xn2 = np.einsum("bd,bd->b", X, X)

    def _measure(self, qids: np.ndarray, Q: np.ndarray, exclude_self: bool):
        """(approximate distances, infinite where a pair does not count; their numbers; their means)"""
        D = scan._approx(self.metric, Q, np.einsum("qd,qd->q", Q, Q), self.X, self.xn2)
        if exclude_self:
            D[qids[:, None] == self.ids[None, :]] = np.inf
        out = ~np.isfinite(D)
        n = D.shape[1] - out.sum(1)
        D[out] = 0.0
        mean = D.sum(1) / n
        D[out] = np.inf
        return D, n, mean

    def _within(self, q: np.ndarray, D: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """(columns, exact distances) of one query's points that may be within ``t``."""
        limit = scan._limit(self.metric, np.array([t]), np.array([q @ q]), self.xn2)[0]
        at = np.flatnonzero((D <= limit) & np.isfinite(D))
        return at, scan._fold(q[None, :], self.X[at], self.metric)

    def _nearest(self, q: np.ndarray, D: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, exact distances) of the ``m`` nearest of one query by (d, id)."""
        at, d = self._within(q, D, np.partition(D, m - 1)[m - 1])
        order = np.lexsort((self.ids[at], d))[:m]
        return at[order], d[order]

    def contrast(self, qids: np.ndarray, Q: np.ndarray) -> np.ndarray:
        """RC with index k."""
        D, _, mean = self._measure(qids, Q, self.exclude_self)
        dk = np.array([self._nearest(q, row, self.k + 1)[1][self.k] for q, row in zip(Q, D)])
        with np.errstate(divide="ignore"):
            return mean / dk

    def gradient(self, qids: np.ndarray, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(RC, its gradient), as ``generate.rc_gradient``."""
        D, n, mean = self._measure(qids, Q, self.exclude_self)
        near = [self._nearest(q, row, self.k + 1) for q, row in zip(Q, D)]
        pk, dk = self.X[[at[self.k] for at, _ in near]], np.array([d[self.k] for _, d in near])[:, None]
        if self.metric == "angular":
            g, ddk = -np.isfinite(D).astype(float) @ np.where(np.isfinite(self.xn2)[:, None], self.X, 0.0), -pk
        else:
            inv = np.where(np.isfinite(D) & (D > 0), 1.0 / np.where(D > 0, D, 1.0), 0.0)
            g, ddk = inv.sum(1)[:, None] * Q - inv @ np.where(np.isfinite(self.xn2)[:, None], self.X, 0.0), (Q - pk) / dk
        grad = (g / n[:, None]) / dk - mean[:, None] * ddk / (dk * dk)
        if self.metric == "ip":
            grad[:, -1] = 0.0
        return mean / dk[:, 0], grad

    def distcomp(self, qids: np.ndarray, Q: np.ndarray) -> np.ndarray:
        """Share of the distances that an nprobe search computes at the target recall, as ``ivf.hardness``."""
        cells, out = self.cells, np.full(len(Q), np.nan)
        D, n, _ = self._measure(qids, Q, False)
        cd = scan._fold(Q[:, None, :], cells.C[None, :, :], self.metric)
        for r, q in enumerate(Q):
            thr = self._nearest(q, D[r], self.k)[1][-1] + 1e-3
            at, d = self._within(q, D[r], thr)
            hits = np.bincount(cells.place[at[d <= thr]], minlength=len(cells.C))
            order = np.argsort(cd[r], kind="stable")
            order = order[np.isfinite(cd[r][order])]
            recall = np.minimum(np.cumsum(hits[order]), self.k) / float(self.k)
            enough = np.flatnonzero(recall >= cells.target)
            if len(enough):
                out[r] = (cells.sizes[order][:enough[0] + 1].sum() + len(cells.C)) / n[r]
        return out


def points(vectors: DataFrame, starts: DataFrame, k: int, metric: str, exclude_self: bool, score_fn):
    """The vectors as a broadcast ``Points``; None where the search has to go step by step: vectors too large for every task, holes,
    ragged lengths, repeated query ids, no k + 1 vectors, or a score that knows no index of cells."""
    if score_fn is not None and getattr(score_fn, "cells", None) is None:
        return None

    def shape(df: DataFrame, key: str, col: str):
        holes = F.col(key).isNull() | F.col(col).isNull() | F.exists(col, lambda x: x.isNull() | F.isnan(x))
        return df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi"),
                      F.max(holes.cast("int")).alias("holes"), F.count_distinct(key).alias("keys")).first()

    s, v = shape(starts, "qid", "x"), shape(vectors, "id", "v")
    if s["n"] == 0 or s["n"] != s["keys"] or s["holes"] or v["holes"] or not s["lo"] == s["hi"] == v["lo"] == v["hi"]:
        return None
    if v["n"] <= k + 1 or v["n"] * v["hi"] * 8 > scan.MAX_QUERY_BYTES:
        return None
    cells = None
    if score_fn is None:
        ids, X, _ = scan.collect_queries(vectors, "id", "v", max_bytes=scan.MAX_QUERY_BYTES)
    else:
        centroids, assignment, target_recall = score_fn.cells
        cids, C = scan.collect_centres(centroids)
        held = dict(map(tuple, assignment.groupBy("cid").count().collect()))  # one row per cell
        with_cells = scan.nearest_centre(vectors, centroids, metric, keep_vectors=True)
        ids, X, more = scan.collect_queries(with_cells, "id", "v", ("cid",), max_bytes=scan.MAX_QUERY_BYTES)
        cells = Cells(C, np.array([held.get(c, 0) for c in cids]), np.searchsorted(cids, more["cid"]), target_recall)
    return vectors.sparkSession.sparkContext.broadcast(Points(ids, X, metric, k, exclude_self, cells))


def _run(starts: DataFrame, sent, body, schema: str) -> DataFrame:
    """Rows that ``body(points, qids, x)`` yields for the queries ``starts(qid, x)``, dealt to all cores; written once."""
    cores = starts.sparkSession.sparkContext.defaultParallelism
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        held = pa.Table.from_batches(got)
        all_points, qids = sent.value, held.column("qid").to_numpy()
        x = held.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qids), -1)
        step = max(1, _HELD // len(all_points.ids))
        rows = []
        for a in range(0, len(qids), step):
            for row in body(all_points, qids[a:a + step], x[a:a + step]):
                rows.extend(zip(*row))
                if len(rows) >= _ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([plain(v) for v in col], t.type) for col, t in zip(zip(*rows), shape)], names=shape.names)

    def plain(v):
        return v.item() if isinstance(v, np.generic) else v

    return keep(starts.select("qid", "x").repartition(cores).mapInArrow(task, schema))


def anneal(starts: DataFrame, sent, low: float, high: float, scale: float, max_steps: int, t1: float, metric: str, seed: int,
           by_cells: bool) -> DataFrame:
    """The state of every query after every step (iteration -1: its start), as the parts of ``generate.anneal_search``."""
    threshold = max(max_steps // 100, 10)

    def score(p: Points, qids, x):
        if by_cells:
            return p.distcomp(qids, x)
        with np.errstate(divide="ignore"):
            return -np.log(p.contrast(qids, x))

    def gap(y):
        return np.minimum(np.abs(y - low), np.abs(y - high))

    def body(p: Points, qids, x):
        began = time.time()
        y = score(p, qids, x)
        best_x, best_y, best_score, stale = x, y, y, np.zeros(len(x), dtype=int)
        reached, came = (y >= low) & (y <= high), np.full(len(x), None)
        for step in range(-1, max_steps):
            if step >= 0:
                back = stale >= threshold
                x, y, stale = np.where(back[:, None], best_x, x), np.where(back, best_y, y), np.where(back, 0, stale)
                cand = perturb(qids, x, metric, scale, seed, step)
                y_next = score(p, qids, cand)
                u = np.array([uniform(seed, "metropolis", f"{q}:{step}") for q in qids])
                with np.errstate(invalid="ignore"):
                    reached = (y_next >= low) & (y_next <= high)
                    closer = ~reached & (gap(y_next) <= gap(y))
                    moves = reached | closer | (u < np.exp(-np.abs(y - y_next) / (t1 / (step + 1))))
                    better = gap(y_next) < gap(best_score)
                came = y
                x, y = np.where(moves[:, None], cand, x), np.where(moves, y_next, y)
                best_x, best_y = np.where(closer[:, None], cand, best_x), np.where(closer, y_next, best_y)
                best_score, stale = np.where(better, y_next, best_score), np.where(closer, 0, stale + 1)
            yield qids, x, y, best_score, reached, came, np.full(len(x), time.time() - began), np.full(len(x), step)
            live = ~reached
            qids, x, y, best_x, best_y, best_score, stale = (a[live] for a in (qids, x, y, best_x, best_y, best_score, stale))
            if len(qids) == 0:
                return

    return _run(starts, sent, body, f"qid {starts.schema['qid'].dataType.simpleString()}, x array<double>, y double, best_score double, reached boolean, "
                "from_y double, elapsed_s double, iteration long")


def descend(starts: DataFrame, sent, low: float, high: float, lr: float, max_iter: int, metric: str, by_cells: bool) -> DataFrame:
    """The points of every query with their RC and score, as the parts of ``generate.gradient_search``."""
    def body(p: Points, qids, x):
        began = time.time()
        m, v = np.zeros_like(x), np.zeros_like(x)
        for it in range(max_iter):
            rc, g = p.gradient(qids, x)
            score = p.distcomp(qids, x) if by_cells else rc
            inside = (score >= low) & (score <= high)
            yield qids, x, rc, score, inside, np.full(len(x), time.time() - began), np.full(len(x), it)
            live = ~inside
            if not live.any() or it == max_iter - 1:
                return
            qids, x, m, v, g, score = (a[live] for a in (qids, x, m, v, g, score))
            if metric == "angular":
                g = g - (g * x).sum(1, keepdims=True) * x
                norm = np.sqrt((g * g).sum(1, keepdims=True))
                g = g / np.where(norm > 0, norm, 1.0)
            g = np.where((score > high if by_cells else score < high)[:, None], -g, g)
            m, v = ADAM_B1 * m + (1 - ADAM_B1) * g, ADAM_B2 * v + (1 - ADAM_B2) * g * g
            x = post(x - lr * (m / (1 - ADAM_B1 ** (it + 1))) / (np.sqrt(v / (1 - ADAM_B2 ** (it + 1))) + ADAM_EPS), metric)

    return _run(starts, sent, body, f"qid {starts.schema['qid'].dataType.simpleString()}, x array<double>, rc double, score double, inside boolean, "
                "elapsed_s double, iteration long")
