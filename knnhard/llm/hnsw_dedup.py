"""Near-duplicate vectors through hierarchical navigable small-world graphs, one per shard.

Equal vectors become one node with a weight. The nodes are dealt over shards by digest, and every
shard builds its graph: each node has a random top layer, and a new node is linked on its layers to the
diverse nearest ones that a beam search finds. A node within half the linking angle of a
graph node joins the ball around that node instead of becoming one, so a large group of near copies
is one node of the graph and not a clique. Every graph node then queries the graph of every shard
with a beam; a beam that is full of nodes in range is widened, and an audit of sampled nodes against the
whole shard widens the beams of the pair of shards until its recall passes (the widest beam is
the shard itself). Besides the true links of its sample, an audit asks for nodes of the shard from
probes that stand at the linking angle, so it is never empty. Found balls are verified: angles that the triangle inequality leaves open are
measured, vector by vector, as cosines in double precision. Links between balls are united
into components by the distributed stars of ``components``.

Shards hold 32 sqrt(n) nodes (at most ``max_rows``, which bounds a task's memory), so the pairs of
shards grow with n, not with its square.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import attach, col, materialise, table
from knnhard.llm.components import components

_BATCH = 512


# ---- the graph of one shard

def _sorted_beam(ids: np.ndarray, sim: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sim, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def beam_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, start: np.ndarray, width: int,
                step: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that a beam of that width finds on one layer, for a batch of queries.

    ``adj`` holds the layer's neighbours (-1: none), ``start`` the entry nodes of each query. In every
    round each query expands its ``step`` best nodes not yet expanded; it ends when all of its beam is.
    """
    n_q = len(q)
    seen = np.zeros((n_q, len(adj) + 1), bool)
    seen[:, -1] = True  # where -1 points
    rows = np.arange(n_q)[:, None]
    sim = np.where(start >= 0, np.einsum("qd,qkd->qk", q, x[start]), -np.inf).astype("f4")
    seen[rows, start] = True
    ids, sim = _sorted_beam(start, sim, width)
    if ids.shape[1] < width:
        pad = ((0, 0), (0, width - ids.shape[1]))
        ids, sim = np.pad(ids, pad, constant_values=-1), np.pad(sim, pad, constant_values=-np.inf)
    done = ids < 0
    step = min(step, width)
    live = np.arange(n_q)
    while len(live):
        open_sim = np.where(done[live], -np.inf, sim[live])
        pick = np.argpartition(-open_sim, step - 1, axis=1)[:, :step]
        some = np.isfinite(np.take_along_axis(open_sim, pick, 1))
        on = some[:, :].any(1)
        live, pick, some = live[on], pick[on], some[on]
        if not len(live):
            break
        own = live[:, None]
        done[own, pick] = True
        new = np.where(some[:, :, None], adj[np.where(some, ids[own, pick], 0)], -1).reshape(len(live), -1)
        new[seen[own, new]] = -1
        if step > 1:
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        seen[own, new] = True
        fresh = np.matmul(x[new], q[live][:, :, None])[:, :, 0]
        fresh[new < 0] = -np.inf
        all_sim = np.concatenate([sim[live], fresh], 1)
        keep = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
        sim[live] = np.take_along_axis(all_sim, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new], 1), keep, 1)
        flags = np.concatenate([done[live], new < 0], 1)
        done[live] = np.take_along_axis(flags, keep, 1)
    return _sorted_beam(ids, sim, width)


def _diverse(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 none) those that are nearer to the node than to any chosen one;
    free places go to the nearest of the rest."""
    out = np.full((len(cand), degree), -1, "i4")
    for a in range(0, len(cand), 1024):
        c, s = cand[a:a + 1024], sim[a:a + 1024]
        v = x[c]
        near = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            clash = ((near[:, j] > s[:, j, None]) & chosen).any(1)
            chosen[:, j] = (c[:, j] >= 0) & ~clash & (chosen.sum(1) < degree)
        rank = np.argsort(np.where(c < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
        best = np.take_along_axis(c, rank, 1)
        out[a:a + 1024, :best.shape[1]] = best
    return out


def _link_back(x: np.ndarray, adj: np.ndarray, src: np.ndarray, to: np.ndarray) -> None:
    """Enter ``src`` among the neighbours of ``to``; a node with too many keeps a diverse choice."""
    if not len(to):
        return
    degree = adj.shape[1]
    sim = np.einsum("ed,ed->e", x[src], x[to])
    order = np.lexsort((-sim, to))
    src, to = src[order], to[order]
    nodes, first, n = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, n)
    fits = place < degree
    more = np.full((len(nodes), min(degree, int(n.max()))), -1, "i4")
    more[np.repeat(np.arange(len(nodes)), n)[fits], place[fits]] = src[fits]
    for a in range(0, len(nodes), 2048):
        some = nodes[a:a + 2048]
        cand = np.concatenate([adj[some], more[a:a + 2048]], 1)
        s = np.matmul(x[cand], x[some][:, :, None])[:, :, 0]
        s[cand < 0] = -np.inf
        cand, s = _sorted_beam(cand, s, cand.shape[1])
        full = (cand >= 0).sum(1) > degree
        adj[some[~full]] = cand[~full, :degree]
        if full.any():
            adj[some[full]] = _diverse(x, cand[full], s[full], degree)


def build_graph(unit: np.ndarray, join_cos: float, seed: int, degree: int = 12, width: int = 64) -> dict[str, np.ndarray]:
    """Graph of the rows of ``unit`` (unit vectors, float32): ``leader`` (the row of every graph node, so that the
    nodes of a layer are a prefix), ``ball`` (the node whose ball holds each row) and ``adj0``, ``adj1``, ... by layer."""
    n = len(unit)
    level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-300) / math.log(degree)).astype("i4")
    level = np.minimum(level, 12)
    order = np.argsort(-level, kind="stable")
    top = int(level.max()) if n else 0
    x = np.zeros((n + 1, unit.shape[1]), "f4")  # the last row is what -1 points to
    layers = [np.full((int((level >= k).sum()), degree * (2 if k == 0 else 1)), -1, "i4") for k in range(top + 1)]
    leader = np.empty(n, "i4")
    ball = np.empty(n, "i4")
    held = 0
    begin = 0
    while begin < n:
        rows = order[begin:begin + max(16, min(_BATCH, begin))]
        begin += len(rows)
        q = unit[rows]
        found = {}
        if held:
            start = np.zeros((len(rows), 1), "i4")
            for k in range(top, 0, -1):
                here = int((level[order[:begin - len(rows)]] >= k).sum())
                if min(here, held) == 0:
                    continue
                part = int((level[rows] >= k).sum())  # these rows link on this layer
                ids, sim = beam_search(x, layers[k], q, start, width if part else 1)
                found[k] = ids, sim
                start = ids[:, :1]
            found[0] = beam_search(x, layers[0], q, start, width)
            near = found[0][0][:, 0], found[0][1][:, 0]
        else:
            near = np.full(len(rows), -1, "i4"), np.full(len(rows), -np.inf)
        mutual = q @ q.T
        joined = np.where(near[1] >= join_cos, near[0], -1)
        at = np.full(len(rows), -1, "i4")
        close = mutual >= join_cos
        fresh = []
        for r in range(len(rows)):
            if joined[r] < 0:
                at[r] = held + len(fresh)
                fresh.append(r)
                joined[r] = at[r]
                others = close[r] & (joined < 0)
                joined[others] = at[r]
        ball[rows] = joined
        if not fresh:
            continue
        new = np.array(fresh)
        nodes = at[new]
        leader[nodes] = rows[new]
        x[nodes] = q[new]
        mutual = mutual[np.ix_(new, new)]
        np.fill_diagonal(mutual, -np.inf)
        for k in range(int(level[rows[new]].max()), -1, -1):
            mine = level[rows[new]] >= k
            own, own_sim = nodes[mine], mutual[np.ix_(mine, mine)]
            cand = np.broadcast_to(own, own_sim.shape)
            if k in found:
                ids, sim = found[k]
                cand = np.concatenate([ids[new][mine], cand], 1)
                own_sim = np.concatenate([sim[new][mine], own_sim], 1)
            cand = np.where(np.isfinite(own_sim), cand, -1)
            cand, own_sim = _sorted_beam(cand, own_sim, min(width, cand.shape[1]))
            picked = _diverse(x, cand, own_sim, layers[k].shape[1])
            layers[k][own] = picked
            src = np.repeat(own, picked.shape[1])
            _link_back(x, layers[k], src[picked.ravel() >= 0], picked[picked >= 0])
        held += len(new)
    out = {"leader": leader[:held], "ball": ball}
    for k, adj in enumerate(layers):
        out[f"adj{k}"] = adj[:held]
    return out


def search(graph: dict[str, np.ndarray], x: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest graph nodes of the queries: down the layers with a narrow beam, then along the lowest with ``width``."""
    top = max(int(k[3:]) for k in graph if k.startswith("adj") and len(graph[k]))
    ids, sim = [], []
    for a in range(0, len(q), _BATCH):
        part = q[a:a + _BATCH]
        start = np.zeros((len(part), 1), "i4")
        for k in range(top, 0, -1):
            start = beam_search(x, graph[f"adj{k}"], part, start, 1)[0]
        found = beam_search(x, graph["adj0"], part, start, width)
        ids.append(found[0])
        sim.append(found[1])
    return np.concatenate(ids), np.concatenate(sim)


# ---- one shard, one pair of shards

def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype("f8")
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


class Shard:
    """A shard read back: unit vectors in double precision, graph, balls with their radii."""

    def __init__(self, blob: bytes):
        a = dict(np.load(io.BytesIO(blob), allow_pickle=False))
        self.node, self.weight, self.unit = a.pop("node"), a.pop("weight"), _unit(a.pop("vec"))
        self.graph = a
        self.leader, self.ball = a["leader"], a["ball"]
        self.x = np.vstack([self.unit[self.leader], np.zeros((1, self.unit.shape[1]))]).astype("f4")
        order = np.argsort(self.ball, kind="stable")
        cut = np.searchsorted(self.ball[order], np.arange(len(self.leader) + 1))
        self.order, self.cut = order, cut
        cos = np.einsum("nd,nd->n", self.unit, self.unit[self.leader[self.ball]])
        self.radius = np.zeros(len(self.leader))
        np.maximum.at(self.radius, self.ball, np.where(np.arange(len(cos)) == self.leader[self.ball], 0, np.arccos(np.clip(cos, -1, 1)) + 1e-7))
        self.size = np.diff(cut)

    def members(self, b: int) -> np.ndarray:
        return self.order[self.cut[b]:self.cut[b + 1]]


def pack_shard(node: np.ndarray, weight: np.ndarray, vec: np.ndarray, join_cos: float, seed: int) -> bytes:
    out = io.BytesIO()
    np.savez(out, node=node, weight=weight, vec=vec, **build_graph(_unit(vec).astype("f4"), join_cos, seed))
    return out.getvalue()


def _at_angle(x: np.ndarray, angle: float) -> np.ndarray:
    """For every unit vector one at ``angle`` from it, in a fixed random direction."""
    side = np.random.default_rng(len(x)).standard_normal(x.shape)
    side -= np.einsum("nd,nd->n", side, x)[:, None] * x
    norm = np.sqrt(np.einsum("nd,nd->n", side, side))[:, None]
    return (math.cos(angle) * x + math.sin(angle) * np.where(norm > 0, side / np.maximum(norm, 1e-300), 0)).astype("f4")


def _near_pairs(a: Shard, b: Shard, angle: float, width: int, target: float, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (graph node of a, graph node of b) whose balls may hold a link, by the beams of a in b's graph."""
    n = len(b.leader)
    q = a.x[:-1]
    # a ball of b can reach a query at this cosine; float32 products need the slack
    reach = np.cos(np.minimum(angle + a.radius + (b.radius.max() if n else 0), math.pi)).astype("f4") - np.float32(1e-5)
    audited = np.unique(np.linspace(0, len(q) - 1, min(sample, len(q))).astype("i8"))
    wanted = q[audited] @ b.x[:-1].T >= reach[audited, None]
    if a is b:
        wanted[np.arange(len(audited)), audited] = False
    probed = np.unique(np.linspace(0, n - 1, min(sample, n)).astype("i8"))
    probes = _at_angle(b.x[probed], angle)
    todo = np.arange(len(q))
    ids = sim = None
    left, right = [], []
    while len(todo):
        if width * 4 >= n:  # the beam would be most of the shard: the shard itself
            for s in range(0, len(todo), 1024):
                some = todo[s:s + 1024]
                u, v = np.nonzero(q[some] @ b.x[:-1].T >= reach[some, None])
                left.append(some[u])
                right.append(v)
            break
        ids, sim = search(b.graph, b.x, q[todo], width)
        if len(todo) == len(q):
            got = np.zeros_like(wanted)
            hit = ids[audited]
            np.put_along_axis(got, np.where(hit >= 0, hit, hit[:, :1]), True, 1)
            found = (search(b.graph, b.x, probes, width)[0] == probed[:, None]).any(1)
            if (got & wanted).sum() < target * wanted.sum() or found.mean() < target:
                width *= 2
                continue
        hits = sim >= reach[todo, None]
        full = hits.all(1)  # there may be more in range than the beam holds
        u, v = np.nonzero(hits & ~full[:, None])
        left.append(todo[u])
        right.append(ids[u, v])
        todo = todo[full]
        width *= 4
    if not left:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return np.concatenate(left).astype("i8"), np.concatenate(right).astype("i8")


def link_shards(a: Shard, b: Shard, min_cos: float, width: int = 48, target: float = 0.97,
                sample: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's rows in b, links of b's rows in a, linked pairs of balls), verified; ``a is b`` for a shard with itself.

    Links count the weight of the other side; a row's own weight is not among them.
    """
    angle = math.acos(min_cos)
    u, v = _near_pairs(a, b, angle, width, target, sample)
    if a is not b:
        v2, u2 = _near_pairs(b, a, angle, width, target, sample)
        u, v = np.concatenate([u, u2]), np.concatenate([v, v2])
    else:
        u, v = np.minimum(u, v), np.maximum(u, v)
        # a ball of several rows meets itself
        several = np.nonzero(a.size > 1)[0]
        u, v = np.concatenate([u[u < v], several]), np.concatenate([v[u < v], several])
    pairs = np.unique(u * (len(b.leader) + 1) + v)
    u, v = pairs // (len(b.leader) + 1), pairs % (len(b.leader) + 1)
    n_a = np.zeros(len(a.node), "i8")
    n_b = n_a if a is b else np.zeros(len(b.node), "i8")
    linked = np.zeros(len(u), bool)
    single = (a.size[u] == 1) & (b.size[v] == 1)
    at = np.nonzero(single)[0]
    for s in range(0, len(at), 1 << 16):
        some = at[s:s + (1 << 16)]
        ra, rb = a.leader[u[some]], b.leader[v[some]]
        hit = np.einsum("nd,nd->n", a.unit[ra], b.unit[rb]) >= min_cos
        np.add.at(n_a, ra[hit], b.weight[rb[hit]])
        np.add.at(n_b, rb[hit], a.weight[ra[hit]])
        linked[some[hit]] = True
    for i in np.nonzero(~single)[0]:
        ra, rb = a.members(u[i]), b.members(v[i])
        same = a is b and u[i] == v[i]
        cos = a.unit[ra] @ b.unit[b.leader[v[i]]]
        far = np.arccos(np.clip(cos, -1, 1))
        whole = far + b.radius[v[i]] <= angle - 1e-7  # every row of the ball is linked
        open_ = ~whole & (far - b.radius[v[i]] <= angle + 1e-7)
        total = int(b.weight[rb].sum())
        if whole.any():
            n_a[ra[whole]] += total - (a.weight[ra[whole]] if same else 0)
            if not same:
                n_b[rb] += int(a.weight[ra[whole]].sum())
            linked[i] = True
        rest = ra[open_]
        for s in range(0, len(rest), 1024):
            some = rest[s:s + 1024]
            for t in range(0, len(rb), 8192):
                other = rb[t:t + 8192]
                hit = a.unit[some] @ b.unit[other].T >= min_cos
                if same:
                    hit &= some[:, None] != other
                n_a[some] += hit @ b.weight[other]
                if not same:
                    n_b[other] += a.weight[some] @ hit
                linked[i] |= bool(hit.any())
    return n_a, n_b, np.stack([u[linked], v[linked]], 1)


# ---- the job

def _build(min_cos: float):
    join_cos = math.cos(math.acos(min_cos) / 2 - 1e-6)

    def run(rows: pa.Table) -> pa.Table:
        shard, dim = rows.column("shard")[0].as_py(), rows.column("dim")[0].as_py()
        rows = rows.sort_by("node")
        vec = rows.column("vec").combine_chunks()
        vec = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        blob = pack_shard(rows.column("node").to_numpy(), rows.column("weight").to_numpy(), vec, join_cos, shard)
        return pa.table({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()),
                         "blob": pa.array([blob], pa.binary())})

    return run


def _search(min_cos: float, width: int, target: float, sample: int):
    def rows(a: np.ndarray, n: np.ndarray | None, b: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if n is None else pa.array(n, pa.int64()),
                                           none if b is None else pa.array(b, pa.int64())], names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                first = Shard(batch.column("blob_a")[r].as_py())
                alone = batch.column("a")[r].as_py() == batch.column("b")[r].as_py()
                second = first if alone else Shard(batch.column("blob_b")[r].as_py())
                n_a, n_b, pairs = link_shards(first, second, min_cos, width, target, sample)
                for shard, n in ((first, n_a),) if alone else ((first, n_a), (second, n_b)):
                    some = np.nonzero(n)[0]
                    yield rows(shard.node[some], n[some], None)
                yield rows(first.node[first.leader[pairs[:, 0]]], None, second.node[second.leader[pairs[:, 1]]])
                if alone:  # the rows of a ball are linked through its middle
                    other = np.nonzero(first.leader[first.ball] != np.arange(len(first.ball)))[0]
                    yield rows(first.node[other], None, first.node[first.leader[first.ball[other]]])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cos: float = 0.9,
                    width: int = 48, target_recall: float = 0.97, audit: int = 512, max_rows: int = 131_072) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link when the cosine of their vectors, in double precision, is at least ``min_cos`` (over 0, under 1); n_links counts the other
    rows linked directly, component_id is the smallest id reachable. Links below the threshold are never
    counted; links above it are found with the audited recall: per pair of shards, ``audit`` nodes are compared with
    the whole shard and ``audit`` probes are searched for, and the beams (``width`` at first) widen until
    ``target_recall`` of both are found.
    A vector that is null, empty, zero or holds null or non-finite components links with nothing;
    vectors of different lengths never link. Rows repeating id and vector are rows of their own and link with each
    other; a null id is never a component's id while another row of it has one (kept is false for it). An
    empty table gives an empty result; other columns are not read.
    """
    if not 0 < min_cos < 1:
        raise ValueError("min_cos must lie between 0 and 1")
    spark = vectors.sparkSession
    v = col(vec_col)
    good = F.coalesce(F.size(v) > 0, F.lit(False)) \
        & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(col(id_col).alias("id"), F.when(good, v).alias("vec")) \
        .withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    # map-side combined: copies of one vector are one node
    nodes = rows.where("vec is not null").groupBy("h1", "h2").agg(
        F.first("vec").alias("vec"), F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "hnsw-nodes")
    n = nodes.count()
    shards = max(1, math.ceil(n / min(max_rows, 32 * math.isqrt(max(n, 1)))))
    dealt = nodes.select("node", "weight", "vec", F.size("vec").cast("int").alias("dim"),
                         F.pmod(F.xxhash64("h2", "h1"), F.lit(shards)).cast("int").alias("shard"))
    graphs = dealt.repartition(shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(
        _build(min_cos), "shard int, dim int, blob binary")
    graphs = materialise(graphs, "hnsw-graphs")
    index = graphs.select("shard", "dim")
    pairs = index.toDF("a", "dim").join(index.toDF("b", "dim"), "dim").where("a <= b")
    tasks = min(20_000, 2 * shards * (shards + 1))
    met = (pairs.join(graphs.toDF("a", "dim", "blob_a"), ["a", "dim"])
           .join(graphs.toDF("b", "dim", "blob_b"), ["b", "dim"])
           .select("a", "b", "blob_a", F.when(F.col("a") < F.col("b"), F.col("blob_b")).alias("blob_b"))
           .repartition(tasks, "a", "b"))
    found = materialise(met.mapInArrow(_search(min_cos, width, target_recall, audit), "node long, links long, other long"),
                        "hnsw-links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select("node", "other").distinct())
    member = materialise(nodes.select("node", "h1", "h2", "least", "weight").join(roots, "node", "left")
                         .withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
                         .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1), "hnsw-members")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    member = attach(member, "root", least, F.col("node")).select("h1", "h2", "links", "component")
    some = attach(rows.where("vec is not null").select("id", "h1", "h2"), "h1", _by_key(member), F.col("id"))
    some = some.select("id", F.explode("classes").alias("c"), "h2").where("c.h2 = h2").select("id", "c.links", "c.component")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = some.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"),
                      F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _by_key(member: DataFrame) -> DataFrame:
    """Unique on h1: its classes, which are more than one only where two hashes meet."""
    return member.groupBy("h1").agg(F.collect_list(F.struct("h2", "links", "component")).alias("classes"))


def op13_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings``: every vector with its links of cosine 0.9 or more and its component."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
