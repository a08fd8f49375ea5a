"""DuckDB SQL fragments for the oracles (independent of the Spark code path)."""

from __future__ import annotations


def r6(x: str) -> str:
    return f"(round(({x})::DOUBLE, 6) + 0.0)"


def dist(metric: str, a: str = "q.qv", b: str = "x.v") -> str:
    if metric in ("euclidean", "ip"):
        return (f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
                f"lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))")
    if metric == "angular":
        return f"greatest(0.0, 1.0 - {dot(a, b)})"
    raise ValueError(metric)


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def norm2(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))"


def vsum(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: x::DOUBLE))"


def pairs(metric: str = "euclidean", vt: str = "vectors", qt: str = "queries", self_excl: bool = True,
          extra: str = "") -> str:
    cond = "q.qid <> x.id" if self_excl else "TRUE"
    return f"SELECT q.qid, x.id{extra}, {dist(metric)} AS d FROM {qt} q JOIN {vt} x ON {cond}"


RANKED = ("SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) - 1 AS r, "
          "count(*) OVER (PARTITION BY qid) AS n, avg(d) OVER (PARTITION BY qid) AS mean_d FROM pairs")


def uniform(seed, stream: str, key: str, j: str = "0") -> str:
    s = f"concat_ws(':', '{seed}', '{stream}', ({key})::VARCHAR, ({j})::VARCHAR)"
    return f"((('0x' || substr(md5({s}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def normal(seed, stream: str, key: str, j: str = "0") -> str:
    u1 = uniform(seed, stream + "a", key, j)
    u2 = uniform(seed, stream + "b", key, j)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2 * 3.141592653589793!r} * {u2}))"
