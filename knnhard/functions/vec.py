"""Column expressions over ``ARRAY<FLOAT>`` vectors.

Everything here is a plain Spark SQL expression (higher-order array
functions), evaluated in the JVM; values are widened to DOUBLE first so that
results do not depend on float32 summation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "let", "dvec", "vsum", "dot", "sqdist", "euclidean", "angular", "norm2", "norm",
    "normalise", "pad_to", "pad8", "lift_ip", "zero_last", "nan_to_zero",
    "nan_count", "all_finite", "any_nonzero", "znorm", "metric_distance",
    "rnd",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a bound lambda
    variable. Spark does not hoist sub-expressions out of array lambdas, so
    an array used inside ``transform(a, x -> ... a ...)`` would otherwise be
    recomputed per element."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def dvec(c) -> Column:
    """Array widened to DOUBLE elements."""
    return _c(c).cast("array<double>")


def vsum(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return vsum(F.zip_with(dvec(a), dvec(b), lambda x, y: x * y))


def sqdist(a, b) -> Column:
    return vsum(F.zip_with(dvec(a), dvec(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a, b) -> Column:
    return F.sqrt(sqdist(a, b))


def angular(a, b) -> Column:
    """``1 - a.b`` on unit vectors, clamped at 0 (the reference clamps too)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b))


def norm2(a) -> Column:
    return vsum(F.transform(dvec(a), lambda x: x * x))


def norm(a) -> Column:
    return F.sqrt(norm2(a))


def normalise(a) -> Column:
    return let(dvec(a), lambda b: let(norm(b), lambda n: F.transform(b, lambda x: x / n)))


def pad_to(a, multiple: int = 8) -> Column:
    """Zero-pad to a multiple of ``multiple`` dimensions: pad = (m - dim % m) % m."""
    a = _c(a)
    pad = F.pmod(-F.size(a), F.lit(multiple))
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), pad))


def pad8(a) -> Column:
    return pad_to(a, 8)


def lift_ip(a, scale=1.0) -> Column:
    """Inner-product to Euclidean lift of a data vector: append sqrt(1-|x|^2).

    ``scale`` divides the vector first (pass the maximum norm so that every
    norm is <= 1; the reference has no guard and yields NaN otherwise).
    """
    s = F.lit(scale) if not isinstance(scale, Column) else scale
    return let(F.transform(dvec(a), lambda e: e / s),
               lambda x: F.concat(x, F.array(F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - norm2(x))))))


def zero_last(a) -> Column:
    return let(dvec(a), lambda b: F.concat(F.slice(b, 1, F.size(b) - 1), F.array(F.lit(0.0))))


def nan_to_zero(a) -> Column:
    return F.transform(_c(a), lambda x: F.nanvl(x, F.lit(0.0).cast("float")))


def nan_count(a) -> Column:
    return F.size(F.filter(_c(a), lambda x: F.isnan(x)))


def all_finite(a) -> Column:
    return F.forall(dvec(a), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def any_nonzero(a) -> Column:
    return F.exists(_c(a), lambda x: x != 0)


def znorm(a) -> Column:
    """Per-row z-normalisation with the population standard deviation."""
    def body(b):
        n = F.size(b)
        return let(vsum(b) / n, lambda mean: let(
            F.sqrt(vsum(F.transform(b, lambda x: (x - mean) * (x - mean))) / n),
            lambda sd: F.transform(b, lambda x: (x - mean) / sd)))
    return let(dvec(a), body)


def metric_distance(q, v, metric: str) -> Column:
    if metric in ("euclidean", "ip"):
        return euclidean(q, v)
    if metric == "angular":
        return angular(q, v)
    raise ValueError(f"unknown metric {metric!r}")


def ratio(a, b) -> Column:
    """``a / b`` of doubles as IEEE 754, and the oracles' SQL, has it: infinite or NaN for ``b = 0``, where Spark's division is an error
    (``spark.sql.ansi.enabled``) or NULL."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(b == 0, F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
                                                            .when(a == 0, F.lit(float("nan"))).otherwise(a))


def rnd(c, digits: int = 6) -> Column:
    return F.round(_c(c), digits)
