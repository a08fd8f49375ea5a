"""Portable, seeded randomness as column expressions.

``u(seed, stream, key, j) = (int(md5('seed:stream:key:j')[0:8], 16) + 0.5) / 2^32``
is an exact function of its inputs, so any engine (and any re-executed task)
draws the same numbers: no RNG state, safe under task retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["uniform", "normal", "uniform_vec", "normal_vec", "hash_order"]

_TWO32 = float(2 ** 32)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def uniform(seed, stream, key, j=0) -> Column:
    h = F.md5(F.concat_ws(":", _lit(seed).cast("string"), _lit(stream).cast("string"),
                          _lit(key).cast("string"), _lit(j).cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(_TWO32)


def normal(seed, stream, key, j=0) -> Column:
    """Standard normal by Box-Muller from two hash uniforms."""
    u1 = uniform(seed, F.concat(_lit(stream).cast("string"), F.lit("a")), key, j)
    u2 = uniform(seed, F.concat(_lit(stream).cast("string"), F.lit("b")), key, j)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def uniform_vec(seed, stream, key, dim) -> Column:
    return F.transform(F.sequence(F.lit(0), _lit(dim) - 1), lambda j: uniform(seed, stream, key, j))


def normal_vec(seed, stream, key, dim) -> Column:
    return F.transform(F.sequence(F.lit(0), _lit(dim) - 1), lambda j: normal(seed, stream, key, j))


def hash_order(seed, key) -> Column:
    """Deterministic pseudo-random ordering key for seeded sampling."""
    return F.md5(F.concat_ws(":", _lit(seed).cast("string"), _lit(key).cast("string")))
