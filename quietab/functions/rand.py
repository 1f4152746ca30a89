"""Deterministic, partition-independent randomness as column expressions.

Every draw is a pure function of ``(seed, key...)``: recomputing a lost
partition, changing the partition count, or re-running a job yields the same
numbers.  This is what makes retried tasks safe (no ``rand()`` anywhere in the
engine).  The md5 form is bit-identical in DuckDB, which is how the oracle
queries reproduce it:

    ('0x' || substr(md5('<seed>:<k1>:<k2>'), 1, 13))::bigint / 4503599627370496.0
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import UNROLL_MAX

TWO_POW_52 = 4503599627370496.0


def _key_string(seed, keys) -> Column:
    parts = [F.lit(str(seed))]
    for k in keys:
        parts.append(F.lit(":"))
        parts.append(k.cast("string") if isinstance(k, Column) else F.lit(str(k)))
    return F.concat(*parts)


def u(seed, *keys) -> Column:
    """Uniform in [0, 1) with 52 random bits, keyed by ``seed`` and ``keys``."""
    h = F.substring(F.md5(_key_string(seed, keys)), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO_POW_52)


def _polar(seed, *keys) -> tuple[Column, Column]:
    """(radius, angle) of a Box-Muller pair from the two uniforms of one md5:
    its hex digits 1-13 and 14-26."""
    h = F.md5(_key_string(seed, keys))
    u1, u2 = (F.conv(F.substring(h, at, 13), 16, 10).cast("double") / F.lit(TWO_POW_52) for at in (1, 14))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)), F.lit(2.0 * math.pi) * u2


def gauss(seed, *keys) -> Column:
    """Standard normal, keyed by ``seed`` and ``keys``."""
    r, angle = _polar(seed, *keys)
    return r * F.cos(angle)


def draw_category(cum_probs: Column, uniform: Column) -> Column:
    """Index of the category whose cumulative interval holds ``uniform``.

    ``cum_probs`` is the inclusive cumulative probability array.  The ``least``
    guards a last cumulative value that rounds below 1.
    """
    n = F.size(cum_probs)
    below = F.size(F.filter(cum_probs, lambda c: c <= uniform))
    return F.least(n - 1, below).cast("long")


def draw_timestep(num_timesteps: int, uniform: Column) -> Column:
    return F.floor(uniform * F.lit(num_timesteps)).cast("long")


def gauss_vector(seed, dim: int, *keys) -> Column:
    """``dim`` independent normals as an array from ceil(dim/2) pairs keyed by
    (seed, keys, p): elements 2p and 2p + 1 are r cos and r sin of pair p.  The
    same numbers at every width: wide vectors build the pairs by ``transform``."""
    return _from_pairs(_polar, seed, dim, keys)


def _from_pairs(polar, seed, dim: int, keys) -> Column:
    pairs = (dim + 1) // 2

    def pair(p):
        r, angle = polar(seed, *keys, p)
        return F.array(r * F.cos(angle), r * F.sin(angle))

    if dim <= UNROLL_MAX:
        both = [pair(p) for p in range(pairs)]
        return F.array(*[both[j // 2][j % 2] for j in range(dim)])
    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(pairs - 1)), pair)), 1, dim)


# ----------------------------------------------------------------------------- fast variants
# xxhash64-based draws: JVM-native and codegen'd (~10x cheaper than md5 + hex
# parsing), equally partition-independent, but not reproducible in DuckDB --
# used where a job draws many values per row (noise vectors) at scale.

_TWO_POW_53 = 9007199254740992.0


def u_fast(seed, *keys) -> Column:
    """Uniform in (0, 1) from xxhash64(seed, keys...)."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    h = F.xxhash64(F.lit(int(seed)), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(_TWO_POW_53)


def _polar_fast(seed, *keys) -> tuple[Column, Column]:
    r = F.sqrt(F.lit(-2.0) * F.log(u_fast(seed, *keys, 0)))
    return r, F.lit(2.0 * math.pi) * u_fast(seed, *keys, 1)


def gauss_fast(seed, *keys) -> Column:
    r, angle = _polar_fast(seed, *keys)
    return r * F.cos(angle)


def gauss_vector_fast(seed, dim: int, *keys) -> Column:
    """:func:`gauss_vector` on the xxhash64 uniforms."""
    return _from_pairs(_polar_fast, seed, dim, keys)
