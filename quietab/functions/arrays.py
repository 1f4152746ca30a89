"""Array-valued column functions, all JVM-side higher-order expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(n: int) -> int:
    """Bits for ``n`` categories: ``max(1, ceil(log2 n))`` computed exactly
    as the length of ``bin(n-1)`` (no floating log)."""
    return max(1, (max(n, 1) - 1).bit_length())


#: arrays up to this width are built element by element (plain expressions that
#: whole-stage codegen compiles); wider ones use higher-order functions, which
#: Spark evaluates interpreted inside the generated code
UNROLL_MAX = 64


def code_to_bits(code: Column, width: int) -> Column:
    """H1: big-endian bits; code -1 (unseen/null) gives all ones."""
    if width <= UNROLL_MAX:
        return F.array(*[F.shiftright(code, k).bitwiseAND(1).cast("float") for k in range(width - 1, -1, -1)])
    return F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)),
                       lambda k: F.call_function("shiftright", code, k).bitwiseAND(1).cast("float"))


def bits_to_code(bits, width: int | None = None) -> Column:
    """H2: half-even round every bit (no clamp), then weighted big-endian sum.

    ``bits`` is an array column or a list of element columns.  Half-even
    rounding to an integer uses ``rint`` (exact for doubles); ``bround`` on a
    double goes through a decimal conversion per element."""
    if isinstance(bits, (list, tuple)):
        elems = list(bits)
    elif width is not None and width <= UNROLL_MAX:
        elems = [bits[j] for j in range(width)]
    else:
        return F.aggregate(bits, F.lit(0.0).cast("double"),
                           lambda acc, b: acc * 2 + F.rint(b.cast("double"))).cast("long")
    acc = F.lit(0.0).cast("double")
    for e in elems:
        acc = acc * 2 + F.rint(e.cast("double"))
    return acc.cast("long")


def code_to_onehot(code: Column, n: int) -> Column:
    """H3: one-hot of width n; code -1 selects the last slot (Q1)."""
    eff = F.when(code < 0, F.lit(n - 1)).otherwise(code)
    if n <= UNROLL_MAX:
        return F.array(*[(eff == i).cast("float") for i in range(n)])
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == eff).cast("float"))


def argmax(arr: Column, width: int | None = None) -> Column:
    """T4: 0-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("long")


def clip_code(code: Column, n: int) -> Column:
    """P10: clip a decoded code into [0, n-1]."""
    return F.greatest(F.lit(0), F.least(code, F.lit(n - 1))).cast("long")


def l2_norm(vec: Column) -> Column:
    """Euclidean norm of an array."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"),
                              lambda a, x: a + x.cast("double") * x.cast("double")))


def row_mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two equal-length arrays."""
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(sq, F.lit(0.0).cast("double"), lambda s, x: s + x) / F.size(a)


def has_nan(vec: Column) -> Column:
    """P8 predicate: any NaN (or null) element."""
    return F.exists(vec, lambda x: F.isnan(x) | x.isNull())


def drop_nan_rows(df, features: str = "features"):
    """Drop rows whose vector holds any NaN (labels stay aligned: same row)."""
    return df.where(~has_nan(F.col(features)))


def literal_array(values) -> Column:
    """A constant array of numbers or booleans, parsed in one call (``F.lit`` of a list makes a call for each)."""
    def text(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return f"{v}L"
        return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"
    return F.expr(f"array({', '.join(map(text, values))})") if len(values) else F.expr("array()")
