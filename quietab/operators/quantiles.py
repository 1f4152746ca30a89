"""Exact quantiles by bracket selection.

``percentile_approx`` gives, for every requested rank, two values that enclose it
(its rank error is at most ``n / accuracy``; the brackets take twice that).  One more
scan counts the values below and between all bracket ends and collects, combined map-side, the
distinct values inside the brackets only.  Ranks are then read off exactly.  No value outside a
bracket is shuffled, and nothing is sorted but the brackets' contents.

Columns (``exact_quantiles``): the brackets' ends are the splits of Spark's ``Bucketizer``, a
binary search in the JVM.  Where the brackets would hold more than ``FETCH_ROWS`` values,
rounds of counting first narrow them, each by the approximate grid inside the
intervals that still hold a wanted rank; an interval of one value needs no fetch.
Groups (``grouped_quantiles``): brackets are a table with a row per group, joined to the rows;
a group's bracket holds about ``4 / accuracy`` of its rows, and equal values are one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import literal_array
from .bounded import broadcast_checked

#: values that the brackets of all columns may hold when they are fetched
FETCH_ROWS = 1_000_000
#: accuracies of percentile_approx: the first that keeps within FETCH_ROWS is taken
ACCURACIES = (10_000, 100_000)
#: points of the grid that narrows an interval in a round
GRID = 256


def _number(c: str | Column) -> Column:
    """The value as double, NaN as null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def _ranks(n: int, probs) -> list[int]:
    return sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})


def _interpolated(n: int, probs, at: dict) -> list[float]:
    out = []
    for p in probs:
        h = p * (n - 1)
        lo, hi = math.floor(h), math.ceil(h)
        out.append(at[lo] if lo == hi else (hi - h) * at[lo] + (h - lo) * at[hi])
    return out


def _edges(values) -> np.ndarray:
    """Split points that make each of the values an interval of its own."""
    v = np.array([x for x in values if x is not None and np.isfinite(x)], np.float64) + 0.0
    e = np.unique(np.concatenate((v, np.nextafter(v, np.inf))))
    return e[np.isfinite(e)]


def _scan(df: DataFrame, edges: dict[str, np.ndarray], wanted: dict[str, np.ndarray]) -> dict:
    """Per column: count of each interval between the edges, and (value, count) inside the wanted ones."""
    cols = list(edges)
    plain = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(cols)])
    split = Bucketizer(inputCols=[f"x{i}" for i in range(len(cols))], outputCols=[f"b{i}" for i in range(len(cols))],
                       splitsArray=[[-math.inf, *edges[c].tolist(), math.inf] for c in cols], handleInvalid="keep").transform(plain)
    parts = []
    for i, c in enumerate(cols):
        b = F.col(f"b{i}").cast("int")
        inside = F.get(literal_array(wanted[c].tolist()), b) if wanted[c].any() else F.lit(False)
        parts.append(F.struct(F.lit(i).alias("c"), b.alias("b"), F.when(inside, F.col(f"x{i}")).alias("v"),
                              F.col(f"x{i}").isNotNull().alias("ok")))
    got = (split.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("ok")
           .groupBy("c", "b", "v").agg(F.count(F.lit(1)).alias("n")).toArrow())
    c_, b_, n_ = (got.column(k).to_numpy() for k in ("c", "b", "n"))
    v_, has = got.column("v").to_numpy(), got.column("v").is_valid().to_numpy()
    out = {}
    for i, c in enumerate(cols):
        own = c_ == i
        counts = np.bincount(b_[own], weights=n_[own], minlength=len(edges[c]) + 1).astype(np.int64)
        inner = own & has
        order = np.argsort(v_[inner], kind="stable")
        out[c] = counts, v_[inner][order], n_[inner][order], b_[inner][order]
    return out


def _approximate(df: DataFrame, cols: list[str], points: dict[str, list[float]], accuracy: int) -> dict[str, list]:
    row = df.agg(*[F.percentile_approx(_number(c), literal_array(points[c]), accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"q{i}"] or [] for i, c in enumerate(cols)}


def exact_quantiles(df: DataFrame, probs: dict, counts: dict) -> dict:
    """Linear-interpolation quantiles ``{column: [value per prob]}``; ``counts`` holds each
    column's number of values that are neither null nor NaN (at least 1)."""
    cols = sorted(probs)
    open_ranks = {c: _ranks(counts[c], probs[c]) for c in cols}
    at: dict = {c: {} for c in cols}

    def inside(accuracy: int) -> float:
        return sum(counts[c] * min(1.0, len(open_ranks[c]) * 4 / accuracy) for c in cols)

    accuracy = next((a for a in ACCURACIES if inside(a) <= FETCH_ROWS), ACCURACIES[-1])
    delta = 2 / accuracy
    points, edges, wanted = {}, {}, {}
    for c in cols:
        middle = (np.array(open_ranks[c]) + 0.5) / counts[c]
        points[c] = np.clip(np.stack((middle - delta, middle + delta), 1), 0, 1).ravel().tolist()
    ends = _approximate(df, cols, points, accuracy)
    fetch = inside(accuracy) <= FETCH_ROWS
    for c in cols:
        edges[c] = _edges(ends[c])
        wanted[c] = np.zeros(len(edges[c]) + 1, bool)
        for lo, hi in zip(ends[c][::2], ends[c][1::2]) if fetch else ():
            a = np.searchsorted(edges[c], lo + 0.0, "right") if np.isfinite(lo) else 0
            b = np.searchsorted(edges[c], hi + 0.0, "right") if np.isfinite(hi) else len(edges[c])
            wanted[c][a:b + 1] = True
            if a == b and np.isfinite(lo):
                wanted[c][a] = False  # one value: counting is enough
    while cols:
        left, sizes = {}, 0
        for c, (n, values, times, of) in _scan(df, {c: edges[c] for c in cols}, wanted).items():
            upto = np.cumsum(n)
            inner = np.cumsum(times)
            for r in open_ranks[c]:
                b = int(np.searchsorted(upto, r, "right"))
                e = edges[c]
                if 0 < b < len(e) and e[b] == np.nextafter(e[b - 1], np.inf):
                    at[c][r] = float(e[b - 1])
                elif wanted[c][b]:
                    own = np.flatnonzero(of == b)
                    before = upto[b] - n[b]
                    at[c][r] = float(values[own[np.searchsorted(inner[own] - inner[own[0]] + times[own[0]], r - before, "right")]])
                else:
                    left.setdefault(c, {}).setdefault(b, []).append(r)
                    sizes += 0 if len(left[c][b]) > 1 else int(n[b])
        cols = sorted(left)
        open_ranks = {c: sorted(r for rs in left[c].values() for r in rs) for c in cols}
        fetch = sizes <= FETCH_ROWS
        grids = {} if fetch else _grids(df, {c: edges[c] for c in cols}, left)
        for c in cols:
            e, keep = edges[c], []
            for b in left[c]:
                keep += [*e[max(b - 1, 0):b + 1], *grids.get((c, b), ())]
            new = np.unique(np.concatenate([np.array(keep, np.float64), _edges(grid_values(grids, c))]))
            flags = np.zeros(len(new) + 1, bool)
            for b in left[c] if fetch else ():
                lo = np.searchsorted(new, e[b - 1], "right") if b > 0 else 0
                hi = np.searchsorted(new, e[b], "left") if b < len(e) else len(new)
                flags[lo:hi + 1] = True
            edges[c], wanted[c] = new, flags
    return {c: _interpolated(counts[c], probs[c], at[c]) for c in probs}


def grid_values(grids: dict, c: str) -> list:
    return [v for (col, _), vs in grids.items() if col == c for v in vs]


def _grids(df: DataFrame, edges: dict, left: dict) -> dict:
    """Approximate grid of the values inside each interval that holds a wanted rank."""
    cols = sorted(edges)
    plain = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(cols)])
    split = Bucketizer(inputCols=[f"x{i}" for i in range(len(cols))], outputCols=[f"b{i}" for i in range(len(cols))],
                       splitsArray=[[-math.inf, *edges[c].tolist(), math.inf] for c in cols], handleInvalid="keep").transform(plain)
    parts = []
    for i, c in enumerate(cols):
        flags = np.zeros(len(edges[c]) + 1, bool)
        flags[list(left[c])] = True
        b = F.col(f"b{i}").cast("int")
        parts.append(F.struct(F.lit(i).alias("c"), b.alias("b"),
                              F.when(F.col(f"x{i}").isNotNull() & F.get(literal_array(flags.tolist()), b), F.col(f"x{i}")).alias("v")))
    rows = (split.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("v is not null").groupBy("c", "b")
            .agg(F.percentile_approx("v", [k / GRID for k in range(1, GRID)], 10 * GRID).alias("g")).collect())
    return {(cols[r["c"]], r["b"]): r["g"] for r in rows}  # one row an interval


def grouped_quantiles(df: DataFrame, value: str, by=(), probs=(0.5,), names=None, extra: dict[str, Column] | None = None,
                      accuracy: int = ACCURACIES[0]) -> DataFrame:
    """Linear-interpolation quantiles per group (a null key is a group), and the aggregates ``extra`` of
    the same scan.  A group without a value has null quantiles."""
    by, extra = list(by), dict(extra or {})
    names = list(names or [f"q{i}" for i in range(len(probs))])
    d = df.withColumn("__v", _number(value))
    delta = 2 / accuracy
    points = [x for p in probs for x in (max(0.0, p - delta), min(1.0, p + delta))]
    stats = d.groupBy(*by).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", points, accuracy).alias("__b"),
                               *[c.alias(k) for k, c in extra.items()])
    few = F.col("__n") <= 2 / delta  # a rank beside the quantile's own may be outside: the group is small, take all
    for i in range(len(probs)):
        stats = stats.withColumns({f"__lo{i}": F.when(few, float("-inf")).otherwise(F.col("__b")[2 * i]),
                                   f"__hi{i}": F.when(few, float("inf")).otherwise(F.col("__b")[2 * i + 1])})
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    stats = broadcast_checked(stats.drop("__b"))
    ends = stats.select(*keys, "__n", *[f"__{s}{i}" for i in range(len(probs)) for s in ("lo", "hi")])
    rows = d.where("__v is not null").select(*by, "__v")
    if by:
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
        rows = rows.join(ends, same)
    else:
        one = stats.drop(*extra).first()
        rows = rows.withColumns({c: F.lit(one[c]) for c in ends.columns})
    within = [(F.col("__v") >= F.col(f"__lo{i}")) & (F.col("__v") <= F.col(f"__hi{i}")) for i in range(len(probs))]
    any_of = within[0]
    for w in within[1:]:
        any_of = any_of | w
    group = [f"__k{i}" for i in range(len(by))]
    cut = rows.groupBy(*group, "__n", *[f"__{s}{i}" for i in range(len(probs)) for s in ("lo", "hi")],
                       F.when(any_of, F.col("__v")).alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"),
        *[F.sum((F.col("__v") < F.col(f"__lo{i}")).cast("long")).alias(f"__u{i}") for i in range(len(probs))])
    every = Window.partitionBy(*group, F.lit(0))
    upto = every.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    places = {}
    for i in range(len(probs)):
        inner = (F.col("__v") >= F.col(f"__lo{i}")) & (F.col("__v") <= F.col(f"__hi{i}"))
        places[f"__e{i}"] = F.sum(f"__u{i}").over(every) + F.sum(F.when(inner, F.col("__c")).otherwise(0)).over(upto)
        places[f"__i{i}"] = inner
    placed = cut.withColumns(places)
    picks = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        for side, rank in (("a", F.floor(h)), ("b", F.ceil(h))):
            here = F.col(f"__i{i}") & (rank < F.col(f"__e{i}")) & (rank >= F.col(f"__e{i}") - F.col("__c"))
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{side}{i}"))
    picked = placed.groupBy(*group, "__n").agg(*picks)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        value_ = F.when(F.floor(h) == F.ceil(h), a).otherwise((F.ceil(h) - h) * a + (h - F.floor(h)) * b)
        out.append(F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a bracket missed its rank"))).otherwise(value_).alias(name))
    picked = picked.select(*group, *out)
    if not by:
        return picked if not extra else picked.withColumns({k: F.lit(stats.first()[k]) for k in extra})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return stats.select(*by, *extra).join(picked, same, "left").select(*by, *names, *extra)
