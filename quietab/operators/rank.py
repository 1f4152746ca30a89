"""Scalable prefix sums and global ranks.

A bare ``Window.orderBy(...)`` without a partition key moves every row into one
task.  Here the rows are range-partitioned by (group, order) -- Spark samples the
bounds itself, their number is not limited -- and every task adds up its own rows in one
pass while the partitions are written to the shared checkpoint folder.  A partition's
first group alone can have begun earlier, so the offsets are a table of at most one row a
partition, which a broadcast join adds.  One shuffle, no window over rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, ship_package

#: literal boundaries of one refining round of exactly-N
LITERAL_BUCKETS_MAX = 4096


def default_buckets(df: DataFrame) -> int:
    """~4 buckets per shuffle partition, at most LITERAL_BUCKETS_MAX (they become a CASE tree)."""
    return min(max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))), LITERAL_BUCKETS_MAX)


def _bucket_expr(bounds: list, order: Sequence[str]) -> Column:
    """Number of (strictly increasing) boundary tuples <= the row's order tuple,
    as a balanced CASE tree: ~log2(B) comparisons, compiled by codegen (a
    ``filter`` over a literal array would run interpreted, B comparisons)."""
    if not bounds:
        return F.lit(0)
    if len(order) == 1:
        x = F.col(order[0])
        lits = [F.lit(b[0] if isinstance(b, (tuple, list)) else b) for b in bounds]
    else:
        x = F.struct(*[F.col(c).alias(f"c{j}") for j, c in enumerate(order)])
        lits = [F.struct(*[F.lit(v).alias(f"c{j}") for j, v in enumerate(b)]) for b in bounds]

    def upper(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < lits[mid], upper(lo, mid)).otherwise(upper(mid + 1, hi))

    tree = upper(0, len(lits))
    return F.when(x.isNull(), F.lit(0)).otherwise(tree) if len(order) == 1 else tree


def _sampled_bounds(df: DataFrame, order: Sequence[str], buckets: int) -> list:
    n = df.count()
    if n == 0 or buckets <= 1:
        return []
    frac = min(1.0, buckets * 64 / n)
    rows = (df.select(*order).sample(False, frac, seed=20231).na.drop()
            .orderBy(*order).collect())
    if not rows:
        return []
    step = len(rows) / buckets
    bounds = []
    for i in range(1, buckets):
        r = tuple(rows[min(len(rows) - 1, int(i * step))])
        if not bounds or r != bounds[-1]:
            bounds.append(r)
    return bounds


def _changes(b: pa.RecordBatch, names: Sequence[str], last: list | None) -> np.ndarray:
    """Rows whose group differs from that of the row before (of the last row before the batch)."""
    out = np.zeros(len(b), bool)
    for k, name in enumerate(names):
        column = b.column(name)
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            out[1:] |= np.array([x != y for x, y in zip(values[1:], values[:-1])], bool)
        else:
            if pa.types.is_floating(column.type):  # NaN equals itself, as in Spark's groups
                nulls = column.is_null()
                plain = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                column = pa.array(np.where(np.isnan(plain), np.nan, plain).view(np.int64), mask=nulls.to_numpy(zero_copy_only=False))
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            out[1:] |= code[1:] != code[:-1]
        if last is not None:
            first = b.column(name)[0].as_py()
            out[0] |= not (first == last[k] or (first != first and last[k] != last[k]))
    out[0] |= last is None
    return out


def _inside(by: Sequence[str], values: Sequence[str]):
    """Running row number and sums of each group within a sorted partition."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, sums = None, 0, [0] * len(values)
        for b in batches:
            if not len(b):
                continue
            starts = np.flatnonzero(_changes(b, by, last))
            cuts = np.unique(np.concatenate(([0], starts, [len(b)])))
            lens = np.diff(cuts)
            fresh = np.isin(cuts[:-1], starts)
            number = np.arange(1, len(b) + 1) - np.repeat(cuts[:-1], lens)
            if not fresh[0]:
                number[:lens[0]] += n
            made = [pa.array(number)]
            n = int(number[-1])
            for k, name in enumerate(values):
                v = b.column(name).to_numpy(zero_copy_only=False)
                if v.dtype.kind == "f":  # group by group: no group's rounding reaches another
                    got = np.concatenate([np.cumsum(v[i:j]) for i, j in zip(cuts[:-1], cuts[1:])])
                else:
                    total = np.cumsum(v)
                    got = total - np.repeat((total - v)[cuts[:-1]], lens)
                if not fresh[0]:
                    got[:lens[0]] += sums[k]
                sums[k] = got[-1]
                made.append(pa.array(got))
            last = [b.column(name)[len(b) - 1].as_py() for name in by]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "__n", *[f"{v}r" for v in values]])
    return run


def running_totals(df: DataFrame, order: Sequence[str], values: dict[str, Column] | None = None,
                   by: Sequence[str] = (), buckets: int | None = None, rank_col: str | None = "rank",
                   inclusive: bool = True, tiebreak: bool = False) -> DataFrame:
    """Add running sums of the integral or double ``values`` (null: 0) and a 1-based ``rank_col``
    in ``order`` within ``by`` groups (nulls are a group).  Ties in ``order`` must be broken by the caller (the
    last order column should be a unique key, or pass ``tiebreak=True`` to
    append a unique, stable row id -- it splits even fully identical rows
    over partitions); the result then equals
    ``sum(v) over (partition by by order by order rows unbounded preceding)``.
    ``buckets``: partitions (default: ``spark.sql.shuffle.partitions``).
    """
    values, by, order = dict(values or {}), list(by), list(order)
    ship_package(df.sparkSession)
    if tiebreak:  # ids of a fixed written file layout
        df = materialise(df, "rank-input").withColumn("__tb", F.monotonically_increasing_id())
        order.append("__tb")
    names = df.columns
    tmp = {name: f"__v_{i}" for i, name in enumerate(values)}
    whole = {"tinyint", "smallint", "int", "bigint"}
    base = df.withColumns({tmp[k]: v for k, v in values.items()}) if values else df
    for t in tmp.values():
        kind = "bigint" if base.schema[t].dataType.simpleString() in whole else "double"
        base = base.withColumn(t, F.coalesce(F.col(t).cast(kind), F.lit(0).cast(kind)))
    parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    ordered = (base.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
               .withColumn("__part", F.spark_partition_id()))
    out = T.StructType([*ordered.schema.fields, T.StructField("__n", T.LongType()),
                        *[T.StructField(f"{t}r", ordered.schema[t].dataType) for t in tmp.values()]])
    inside = materialise(ordered.mapInArrow(_inside(by, list(tmp.values())), out), "ranked")
    totals = inside.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__c"),
                                               *[F.sum(t).alias(f"{t}c") for t in tmp.values()])
    # only the first group of a partition began earlier: at most `parts` rows
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__part", F.sum("__c").over(before).alias("__co"),
                            *[F.sum(f"{t}c").over(before).alias(f"{t}o") for t in tmp.values()]).where("__co is not null")
    offsets = F.broadcast(offsets.select(F.col("__part").alias("__opart"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)],
                                         "__co", *[f"{t}o" for t in tmp.values()]))
    same = F.col("__part") == F.col("__opart")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    joined = inside.join(offsets, same, "left")
    made = {}
    if rank_col:
        made[rank_col] = F.col("__n") + F.coalesce("__co", F.lit(0))
    for k, t in tmp.items():
        total = F.col(f"{t}r") + F.coalesce(F.col(f"{t}o"), F.lit(0).cast(out[t].dataType))
        made[k] = total if inclusive else total - F.col(t)
    return joined.select(*[c for c in names if c not in made and c != "__tb"], *[v.alias(k) for k, v in made.items()])


def global_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                buckets: int | None = None, name: str = "rank") -> DataFrame:
    """``row_number() over (partition by by order by order)`` without a single-task window."""
    return running_totals(df, order, None, by=by, buckets=buckets, rank_col=name)
