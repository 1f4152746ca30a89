"""Left join with a large dictionary that no hot key and no null slows down.

A plain shuffle join sends every null and every copy of a frequent value to one task.
Here the table's frequent values are counted on a sample of its rows (only where a row is routed
depends on it, never its result), looked up in a broadcast table of at most
``HEAVY`` entries, and take no part in the shuffle's key: such rows, and those with a null, are
spread by a hash of the whole row and meet nothing there.  The rest is joined by
the value.  One shuffle of the table, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bounded import broadcast_checked

#: sampled rows, and share of them that makes a value heavy
SAMPLE_ROWS = 100_000
HEAVY_SHARE = 0.001
HEAVY = int(1 / HEAVY_SHARE)
#: places over which rows without a key of their own are spread
SPREAD = 1 << 20


def heavy_values(df: DataFrame, value: Column) -> DataFrame:
    """(v): values with a share of at least HEAVY_SHARE of a sample; at most HEAVY rows."""
    rows = df.select(value.alias("v"))
    total = rows.count()
    some = rows.sample(False, min(1.0, SAMPLE_ROWS / max(1, total)), seed=11)
    least = max(2.0, HEAVY_SHARE * min(total, SAMPLE_ROWS))
    return some.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("v")


def dictionary_join(df: DataFrame, value: Column, dictionary: DataFrame, key: str, out: str, heavy: DataFrame | None = None) -> DataFrame:
    """``df`` with the dictionary's other column as ``out`` (null: not found).  ``key`` is unique in
    ``dictionary`` and never null.  ``heavy`` (v): values to keep out of the shuffle; taken from a sample of ``df``
    unless given (a stream gives those of the table it was fitted on)."""
    names = df.columns
    found = next(c for c in dictionary.columns if c != key)
    if heavy is None:
        heavy = df.sparkSession.createDataFrame([], "v string") if df.isStreaming else heavy_values(df, value)
    known = broadcast_checked(dictionary.join(F.broadcast(heavy.select(F.col("v").alias(key))), key).select(
        F.col(key).alias("__hk"), F.col(found).alias("__hv")), max_rows=4 * HEAVY)
    rows = df.withColumn("__v", value).join(known, F.col("__v") == F.col("__hk"), "left")
    alone = F.col("__v").isNull() | F.col("__hk").isNotNull()
    rows = rows.withColumns({"__key": F.when(~alone, F.col("__v")),
                             "__place": F.when(alone, F.pmod(F.xxhash64(*names), F.lit(SPREAD)) + 1).otherwise(F.lit(0))})
    zero = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))  # a column: a literal would be folded out of the join's key
    light = dictionary.select(F.col(key).alias("__dk"), F.col(found).alias("__dv"), zero.alias("__dplace"))
    same = (F.col("__key") == F.col("__dk")) & (F.col("__place") == F.col("__dplace"))  # place 0: no spread row
    return rows.join(light, same, "left").select(*names, F.coalesce("__hv", "__dv").alias(out))
