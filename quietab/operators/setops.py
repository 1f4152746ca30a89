"""U1 append by name, U3 key-set intersection/difference, P9 domain split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_tables(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def split_keys(df: DataFrame, predicate: Column, key) -> tuple[DataFrame, DataFrame]:
    """(keys passing ``predicate``, all keys minus those) as key tables.

    One grouping by the key (map-side combined) tells whether any of its rows
    passes, so every key -- null included -- lands in exactly one table.
    """
    key = [key] if isinstance(key, str) else list(key)
    seen = df.groupBy(*key).agg(F.max(F.coalesce(predicate, F.lit(False))).alias("__passes"))
    return seen.where("__passes").drop("__passes"), seen.where(~F.col("__passes")).drop("__passes")


def reject_invalid(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose predicate holds, and the rest (null counts as rejected)."""
    ok = df.where(predicate)
    bad = df.where(~predicate | predicate.isNull())
    return ok, bad
