"""Turn low-cardinality integral numeric columns into categories.

Every numeric column (converted or not) consumes the next prefix
``a, b, ..., z, aa, ab, ...``; a column converts when it has fewer than
``threshold`` distinct non-null values and all of them are integral.  Value
``v`` becomes ``prefix + rank(v)`` over the sorted distinct values.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import is_numeric_type


def prefix(i: int) -> str:
    letters = string.ascii_lowercase
    if i < 26:
        return letters[i]
    i -= 26
    return letters[i // 26 % 26] + letters[i % 26] if i < 676 else f"c{i + 26}"


def low_cardinality_mapping(df: DataFrame, threshold: int = 15) -> dict:
    """``{col: (prefix, sorted values)}`` for every column that converts.

    One unpivot + distinct over the numeric columns; the per-column distinct
    counts and integrality flags are one small aggregate; only columns under
    the threshold have their (fewer than ``threshold``) values collected."""
    num_cols = [f.name for f in df.schema.fields
                if is_numeric_type(f.dataType) or f.dataType.simpleString() == "boolean"]
    if not num_cols:
        return {}
    # cheap HLL pass first: a column estimated far above the threshold cannot
    # convert, so only plausible columns go through the exact distinct
    est = df.agg(*[F.approx_count_distinct(F.col(c).cast("double")).alias(f"e{i}")
                   for i, c in enumerate(num_cols)]).first()
    cand = [c for i, c in enumerate(num_cols) if est[f"e{i}"] <= 2 * threshold + 10]
    if not cand:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cand])
    long = df.select(F.explode(pairs).alias("kv")).select("kv.*").where("v is not null and not isnan(v)")
    distinct = long.distinct().persist()
    stats = {r["col"]: (r["n"], r["integral"]) for r in distinct.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("v") == F.floor("v")).alias("integral")).collect()}
    convert = [c for c in num_cols if c in stats and stats[c][0] < threshold and stats[c][1]]
    values = {c: [] for c in convert}
    if convert:
        for r in distinct.where(F.col("col").isin(convert)).orderBy("col", "v").collect():
            values[r["col"]].append(r["v"])
    distinct.unpersist()
    return {c: (prefix(i), values[c]) for i, c in enumerate(num_cols) if c in values}


def mapping_df(spark, mapping: dict) -> DataFrame:
    rows = [(c, float(v), f"{p}{j}") for c, (p, vals) in mapping.items() for j, v in enumerate(vals)]
    return spark.createDataFrame(rows, "col string, value double, category string")


def categorise_low_cardinality(df: DataFrame, threshold: int = 15) -> DataFrame:
    mapping = low_cardinality_mapping(df, threshold)
    out = {}
    for c, (p, vals) in mapping.items():
        m = F.create_map(*[x for j, v in enumerate(vals) for x in (F.lit(float(v)), F.lit(f"{p}{j}"))])
        out[c] = F.try_element_at(m, F.col(c).cast("double"))
    return df.withColumns(out) if out else df
