"""Table, profile, fitted-state and metric sources/sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import trim_headers
from .csv_ranges import csv_strings

# pandas' default missing-value tokens (fixed values)
DEFAULT_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: quoted fields may hold separators, doubled quotes and line breaks (RFC 4180)
CSV_DIALECT = {"quote": '"', "escape": '"'}
NAN_TOKENS = ["NaN", "-NaN", "nan", "-nan", "1.#QNAN", "-1.#QNAN", "1.#IND", "-1.#IND"]


def read_table(spark: SparkSession, path: str, fmt: str = "csv", na_values=None,
               infer: bool = True) -> DataFrame:
    """S1.  CSV: read every column as string (by ranges, also with line breaks inside
    quotes: ``csv_ranges``), map NA tokens to null, then infer bigint / double / string per column in one aggregation pass
    (``nullValue`` takes a single token, so the NA mapping is an expression)."""
    if fmt == "parquet":
        return trim_headers(spark.read.parquet(path))
    if fmt != "csv":
        return trim_headers(spark.read.format(fmt).load(path))
    raw = trim_headers(csv_strings(spark, path, CSV_DIALECT))
    na = DEFAULT_NA if na_values is None else list(na_values)
    nan_tok = [t for t in NAN_TOKENS if t in na]
    missing = [t for t in na if t not in nan_tok]
    if not infer:
        return raw.select(*[F.when(F.col(c).isin(na), None).otherwise(F.col(c)).alias(c) for c in raw.columns])
    checks = []
    for i, c in enumerate(raw.columns):
        x = F.col(c)
        gone = x.isNull() | x.isin(missing)
        checks.append(F.bool_and(gone | F.expr(f"try_cast(`{c}` as bigint)").isNotNull()).alias(f"l{i}"))
        checks.append(F.bool_and(gone | x.isin(nan_tok) | F.expr(f"try_cast(`{c}` as double)").isNotNull())
                      .alias(f"d{i}"))
    flags = raw.agg(*checks).first().asDict()
    sel = []
    for i, c in enumerate(raw.columns):
        x = F.col(c)
        if flags[f"l{i}"] is not False:
            sel.append(F.when(x.isin(na), None).otherwise(x).cast("bigint").alias(c))
        elif flags[f"d{i}"]:
            sel.append(F.when(x.isin(missing), None).when(x.isin(nan_tok), F.lit(float("nan")))
                       .otherwise(x.cast("double")).alias(c))
        else:
            sel.append(F.when(x.isin(na), None).otherwise(x).alias(c))
    return raw.select(*sel)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None) -> None:
    """Partitioned directory write (``partitionBy('split')`` enables pruning)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                  ignoreTrailingWhiteSpace=False).csv(path)
    else:
        w.format(fmt).save(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """S3: the one-row profile as JSON."""
    profile.coalesce(1).write.mode("overwrite").json(path)


def read_profile(spark: SparkSession, path: str) -> dict:
    return spark.read.json(path).first().asDict()


def training_view(df: DataFrame, features: list[str], label: str, task: str, width: int | None = None,
                  out: str = "features") -> DataFrame:
    """Feature columns to one ARRAY<FLOAT>, label typed by task; the width
    check is on the schema (no job runs)."""
    if width is not None and len(features) != width:
        raise ValueError(f"feature width {len(features)} != expected {width}")
    lab = F.col(label).cast("float" if task in ("binclass", "regression") else "long")
    return df.select(F.array(*[F.col(c).cast("float") for c in features]).alias(out), lab.alias("label"))


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """Long-format metric table ``(model, split, metric, value)``."""
    metrics.repartition(1).write.mode("overwrite").format(fmt).save(path)


def write_json_object(spark: SparkSession, obj: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(obj),)], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path))
