"""Table specification: which columns are numeric, categorical, label and key.

Kinds are decided from the Spark schema (never by position), and kept in an
explicit :class:`TableSpec` that every later stage receives.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)  # booleans are categories


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


@dataclass(frozen=True)
class TableSpec:
    num_cols: tuple[str, ...]
    cat_cols: tuple[str, ...]
    label: str | None = None
    key: tuple[str, ...] = field(default_factory=tuple)

    @property
    def feature_cols(self) -> tuple[str, ...]:
        return self.num_cols + self.cat_cols

    @staticmethod
    def infer(df: DataFrame, label: str | None = None, key=(), exclude=()) -> "TableSpec":
        """Label defaults to the last column; the rest split by type."""
        key = (key,) if isinstance(key, str) else tuple(key)
        cols = [c for c in df.columns if c not in key and c not in exclude]
        if label is None:
            label = cols[-1]
        num, cat = [], []
        for f in df.schema.fields:
            if f.name not in cols or f.name == label:
                continue
            (num if is_numeric_type(f.dataType) else cat).append(f.name)
        return TableSpec(tuple(num), tuple(cat), label, key)


def trim_headers(df: DataFrame) -> DataFrame:
    """Q15: strip surrounding whitespace from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def canonical(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Key columns, numerics, categoricals, label -- one projection."""
    cols = [*spec.key, *spec.num_cols, *spec.cat_cols]
    if spec.label:
        cols.append(spec.label)
    return df.select(*cols)


def infer_task(df: DataFrame, label: str) -> tuple[str, int]:
    """A5: 2 distinct -> binclass, < 100 -> multiclass, else regression (whose number of
    distinct values is approximate: a continuous label is not shuffled to count it)."""
    n = df.select(label).where(F.col(label).isNotNull()).distinct().limit(100).count()  # 100 decide it
    if n < 100:
        return ("binclass" if n == 2 else "multiclass"), int(n)
    return "regression", int(df.agg(F.approx_count_distinct(F.col(label)).alias("n")).first()["n"])


def profile_df(splits: DataFrame, spec: TableSpec, name: str, split_col: str = "split") -> DataFrame:
    """The table profile as a one-row DataFrame (one aggregation pass)."""
    n_classes = F.count_distinct(F.col(spec.label))
    sizes = {s: F.sum((F.col(split_col) == s).cast("long")) for s in ("train", "val", "test")}
    return splits.agg(
        F.lit(name).alias("name"),
        F.when(n_classes < 100, F.when(n_classes == 2, "binclass").otherwise("multiclass"))
         .otherwise("regression").alias("task_type"),
        n_classes.cast("long").alias("n_classes"),
        F.lit(len(spec.num_cols)).cast("long").alias("n_num_features"),
        F.lit(len(spec.cat_cols)).cast("long").alias("n_cat_features"),
        sizes["train"].alias("train_size"),
        sizes["val"].alias("val_size"),
        sizes["test"].alias("test_size"),
    )
