"""Test views over the driver tables (FX1-FX6), built lazily from parquet.

Each view reads a whole table (plus the join for FX2/FX5); the same
definitions appear as SQL in ``__spark_entry__.oracle_sql``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spec import TableSpec

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fx1(spark, sf_dir) -> tuple[DataFrame, TableSpec]:
    """lineitem: 4 numerics, 2 categoricals, label l_linestatus, 6-column key."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        F.col("l_linenumber").cast("string").alias("linenumber_cat"), "l_linestatus")
    spec = TableSpec(("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
                     ("l_returnflag", "linenumber_cat"), "l_linestatus",
                     ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))
    return df, spec


def fx2(spark, sf_dir) -> tuple[DataFrame, TableSpec]:
    """orders joined to customer on custkey."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                               "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment",
                                                 F.col("c_nationkey").cast("string").alias("c_nation"))
    df = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment", "c_nation",
        "o_orderstatus")
    spec = TableSpec(("o_totalprice", "c_acctbal"), ("o_orderpriority", "c_mktsegment", "c_nation"),
                     "o_orderstatus", ("o_orderkey",))
    return df, spec


def fx3(spark, sf_dir) -> tuple[DataFrame, TableSpec]:
    """events with a derived, learnable binary label ``value > 50``."""
    df = table(spark, sf_dir, "events").select(
        "event_id", "value", "user_id", "event_type",
        (F.col("value") > 50).cast("int").alias("label"))
    spec = TableSpec(("value", "user_id"), ("event_type",), "label", ("event_id",))
    return df, spec


def fx4(spark, sf_dir) -> DataFrame:
    """embeddings: 64-float vectors with a 10-class label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def fx5(spark, sf_dir) -> tuple[DataFrame, TableSpec]:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    df = d.join(lab, "doc_id")
    spec = TableSpec(("n_chars",), ("lang", "source"), "quality", ("doc_id",))
    return df, spec


def fx6(spark, sf_dir) -> tuple[DataFrame, TableSpec]:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_type", "p_brand")
    spec = TableSpec(("p_size", "p_retailprice"), ("p_brand",), "p_type", ("p_partkey",))
    return df, spec
