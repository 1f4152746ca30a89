"""Structured Streaming form of the fitted encoder.

Fitting is batch; the fitted :class:`~quietab.operators.encode.EncoderModel`
is a stateless projection (literal maps, arithmetic, Arrow UDFs for quantile
columns, stream-static joins for large dictionaries), so the same ``encode``
applies to a streaming DataFrame row by row with no state store.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def read_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def encode_stream(model, stream: DataFrame, keep=(), features: str = "features") -> DataFrame:
    return model.encode(stream, keep=keep, features=features)


def run_available_now(stream: DataFrame, sink: str | None = None, name: str = "encoded") -> str:
    """Process everything available now into a parquet sink under the shared
    checkpoint folder (exactly-once via the streaming checkpoint); returns
    the sink path."""
    spark = stream.sparkSession
    base = checkpoint_dir(spark)
    tag = uuid.uuid4().hex[:10]
    sink = sink or os.path.join(base, f"{name}-{tag}")
    q = (stream.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", os.path.join(base, f"{name}-ckpt-{tag}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
