"""Token-id output: Re-Pair compressed shard files in ascending doc_id order.

Documents are range-partitioned and sorted by doc_id, encoded by the tokenizers
library, ended with the end id and cut into shards of about ``SHARD_IDS`` ids.  Each shard
becomes one file (``grammar``): rules, expansion lengths, symbols and document
ends; the files are the binary rows of a Parquet table in the shared folder,
with (part, shard) giving their order.  A document's global start is the ids
of all parts before (one row per partition, summed in order), of the shards before in
its part (stored with the shard) and of the documents before in its shard.

Plan: one range shuffle of (doc_id, text); encoding and compression happen in
the task that holds the part; reading back is a scan with one row per part joined.  A
task holds one shard's ids.

Defined cases: a null or empty text is the end id alone; null doc_ids come
first; rows that repeat a doc_id follow the order of their texts, and equal rows may be
spread over parts; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietab.llm.common import blocks, maybe_broadcast, narrow, small_batches, table, written
from quietab.llm.grammar import opened, packed_shard
from quietab.llm.tokens import ENCODE_BYTES, encoder, shared_tokenizer

SHARD_IDS = 1 << 20
#: documents of each range that one task encodes, shard by shard
TASK_DOCS = 16_384

SHARDS = "part int, shard int, ids_before long, n_ids long, data binary"


def shards(docs: DataFrame, tokenizer: str, end_id: int = 1, spaced: bool = False) -> DataFrame:
    """The shard files: part, shard, ids_before (in the part), n_ids, data."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_tokenizer(spark.sparkContext, tokenizer)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TASK_DOCS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared, spaced)
        terminals = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part = TaskContext.get().partitionId()
        ids_list, counts, doc_ids = [], [], []
        shard = before = held = 0

        def file():
            nonlocal shard, before, held
            ids = np.concatenate(ids_list)
            data = packed_shard(ids, np.array(counts), doc_ids, terminals)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "shard", "ids_before", "n_ids", "data"])
            shard, before, held = shard + 1, before + len(ids), 0
            for x in (ids_list, counts, doc_ids):
                x.clear()
            return out

        for b in batches:
            for lo, hi, block in blocks(b.column("text"), ENCODE_BYTES):
                ids, n = enc.encode(block)
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                ids_list.append(ids)
                counts.extend((n + 1).tolist())
                doc_ids.extend(b.column("doc_id").slice(lo, hi - lo).to_pylist())
                held += len(ids)
                if held >= SHARD_IDS:
                    yield file()
        if counts:
            yield file()

    # the files hold 64-bit ids
    rows = (narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
            .withColumn("row", F.monotonically_increasing_id()))
    return (rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row")
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text")
            .mapInArrow(run, SHARDS))


def read_back(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the
    shard files; with ``with_ids`` also the ids."""
    small_batches(files.sparkSession)
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = per_part.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    rows = files.join(maybe_broadcast(base), "part").select((F.col("base") + F.col("ids_before")).alias("first"), "data")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column("first").to_pylist(), b.column("data")):
                shard = opened(data.as_py())
                upto = np.cumsum(shard.sizes())[shard.ends.astype(np.int64) - 1]
                n = np.diff(upto, prepend=0)
                every = shard.all_ids().astype("<u4")
                crc, ids = np.zeros(len(n), np.int64), []
                for k in range(len(n)):
                    own = every[upto[k] - n[k]:upto[k]]
                    crc[k] = zlib.crc32(own.tobytes())
                    if with_ids:
                        ids.append(own.astype(np.int32))
                made = [pa.array(shard.doc_ids, pa.int64(), mask=~shard.has_id), pa.array(first + upto - n),
                        pa.array(n), pa.array(crc)] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op6_token_files(spark, sf_dir) -> DataFrame:
    files = written(shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "token-files")
    return read_back(files)
