"""Packing of token sequences: first-fit decreasing in randomised groups.

Documents are dealt to groups by a seeded hash of their id, text and input partition; a group has
about ``GROUP_DOCS`` documents whatever the corpus size.  A document's ids are cut into
pieces of ``length``; full pieces are sequences of their own and leave at once, the
remainders of a group are packed by first-fit decreasing: a tournament tree
over the bins' free capacities finds the first bin that still takes a piece.
Then the gaps that are left are closed by cutting: pieces of the emptiest bins
move, cut to measure, into the gaps of the fullest, until one bin of the group
is not full.  So a group pads one sequence at most.

Plan: one shuffle of (doc_id, text) by group, sorted by the hash inside
partitions; a task holds at most the remainders of one group (``GROUP_DOCS`` x
``length`` ids), however long its documents are.  A group that grows beyond
that (rows that repeat) is packed in portions.  Encoding happens in the same
pass, so ids are never shuffled.

Defined cases: a null or empty text is the end id alone; repeated rows are
documents of their own; null doc_ids are returned as null; an empty table gives
an empty result; ties of length are broken by arrival, which follows the hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietab.llm.common import blocks, narrow, small_batches, table
from quietab.llm.tokens import ENCODE_BYTES, encoder, shared_tokenizer

LENGTH = 1024
GROUP_DOCS = 2048
#: groups of each task, one after the other
TASK_GROUPS = 8


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin.  ``tree[1]`` is the largest free capacity; a node holds its children's larger one."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        at = node - leaves
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left > right else right
    return bins


def packed(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length): first-fit decreasing, then gaps closed by cutting."""
    bins = [[(i, 0, int(sizes[i])) for i in b] for b in first_fit_decreasing(sizes, capacity)]
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, donor = order[lo], order[hi]
        gap = capacity - used[to]
        if not gap:
            lo += 1
            continue
        item, start, n = bins[donor].pop()
        take = min(gap, n)
        bins[to].append((item, start, take))
        if take < n:
            bins[donor].append((item, start + take, n - take))
        used[to] += take
        used[donor] -= take
        if not used[donor]:
            hi -= 1
    return [b for b in bins if b]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, seed: int = 7,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset; with ``with_ids`` also the ids themselves."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_tokenizer(spark.sparkContext, tokenizer)
    rows = narrow(docs, "doc_id", "text")
    count = rows.count()
    groups = max(1, -(-count // GROUP_DOCS))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // TASK_GROUPS))
    out = T.StructType([rows.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    kind = pa.int64() if rows.schema["doc_id"].dataType == T.LongType() else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared, spaced=True)
        ready: list = []
        rest: list = []  # (doc_id, start, ids, doc_tokens) of the open group
        group, sequence = None, 0

        def piece(doc_id, start, ids, total, offset):
            ready.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total,
                          (group << 32) + sequence, offset) + ((ids.astype(np.int32),) if with_ids else ()))

        def close():
            nonlocal rest, sequence
            for b in packed(np.array([len(r[2]) for r in rest], np.int64), length):
                offset = 0
                for item, at, n in b:
                    doc_id, start, ids, total = rest[item]
                    piece(doc_id, start + at, ids[at:at + n], total, offset)
                    offset += n
                sequence += 1
            rest = []

        def flush():
            cols = list(zip(*ready)) if ready else []
            ready.clear()
            if cols:
                made = [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
                if with_ids:
                    made.append(pa.array(cols[7], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(made, out.names)

        for b in batches:
            ids_of, group_of = b.column("doc_id"), b.column("g").to_pylist()
            for lo, hi, block in blocks(b.column("text"), ENCODE_BYTES):
                ids, counts = enc.encode(block)
                ends = np.cumsum(counts)
                for k, doc_id in enumerate(ids_of.slice(lo, hi - lo).to_pylist()):
                    if group_of[lo + k] != group:
                        close()
                        group, sequence = group_of[lo + k], 0
                    elif len(rest) == GROUP_DOCS * 2:
                        close()
                    own = np.append(ids[ends[k] - counts[k]:ends[k]], np.uint32(end_id))
                    full = len(own) // length * length
                    for at in range(0, full, length):
                        piece(doc_id, at, own[at:at + length], len(own), 0)
                        sequence += 1
                    if full < len(own):
                        rest.append((doc_id, full, own[full:], len(own)))
                yield from flush()
        close()
        yield from flush()

    # rows that repeat get the group of their input partition too, so that copies (they may be a third of the
    # table) spread; a retried task deals its rows alike, whatever their order
    h = F.xxhash64(F.xxhash64("doc_id", "text", F.lit(seed)), F.spark_partition_id())
    dealt = (rows.withColumn("h", h).withColumn("g", F.pmod("h", F.lit(groups)))
             .repartition(tasks, F.col("g")).sortWithinPartitions("g", "h").select("g", "doc_id", "text"))
    return dealt.mapInArrow(run, out)


def op7_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
