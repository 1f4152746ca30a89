"""Benchmark decontamination by the q-gram lemma.

An item of ``m`` bytes (lower-cased, everything but letters and digits as single
spaces, UTF-8) occurs in a text if some part of the normalised text is within
``k = min(rate * m, (m - q) / q)`` edits of the whole item.  By the q-gram lemma
such a part shares at least ``m - q + 1 - k q`` q-grams with the item, all on
diagonals (text position minus item position) at most ``k`` apart.  Diagonals
are counted in bands of ``2 (k + 1)`` that overlap by half, so one band holds
them all; bands that meet the bound are verified by an exact search and then by
a banded alignment.

Plan: one shuffle-free scan of the documents per block of at most
``BLOCK_ITEM_BYTES`` of item text (the broadcast index has that proven bound;
a larger benchmark takes more blocks, never a cut).  A q-gram's hash is looked up for every text
position at once (numpy); only positions that hit the index are expanded.
q-grams shared by more than ``COMMON`` items are left out of an item's postings
only if its bound, lowered by their number, stays positive -- nothing is lost.

Defined cases: a null or empty text or item matches nothing, nor does an item of
fewer than ``q`` bytes (too little text to be evidence); items with equal text
are searched once and all reported; a null item_id is reported as null; repeated rows
are each reported.  Several occurrences of an item in a text give one row, the one with
the fewest edits, then the earliest end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quietab.llm.common import WORD_TABLE, blocks, map_text, narrow, small_batches, table

BLOCK_ITEM_BYTES = 4 << 20
COMMON = 64
TABLE_BITS = 22


@dataclass(frozen=True)
class LeakConfig:
    q: int = 10
    rate: float = 0.08


def normalised(text: bytes | None) -> bytes:
    if not text:
        return b""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(WORD_TABLE).split())


def gram_codes(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q-gram at each position (8 <= q <= 16)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    head = np.ndarray((n,), "<u8", data, 0, (1,))
    tail = np.ndarray((n,), "<u8", data, q - 8, (1,))
    code = head * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    code += tail
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    return code


class ItemIndex:
    """Postings of the items' q-grams with their bounds."""

    def __init__(self, texts: list[bytes], cfg: LeakConfig):
        self.cfg, self.texts = cfg, texts
        q = cfg.q
        m = np.array([len(t) for t in texts], np.int64)
        self.edits = np.maximum(np.minimum((cfg.rate * m).astype(np.int64), (m - q) // q), 0)
        self.least = np.where(m >= q, m - q + 1 - self.edits * q, np.iinfo(np.int64).max)
        code = [gram_codes(np.frombuffer(t, np.uint8), q) for t in texts]
        n = np.array([len(c) for c in code], np.int64)
        item = np.repeat(np.arange(len(texts)), n)
        place = np.concatenate([np.arange(x) for x in n]) if len(n) else np.zeros(0, np.int64)
        code = np.concatenate(code) if code else np.zeros(0, np.uint64)
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        common = count[inverse] > COMMON
        lowered = self.least - np.bincount(item[common], minlength=len(texts))
        skip = common & (lowered[item] >= 1)
        self.least = np.where(lowered >= 1, lowered, self.least)
        order = np.flatnonzero(~skip)
        order = order[np.argsort(code[order], kind="stable")]
        self.item, self.place = item[order], place[order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def bands(self, data: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(doc, item, first diagonal) of the bands that meet the bound."""
        code = gram_codes(data, self.cfg.q)
        if not len(code) or not len(self.code):
            return []
        at = np.flatnonzero(self.table[(code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        hit = self.code[slot] == code[at]
        at, slot = at[hit], slot[hit]
        n = self.count[slot]
        post = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item = self.item[post]
        d = doc[np.repeat(at, n)]
        diagonal = np.repeat(at, n) - starts[d] - self.place[post]
        step = self.edits[item] + 1
        band = diagonal // step
        key = (d * len(self.texts) + item) << 28 | (band + (1 << 26))
        key, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        pair = key >> 28
        item = pair % max(1, len(self.texts))
        ok = count >= self.least[item]
        band = (key & ((1 << 28) - 1)) - (1 << 26)
        return list(zip((pair // len(self.texts))[ok].tolist(), item[ok].tolist(),
                        (band * (self.edits[item] + 1))[ok].tolist()))


def aligned(item: bytes, text: bytes, first: int, k: int) -> tuple[int, int]:
    """(fewest edits, end in text) of the whole item against any part of ``text``
    that starts on the diagonals first - k .. first + 2 (k + 1) + k."""
    lo = first - k
    width = 4 * k + 3
    m = len(item)
    spread = np.zeros(m + width, np.uint8)
    a, b = max(0, lo), min(len(text), lo + m + width)
    if b <= a:
        return m, 0
    spread[a - lo:b - lo] = np.frombuffer(text, np.uint8, b - a, a)
    p = np.frombuffer(item, np.uint8)
    ramp = np.arange(width)
    row = np.zeros(width, np.int64)
    inf = np.array([m + k + 1])
    for i in range(m):
        best = np.minimum(row + (spread[i:i + width] != p[i]), np.concatenate((row[1:], inf)) + 1)
        row = np.minimum.accumulate(best - ramp) + ramp
    ends = lo + m + ramp
    row = np.where((ends < 0) | (ends > len(text)), m + k + 1, row)
    at = int(row.argmin())
    return int(row[at]), int(ends[at])


def found(index: ItemIndex, block: list) -> list[tuple[int, int, int, int]]:
    """(row of block, item, edits, end) of each item found in each text."""
    texts = [normalised(t) for t in block]
    lens = np.array([len(t) for t in texts], np.int64)
    pad = b"\x00" * index.cfg.q
    starts = np.concatenate(([0], np.cumsum(lens + len(pad))[:-1])) if len(texts) else lens
    data = np.frombuffer(pad.join([*texts, b""]), np.uint8)
    doc = np.repeat(np.arange(len(texts)), lens + len(pad))
    best: dict = {}
    for d, i, first in index.bands(data, doc, starts):
        item, k = index.texts[i], int(index.edits[i])
        now = best.get((d, i), (k + 1, 0))
        if now[0] == 0:
            continue
        at = texts[d].find(item, max(0, first - k), first + 3 * k + 2 + len(item))
        got = (0, at + len(item)) if at >= 0 else aligned(item, texts[d], first, k)
        if got[0] <= k:
            best[d, i] = min(now, got)
    return sorted((d, i, e, end) for (d, i), (e, end) in best.items())


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[bytes, list]]]:
    """Blocks of (normalised item, its item_ids), each collected under a proven bound."""
    items = narrow(benchmark, "item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // (BLOCK_ITEM_BYTES // 2))
    for k in range(parts):
        by_text: dict = {}
        for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).toLocalIterator():
            by_text.setdefault(normalised(r["text"].encode()), []).append(r["item_id"])
        yield sorted((t, ids) for t, ids in by_text.items())


def leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, n_edits, n_bytes (of the item), ends_at (byte of the normalised text)."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = narrow(docs, "doc_id").schema[0], narrow(benchmark, "item_id").schema[0]
    out = T.StructType([kinds[0], kinds[1], T.StructField("n_edits", T.LongType()),
                        T.StructField("n_bytes", T.LongType()), T.StructField("ends_at", T.LongType())])
    item_kind = to_arrow_schema(out).field("item_id").type
    rows = narrow(docs, "doc_id", "text")
    result = spark.createDataFrame([], out)
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex([t for t, _ in shared.value], cfg)
            ids = [i for _, i in shared.value]
            for b in batches:
                for lo, hi, block in blocks(b.column("text")):
                    got = [(d, one, e, len(index.texts[i]), end) for d, i, e, end in found(index, block) for one in ids[i]]
                    if got:
                        d, one, e, n, end = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").slice(lo, hi - lo).take(pa.array(d)), pa.array(one, item_kind),
                             pa.array(e), pa.array(n), pa.array(end)], out.names)

        result = result.unionAll(rows.mapInArrow(search, out))
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """The documents in which no item occurs, in their own columns."""
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast([t for t, _ in items])

        def make(shared=shared):
            index = ItemIndex(shared.value, cfg)

            def f(block):
                clean = np.ones(len(block), bool)
                clean[[d for d, *_ in found(index, block)]] = False
                return {"clean": clean}
            return f

        docs = map_text(docs, [T.StructField("clean", T.BooleanType())], make, only="clean")
    return docs


def op3_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
