"""Language-model scoring: interpolated modified Kneser-Ney over hashed n-grams.

Method.  A text is its tokens and one end token; the context of its first tokens
is filled with a start token, which is never predicted.  The highest order counts
n-grams, every lower order counts the different words in front of one (Kneser and Ney;
three discounts an order from the counts of counts, Chen and Goodman 1999; the
fixed discounts 0.5, 1, 1.5 where a corpus is too small to estimate them, each
kept between 0.01 and its count).  Order 1 is interpolated with the uniform
distribution over the distinct training tokens and one unknown token, so an
order's probabilities sum to 1.

Counting, as Spark shuffles: a task counts the distinct n-grams of its texts and deals
them by the hash of their context; n-grams of hot contexts (a share of ``HOT`` of all tokens, found
by a scan) by their own hash, so that a frequent word's n-grams spread over all shards.
A shard's task merges the runs dealt to it, writes sorted hash arrays
of its n-grams and contexts into the shared folder, and deals on partial counts of the next lower
order and of the hot contexts.  One shuffle an order; the driver gets one row of counts of counts a
shard and order.  The number of shards follows the bytes of text.

Storage: per order and shard one file of sorted hash arrays, n-grams seen once as bare
hashes, the others with their counts.  Files appear by an atomic move and depend on
the corpus alone, so a task run twice writes the same.  Scoring tasks sort the distinct n-grams of a
block of texts and pass through each shard once, memory-mapped
(a shared folder that is no file system is read shard by shard instead).
Every n-gram is kept: no cut-off, no pruning.

Words are told apart by XXH64, n-grams by 64-bit mixtures of these.

Defined cases: a null text is empty, an empty text is its end token; a row without doc_id is scored, but
neither held out nor learned from; repeated rows are counted and scored each on their own; without
training text every probability is 1 (the one unknown token); very long texts are blocks of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietab.llm.common import LOWER_TABLE, map_text, narrow, small_batches, table, word_ids, written
from quietab.session import scratch_folder

U64 = np.uint64
#: tokens that no text holds (words have no space)
END, START = U64(xxhash.xxh64_intdigest(b" end")), U64(xxhash.xxh64_intdigest(b" start"))
#: bytes of text counted or scored at once inside a task
RUN_BYTES = 8 << 20
SCORE_BYTES = 6 << 20
#: bytes of training text for each shard of the model
SHARD_BYTES = 16 << 20
#: share of all tokens that makes a context hot
HOT = 1e-4

FOLD = np.frombuffer(LOWER_TABLE, np.uint8)
IS_GAP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

ROWS = "shard int, kind string, a binary, n binary, w binary, k binary, r binary"
NAMES = ["shard", "kind", *"anwkr"]
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
          T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
          T.StructField("perplexity", T.DoubleType())]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of an ordered pair of hashes."""
    z = (a ^ (a >> U64(31))) * U64(0x9E3779B97F4A7C15) + b * U64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return z ^ (z >> U64(29))


def context_hash(words: list) -> np.ndarray:
    """One word stands for itself, more are mixed from the left."""
    got = words[0]
    for w in words[1:]:
        got = mix(got, w)
    return got


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct token (the last one: the end), each token's place there, first token of each text."""
    words, places, before = word_ids(texts, FOLD, IS_GAP)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), U64, len(words))
    ids = np.full(len(places) + len(texts), len(hashes), np.int64)
    ids[np.arange(len(places)) + np.repeat(np.arange(len(texts)), np.diff(before))] = places
    return np.append(hashes, END), ids, before[:-1] + np.arange(len(texts))


def shifted(tokens: np.ndarray, at: np.ndarray, start) -> np.ndarray:
    """The token before each one; ``start`` before the first of a text."""
    got = np.empty_like(tokens)
    got[1:] = tokens[:-1]
    got[at] = start
    return got


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; rises with it."""
    return ((keys >> U64(32)) * U64(shards)) >> U64(32)


def packed(values: np.ndarray) -> bytes:
    """Small integers, by zstd (hashes cannot be made smaller, counts can)."""
    return zstandard.compress(values.astype(np.int64, copy=False).tobytes(), 1)


def unpacked(blobs: list[bytes], each: int = 1) -> np.ndarray:
    """All packed runs of ``each`` columns, one after the other."""
    parts = [np.frombuffer(zstandard.decompress(x), np.int64).reshape(each, -1) for x in blobs if x]
    return np.concatenate(parts or [np.zeros((each, 0), np.int64)], axis=1)


def dealt(kind: str, of: np.ndarray, a: np.ndarray | None = None, w: np.ndarray | None = None,
          k: np.ndarray | None = None, r: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of one shard each, from columns in the order of their shard ``of``: runs of equal
    contexts ``a`` with their lengths ``n``, words ``w`` and the counts ``k`` and ``r``."""
    cuts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
    rows = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        heads = lens = b""
        if a is not None:
            own = a[i:j]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            heads, lens = own[first].tobytes(), packed(np.diff(np.append(first, j - i)))
        rows.append((int(of[i]), kind, heads, lens, b"" if w is None else w[..., i:j].tobytes(),
                     b"" if k is None else packed(k[..., i:j]), b"" if r is None else packed(r[i:j])))
    columns = list(zip(*rows)) or [()] * 7
    types = [pa.int32(), pa.string()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)


def gram_shards(a: np.ndarray, keys: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """n-grams go with their context, so that it is stored once; those of hot contexts by their own hash."""
    of = shard_of(a, shards)
    at = np.isin(a, hot)
    of[at] = shard_of(keys[at], shards)
    return of


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Distinct keys in order, the place of one row of each, and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], first) if len(first) else v for v in (v.astype(np.int64) for v in values)]
    return keys[first], order[first], sums


class Store:
    """Files of arrays in the shared folder."""

    def __init__(self, uri: str):
        local = uri.startswith("file:") or "://" not in uri
        if local:
            path = uri.removeprefix("file:")
            self.fs, self.root = pafs.LocalFileSystem(), "/" + path.lstrip("/")
        else:
            self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.local = local

    def put(self, name: str, arrays: list[np.ndarray]) -> None:
        self.fs.create_dir(self.root, recursive=True)
        target = f"{self.root}/{name}"
        temporary = f"{target}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            out.write(np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes())
            for a in arrays:
                out.write(a.astype(U64, copy=False).data.cast("B") if len(a) else b"")
        self.fs.move(temporary, target)

    def get(self, name: str) -> list[np.ndarray]:
        path = f"{self.root}/{name}"
        if self.local:
            data = np.memmap(path, U64, "r")
        else:
            with self.fs.open_input_stream(path) as src:
                data = np.frombuffer(src.read(), U64)
        n = int(data[0])
        ends = np.cumsum(data[:n + 1].astype(np.int64)) + 1
        return [data[int(ends[i]):int(ends[i + 1])] for i in range(n)]


def split_once(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Keys whose values are all 1, then the others and their values."""
    once = np.ones(len(keys), bool)
    for v in values:
        once &= v == 1
    return [keys[once], keys[~once], *[v[~once] for v in values]]


def find(store: Store, kind: str, shards: int, keys: np.ndarray, n_values: int, of: np.ndarray | None = None) -> list[np.ndarray]:
    """Values of sorted keys (0: not there), shard by shard; ``of``: their shards, where not by the key itself."""
    out = [np.zeros(len(keys), np.int64) for _ in range(n_values)]
    if of is None:
        of = shard_of(keys, shards)
        order, cuts = None, np.searchsorted(of, np.arange(shards + 1, dtype=U64))
    else:
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(shards + 1, dtype=U64))
    for s in range(shards):
        i, j = cuts[s], cuts[s + 1]
        if i == j:
            continue
        once, more, *values = store.get(f"{kind}-{s:06d}")
        place = slice(i, j) if order is None else order[i:j]
        own = keys[place]
        for o, v in zip(out, _among(own, once, more, values)):
            o[place] = v
    return out


def _among(own: np.ndarray, once: np.ndarray, more: np.ndarray, values: list) -> list[np.ndarray]:
    got = [np.zeros(len(own), np.int64) for _ in values]
    if len(once):
        at = np.minimum(np.searchsorted(once, own), len(once) - 1)
        hit = once[at] == own
        for g in got:
            g[hit] = 1
    if len(more):
        at = np.minimum(np.searchsorted(more, own), len(more) - 1)
        hit = more[at] == own
        for g, v in zip(got, values):
            g[hit] = v[at[hit]]
    return got


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and at least 3, from the numbers of n-grams with count 1, 2, 3 and 4."""
    if not all(n[:3]):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.01), float(j)) for j in (1, 2, 3))


def _put_contexts(store: Store, name: str, keys: np.ndarray, sums: list) -> None:
    """Total, and numbers of n-grams with count 1, 2, at least 3; a context with total 1 as bare hash."""
    once = sums[0] == 1
    store.put(name, [keys[once], keys[~once], *[s[~once] for s in sums]])


def _merge(level: int, order: int, shards: int, uri: str, shared):
    """The step of one order: merges the runs of a shard, writes its n-grams and contexts, and deals
    the lower order's n-grams and its part of the hot contexts' statistics."""
    def run(t: pa.Table) -> pa.Table:
        store, shard, hot = Store(uri), t.column("shard")[0].as_py(), shared.value
        pick = lambda kind: t.filter(pc.equal(t.column("kind"), kind))
        blobs = lambda rows, name: rows.column(name).to_pylist()
        hashes = lambda rows, name, each=1: np.concatenate(
            [np.frombuffer(x, U64).reshape(each, -1) for x in blobs(rows, name)] or [np.zeros((each, 0), U64)], axis=1)
        out = pick("stats").to_batches()
        if level < order:
            c = pick("context")
            at, _, sums = summed(hashes(c, "a")[0], *unpacked(blobs(c, "k"), 4))
            _put_contexts(store, f"hot{level + 1}-{shard:06d}", at, sums)
        g = pick("gram")
        words = hashes(g, "w", max(1, level - 1))
        (count,) = unpacked(blobs(g, "k"))
        raw = unpacked(blobs(g, "r"))[0] if level < order else count
        a = np.repeat(hashes(g, "a")[0], unpacked(blobs(g, "n"))[0]) if level > 1 else words[0]
        del g, t
        keys, place, (count, raw) = summed(mix(a, words[-1]) if level > 1 else a, count, raw)
        a, words = a[place], words[:, place]
        n = [int((count == i).sum()) for i in (1, 2, 3, 4)]
        told = np.array([level, *n, len(count), count.sum(), raw.sum()], np.int64)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array(["stats"]), *[pa.array([x], pa.binary()) for x in
                                                                  (b"", b"", b"", told.tobytes(), b"")]], NAMES))
        store.put(f"gram{level}-{shard:06d}", split_once(keys, [count] if level > 1 else [count, raw]))
        del keys
        if level > 1:
            at, _, sums = summed(a, count, count == 1, count == 2, count >= 3)
            is_hot = np.isin(at, hot)
            _put_contexts(store, f"context{level}-{shard:06d}", at[~is_hot], [s[~is_hot] for s in sums])
            out.append(dealt("context", shard_of(at[is_hot], shards), a=at[is_hot], k=np.array([s[is_hot] for s in sums])))
            del a, at, sums, is_hot
            one = np.ones(len(count), np.int64)
            if level > 2:
                low = context_hash(list(words[:-1]))
                lower, place, (seen, raw) = summed(mix(low, words[-1]), one, raw)
                low, words = low[place], words[1:, place]
                out.append(in_shards(low, lower, words, seen, raw, hot, shards))
            else:
                lower, place, (seen, raw) = summed(words[0], one, raw)
                out.append(dealt("gram", shard_of(lower, shards), w=words[:, place], k=seen, r=raw))
        return pa.Table.from_batches(out).select(NAMES)
    return run


def in_shards(a, keys, words, count, raw, hot, shards) -> pa.RecordBatch:
    """n-grams dealt to their shards."""
    of = gram_shards(a, keys, hot, shards)
    order = np.lexsort((a, of))
    return dealt("gram", of[order], a=a[order], w=words[:, order], k=count[order], r=None if raw is None else raw[order])


def token_words(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, order: int) -> list:
    """Hashes of the words of each token's n-gram, the oldest first."""
    words = [hashes[ids]]
    for _ in range(order - 1):
        words.insert(0, shifted(words[0], at, START))
    return words


def context_counts(texts: list, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, number of tokens) of the contexts of each order."""
    hashes, ids, at = tokens(texts)
    times = np.bincount(ids, minlength=len(hashes))
    yield np.append(hashes[:-1], START), np.append(times[:-1], len(texts))  # a token precedes another, unless it is an end
    if order > 2:
        words = token_words(hashes, ids, at, order)
        for k in range(3, order + 1):
            yield np.unique(context_hash(words[order - k:-1]), return_counts=True)


def in_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """The texts of a task in lists of about ``RUN_BYTES``."""
    waiting, held = [], 0
    for b in batches:
        for text in b.column(0).cast(pa.binary()).to_pylist():
            waiting.append(text)
            held += len(text or b"") + 1
            if held >= RUN_BYTES:
                yield waiting
                waiting, held = [], 0
    if waiting:
        yield waiting


@dataclass(frozen=True)
class Model:
    """What scoring tasks need besides the files."""
    uri: str
    shards: int
    order: int
    hot: np.ndarray  # hashes of the contexts whose n-grams lie in all shards
    discounts: tuple  # of orders 1, 2, ...
    low: tuple  # order 1: n-grams with count 1, 2, at least 3; sum of counts
    train_tokens: int
    train_words: int


def hot_contexts(texts: DataFrame, order: int) -> np.ndarray:
    """Hashes of the contexts that hold a share of ``HOT`` of all tokens: at most 1 / HOT an order."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in in_runs(batches):
            for k, (at, n) in enumerate(context_counts(run, order)):
                total = int(n.sum())
                if not k:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["a", "n"])
                often = n >= HOT * total  # a context that is hot in all is hot in a run
                yield pa.RecordBatch.from_arrays([pa.array(at[often].view(np.int64)), pa.array(n[often])], ["a", "n"])

    found = written(texts.mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")), "contexts")
    total = found.filter("a is null").agg(F.sum("n")).first()[0] or 0
    rows = found.filter((F.col("a").isNotNull()) & (F.col("n") >= HOT * total)).select("a").collect()
    return np.sort(np.array([r["a"] for r in rows], np.int64).view(U64))


def train(docs: DataFrame, order: int = 2) -> Model:
    """The model of all texts of ``docs`` (order 2 or more), its arrays written to the shared folder."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    texts = narrow(docs, "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    uri = scratch_folder(spark, "ngrams")
    hot = hot_contexts(texts, order)
    shared = spark.sparkContext.broadcast(hot)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in in_runs(batches):
            words = token_words(*tokens(run), order)
            a = context_hash(words[:-1])
            keys, place, (n,) = summed(mix(a, words[-1]), np.ones(len(a), np.int64))
            a, words = a[place], np.array([w[place] for w in words[1:]])
            yield in_shards(a, keys, words, n, None, shared.value, shards)

    every = spark.range(shards).selectExpr("cast(id as int) shard", "'shard' kind", *[f"cast('' as binary) {c}" for c in "anwkr"])
    rows = texts.mapInArrow(count, ROWS).unionAll(every)  # so that each shard has its files
    for level in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(_merge(level, order, shards, uri, shared), ROWS)
    told = [np.frombuffer(r["k"], np.int64) for r in rows.filter("kind = 'stats'").collect()]  # one a shard and order
    by_level = {k: sum((x[1:] for x in told if x[0] == k), np.zeros(7, np.int64)).tolist() for k in range(1, order + 1)}
    n1, n2, _, _, distinct, total, raw = by_level[1]
    return Model(uri, shards, order, hot, tuple(discounts(by_level[k][:4]) for k in range(1, order + 1)),
                 (n1, n2, distinct - n1 - n2, total), raw, distinct)


def discounted(count: np.ndarray, d: tuple) -> np.ndarray:
    return count - np.array([0.0, *d])[np.minimum(count, 3)]


def log_probabilities(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability and training count of every token, first token of each text."""
    if not model.train_tokens:
        _, ids, at = tokens(texts)
        return np.zeros(len(ids)), np.zeros(len(ids), np.int64), at
    store = Store(model.uri)
    hashes, ids, at = tokens(texts)
    rank = np.argsort(hashes)
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    cc, raw = find(store, "gram1", model.shards, hashes[rank], 2)
    d = model.discounts[0]
    *low, total = model.low
    p = (discounted(cc, d) / total + np.dot(d, low) / total / (model.train_words + 1))[place][ids]
    raw = raw[place][ids]
    words = [hashes[ids]]
    for level in range(2, model.order + 1):
        words.insert(0, shifted(words[0], at, START))
        a = context_hash(words[:-1])
        d = model.discounts[level - 1]
        keys, of = np.unique(mix(a, words[-1]), return_inverse=True)
        own = np.empty_like(keys)
        own[of] = a
        (count,) = find(store, f"gram{level}", model.shards, keys, 1, gram_shards(own, keys, model.hot, model.shards))
        seen = discounted(count, d)[of]
        if level == 2:  # one word: numbered already
            keys = np.append(hashes, START)
            rank = np.argsort(keys)
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            keys, of = keys[rank], place[shifted(ids, at, len(hashes))]
        else:
            keys, of = np.unique(a, return_inverse=True)
        stats = np.zeros((4, len(keys)), np.int64)
        is_hot = np.isin(keys, model.hot)
        stats[:, ~is_hot] = find(store, f"context{level}", model.shards, keys[~is_hot], 4)
        stats[:, is_hot] = find(store, f"hot{level}", model.shards, keys[is_hot], 4)
        total, n1, n2, n3 = stats
        n2[total == 1] = n3[total == 1] = 0  # kept as bare hashes
        known = total > 0
        total = np.maximum(total, 1)
        rest = np.where(known, (d[0] * n1 + d[1] * n2 + d[2] * n3) / total, 1.0)[of]
        p = seen / total[of] + rest * p
    return np.log10(p), raw, at


def _score(shared):
    def make():
        model = shared.value

        def f(block: list) -> dict:
            if not block:
                return {x.name: [] for x in FIELDS}
            logs, raw, at = log_probabilities(model, block)
            n = np.diff(np.append(at, len(logs)))
            base = np.log10((raw + 0.1) / (model.train_tokens + 0.1 * (model.train_words + 1)))
            score = np.add.reduceat(logs, at)
            return {"n_tokens": n, "n_known": np.add.reduceat((raw > 0).astype(np.int64), at),
                    "base_score": np.add.reduceat(base, at), "score": score, "perplexity": 10 ** (-score / n)}
        return f
    return make


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """n_tokens, n_known, base_score, score and perplexity of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, FIELDS, _score(shared), keep=keep, block_bytes=SCORE_BYTES)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 10


def op13_lm_scoring(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(remainder(F.col("doc_id")) != 0))
    return (score(docs, model, keep=["doc_id"])
            .withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)))
            .withColumn("train_tokens", F.lit(model.train_tokens).cast("long")))
