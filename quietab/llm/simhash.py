"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprint: 64 bits, a bit is 1 if it is set in over half of the XXH64 values
(seed 42) of the text's word shingles.  Fingerprints at 3 or fewer differing
bits are linked; a document's component is that of its fingerprint.

Candidate search.  The 64 bits are cut into segments of 23, 23 and 18 bits (the
last padded with zeros).  The binary Golay code (23, 12) is perfect: every
segment lies within 3 bits of exactly one codeword.  A segment's *primary* key
is that codeword's 12-bit index; a segment at distance exactly 3 gets five more
keys, the codewords at distance 4.  If two segments differ in at most one bit,
the primary key of either is among the keys of the other: a segment at distance
<= 2 keeps its codeword within 3 after the change, and two at distance 3 with
different codewords see each other's codeword at distance 4.

Pigeonhole.  With at most 3 errors over three segments at least two have at most
one.  Either one of these is free of errors -- key (its exact bits, codeword
index of the other), six ordered choices -- or each of the three has one error:
key (three codeword indices).  So no link can be missed, and every bucket key
has 30 to 36 bits whatever the corpus size.  Rows flagged ``own`` carry primary
keys only; a link joins an ``own`` row with any other row of the same key.

Plan: fingerprints are written once; equal ones collapse (map-side) before keys
are made, so copies cost nothing.  Keys are shuffled by key; each task sorts its
keys and verifies the bit distance inside equal keys.  Short runs are checked
pairwise; a longer run yields the spanning forest of its links by search
(a bucket emits fewer rows than it has members, never all pairs), which
keeps every component; a large run of few links is split by a second exact key.
The links are written once.  A task holds 17 bytes per key row, distinct fingerprints
only, with about ``ROWS_PER_TASK`` rows per task.  Components come from
star contraction (``components``).

Defined cases: a null or empty text, or one without a word, has fingerprint 0
and is linked like any other; fewer words than a shingle make one shingle of
the whole sequence; repeated rows are equal fingerprints and stay as many rows;
null doc_ids are ignored by the smallest id (a component of null ids only has a
null component_id; ``one_of_each`` keeps one row of it); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, combinations, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietab.llm.common import LOWER_TABLE, map_text, narrow, renamed, small_batches, table, written
from quietab.llm.components import components

SHINGLE = 3
MAX_BITS = 3
GENERATOR = 0xC75            # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))
ROWS_PER_FINGERPRINT = 181   # expected key rows: 6 x 5.3 + 5.3^3
ROWS_PER_TASK = 2_000_000
PAIRWISE_RUN = 32
#: a run of more rows is split by a second key if this many searches leave most of it
SPLIT_RUN, SEARCHES = 512, 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").translate(LOWER_TABLE).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda a, b: a + b + 1, initial=0))
    n = len(words) - shingle + 1
    grams = [line[a:b - 1] for a, b in zip(starts, starts[shingle:])]
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = grams[lo:lo + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """fp (the 64 bits as a signed long) of every document."""
    def make():
        return lambda block: {"fp": np.array([fingerprint(t, shingle) for t in block], np.uint64).view(np.int64)}
    return map_text(docs, [T.StructField("fp", T.LongType())], make, keep=keep)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 23-bit vectors by halves, and per syndrome the error
    patterns whose removal gives the keys' codewords (-1: no such key)."""
    unit = []
    for k in range(23):
        r = 1 << k
        while r.bit_length() > 11:
            r ^= GENERATOR << (r.bit_length() - 12)
        unit.append(r)

    def syndromes(bits):
        out = np.zeros(1 << len(bits), np.int64)
        for k, r in enumerate(bits):
            out[1 << k:2 << k] = out[:1 << k] ^ r
        return out

    errors = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for k in at:
                s ^= unit[k]
            errors[s, used[s]] = sum(1 << k for k in at)
            used[s] += 1
    return syndromes(unit[:12]), syndromes(unit[12:]), errors


def segment_keys(v: np.ndarray) -> np.ndarray:
    """Codeword indices (n, 6) near each 23-bit vector; column 0 is the primary key, -1: none."""
    low, high, errors = golay()
    e = errors[low[v & 0xFFF] ^ high[v >> 12]]
    return np.where(e < 0, -1, (v[:, None] ^ e) >> 11)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fps, bucket key, own) of all keys of the fingerprints (uint64)."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [segment_keys(s) for s in seg]
    rows, keys, own = [], [], []

    def add(family, value, ok, primary):
        at = np.flatnonzero(ok)
        rows.append(at)
        keys.append((family << 36) | value[at])
        own.append(np.full(len(at), primary))

    for family, (i, j) in enumerate(product(range(3), repeat=2)):
        if i != j:
            for c in range(6):
                add(family, seg[i] << 12 | near[j][:, c], near[j][:, c] >= 0, c == 0)
    for c in product(range(6), repeat=3):
        k = [near[s][:, c[s]] for s in range(3)]
        add(9, k[0] << 24 | k[1] << 12 | k[2], (k[0] >= 0) & (k[1] >= 0) & (k[2] >= 0), c == (0, 0, 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def forest(fps: np.ndarray, own: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links between ``own`` rows and any rows of one run.

    A search from one row after the other is quick where rows are linked.  If after ``SEARCHES``
    rows most are still left, the run is sparse and large, and is split by a second exact
    key: the bits that differ in it are dealt to four blocks, of which a link of at most three bits
    leaves one equal, so every link lies within a smaller run of equal block."""
    left, searched, split = np.arange(len(fps)), 0, len(fps) > SPLIT_RUN
    while len(left):
        queue, left = [int(left[-1])], left[:-1]
        while queue and len(left):
            if split and searched >= SEARCHES:
                split = False
                if len(left) > len(fps) // 2:
                    rest = np.append(left, queue)  # all links of the rows searched are found
                    if (blocks := _blocks(fps[rest])) is not None:
                        for mask in blocks:
                            yield from verified((fps[rest] & mask).view(np.int64), fps[rest], own[rest], max_bits)
                        return
            searched += 1
            v = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[v]) <= max_bits
            if not own[v]:
                near &= own[left]
            if near.any():
                found = left[near]
                left = left[~near]
                yield np.full(len(found), fps[v]), fps[found]
                queue.extend(found.tolist())


def _blocks(fps: np.ndarray) -> list | None:
    """Four masks that share out the bits in which the fingerprints differ; None if these are few."""
    vary = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [k for k in range(64) if vary >> k & 1]
    if len(bits) < 12:
        return None
    return [np.uint64(sum(1 << k for k in bits[i::4])) for i in range(4)]


def verified(key: np.ndarray, fp: np.ndarray, own: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) of one task's key rows."""
    order = np.argsort(key, kind="stable")
    key, fp, own = key[order], fp[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    for at in np.flatnonzero(size > PAIRWISE_RUN):
        yield from forest(fp[first[at]:first[at] + size[at]], own[first[at]:first[at] + size[at]], max_bits)
    run = np.repeat(size, size)
    rest = (run > 1) & (run <= PAIRWISE_RUN)
    key, fp, own = key[rest], fp[rest], own[rest]
    for s in range(1, PAIRWISE_RUN):
        at = np.flatnonzero((key[s:] == key[:-s]) & (own[s:] | own[:-s]))
        if not len(at) and not (key[s:] == key[:-s]).any():
            break
        a, b = fp[at], fp[at + s]
        ok = np.bitwise_count(a ^ b) <= max_bits
        yield a[ok], b[ok]


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct links (a < b) that connect all distinct fingerprints ``fp`` at
    ``max_bits`` (at most 3) or fewer bits, directly or through other links."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the key scheme finds up to 3 differing bits")
    spark = nodes.sparkSession
    small_batches(spark)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 512):
                part = fps[lo:lo + 512]
                rows, key, own = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows].view(np.int64)), pa.array(own)],
                                                 ["key", "fp", "own"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())]))
        key, fp, own = (got[c].to_numpy() for c in ("key", "fp", "own"))
        del got
        for a, b in verified(key, fp.view(np.uint64), own, max_bits):
            a, b = a.view(np.int64), b.view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-nodes.count() * ROWS_PER_FINGERPRINT // ROWS_PER_TASK))
    return (nodes.select("fp").mapInArrow(keys, "key long, fp long, own boolean")
            .repartition(tasks, "key").mapInArrow(verify, "a long, b long").distinct())


def rooted(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The written table of distinct fingerprints ``fp`` with the root fingerprint of their components."""
    roots = components(written(links(nodes, max_bits), "simhash-links")).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    fps = written(fingerprints(narrow(docs, "doc_id", "text"), ["doc_id"], shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    groups = rooted(nodes, max_bits)
    ids = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = groups.join(ids, "root").select("fp", "component_id")
    return (fps.join(of_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, in its own columns: the first by doc_id (nulls
    last), then by the hash of its text.  Rows are told apart by a key of their
    own, written with them, so neither null nor repeated doc_ids merge groups."""
    plain = renamed(docs)
    keyed = written(plain.withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
    key, text = (f"c{docs.columns.index(n)}" for n in ("doc_id", "text"))
    rows = keyed.select(F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("doc_id"),
                                 F.xxhash64(text).alias("hash"), "row").alias("first"), F.col(text).alias("text"))
    nodes = written(fingerprints(rows, ["first"], shingle).groupBy("fp").agg(F.min("first").alias("first")), "simhash-nodes")
    chosen = rooted(nodes, max_bits).groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return keyed.join(chosen, "row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def op9_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
