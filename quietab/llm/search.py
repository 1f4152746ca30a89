"""Ranked lexical search: exact top documents for every item, by blocked posting lists.

Method.  Documents are indexed in portions.  Inside a portion the documents of each
term's posting list are clustered by similarity (the list's documents go to the most similar
of evenly spaced ones, by their hashed term vectors) into geometric blocks; a block stores the
coordinatewise maximum of its documents' vectors.  An item's weighted sum over a block's summary
is an upper bound for every document in the block, so a search takes the blocks of the item's terms in falling order of
bound, scores their documents on the whole vectors, and skips a block only if its bound is
below the worst of the best ``k`` found so far.  Each document with a score above 0 stands in a list of one
of the item's terms, so the result is exact.  A block of fewer than ``LEAST`` documents is
bounded by its portion's maxima instead of its own.

A document's vector holds ``(1000000000 tf) div (1000 tf + 8 m)`` per term; an item weighs it by its own count of
the term times ``floor(1000 ln((2N + 2) / (2 df + 1)))``.  Summaries are kept in 16ths, rounded up,
so a bound is never too small.  All else is 64-bit integer arithmetic.

Plan, per block of at most 4 MB of item text (broadcast: vocabulary, items): one scan of the texts writes the
forward vectors over the items' vocabulary (other terms cannot add to a score); grouped sums give N, L and
each term's df; one pass over the vectors writes the index, one Parquet row a portion; one pass over the index
searches it, keeping the best ``k`` of each item a task; a window merges those.  Nothing but
these few rows is shuffled, so neither a frequent term nor a large group of copies makes a hot key.

Defined cases: a null or empty text has no term and never appears; an item without terms, or with
none that a document holds, has no rows; every row of the items is searched on its own, also
one with a repeated or null item_id; equal scores go by ascending doc_id, a null doc_id last; repeated documents
are ranked each on their own.  No documents, no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quietab.llm.common import WORD_TABLE, blocks, narrow, small_batches, table, word_ids
from quietab.session import scratch_folder

TOP = 10
#: bytes of item text searched with one index
ITEM_BYTES = 4 << 20
#: postings and documents of one portion
PORTION_POSTINGS, PORTION_DOCS = 1 << 16, 1 << 14
#: documents of a geometric block, and fewest with a summary of their own
BLOCK, LEAST = 128, 16
#: entries of documents that summaries are made of at once
BUFFER = 1 << 19
#: dimensions of the hashed vectors that clustering compares
SKETCH = 64
#: summaries count in this unit, rounded up
UNIT = 16

FOLD = np.frombuffer(WORD_TABLE, np.uint8)
IS_GAP = np.arange(256) == 32
ARRAYS = ("starts", "terms", "impacts", "list_blocks", "block_starts", "block_docs", "owned", "sum_starts", "sum_blocks",
          "sum_most", "most")
KIND = {"sum_most": np.uint16, "most": np.uint16}


def packed(index: dict) -> list[bytes]:
    """The arrays as stored: a term's blocks by their differences, everything by zstd."""
    gaps = np.diff(index["sum_blocks"], prepend=0)
    first = index["sum_starts"][:-1][np.diff(index["sum_starts"]) > 0]
    gaps[first] = index["sum_blocks"][first]
    arrays = {**index, "sum_blocks": gaps}
    return [zstandard.compress(arrays[a].astype(KIND.get(a, np.int32)).tobytes(), 1) for a in ARRAYS]


def unpacked(blobs: list) -> dict:
    index = {a: np.frombuffer(zstandard.decompress(x), KIND.get(a, np.int32)) for a, x in zip(ARRAYS, blobs)}
    index = {a: v if a in ("sum_blocks", "sum_most") else v.astype(np.int64) for a, v in index.items()}
    upto, lens = np.cumsum(index["sum_blocks"], dtype=np.int64), np.diff(index["sum_starts"])
    first = index["sum_starts"][:-1][lens > 0]
    index["sum_blocks"] = (upto - np.repeat(upto[first] - index["sum_blocks"][first], lens[lens > 0])).astype(np.int32)
    index["owned"] = index["owned"].astype(bool)
    return index


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its end, one range after the other."""
    lens = ends - starts
    total = int(lens.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) if len(lens) else starts
    return np.arange(total) + shift


def length_factor(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return 100 - 75 + (75 * n * docs) // terms


# --- index ---------------------------------------------------------------------------

def clustered(sketch: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The block of each document of a posting list: numbers from 0, every number used."""
    k = -(-len(docs) // BLOCK)
    if k == 1:
        return np.zeros(len(docs), np.int64)
    own = sketch[docs]
    near = np.argmax(own @ own[np.arange(k) * len(docs) // k].T, axis=1)
    order = np.argsort(near, kind="stable")
    sizes = np.bincount(near, minlength=k)
    within = np.arange(len(docs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = np.empty(len(docs), np.int64)
    parts = -(-sizes // (2 * BLOCK))  # a crowded cluster becomes several blocks
    block[order] = np.repeat(np.cumsum(parts) - parts, sizes) + within // (2 * BLOCK)
    return block


def portion_index(starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray) -> dict:
    """Blocked posting lists and summaries of documents given as rows of (term, impact)."""
    n, vocabulary = len(starts) - 1, len(weights)
    lens = np.diff(starts)
    doc = np.repeat(np.arange(n), lens)
    cell = (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    value = impacts * weights[terms] * np.where(cell & np.uint64(1), 1.0, -1.0)
    sketch = np.bincount(doc * SKETCH + (cell >> np.uint64(1)).astype(np.int64), value, n * SKETCH).reshape(n, SKETCH)
    sketch /= np.maximum(np.sqrt((sketch ** 2).sum(1)), 1e-9)[:, None]
    sketch = sketch.astype(np.float32)

    by_term = np.argsort(terms, kind="stable")
    listed = doc[by_term]
    lists = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=vocabulary))))
    block = np.zeros(len(terms), np.int64)
    n_blocks = (lists[1:] > lists[:-1]).astype(np.int64)
    for t in np.flatnonzero(np.diff(lists) > BLOCK).tolist():
        a, b = lists[t], lists[t + 1]
        block[a:b] = clustered(sketch, listed[a:b])
        n_blocks[t] = block[a:b].max() + 1
    list_blocks = np.concatenate(([0], np.cumsum(n_blocks)))
    block += np.repeat(list_blocks[:-1], np.diff(lists))
    order = np.argsort(block, kind="stable")
    block_docs = listed[order]
    sizes = np.bincount(block, minlength=list_blocks[-1])
    block_starts = np.concatenate(([0], np.cumsum(sizes)))

    owned = sizes >= LEAST
    most = np.zeros(vocabulary, np.int64)
    np.maximum.at(most, terms, impacts)
    small = (-(-impacts // UNIT)).astype(np.int32)
    found = []
    which = np.flatnonzero(owned)
    spread = np.add.reduceat(lens[block_docs], block_starts[:-1]) if len(block_docs) else sizes
    at = 0
    while at < len(which):  # as many blocks at once as fit in the buffers
        cost = np.maximum(np.cumsum(spread[which[at:]]) // BUFFER, np.arange(1, len(which) - at + 1) * vocabulary // (2 * BUFFER))
        end = at + max(1, int(np.searchsorted(cost, 1)))
        some = which[at:end]
        members = block_docs[ranges(block_starts[some], block_starts[some + 1])]
        own = np.repeat(np.arange(len(some)), sizes[some])
        entries = ranges(starts[members], starts[members + 1])
        buffer = np.zeros(len(some) * vocabulary, np.int32)
        np.maximum.at(buffer, np.repeat(own, lens[members]) * vocabulary + terms[entries], small[entries])
        hit = np.flatnonzero(buffer)
        found.append((some[hit // vocabulary].astype(np.int32), (hit % vocabulary).astype(np.int32), buffer[hit].astype(np.uint16)))
        at = end
    blk, trm, top = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int32) for i in range(3))
    order = np.argsort(trm, kind="stable")
    sum_starts = np.concatenate(([0], np.cumsum(np.bincount(trm, minlength=vocabulary))))
    return {"starts": starts, "terms": terms, "impacts": impacts, "list_blocks": list_blocks, "block_starts": block_starts,
            "block_docs": block_docs, "owned": owned, "sum_starts": sum_starts, "sum_blocks": blk[order],
            "sum_most": top[order], "most": -(-most // UNIT)}


class Best:
    """The best ``k`` (score, doc_id) of one item."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """Scores below this cannot enter."""
        return 1 if len(self.rows) < self.k else -self.rows[-1][0]

    def add(self, scores: Iterable[int], ids: Iterable) -> None:
        self.rows += [(-s, i is None, 0 if i is None else i) for s, i in zip(scores, ids)]
        self.rows.sort()
        del self.rows[self.k:]


def search_portion(index: dict, ids: pa.Array, terms: np.ndarray, weights: np.ndarray, best: Best, query: np.ndarray) -> int:
    """Adds the portion's best documents for (terms, weights); returns how many it scored.
    ``query`` is a zeroed buffer over the vocabulary."""
    lists, starts = index["list_blocks"], index["starts"]
    candidates = ranges(lists[terms], lists[terms + 1])
    if not len(candidates):
        return 0
    bound = np.zeros(int(lists[-1]), np.int64)
    first, last = index["sum_starts"][terms].tolist(), index["sum_starts"][terms + 1].tolist()
    for a, b, w in zip(first, last, weights.tolist()):
        bound[index["sum_blocks"][a:b]] += index["sum_most"][a:b].astype(np.int64) * w  # a term names a block once
    bound = bound[candidates]
    bound[~index["owned"][candidates]] = index["most"][terms] @ weights
    bound *= UNIT
    order = np.argsort(-bound, kind="stable")
    candidates, bound = candidates[order], bound[order]
    query[terms] = weights
    seen = np.zeros(len(starts) - 1, bool)
    at, step, scored = 0, 4, 0
    while at < len(candidates) and bound[at] >= best.least():
        end = at + int((bound[at:at + step] >= best.least()).sum())
        now = candidates[at:end]
        docs = index["block_docs"][ranges(index["block_starts"][now], index["block_starts"][now + 1])]
        docs = np.unique(docs[~seen[docs]])
        if len(docs):
            seen[docs] = True
            scored += len(docs)
            a, b = starts[docs], starts[docs + 1]
            entries = ranges(a, b)
            scores = np.add.reduceat(query[index["terms"][entries]] * index["impacts"][entries],
                                     np.concatenate(([0], np.cumsum(b - a)[:-1])))
            top = np.lexsort((docs, -scores))[:best.k]  # places follow the doc_ids
            top = top[scores[top] >= best.least()]
            if len(top):
                best.add(scores[top].tolist(), ids.take(pa.array(docs[top])).to_pylist())
        at, step = end, step * 2
    query[terms] = 0
    return scored


# --- Spark jobs -------------------------------------------------------------------------

def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Blocks of (item_id, its terms with their counts), each collected under a proven bound."""
    items = narrow(items, "item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // (ITEM_BYTES // 2))
    for k in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        got = [(r["item_id"], Counter(terms_of(r["text"].encode()))) for r in some.toLocalIterator()]
        yield [(i, c) for i, c in got if c]


def _write(df: DataFrame, name: str) -> DataFrame:
    """As common.written, for rows of large binary arrays: row groups of few rows, packed by zstd."""
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1,
                        "parquet.block.size.row.check.min": 1}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forward_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts of the vocabulary in the text."""
    spark = docs.sparkSession
    small_batches(spark)
    source = narrow(docs, "doc_id", "text")
    out = T.StructType([source.schema["doc_id"], T.StructField("n", T.LongType()),
                        T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for lo, hi, block in blocks(b.column("text")):
                words, places, ends = word_ids(block, FOLD, IS_GAP)
                term = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))[places]
                n = np.diff(ends)
                doc = np.repeat(np.arange(hi - lo), n)[term >= 0]
                key, count = np.unique(doc * len(known) + term[term >= 0], return_counts=True)
                term, count = (key % max(1, len(known))).astype(np.int32), count.astype(np.int32)
                cuts = np.searchsorted(key, np.arange(hi - lo + 1) * len(known)).tolist()
                runs = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n),
                     pa.array([term[i:j].tobytes() for i, j in runs], pa.binary()),
                     pa.array([count[i:j].tobytes() for i, j in runs], pa.binary())], out.names)

    return _write(source.mapInArrow(run, out).filter("n > 0"), "vectors")


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """df of each term: counted per task, summed by Spark; at most ``size`` rows come back."""
    def count(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for r in vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def build_index(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """One row a portion: the documents' ids in order and the arrays of :func:`portion_index`."""
    out = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["doc_id"].dataType)),
                        *[T.StructField(a, T.BinaryType()) for a in ARRAYS]])
    arrow = to_arrow_schema(out)
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def row(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(waiting).combine_chunks()
        t = t.take(pc.sort_indices(t, [("doc_id", "ascending")], null_placement="at_end"))
        parts = [np.frombuffer(x, np.int32) for x in t.column("terms").to_pylist()]
        lens = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(lens)))
        tf = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.int32).astype(np.int64)
        m = np.repeat(length_factor(t.column("n").to_numpy(), n_docs, n_terms), lens)
        index = portion_index(starts, np.concatenate(parts).astype(np.int64), (1_000_000_000 * tf) // (1000 * tf + 8 * m),
                              shared.value)
        ids = t.column("doc_id").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
        made = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(arrow.field("ids").type)]
        made += [pa.array([x], pa.binary()) for x in packed(index)]
        return pa.RecordBatch.from_arrays(made, out.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, postings, docs = [], 0, 0
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("terms")).to_numpy(zero_copy_only=False) // 4)
            at = 0
            while at < len(b):
                base = ends[at - 1] if at else 0
                upto = int(np.searchsorted(ends, base + PORTION_POSTINGS - postings, "right"))
                upto = min(max(upto, at if waiting else at + 1), at + PORTION_DOCS - docs)
                if upto > at:
                    waiting.append(b.slice(at, upto - at))
                    postings += int(ends[upto - 1] - base)
                    docs += upto - at
                at = upto
                if at < len(b) or postings >= PORTION_POSTINGS or docs >= PORTION_DOCS:
                    yield row(waiting)
                    waiting, postings, docs = [], 0, 0
        if waiting:
            yield row(waiting)

    holding = vectors.filter(F.octet_length("terms") > 0)  # documents without a term of the items score 0
    return _write(holding.mapInArrow(run, out), "index")


def search(index: DataFrame, items: list[tuple[object, np.ndarray, np.ndarray]], vocabulary: int, k: int,
           item_type: T.DataType) -> DataFrame:
    """Each task's best ``k`` rows of each item: item (its number), item_id, doc_id, score."""
    out = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type),
                        T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(out)
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, query = shared.value, np.zeros(vocabulary, np.int64)
        best = [Best(k) for _ in asked]
        for b in batches:
            for i in range(len(b)):
                portion = unpacked([b.column(a)[i].as_buffer() for a in ARRAYS])
                ids = b.column("ids")[i].values
                for one, (_, terms, weights) in zip(best, asked):
                    search_portion(portion, ids, terms, weights, one, query)
        rows = [(i, asked[i][0], None if null else d, -s) for i, one in enumerate(best) for s, null, d in one.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], out.names)

    return index.mapInArrow(run, out)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    item_type = narrow(items, "item_id").schema[0].dataType
    result = spark.createDataFrame([], T.StructType([
        T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), narrow(docs, "doc_id").schema[0],
        T.StructField("score", T.LongType())]))
    for block in item_blocks(items):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, c in block for w in c}))}
        if not vocabulary:
            continue
        vectors = forward_vectors(docs, vocabulary)
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = document_counts(vectors, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        index = build_index(vectors, weights, n_docs, n_terms)
        asked = []
        for item_id, counts in block:
            terms = np.array(sorted(vocabulary[w] for w in counts), np.int64)
            times = {vocabulary[w]: c for w, c in counts.items()}
            asked.append((item_id, terms, weights[terms] * np.array([times[t] for t in terms.tolist()], np.int64)))
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        result = result.unionAll(search(index, asked, len(vocabulary), k, item_type)
                                 .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
                                 .select("item_id", "rank", "doc_id", "score"))
    return result


def op12_ranked_search(spark, sf_dir) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), spread AS (
  SELECT term, count(*) AS df FROM postings GROUP BY term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM spread, totals
), item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT item_id, term, count(*) AS times FROM item_terms GROUP BY item_id, term
), scores AS (
  SELECT a.item_id, p.doc_id,
         sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * l.n * t.docs) // t.terms))))::BIGINT AS score
  FROM asked a JOIN postings p ON p.term = a.term JOIN weights w ON w.term = a.term
  JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN totals t
  GROUP BY a.item_id, p.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
