"""Quality rules: hashed n-gram log-likelihood ratio with base counting rules.

Method.  Every text is a bag of its overlapping byte n-grams (``n`` bytes, hashed
to ``buckets`` cells).  Two multinomials are counted over the whole corpus: the
trusted target (rows whose label is ``trusted``) and all raw rows.  With add-``alpha``
smoothing each cell has a log ratio ``log p_target - log p_raw``; a text's score
is the mean ratio of its n-grams, so it does not depend on the length.  Every
document is thresholded alike: ``score >= min_score`` keeps it.

Spark plan: one scan that counts per task (numpy ``bincount``) and ships
(cell, raw, target) rows to a map-side combined sum -- the result has ``buckets``
rows whatever the corpus size -- and a second, shuffle-free scan that scores.

Defined cases: a null text counts as empty; an empty text or one with fewer
than ``n`` bytes has score 0 (no evidence); with no trusted row (or an empty
corpus) every ratio is 0, so only the base rules decide; a null or missing label
is not trusted; a row whose id occurs several times among the trusted labels
counts once.  Repeated rows are counted and judged each on their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietab.llm.common import joined, map_text, maybe_broadcast, narrow, segment_sums, small_batches, blocks

SPACES = bytes([32, 9, 10, 11, 12, 13])
SYMBOLS = b"#*$%&|<>"
NOT_CODE_POINTS = SPACES + bytes(range(0x80, 0xC0))

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
          T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
          T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
          T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())]


@dataclass(frozen=True)
class QualityConfig:
    n: int = 4
    buckets: int = 1 << 16
    alpha: float = 1.0
    min_score: float = -0.35


def gram_cells(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Cell of the n-gram that starts at each position (n <= 4 bytes, little-endian)."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        code |= data[k:len(data) - n + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def gram_weights(lens: np.ndarray, starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """True where an n-gram lies inside one text."""
    inside = np.zeros(size + 1, np.int64)
    ok = lens >= n
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, starts[ok] + lens[ok] - n + 1, -1)
    return np.cumsum(inside[:-1]) > 0


def fit_ratios(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> np.ndarray:
    """Log ratio of every cell: counts over all documents, target over all trusted ones."""
    spark = docs.sparkSession
    small_batches(spark)
    trusted = (narrow(labels, "doc_id", "quality").filter("quality = 1 and doc_id is not null")
               .select("doc_id").distinct().withColumn("good", F.lit(True)))
    rows = (narrow(docs, "doc_id", "text").join(maybe_broadcast(trusted), "doc_id", "left")
            .select("text", F.coalesce("good", F.lit(False)).alias("good")))
    n, size = cfg.n, cfg.buckets

    def count(batches):
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            good = b.column("good").to_numpy(zero_copy_only=False)
            for lo, hi, block in blocks(b.column("text")):
                data, starts, lens = joined(block)
                cells = gram_cells(data, n, size)
                inside = gram_weights(lens, starts, len(cells), n)
                raw += np.bincount(cells[inside], minlength=size)
                of_good = gram_weights(np.where(good[lo:hi], lens, 0), starts, len(cells), n)
                target += np.bincount(cells[of_good], minlength=size)
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                             ["cell", "raw", "target"])

    counts = (rows.mapInArrow(count, "cell long, raw long, target long")
              .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.zeros(size), np.zeros(size)
    for r in counts:  # at most `buckets` rows
        raw[r["cell"]], target[r["cell"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(size)
    return (np.log((target + cfg.alpha) / (target.sum() + cfg.alpha * size))
            - np.log((raw + cfg.alpha) / (raw.sum() + cfg.alpha * size)))


def repeat_words(words: list) -> int:
    """Words covered by 3-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    k = len(ids)
    if k < 2_000_000:
        key = (w[:-2] * k + w[1:-1]) * k + w[2:]
    else:
        pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
        key = pair[:-1] * k + w[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j:j + len(again)] |= again
    return int(covered.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), len(text.translate(None, NOT_CODE_POINTS)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words))


def _judge(ratios, cfg: QualityConfig):
    def make():
        weights = ratios.value

        def f(block: list) -> dict:
            base = np.array([base_counts(t) for t in block], np.int64).reshape(-1, 5)
            data, starts, lens = joined(block)
            cells = gram_cells(data, cfg.n, cfg.buckets)
            got = np.zeros(len(data))
            got[:len(cells)] = weights[cells]
            m = np.maximum(lens - cfg.n + 1, 0)
            score = segment_sums(got, starts, m) / np.maximum(m, 1)
            score = np.round(score, 9)  # well above the rounding noise of the running sum
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            return {"n_words": base[:, 0], "word_chars": base[:, 1], "n_symbols": base[:, 2],
                    "n_dup_lines": base[:, 3], "n_repeat_words": base[:, 4], "base_failed": failed,
                    "kept": ~failed & (score >= cfg.min_score), "score": score}
        return f
    return make


def quality(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig(),
            keep: list[str] | None = None, filter_rows: bool = False) -> DataFrame:
    """Counts, score and verdict of every document; with ``filter_rows`` the kept
    documents in their own columns."""
    ratios = docs.sparkSession.sparkContext.broadcast(fit_ratios(docs, labels, cfg))  # `buckets` doubles
    return map_text(docs, FIELDS, _judge(ratios, cfg), keep=keep, only="kept" if filter_rows else None)


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    from quietab.llm.common import table
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
