"""Toxicity by a classifier chain.

Categories are predicted one after the other.  Each has an L2-regularised
logistic model over the words a text holds and their beginnings (the first
``PREFIXES`` bytes, so that inflected forms share their stem); the probabilities of the earlier
categories are further inputs of the later models.  In training these inputs
are out-of-fold predictions (``folds`` folds by a hash of the id), so a later model
learns from probabilities as uncertain as those it will meet.  The last category
is ``toxic``, the label itself.  The earlier ones are kinds of toxicity found in the
sample: its toxic rows are clustered by their telling words (spherical k-means, ``kinds`` of them, the
larger ones first), so that each language or manner of abuse can be a kind.  A caller with categories of their own gives
seed words instead (``seeds``): a category holds for toxic rows with one of its words.

Learning uses a bounded sample: about ``max_rows`` labelled rows, chosen by a
seeded hash of the id.  Its words and beginnings are counted by Spark; at most
``max_words`` of them whose presence depends on the label (likelihood ratio
statistic of at least ``min_g2``, in ``min_docs`` rows) become inputs, so the fitted state is bounded, too.
Prediction is one shuffle-free scan over whole texts.

Words: A-Z lower-cased, everything outside letters, digits and non-ASCII separates.
Defined cases: a null or empty text, or one without a word, is not toxic with
score 0 in every category; without labelled rows of both kinds nothing is
toxic and all scores are 0; a null label is no label; of several labels of an
id the largest counts; of several texts of an id the one with the smallest hash is
learned from; repeated rows get equal results; a kind without rows has probabilities near 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietab.llm import linear
from quietab.llm.common import WORD_TABLE, blocks, map_text, narrow, small_batches, table, written

PREFIXES = (4, 5, 6, 7)
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class ToxicConfig:
    max_rows: int = 8192
    max_words: int = 4096
    min_docs: int = 3
    min_g2: float = 12.0
    folds: int = 5
    l2: float = 0.3
    threshold: float = 0.5
    kinds: int = 4
    seeds: dict = field(default_factory=dict)

    @property
    def earlier(self) -> list[str]:
        """The categories before ``toxic``."""
        return list(self.seeds) or [f"kind{k}" for k in range(1, self.kinds + 1)]


@dataclass
class ToxicModel:
    words: dict[bytes, int]
    names: list[str]
    weights: list[np.ndarray]  # of category k: words, the k earlier probabilities, intercept


def words_of(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(WORD_TABLE).split())


def forms(word: bytes) -> list[bytes]:
    """The word and its beginnings; a beginning ends in ``*``, which no word holds."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


class Inputs:
    """Input numbers of texts; remembers each distinct word's."""

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers, self.known = numbers, {}

    def of(self, words: set[bytes]) -> list[int]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        found: set = set()
        for w in words:
            at = known.get(w)
            if at is None:
                at = known[w] = [self.numbers[f] for f in forms(w) if f in self.numbers]
            if at:
                found.update(at)
        return sorted(found)


def fields(cfg: ToxicConfig) -> list[T.StructField]:
    return ([T.StructField("toxic", T.BooleanType()), T.StructField("score", T.DoubleType())]
            + [T.StructField(f"p_{c}", T.DoubleType()) for c in cfg.earlier])


def sample(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig) -> DataFrame:
    """(text, toxic, fold) of the learning sample: ids are unique and hashed
    uniformly, so it has about ``max_rows`` rows however large the labels are."""
    known = (narrow(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, cfg.max_rows / max(1, known.count()))
    h = F.xxhash64("doc_id", F.lit(1))
    chosen = (known.filter(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20))
              .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(cfg.folds)).cast("int")))
    return (narrow(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
            # of several texts of an id always the same one
            .groupBy("doc_id", "fold").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            .select("text", (F.col("toxic") > 0).alias("toxic"), "fold"))


def telling_words(rows: DataFrame, cfg: ToxicConfig) -> tuple[dict[bytes, int], int]:
    """Input words and the number of toxic rows of the sample."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("k")).first()
    n, k = total["n"], total["k"] or 0
    if not 0 < k < n:
        return {}, 0

    def split(batches):
        every, of_toxic = Counter(), Counter()
        shapes = lru_cache(CACHE_WORDS)(forms)

        def counted():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(every), pa.binary()), pa.array(list(every.values())),
                 pa.array([of_toxic[w] for w in every])], ["word", "df", "dk"])
            every.clear()
            of_toxic.clear()
            return out

        for b in batches:
            toxic = b.column("toxic").to_pylist()
            for lo, _, block in blocks(b.column("text")):
                for i, t in enumerate(block, lo):
                    found = set(chain.from_iterable(map(shapes, words_of(t))))
                    every.update(found)
                    if toxic[i]:
                        of_toxic.update(found)
                if len(every) > CACHE_WORDS:
                    yield counted()
        if every:
            yield counted()

    df, dk = F.col("df"), F.col("dk")
    cells = ((dk, df * (k / n)), (df - dk, df * (1 - k / n)), (k - dk, (n - df) * (k / n)),
             (n - k - df + dk, (n - df) * (1 - k / n)))
    g2 = sum((F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    top = (rows.mapInArrow(split, "word binary, df long, dk long").groupBy("word")
           .agg(F.sum("df").alias("df"), F.sum("dk").alias("dk"))
           .filter((df >= cfg.min_docs) & (df < n)).withColumn("g2", g2).filter(F.col("g2") >= cfg.min_g2)
           .orderBy(F.desc("g2"), "word").limit(cfg.max_words).select("word").collect())
    seeds = {w.encode() for ws in cfg.seeds.values() for w in ws}
    return {w: i for i, w in enumerate(sorted({bytes(r["word"]) for r in top} | seeds))}, k


def kinds_of(row: np.ndarray, col: np.ndarray, n: int, d: int, toxic: np.ndarray, k: int) -> list[np.ndarray]:
    """Masks of ``k`` kinds of the toxic rows, the larger first (rows without an input are none)."""
    at = np.flatnonzero(toxic)
    x = np.zeros((len(at), d), np.float32)
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    own = place[row] >= 0
    x[place[row[own]], col[own]] = 1.0
    x *= np.log((len(at) + 1) / (x.sum(0) + 1)).astype(np.float32)  # words that most toxic rows hold tell no kind
    norm = np.sqrt((x * x).sum(1))
    some = norm > 0
    x[some] /= norm[some][:, None]
    kind = np.full(len(at), -1)
    if some.any():
        centres = x[some][:1]
        while len(centres) < min(k, int(some.sum())):  # the row farthest from all centres is the next
            centres = np.vstack((centres, x[some][(x[some] @ centres.T).max(1).argmin()]))
        for _ in range(30):
            near = (x[some] @ centres.T).argmax(1)
            sums = np.stack([x[some][near == c].sum(0) for c in range(len(centres))])
            moved = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
            if np.allclose(moved, centres):
                break
            centres = moved
        kind[some] = near
    sizes = np.bincount(kind[kind >= 0], minlength=k)
    masks = []
    for c in np.argsort(-sizes, kind="stable")[:k]:
        mask = np.zeros(n, bool)
        mask[at[kind == c]] = True
        masks.append(mask)
    return masks


def fit_chain(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig = ToxicConfig()) -> ToxicModel | None:
    small_batches(docs.sparkSession)
    rows = written(sample(docs, labels, cfg), "toxic-sample")
    words, k = telling_words(rows, cfg)
    if not k:
        return None

    def inputs(batches):
        numbers = Inputs(words)
        for b in batches:
            for lo, hi, block in blocks(b.column("text")):
                at = [numbers.of(words_of(t)) for t in block]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32()))] + [
                    b.column(c).slice(lo, hi - lo) for c in ("toxic", "fold")], ["at", "toxic", "fold"])

    got = rows.mapInArrow(inputs, "at array<int>, toxic boolean, fold int").toArrow()
    order = sorted(zip(got["fold"].to_pylist(), got["toxic"].to_pylist(), got["at"].to_pylist()))
    fold = np.array([f for f, _, _ in order])
    toxic = np.array([t for _, t, _ in order])
    size = np.array([len(a) for _, _, a in order])
    row = np.repeat(np.arange(len(order)), size)
    col = np.array([i for _, _, a in order for i in a], np.int64)
    val = np.ones(len(col))
    names = [*cfg.earlier, "toxic"]
    if cfg.seeds:
        targets = [toxic & (np.bincount(row, np.isin(col, [words[w.encode()] for w in ws]), len(order)) > 0) for ws in cfg.seeds.values()]
    else:
        targets = kinds_of(row, col, len(order), len(words), toxic, cfg.kinds)
    weights = []
    for j, y in enumerate([*targets, toxic]):
        x = linear.Rows(row, col, val, len(order), len(words) + j)
        out_of_fold = np.zeros(len(order))
        for f in range(cfg.folds):
            left, there = fold != f, fold == f
            if there.any() and left.any():
                w = linear.fit(x.pick(left), y[left], cfg.l2)
                out_of_fold[there] = linear.sigmoid(x.pick(there).times(w))
        weights.append(linear.fit(x, y, cfg.l2))
        row = np.concatenate((row, np.arange(len(order))))
        col = np.concatenate((col, np.full(len(order), len(words) + j)))
        val = np.concatenate((val, out_of_fold))
    return ToxicModel(words, names, weights)


def predict(model: ToxicModel | None, inputs: Inputs, block: list, cfg: ToxicConfig) -> dict:
    n = len(block)
    p = {c: np.zeros(n) for c in [*cfg.earlier, "toxic"]}
    if model is not None:
        d = len(model.words)
        found = [words_of(t) for t in block]
        some = np.array([bool(w) for w in found])
        at = [inputs.of(f) for f in found]
        size = np.array([len(a) for a in at], np.int64)
        row, col = np.repeat(np.arange(n), size), np.array([i for a in at for i in a], np.int64)
        for j, name in enumerate(model.names):
            w = model.weights[j]
            z = np.bincount(row, w[col], n) + w[-1] + sum(w[d + i] * p[c] for i, c in enumerate(model.names[:j]))
            p[name] = np.where(some, linear.sigmoid(z), 0.0)
    return ({"toxic": p["toxic"] >= cfg.threshold, "score": p["toxic"].round(6)}
            | {f"p_{c}": p[c].round(6) for c in cfg.earlier})


def toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig = ToxicConfig(),
             keep: list[str] | None = None) -> DataFrame:
    """toxic, score and the earlier categories' probabilities of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels, cfg))

    def make():
        inputs = Inputs(shared.value.words if shared.value else {})
        return lambda block: predict(shared.value, inputs, block, cfg)

    return map_text(docs, fields(cfg), make, keep=keep)


def op1_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
