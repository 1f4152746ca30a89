"""Hierarchical language identification.

Features: byte 2- and 3-grams of the lower-cased text with everything but
letters blanked, hashed to ``cells`` cells, square-rooted and scaled to length
one.  A logistic model per language family predicts the family; inside it, one
linear support vector machine (squared hinge) per pair of languages votes.

Learning uses the text and non-null lang of rows with ``crc32(doc_id) % 5 != 0``
only, at most about ``per_lang`` different texts of each of the ``max_langs`` most frequent languages
(documented sample bounds; rows are chosen by a seeded hash, so the choice does not depend on the
partitioning).  Prediction is one shuffle-free scan over whole texts; lang,
source and doc_id are not read by it except to return doc_id and its fold.

Defined cases: a null text or one without a letter gives ``und`` with score 0,
as does a corpus without any learnable row; a null doc_id is not held out and is
not learned from; equal votes go to the larger sum of margins, then to the
alphabetically first language; repeated rows get equal results.  A language outside the family table is a
family of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietab.llm import linear
from quietab.llm.common import blocks, map_text, narrow, small_batches, table

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "am", "mt"),
}

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
BLANKED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class LangConfig:
    cells: int = 4096
    per_lang: int = 500
    max_langs: int = 256
    l2: float = 0.01
    #: belief (family times pair) below which ``keep_languages`` drops a row
    min_score: float = 0.35
    families: dict = field(default_factory=lambda: dict(FAMILIES))


@dataclass
class LangModel:
    families: list          # [(family name, [languages])]
    family_w: np.ndarray    # (cells + 1, families)
    pairs: list             # [(language a, language b)], positive margin: a
    pair_w: np.ndarray      # (cells + 1, pairs)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vectors(block: list, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(one row of hashed features per text, whether the text has a letter)."""
    x = np.zeros((len(block), cells), np.float32)
    letters = np.zeros(len(block), bool)
    for lo in range(0, len(block), 512):
        part, lens = [], []
        for t in block[lo:lo + 512]:
            s = t.decode("utf-8", "replace").lower() if t else ""
            letters[lo + len(lens)] = has_letter(s)
            b = s.encode().translate(BLANKED)
            lens.append(len(b) + 2)
            part.append(b)
        data = np.frombuffer((b" " + b"  ".join(part) + b" ") if part else b"", np.uint8).astype(np.uint64)
        lens = np.array(lens, np.int64)
        doc = np.repeat(np.arange(len(lens)) * cells, lens)
        two = data[:-1] | data[1:] << np.uint64(8)
        three = two[:-1] | data[2:] << np.uint64(16)
        shift, odd = np.uint64(44), np.uint64(0x9E3779B97F4A7C15)
        sums = np.zeros(len(lens) * cells)
        for gram, salt in ((two, 0), (three, 1 << 24)):
            cell = ((gram + np.uint64(salt)) * odd >> shift).astype(np.int64) % cells
            same = doc[:len(cell)] == doc[len(doc) - len(cell):]
            sums += np.bincount((doc[:len(cell)] + cell)[same], minlength=len(sums))
        v = np.sqrt(sums).reshape(len(lens), cells)
        x[lo:lo + len(lens)] = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    return x, letters


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % 5


def learnable(docs: DataFrame, cfg: LangConfig) -> DataFrame:
    """(lang, text) of the bounded learning sample."""
    rows = (narrow(docs, "doc_id", "text", "lang")
            .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)))
    often = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.max_langs)
    counts = {r["lang"]: r["n"] for r in often.collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, cfg.per_lang / n))).otherwise(share)
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    return rows.filter(u < share).select("lang", "text").distinct()  # copies would outgrow the bound and teach nothing


def fit_languages(docs: DataFrame, cfg: LangConfig = LangConfig()) -> LangModel | None:
    small_batches(docs.sparkSession)
    cells = cfg.cells

    def features(batches):
        for b in batches:
            for lo, hi, block in blocks(b.column("text")):
                x, letters = vectors(block, cells)
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").slice(lo, hi - lo), pa.array(letters),
                     pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, at)], pa.list_(pa.float32()))],
                    ["lang", "letters", "at", "val"])

    got = (learnable(docs, cfg).mapInArrow(features, "lang string, letters boolean, at array<int>, val array<float>")
           .filter("letters").select("lang", "at", "val").toArrow())
    lang = np.array(got["lang"].to_pylist(), object)
    order = np.argsort(lang.astype(str), kind="stable")
    at = [np.array(a, np.int64) for a in got["at"].to_pylist()]
    val = [np.array(a, float) for a in got["val"].to_pylist()]
    if not len(lang):
        return None
    n = np.array([len(at[i]) for i in order])
    x = linear.Rows(np.repeat(np.arange(len(order)), n), np.concatenate([at[i] for i in order]),
                    np.concatenate([val[i] for i in order]), len(order), cells)
    lang = lang[order]
    family_of = {code: name for name, codes in cfg.families.items() for code in codes}
    groups: dict = {}
    for code in sorted(set(lang)):
        groups.setdefault(family_of.get(code, code), []).append(code)
    families = sorted(groups.items())
    name = np.array([family_of.get(code, code) for code in lang])
    family_w = np.stack([linear.fit(x, name == f, cfg.l2) if len(families) > 1 else np.zeros(x.d)
                         for f, _ in families], 1)
    pairs, pair_w = [], []
    for _, codes in families:
        for i, a in enumerate(codes):
            for b in codes[i + 1:]:
                own = (lang == a) | (lang == b)
                pairs.append((a, b))
                pair_w.append(linear.fit(x.pick(own), lang[own] == a, cfg.l2, "hinge2"))
    return LangModel(families, family_w, pairs, np.stack(pair_w, 1) if pairs else np.zeros((x.d, 0)))


def predict(model: LangModel | None, block: list, cells: int) -> dict:
    langs, scores = np.full(len(block), "und", object), np.zeros(len(block))
    if model is None:
        return {"lang_pred": langs, "score": scores}
    x, letters = vectors(block, cells)
    z = x @ model.family_w[:-1] + model.family_w[-1]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    margin = x @ model.pair_w[:-1] + model.pair_w[-1]
    best = p.argmax(1)
    for k, (_, codes) in enumerate(model.families):
        rows = np.flatnonzero((best == k) & letters)
        votes = np.zeros((len(rows), len(codes)))
        total, belief = np.zeros_like(votes), np.ones_like(votes)
        for j, (a, b) in enumerate(model.pairs):
            if a in codes:
                m = margin[rows, j]
                for code, own in ((a, m), (b, -m)):
                    c = codes.index(code)
                    votes[:, c] += (own > 0) | ((own == 0) & (code == a))
                    total[:, c] += own
                    belief[:, c] = np.minimum(belief[:, c], linear.sigmoid(2 * own))
        top = (votes + 1e-6 * np.tanh(total)).argmax(1) if len(rows) else np.zeros(0, int)
        langs[rows] = [codes[c] for c in top]
        scores[rows] = p[rows, k] * belief[np.arange(len(rows)), top]
    return {"lang_pred": langs, "score": np.clip(scores, 0, 1).round(6)}


def identify(docs: DataFrame, cfg: LangConfig = LangConfig(), keep: list[str] | None = None,
             model: LangModel | None = None) -> DataFrame:
    """lang_pred and score of every document."""
    model = model or fit_languages(docs, cfg)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells x (families + pairs) floats

    def make():
        return lambda block: predict(shared.value, block, cfg.cells)

    return map_text(docs, FIELDS, make, keep=keep)


def keep_languages(docs: DataFrame, cfg: LangConfig = LangConfig()) -> DataFrame:
    """The documents whose language is identified (not ``und``) with at least
    ``min_score``, in their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_languages(docs, cfg))

    def make():
        def f(block):
            got = predict(shared.value, block, cfg.cells)
            return {"ok": (got["lang_pred"] != "und") & (got["score"] >= cfg.min_score)}
        return f

    return map_text(docs, [T.StructField("ok", T.BooleanType())], make, only="ok")


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (identify(docs, keep=["doc_id"])
            .select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                    "lang_pred", "score"))
