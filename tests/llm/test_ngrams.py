"""The n-gram model against plain dictionaries, and its defined cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from test_queries import odd, small  # noqa: F401

from quietab.llm import catalog, ngrams


class Plain:
    """Modified Kneser-Ney with dictionaries of word tuples."""

    def __init__(self, texts, order):
        self.order = order
        self.tokens = [self.split(t) for t in texts]
        self.raw = Counter(w for t in self.tokens for w in t)
        self.count = {order: Counter(g for t in self.tokens for g in self.grams(t, order))}
        for k in range(order - 1, 0, -1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.d, self.context = {}, {}
        for k, c in self.count.items():
            n = Counter(c.values())
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                self.d[k] = [0] + [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.01), j) for j in (1, 2, 3)]
            else:
                self.d[k] = [0, 0.5, 1.0, 1.5]
            self.context[k] = defaultdict(list)
            for g, x in c.items():
                self.context[k][g[:-1]].append(x)

    @staticmethod
    def split(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        return [w for w in low.split(" ") if w] + ["</s>"]

    @staticmethod
    def grams(t, order):
        padded = ["<s>"] * (order - 1) + t
        return [tuple(padded[i:i + order]) for i in range(len(t))]

    def p(self, gram):
        k = len(gram)
        below = self.p(gram[1:]) if k > 1 else 1 / (len(self.raw) + 1)
        seen = self.context[k].get(gram[:-1])
        if not seen:
            return below
        d, total, c = self.d[k], sum(seen), self.count[k][gram]
        return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in seen) / total * below

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(self.split(text), self.order))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_equals_plain_dictionaries(spark, order, monkeypatch):
    monkeypatch.setattr(ngrams, "SHARD_BYTES", 4000)
    monkeypatch.setattr(ngrams, "RUN_BYTES", 900)
    monkeypatch.setattr(ngrams, "HOT", {2: 0.01, 3: 1e-4, 4: 0.005}[order])
    rnd = random.Random(order)
    words = [f"w{int(rnd.expovariate(0.08))}" for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    texts += ["", None, " \t\r\n ", "A a A", "x" * 5000, "new été neu"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    learn = docs.filter("doc_id % 7 <> 0")
    model = ngrams.train(learn, order)
    assert model.shards > 4 and len(model.hot)
    plain = Plain([t for i, t in enumerate(texts) if i % 7], order)
    assert model.train_tokens == sum(plain.raw.values()) and model.train_words == len(plain.raw)
    got = {r["doc_id"]: r for r in ngrams.score(docs, model, ["doc_id"]).collect()}
    n, v = model.train_tokens, len(plain.raw)
    for i, t in enumerate(texts):
        own = Plain.split(t)
        assert got[i]["n_tokens"] == len(own) and got[i]["n_known"] == sum(plain.raw[w] > 0 for w in own)
        assert got[i]["score"] == pytest.approx(plain.score(t), rel=1e-9)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((plain.raw[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert got[i]["perplexity"] == pytest.approx(10 ** (-plain.score(t) / len(own)))
    context = ("<s>",) * (order - 1)
    assert sum(plain.p((*context, w)) for w in [*plain.raw, "never seen"]) == pytest.approx(1)


def test_odd_rows_and_no_training_text(spark, odd):  # noqa: F811
    model = ngrams.train(odd)
    res = ngrams.score(odd, model)
    assert res.columns.count("score") == 1 and res.columns.count("n_tokens") == 1 and "Text" in res.columns
    rows = ngrams.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[8]["n_tokens"] == 1 and by[1]["score"] == by[2]["score"]
    none = ngrams.train(odd.limit(0))
    assert {(r["score"], r["base_score"], r["n_known"]) for r in ngrams.score(odd, none, ["doc_id"]).collect()} == {(0.0, 0.0, 0)}
    assert ngrams.score(odd.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        ngrams.train(odd, 1)


def test_partitions_and_runs_do_not_matter(spark, small, monkeypatch):  # noqa: F811
    docs = small["documents"]
    one = {r["doc_id"]: tuple(r) for r in ngrams.score(docs, ngrams.train(docs.coalesce(1)), ["doc_id"]).collect()}
    monkeypatch.setattr(ngrams, "RUN_BYTES", 20_000)
    monkeypatch.setattr(ngrams, "SHARD_BYTES", 80_000)
    monkeypatch.setattr(ngrams, "SCORE_BYTES", 10_000)
    many = {r["doc_id"]: tuple(r) for r in ngrams.score(docs.repartition(7), ngrams.train(docs.repartition(5)), ["doc_id"]).collect()}
    assert one.keys() == many.keys()
    for k in one:
        assert np.allclose(one[k], many[k], rtol=1e-12)


def test_query_on_a_whole_table(spark, small):  # noqa: F811
    got = {r["doc_id"]: r for r in catalog.QUERIES["op13_lm_scoring"](spark, SF_SMALL).collect()}
    docs = {r["doc_id"]: r["text"] for r in small["documents"].collect()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 10 == 0}
    plain = Plain([t for d, t in docs.items() if d not in held], 2)
    assert got.keys() == docs.keys() and {d for d in got if got[d]["held_out"]} == held
    for d, t in docs.items():
        assert got[d]["train_tokens"] == sum(plain.raw.values())
        assert got[d]["score"] == pytest.approx(plain.score(t), rel=1e-9)
    better = [got[d]["score"] > got[d]["base_score"] for d in held]
    assert sum(better) > 0.5 * len(better)


def test_files_of_a_remote_folder(tmp_path):
    store = ngrams.Store(f"file://{tmp_path}")
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint64), np.array([7, 8])]
    store.put("x", arrays)
    store.put("x", arrays)
    mapped = store.get("x")
    store.local = False
    read = store.get("x")
    for a, b, c in zip(arrays, mapped, read, strict=True):
        assert a.tolist() == b.tolist() == c.tolist()
    assert isinstance(mapped[0], np.memmap) and len(list(tmp_path.iterdir())) == 1
