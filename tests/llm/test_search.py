"""The blocked search against a plain scan, and its defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL
from test_queries import odd, small  # noqa: F401

from quietab.llm import catalog, search
from quietab.llm.common import narrow

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text).  One list of (doc_id, score) per item."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for _, text in items:
        asked = Counter(terms(text))
        scores = []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(q * weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out.append([(d, -s) for s, _, _, d in sorted(scores, key=lambda x: x[:3])[:k]])
    return out


def result(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {i: [(d, s) for _, d, s in sorted(rows, key=lambda x: x[0])] for i, rows in got.items()}


@pytest.fixture
def tiny_blocks(monkeypatch):
    for name, value in (("BLOCK", 8), ("LEAST", 4), ("PORTION_POSTINGS", 3000), ("PORTION_DOCS", 150)):
        monkeypatch.setattr(search, name, value)


def test_odd_rows(spark, odd, small, tiny_blocks):  # noqa: F811
    items = spark.createDataFrame([(1, "the same TEXT here"), (2, None), (3, ""), (4, "!!"), (5, "no such-words zzz"),
                                   (6, "été 日本 the the the idiot"), (7, "One id 123")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in narrow(odd, "doc_id", "text").collect()]
    rows = [tuple(r) for r in items.collect()]
    want = {i: w for (i, _), w in zip(rows, brute(docs, rows)) if w}
    assert want and result(search.rank(odd, items)) == want
    assert search.rank(odd.limit(0), items).count() == 0 and search.rank(odd, items.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "item_id long, text string")
    got = sorted((tuple(r) for r in search.rank(odd, twice, 2).collect()), key=str)
    assert len(got) == 6 and got[0] == got[1] and {r[0] for r in got} == {1, None}


def test_query_on_whole_tables(spark, small):  # noqa: F811
    docs = [(r["doc_id"], r["text"]) for r in small["documents"].collect()]
    items = [(r["item_id"], r["text"]) for r in small["benchmark"].collect()]
    want = {i: w for (i, _), w in zip(items, brute(docs, items)) if w}
    assert result(catalog.QUERIES["op12_ranked_search"](spark, SF_SMALL)) == want


@pytest.mark.parametrize("seed", range(3))
def test_skewed_corpus_with_copies_and_ties(spark, tiny_blocks, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(words[min(299, int(rnd.expovariate(0.03)))] for _ in range(n))
    copy, hot = text(40), text(12)
    docs = [(i, text(rnd.choice([3, 10, 60, 400]))) for i in range(500)] + [(600 + i, copy) for i in range(200)]
    docs += [(1000 + i, hot + " " + words[i % 7]) for i in range(150)] + [(None, copy), (7, copy), (7, copy)]
    rnd.shuffle(docs)
    items = [(i, text(rnd.choice([1, 4, 20]))) for i in range(30)] + [(100, copy), (101, hot), (102, words[0]), (103, words[299])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = {i: w for (i, _), w in zip(items, brute(docs, items)) if w}
    assert result(search.rank(frame, asked)) == want


def test_blocks_hold_every_posting_and_bounds_hold():
    rnd = np.random.default_rng(3)
    lens = rnd.integers(1, 30, 900)
    starts = np.concatenate(([0], np.cumsum(lens)))
    terms_ = np.concatenate([np.sort(rnd.choice(60, n, replace=False)) for n in lens])
    impacts = rnd.integers(1, 1_000_000, len(terms_))
    weights = rnd.integers(1, 9000, 60)
    index = search.portion_index(starts, terms_, impacts, weights)
    doc = np.repeat(np.arange(900), lens)
    vectors = np.zeros((900, 60), np.int64)
    vectors[doc, terms_] = impacts
    for t in range(60):
        blocks = range(index["list_blocks"][t], index["list_blocks"][t + 1])
        members = [index["block_docs"][index["block_starts"][b]:index["block_starts"][b + 1]] for b in blocks]
        assert sorted(np.concatenate(members).tolist()) == sorted(doc[terms_ == t].tolist())
        for b, m in zip(blocks, members):
            assert len(m) <= 2 * search.BLOCK
            most = np.zeros(60, np.int64)
            for u in range(60):
                own = slice(index["sum_starts"][u], index["sum_starts"][u + 1])
                at = np.flatnonzero(index["sum_blocks"][own] == b)
                most[u] = int(index["sum_most"][own][at[0]]) * search.UNIT if len(at) else 0
            if index["owned"][b]:
                top = vectors[m].max(0)
                assert (most >= top).all() and (most < top + search.UNIT).all()
            assert (index["most"] * search.UNIT >= vectors[m].max(0)).all()


def test_blocks_are_skipped(monkeypatch):
    """Documents of separate topics: a search scores few of a long list's documents, and all that matter."""
    rnd = np.random.default_rng(1)
    topic = rnd.integers(0, 40, 4000)
    rows = [np.unique(np.concatenate(([0], 1 + 20 * t + rnd.integers(0, 20, 12)))) for t in topic]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    terms_ = np.concatenate(rows)
    impacts = rnd.integers(400_000, 600_000, len(terms_))
    index = search.portion_index(starts, terms_, impacts, np.full(801, 3000))
    best, query = search.Best(10), np.zeros(801, np.int64)
    asked = np.array([0, 61, 62, 63, 64, 65, 66])
    weights = np.array([2000, *[3000] * 6])
    import pyarrow as pa
    scored = search.search_portion(index, pa.array(range(4000)), asked, weights, best, query)
    dense = np.zeros((4000, 801), np.int64)
    dense[np.repeat(np.arange(4000), np.diff(starts)), terms_] = impacts
    scores = dense[:, asked] @ weights
    order = np.lexsort((np.arange(4000), -scores))[:10]
    assert [(-s, d) for s, _, d in best.rows] == [(scores[d], d) for d in order]
    assert scored < 1500 and not query.any()


def test_items_in_blocks(spark, small, monkeypatch):  # noqa: F811
    want = result(search.rank(small["documents"], small["benchmark"]))
    monkeypatch.setattr(search, "ITEM_BYTES", 4000)
    assert len(list(search.item_blocks(small["benchmark"]))) > 2
    assert result(search.rank(small["documents"], small["benchmark"])) == want


def test_recall_at_mid_size_is_whole(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()][:10]
    got = result(catalog.QUERIES["op12_ranked_search"](spark, SF_MID))
    assert all(got[i] == w for (i, _), w in zip(items, brute(docs, items)))
