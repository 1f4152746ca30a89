"""The operators as Spark jobs: odd rows, clashing columns, empty tables, whole small tables by brute force."""

import random
import time
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from quietab.llm import (catalog, components, decontam, langid, licences, packing, quality, simhash, token_counts,
                         token_files, toxicity, urls)
from quietab.llm.common import narrow

EXTRA = ["Text", "score", "kept", "fp", "t", "c0", "key", "item_id", "lang_pred", "toxic", "n_tokens"]


@pytest.fixture(scope="module")
def small(spark):
    return {n: spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("documents", "labels", "benchmark", "pages")}


@pytest.fixture(scope="module")
def odd(spark, small):
    """Documents with nulls everywhere, empty, one-word and very long texts, repeated rows and clashing columns."""
    item = small["benchmark"].first()["text"]
    rnd = random.Random(1)
    long = " ".join(rnd.choice(["the", "of", "and", "you idiot", "loser", "maison", "\xe9t\xe9"]) + str(rnd.randint(0, 99))
                    for _ in range(60_000))
    rows = [(1, None, None), (2, "", "en"), (None, "no id at all", "en"), (None, None, None), (3, "One", "en"),
            (4, "!!! 123 ...", "de"), (5, long, "en"), (6, "same text here", "fr"), (6, "same text here", "fr"),
            (7, "same text here", None), (8, "  \n\t ", "es"), (9, "see " + item + " there", "en"),
            (10, "MIT license and CC by", "xx"), (11, "\U0001f642 \u65e5\u672c", "ja")]
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("lang", T.StringType())])
    df = spark.createDataFrame(rows, kind).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(0))
    return df.select("*", *[F.lit(f"extra {i}").alias(c) for i, c in enumerate(EXTRA)]).repartition(3)


def test_toxicity_odd_and_learned(spark, small, odd):
    got = toxicity.toxicity(odd, small["labels"], keep=["doc_id"])
    assert got.columns == ["doc_id", "toxic", "score", "p_kind1", "p_kind2", "p_kind3", "p_kind4"] and got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert not by[1]["toxic"] and by[2]["score"] == 0 == by[4]["p_kind1"] * 0
    none = toxicity.toxicity(odd, small["labels"].limit(0), keep=["doc_id"])
    assert {(r["toxic"], r["score"]) for r in none.collect()} == {(False, 0.0)}
    everything = toxicity.toxicity(odd, small["labels"])  # results replace columns of their names
    assert everything.columns.count("score") == 1 and "Text" in everything.columns
    mid = {n: spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels")}
    rows = toxicity.toxicity(mid["documents"], mid["labels"], keep=["doc_id"]).join(
        mid["labels"].select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    caught = sum(r["toxic"] and r["label"] == 1 for r in rows)
    assert caught >= 0.7 * sum(r["label"] == 1 for r in rows)
    assert sum(r["toxic"] and r["label"] == 0 for r in rows) <= 0.01 * len(rows)


def test_licences_odd(odd):
    got = {r["doc_id"]: r for r in licences.licences(odd, keep=["doc_id"]).collect()}
    assert got[10]["base_labels"] == "cc-by,mit" and got[10]["n_base"] == 2 and got[10]["score"] == 1.0
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[2]["labels"] == ""
    assert licences.licences(odd.limit(0)).count() == 0


def test_decontamination_odd_and_whole(spark, small, odd):
    bench = small["benchmark"].select("item_id", "text", F.lit(1).alias("score"))
    rows = decontam.leaks(odd, bench).collect()
    assert [(r["doc_id"], r["n_edits"]) for r in rows] == [(9, 0)]
    more = bench.select("item_id", "text").union(spark.createDataFrame([(None, None), (77, ""), (78, "abc")], "item_id long, text string"))
    twice = decontam.leaks(odd, more.union(more.select(F.col("item_id") + 1000, "text")))
    assert twice.count() == 2
    kept = decontam.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert decontam.without_leaks(odd, bench.limit(0)).count() == odd.count()
    assert decontam.leaks(odd.limit(0), bench).count() == 0
    items = {r["item_id"]: decontam.normalised(r["text"].encode()) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in small["documents"].collect() for i, t in items.items()
            if t in decontam.normalised(r["text"].encode())}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(small["documents"], bench).collect()}
    assert want and want <= got


def test_language_odd_and_held_out(spark, small, odd):
    got = {r["doc_id"]: r for r in langid.identify(odd, keep=["doc_id"]).collect()}
    assert got[1]["lang_pred"] == got[4]["lang_pred"] == got[8]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[11]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0
    kept = langid.keep_languages(odd)
    assert kept.columns == odd.columns and 4 not in {r[0] for r in kept.select("doc_id").collect()}
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    res = catalog.QUERIES["op4_language_id"](spark, SF_SMALL.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id")
    held = res.filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in docs.select("doc_id").collect()
                                           if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_token_counts_odd(odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(odd, path, ["doc_id"]).collect()}
    counter = token_counts.Counter(token_counts.vocabulary(path))
    assert got[1] == got[2] == 0 and got[3] == counter.path_count("\u2581One")
    long = narrow(odd, "doc_id", "text").filter("doc_id = 5").first()["text"]
    assert got[5] == counter.path_count("\u2581" + long.replace(" ", "\u2581"))
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def test_token_files_odd_and_whole(spark, small, odd, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for docs in (narrow(odd, "doc_id", "text", "score"), small["documents"]):
        files = token_files.shards(docs, path)
        got = token_files.read_back(files, with_ids=True).collect()
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")
                       for r in docs.select("doc_id", "text").collect()))
        got.sort(key=lambda r: r["start"])
        start = 0
        for (known, doc_id, _, text), g in zip(rows, got, strict=True):
            ids = whole.encode(text, add_special_tokens=False).ids + [1]
            assert g["doc_id"] == (doc_id if known else None) and g["start"] == start and g["n_tokens"] == len(ids)
            assert g["ids"] == ids and g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    assert token_files.read_back(token_files.shards(odd.limit(0), path)).count() == 0


def test_packing_odd_and_whole(small, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for docs in (odd, small["documents"]):
        got = packing.pack(docs, path, with_ids=True).collect()
        sequences: dict = {}
        for r in got:
            assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in sequences.values():
            end = 0
            for offset, n in sorted(pieces):
                assert offset == end
                end += n
            assert end <= 1024
        pieces: dict = {}
        for r in got:
            pieces.setdefault((r["doc_id"], r["start"], r["length"]), []).append(r["ids"])
        want = sorted(whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
                      for r in narrow(docs, "doc_id", "text").collect())
        chained, at = [], {}
        for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"])):
            if r["start"] == 0:
                at.setdefault(r["doc_id"], []).append(list(r["ids"]))
            else:
                next(x for x in at[r["doc_id"]] if len(x) == r["start"]).extend(r["ids"])
        for xs in at.values():
            chained.extend(xs)
        assert sorted(chained) == want
    assert packing.pack(odd.limit(0), path).count() == 0


def test_urls_odd(spark, small):
    rows = [(1, None), (2, ""), (3, "x"), (4, "HTTP://A.Example.COM/en/x?q=1#f"), (5, "http://www.example.com/en/"),
            (6, "http://a.net/es/1"), (6, "http://a.net/es/1"), (None, "ftp://org"), (7, "http://com"), (8, "s://x.org?a=/://b")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, small["labels"]).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7] == ("com", "", None, "allow")
    assert got[8] == ("x.org", "", None, "allow")
    assert urls.judge(pages, small["labels"].limit(0)).count() == len(rows)
    assert urls.judge(pages.limit(0), small["labels"]).count() == 0


def test_mined_url_rules_block_like_sql(spark):
    import duckdb
    import pandas as pd
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        host = rnd.choice(["a.spam.org", "www.x.org", "b.spam.org", "Example.org", "w.net"])
        path = rnd.choice(["/en/", "/buy/now", "", "/x1/22.html"])
        rows.append((i, "http://" + host + path + rnd.choice(["", "?ref=1&utm=2", "#top?x=1"])))
        if i % 3:
            bad = rnd.random() < (0.97 if "spam" in host and "buy" in path else 0.05)
            labels.append((i, 0 if bad else 1, 0))
    pages, lab = pd.DataFrame(rows, columns=["page_id", "url"]), pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"])
    con = duckdb.connect()
    con.register("pages", pages)
    con.register("labels", lab)
    want = sorted(con.sql(urls.OP8_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in urls.judge(spark.createDataFrame(pages), spark.createDataFrame(lab)).collect()), key=str)
    assert got == want and sum(r[3] is None and r[4] == "block" for r in got) > 20


def test_mined_url_rules_of_three_tokens_like_brute_force(spark):
    from itertools import combinations
    parts = ("http://spam.org", "/buy", "?ref=1"), ("http://fine.net", "/read", "?id=2")
    rows, labels = [], []
    for n, pick in enumerate((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)):
        for i in range(40):
            rows.append((100 * n + i, "".join(parts[k][j] for j, k in enumerate(pick))))
            labels.append((100 * n + i, 0 if pick == (0, 0, 0) else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens = {u: frozenset(t) for u, t in pages.select("url", urls.tokens_of(F.col("url"))).distinct().collect()}
    seen = [(tokens[u], q == 0) for (_, u), (_, q, _) in zip(rows, labels)]
    sets = {frozenset(c) for t in tokens.values() for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    bad = {s: [b for t, b in seen if s <= t] for s in sets}
    rules = {s for s, b in bad.items() if sum(b) >= 20 and sum(b) >= 0.8 * len(b)}
    least = {s for s in rules if not any(r < s for r in rules)}
    assert least and {len(s) for s in least} == {3}
    cfg = urls.UrlConfig()
    found, alike = urls.mine(pages, lab, cfg)
    spellings: dict = {}
    for r in alike.collect():
        spellings.setdefault(r["item"], []).append(r["token"])
    mined = [frozenset(c) for r in found.collect() for c in product(*[spellings.get(i, [i]) for i in r["items"]])]
    assert len(mined) == len(set(mined)) and set(mined) == least
    got = {(r["page_id"], r["verdict"]) for r in urls.judge(pages, lab, rules=(), cfg=cfg).collect()}
    assert got == {(i, "block" if any(r <= tokens[u] for r in rules) else "allow") for i, u in rows}


def _long_urls(kind, rnd):
    """(rows, labels): ``kind`` tells how the pages of a url of 30 segments and 10 query keys are labelled."""
    long = "/".join(f"seg{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)) + "?" + "&".join(f"{chr(97 + k)}key=1" for k in range(10))
    rows, labels = [], []
    for i in range(440):
        template = i < 80
        url = (rnd.choice(["http://a.site.org/", "http://b.site.org/"]) + long if template
               else f"http://{rnd.choice('abc')}.site.org/{rnd.choice(['x', 'y', 'sega' + 'a'])}")
        if kind == "some" and template:  # one more token decides
            url += "&promo=1" if i % 2 else "&plain=1"
        bad = template and (kind == "all" or (kind == "some" and i % 2 == 1) or (kind == "half" and rnd.random() < 0.5))
        rows.append((i, url))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, rows[0][1]), (1001, "http://c.else.net/" + long), (1002, "http://a.site.org/segba"), (1003, "http://n.org/?promo=2")]
    return rows, labels


@pytest.mark.parametrize("kind", ["all", "half", "some"])
def test_long_spam_urls_do_not_explode(spark, kind):
    """A template of 40 tokens would give FP-growth 2^40 sets; the verdicts are those of all of its rules."""
    rows, labels = _long_urls(kind, random.Random(5))
    pages, lab = (spark.createDataFrame(x, k) for x, k in ((rows, "page_id long, url string"), (labels, "doc_id long, quality int, toxic int")))
    began = time.monotonic()
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, lab, rules=()).collect()}
    assert time.monotonic() - began < 60
    tokens = {u: frozenset(t) for u, t in pages.select("url", urls.tokens_of(F.col("url"))).distinct().collect()}
    seen = [(tokens[u], q == 0) for (_, u), (_, q, _) in zip(rows, labels)]
    # a url is blocked if some set of its tokens is a rule: sets of the same pages are one, so the closed ones suffice
    closed, todo = set(), {t for t, _ in seen}
    while todo:
        closed |= todo
        todo = {a & b for a in todo for b in closed} - closed
    rules = []
    for s in closed:
        held = [b for t, b in seen if s <= t]
        if sum(held) >= 20 and sum(held) >= 0.8 * len(held):
            rules.append((s, {frozenset(x) for x in _generators(s, seen)}))
    want = {i: "block" if any(g <= tokens[u] for _, gens in rules for g in gens) else "allow" for i, u in rows}
    assert got == want
    assert (kind == "half") == all(v == "allow" for v in want.values())


def _generators(closed, seen):
    """Smallest sets of one or two tokens that stand in just the pages of a closed set."""
    def pages(s):
        return [i for i, (t, _) in enumerate(seen) if s <= t]
    want = pages(closed)
    ones = [{x} for x in closed if pages({x}) == want]
    if ones:
        return ones
    twos = [{x, y} for x in closed for y in closed if x < y and pages({x, y}) == want]
    assert twos  # the pages of these tests need no more
    return twos


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    xs = sorted(fps)
    for i, a in enumerate(xs):
        for b in xs[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_simhash_odd_and_whole(spark, small, odd):
    from test_units import plain_fingerprint
    rnd = random.Random(7)
    base = [rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randint(0, 30)) for _ in range(300)]
    near = []
    for i in range(60):
        words = list(base)
        words[rnd.randrange(300)] = f"new{i}"
        near.append((1000 + i, " ".join(words)))
    docs = narrow(odd, "doc_id", "text").union(small["documents"].select(F.col("doc_id") + 100, "text")).union(
        spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect() if r["doc_id"] != 5]
    got = [r for r in simhash.near_duplicates(docs).collect() if r["doc_id"] != 5]
    root = brute_components({f for _, f in rows})
    least: dict = {}
    for d, f in rows:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in rows), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    kept = simhash.one_of_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and len(ids) == len(set(ids)) and 7 not in ids and 6 in ids and 1 in ids and 2 not in ids
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.one_of_each(odd.limit(0)).count() == 0


def test_one_of_each_keeps_groups_with_null_and_repeated_ids(spark):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in ("alpha", "beta", "gamma", "delta", "eps")]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]),
            (None, texts[4]), (9, texts[4]), (8, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (8, texts[4])], key=str)


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    names = list(range(300))
    rnd.shuffle(names)
    links = [tuple(sorted((names[a], names[b]))) for a, b in links]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for lo, hi in ((0, 41), (100, 160), (200, 202)):
        group = [names[i] for i in range(lo, hi)]
        assert {got[g] for g in group} == {min(group)}
    assert len(got) == 41 + 60 + 2


def test_quality_odd_and_ratio(spark, small, odd):
    got = {r["doc_id"]: r for r in quality.quality(odd, small["labels"], keep=["doc_id"]).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[1]["score"] == 0
    everything = quality.quality(odd, small["labels"])
    assert everything.columns.count("kept") == 1 and everything.columns.count("score") == 1
    assert quality.quality(odd.limit(0), small["labels"].limit(0)).count() == 0
    kept = quality.quality(odd, small["labels"], filter_rows=True)
    assert kept.columns == odd.columns
    cfg = quality.QualityConfig()
    trusted = {r["doc_id"] for r in small["labels"].collect() if r["quality"] == 1}
    raw, target = np.zeros(cfg.buckets), np.zeros(cfg.buckets)
    rows = small["documents"].select("doc_id", "text").collect()
    for r in rows:
        cells = quality.gram_cells(np.frombuffer(r["text"].encode(), np.uint8), cfg.n, cfg.buckets)
        for c in cells.tolist():
            raw[c] += 1
            target[c] += r["doc_id"] in trusted
    ratio = np.log((target + 1) / (target.sum() + cfg.buckets)) - np.log((raw + 1) / (raw.sum() + cfg.buckets))
    out = {r["doc_id"]: r for r in quality.quality(small["documents"], small["labels"], keep=["doc_id"]).collect()}
    for r in rows:
        cells = quality.gram_cells(np.frombuffer(r["text"].encode(), np.uint8), cfg.n, cfg.buckets)
        score = ratio[cells].mean() if len(cells) else 0.0
        assert abs(out[r["doc_id"]]["score"] - score) < 1e-8
        assert out[r["doc_id"]]["kept"] == (not out[r["doc_id"]]["base_failed"] and score >= cfg.min_score)


def test_pipeline_stages_on_odd_and_whole(spark, small, odd):
    empty = odd.limit(0)
    docs = small["documents"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        res = stage(spark, odd, SF_SMALL)
        none = stage(spark, empty, SF_SMALL)
        assert none.count() == 0
        if k < 4:
            assert res.columns == odd.columns and none.columns == odd.columns
            res.collect()
            after = stage(spark, docs, SF_SMALL)
            assert after.columns == docs.columns and 0 < after.count() <= docs.count()
            assert after.exceptAll(docs).count() == 0
            docs = after
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == ids
