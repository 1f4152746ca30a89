"""The classifier chain and the language votes against plain Python."""

import math
import random

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from quietab.llm import langid, linear, toxicity
from quietab.llm.common import table


def newton(x, y, l2):
    """Dense logistic regression to convergence; the last column is the intercept."""
    x = np.hstack((x, np.ones((len(x), 1))))
    pen = np.full(x.shape[1], l2)
    pen[-1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + pen * w)
    return w


def prob(x, w):
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    bad = {"en": ["idiot", "scumbag", "trashy"], "xx": ["zorgle", "vlemic", "krank"]}
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 2 else "xx"
        words = [f"{lang}word{rnd.randint(0, 30)}" for _ in range(12)]
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(12)] = rnd.choice(bad[lang])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_chain_equals_plain_python(corpus):
    """Inputs by likelihood ratio, kinds, out-of-fold probabilities and every model, computed densely."""
    docs, labels = corpus
    cfg = toxicity.ToxicConfig(kinds=2, folds=3, min_g2=6.0)
    model = toxicity.fit_chain(docs, labels, cfg)
    label = dict(map(tuple, labels.collect()))
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3)).alias("f")).collect()}
    forms = {r["doc_id"]: {f for w in toxicity.words_of(r["text"].encode()) for f in toxicity.forms(w)} for r in docs.collect()}
    n, k = len(label), sum(label.values())

    def g2(word):
        df = sum(word in f for f in forms.values())
        dk = sum(word in forms[i] for i in forms if label[i])
        cells = ((dk, df * k / n), (df - dk, df * (1 - k / n)), (k - dk, (n - df) * k / n), (n - k - df + dk, (n - df) * (1 - k / n)))
        return sum(2 * o * math.log(o / e) for o, e in cells if o) if df >= 3 and df < n else 0
    every = {w for f in forms.values() for w in f}
    assert set(model.words) == {w for w in every if g2(w) >= 6.0} and b"idiot" in model.words and b"zorg*" in model.words
    words = sorted(model.words)
    number = {w: i for i, w in enumerate(words)}
    ids = sorted(label, key=lambda i: (folds[i], label[i], sorted(number[w] for w in forms[i] if w in number)))  # the sample's own order
    x = np.array([[w in forms[i] for w in words] for i in ids], float)
    y = np.array([label[i] for i in ids], float)
    fold = np.array([folds[i] for i in ids])
    at, col = np.nonzero(x)
    kinds = toxicity.kinds_of(at, col, n, len(words), y > 0, 2)
    assert (kinds[0] & kinds[1]).sum() == 0 and ((kinds[0] | kinds[1]) <= (y > 0)).all()
    assert model.names == ["kind1", "kind2", "toxic"]
    texts = dict(map(tuple, docs.collect()))
    got = toxicity.predict(model, toxicity.Inputs(model.words), [texts[i].encode() for i in ids], cfg)
    inputs, chained = x, x
    for name, target in (("p_kind1", kinds[0]), ("p_kind2", kinds[1]), ("score", y > 0)):
        w = newton(inputs, target.astype(float), cfg.l2)
        assert np.allclose(prob(chained, w), got[name], atol=0.02), name
        held = np.zeros(n)
        for f in range(3):  # a row's own label never reaches the input made of it
            held[fold == f] = prob(inputs[fold == f], newton(inputs[fold != f], target[fold != f].astype(float), cfg.l2))
        chained = np.hstack((chained, prob(chained, w)[:, None]))
        inputs = np.hstack((inputs, held[:, None]))
    assert np.mean((got["score"] > 0.5) == (y > 0)) > 0.95


def test_given_seed_words_make_the_categories(corpus):
    docs, labels = corpus
    cfg = toxicity.ToxicConfig(seeds={"insult": ("idiot",), "other": ("zorgle",)})
    rows = toxicity.toxicity(docs, labels, cfg, ["doc_id"]).join(docs, "doc_id").collect()
    assert {"p_insult", "p_other"} <= set(rows[0].asDict())
    hit = [r["p_insult"] for r in rows if "idiot" in r["text"]]
    rest = [r["p_insult"] for r in rows if "idiot" not in r["text"]]
    assert min(hit) > max(rest)


def test_repeated_ids_do_not_make_the_model_depend_on_the_run(spark, corpus):
    docs, labels = corpus
    more = docs.unionAll(docs.select("doc_id", F.concat("text", F.lit(" enword1 again"))))
    a = toxicity.sample(more.repartition(2), labels, toxicity.ToxicConfig()).collect()
    b = toxicity.sample(more.repartition(7), labels, toxicity.ToxicConfig()).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 400


def test_kinds_are_clusters():
    rows = [(i, (i % 3) * 10 + j) for i in range(30) for j in range(4)]
    row, col = (np.array(c) for c in zip(*rows))
    toxic = np.ones(33, bool)
    toxic[30:] = False
    kinds = toxicity.kinds_of(row, col, 33, 40, toxic, 3)
    assert {tuple(np.flatnonzero(k) % 3) for k in kinds} == {(c,) * 10 for c in range(3)}
    few = toxicity.kinds_of(row[:4], col[:4], 33, 40, toxic, 3)
    assert [int(k.sum()) for k in few] == [1, 0, 0]


def test_votes_margins_and_ties():
    """One-versus-one votes inside the family, ties by margins, then by the first language."""
    families = [("f", ["aa", "bb", "cc"]), ("g", ["zz"])]
    cells = 4096
    rng = np.random.default_rng(1)
    pairs = [("aa", "bb"), ("aa", "cc"), ("bb", "cc")]
    texts = [f"some text number {chr(97 + i)}{chr(98 + i % 7)} {'xyz' * (i % 5)}".encode() for i in range(60)] + [None, b"12 !", b""]
    for scale in (1.0, 0.0):  # without any margin every vote is a tie
        model = langid.LangModel(families, rng.normal(size=(cells + 1, 2)), pairs, scale * rng.normal(size=(cells + 1, 3)))
        got = langid.predict(model, texts, cells)
        x, letters = langid.vectors(texts, cells)
        for i, t in enumerate(texts):
            if not letters[i]:
                assert got["lang_pred"][i] == "und" and got["score"][i] == 0
                continue
            z = x[i].astype(float) @ model.family_w[:-1] + model.family_w[-1]
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if p[1] > p[0]:
                assert got["lang_pred"][i] == "zz" and got["score"][i] == pytest.approx(p[1], abs=1e-5)
                continue
            m = x[i].astype(float) @ model.pair_w[:-1] + model.pair_w[-1]
            votes, total, belief = dict.fromkeys(families[0][1], 0), dict.fromkeys(families[0][1], 0.0), dict.fromkeys(families[0][1], 1.0)
            for (a, b), d in zip(pairs, m):
                votes[a if d >= 0 else b] += 1
                total[a] += d
                total[b] -= d
                belief[a] = min(belief[a], 1 / (1 + math.exp(-2 * d)))
                belief[b] = min(belief[b], 1 / (1 + math.exp(2 * d)))
            best = min(families[0][1], key=lambda c: (-votes[c], -total[c], c))
            assert got["lang_pred"][i] == best and got["score"][i] == pytest.approx(p[0] * belief[best], abs=1e-5)


def test_svm_and_family_models_minimise_their_losses(spark):
    """The gradient of each fitted objective vanishes, and no held-out row is learned from."""
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(80, 6))
    y = dense[:, 0] + 0.3 * rng.normal(size=80) > 0
    row, col = np.nonzero(np.ones((80, 6)))
    for loss in ("logistic", "hinge2"):
        w = linear.fit(linear.Rows(row, col, dense.ravel(), 80, 6), y, 0.5, loss)

        def value(w):
            m = np.where(y, 1, -1) * (dense @ w[:-1] + w[-1])
            return (np.logaddexp(0, -m) if loss == "logistic" else np.maximum(1 - m, 0) ** 2).sum() + 0.25 * (w[:-1] ** 2).sum()
        for k in range(7):
            e = np.eye(7)[k] * 1e-5
            assert abs(value(w + e) - value(w - e)) / 2e-5 < 0.05
    docs = table(spark, SF_SMALL, "documents")
    broken = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit("qq")).otherwise(F.col("lang")))
    assert "qq" not in {r["lang"] for r in langid.learnable(broken, langid.LangConfig()).select("lang").distinct().collect()}
    one = langid.learnable(docs.withColumn("text", F.lit("the same text")).withColumn("lang", F.lit("en")), langid.LangConfig())
    assert one.count() == 1  # copies do not outgrow the bound
