"""Code paths that only large inputs take, forced on small data."""
import numpy as np
import pytest

from quietab import fixtures as fx
from quietab.operators import encode as encmod
from quietab.operators.encode import exact_quantiles, fit_encoder
from quietab.operators.stats import grouped_quantiles

from conftest import SF_SMALL


def test_dictionary_join_paths_equal_literal_path(spark, monkeypatch):
    df, spec = fx.fx2(spark, SF_SMALL)
    ref = fit_encoder(df, spec, "minmax", "bits")
    want = {r["o_orderkey"]: r["features"] for r in ref.encode(df, keep=["o_orderkey"]).collect()}
    # 5-value columns -> collected, broadcast-joined; 25-value column -> ranked, written, shuffle-joined
    monkeypatch.setattr(encmod, "DICT_LITERAL_MAX", 2)
    monkeypatch.setattr(encmod, "DICT_COLLECT_MAX", 10)
    big = fit_encoder(df, spec, "minmax", "bits")
    assert "c_nation" in big.large_dicts and "o_orderpriority" in big.small_dicts
    e = big.encode(df, keep=["o_orderkey"])
    got = {r["o_orderkey"]: r["features"] for r in e.collect()}
    assert got == want
    d = big.decode(e, keep=["o_orderkey"]).toPandas().set_index("o_orderkey").sort_index()
    src = df.toPandas().set_index("o_orderkey").sort_index()
    for c in spec.cat_cols:
        assert (d[c] == src[c]).all()
    # the written large dictionary survives save/load
    import tempfile
    from quietab.session import checkpoint_dir
    path = tempfile.mkdtemp(dir=checkpoint_dir(spark))
    big.save(spark, path)
    back = encmod.EncoderModel.load(spark, path)
    assert set(back.large_dicts) == {"c_nation"}
    again = {r["o_orderkey"]: r["features"] for r in back.encode(df, keep=["o_orderkey"]).collect()}
    assert again == want


def test_exact_quantiles_match_numpy_with_ties(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])  # a hot value: 40 % of rows
    b = rng.integers(0, 7, 5000).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = list(np.linspace(0, 1, 37))
    got = exact_quantiles(df, {"a": probs, "b": probs}, {"a": 5000, "b": 5000})
    assert np.allclose(got["a"], np.percentile(a, np.array(probs) * 100), rtol=0, atol=1e-12)
    assert np.allclose(got["b"], np.percentile(b, np.array(probs) * 100), rtol=0, atol=1e-12)


def test_grouped_quantiles_hot_group_and_value(spark):
    rng = np.random.default_rng(2)
    g = np.where(rng.random(6000) < 0.34, 0, rng.integers(1, 5, 6000))   # group 0 holds a third
    v = np.where((g == 0) & (rng.random(6000) < 0.5), 3.0, rng.normal(size=6000))
    df = spark.createDataFrame([(int(x), float(y)) for x, y in zip(g, v)], "g long, v double")
    out = {r["g"]: (r["q0"], r["q1"]) for r in grouped_quantiles(df, "v", ["g"], [0.5, 0.9]).collect()}
    for k in range(5):
        vals = v[g == k]
        assert out[k][0] == pytest.approx(np.percentile(vals, 50), abs=1e-12)
        assert out[k][1] == pytest.approx(np.percentile(vals, 90), abs=1e-12)
    whole = grouped_quantiles(df, "v", [], [0.5]).first()["q0"]
    assert whole == pytest.approx(np.percentile(v, 50), abs=1e-12)


def test_encoder_with_only_one_kind(spark):
    df, spec = fx.fx3(spark, SF_SMALL)
    from quietab.spec import TableSpec
    only_num = TableSpec(spec.num_cols, (), spec.label, spec.key)
    only_cat = TableSpec((), spec.cat_cols, spec.label, spec.key)
    for s, w in ((only_num, 2), (only_cat, 3)):
        enc = fit_encoder(df, s, "standard", "bits")
        assert enc.width == w
        e = enc.encode(df, keep=["event_id"])
        assert len(e.first()["features"]) == w
        assert enc.decode(e, keep=["event_id"]).count() == df.count()


def test_identical_hot_rows_spread_over_buckets(spark):
    """A third of fully identical rows: with the stable tie-breaker the hot value
    is split across several buckets and the ranks stay exact."""
    from quietab.operators.rank import running_totals
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1.0 ELSE CAST(id AS DOUBLE) END AS v")
    r = running_totals(df, ["v"], rank_col="rk", buckets=12, tiebreak=True)
    rows = r.collect()
    assert sorted(x["rk"] for x in rows) == list(range(1, 3001))
    hot_ranks = sorted(x["rk"] for x in rows if x["v"] == -1.0)
    assert hot_ranks == list(range(1, 1001))  # the tied value occupies the first 1000 ranks
    b = r.select("v").where("v = -1.0").count()
    assert b == 1000
    got = grouped_quantiles(df, "v", [], [0.5]).first()["q0"]
    vals = np.where(np.arange(3000) % 3 == 0, -1.0, np.arange(3000).astype(float))
    assert got == pytest.approx(np.percentile(vals, 50))


def test_tiebreak_splits_a_hot_value(spark):
    from pyspark.sql import functions as F
    from quietab.operators.rank import _bucket_expr, _sampled_bounds
    from quietab.session import materialise
    df = materialise(spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1.0 ELSE CAST(id AS DOUBLE) END AS v"),
                     "hot").withColumn("__tb", F.monotonically_increasing_id())
    bounds = _sampled_bounds(df, ["v", "__tb"], 12)
    hot = df.where("v = -1.0").select(_bucket_expr(bounds, ["v", "__tb"]).alias("b")).distinct().count()
    assert hot >= 3  # a third of the rows spread over several buckets (~4 of 12)


def test_exactly_n_refines_to_the_cutoff(spark, monkeypatch):
    from pyspark.sql import functions as F
    from quietab.operators import sampling
    monkeypatch.setattr(sampling, "CUTOFF_FETCH_MAX", 50)  # force several refinement rounds
    df = spark.range(0, 20000, 3).withColumn("ok", (F.col("id") % 7) != 0)
    got = [r[0] for r in sampling.exactly_n(df, 1234, "id", "ok").select("id").collect()]
    want = [i for i in range(0, 20000, 3) if i % 7 != 0][:1234]
    assert sorted(got) == want
    assert sampling.exactly_n(df, 10 ** 6, "id", "ok").count() == len([i for i in range(0, 20000, 3) if i % 7])
