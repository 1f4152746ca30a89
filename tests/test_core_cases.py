"""Cases that the queries over the given tables do not reach."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietab.operators.encode import fit_encoder
from quietab.operators.label import LabelModel
from quietab.spec import TableSpec


def test_twelve_integer_classes_follow_their_order(spark):
    df = spark.createDataFrame([(i, (i * 7) % 12) for i in range(240)], "id long, y int")
    lab = LabelModel.fit(df, "y", "multiclass")
    assert lab.classes == [str(i) for i in range(12)]
    coded = lab.encode(df, "code")
    assert coded.where("code <> y").count() == 0
    assert lab.decode(coded.select("id", "code"), "code").where(f"y <> (id * 7) % 12").count() == 0


def test_many_classes_go_through_every_call(spark):
    from quietab.plans.generator import GeneratorConfig, fit_generator
    df = spark.range(3000).selectExpr("id", "cast(id % 1500 as int) as y", "cast(id % 7 as double) as v")
    spec = TableSpec(("v",), (), "y", ("id",))
    lab, enc = LabelModel.fit(df, "y", "multiclass"), fit_encoder(df, spec)
    assert lab.n_classes == 1500
    coded = lab.encode(df, "label")
    assert coded.where("label <> y").count() == 0
    tr = enc.encode(coded, keep=["id", "label"])
    model = fit_generator(tr, "id", enc.width, 1500, [1 / 1500] * 1500, GeneratorConfig(
        d_layers=(8,), dim_t=4, num_timesteps=4, steps=1, sample_rate=0.1, seed=1, noise_seed=1))
    _, dec = model.generate(spark, 60, 3, encoder=enc, label_model=lab)
    assert dec.count() == 60 and dec.where("y < 0 or y >= 1500").count() == 0


def test_booleans_and_small_integers_round_trip(spark):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("flag", T.BooleanType()),
                         T.StructField("tiny", T.ByteType()), T.StructField("y", T.IntegerType())])
    rows = [(i, None if i % 5 == 0 else i % 2 == 0, (i * 37) % 256 - 128, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, kind)
    spec = TableSpec.infer(df, "y", "id")
    assert spec.num_cols == ("tiny",) and spec.cat_cols == ("flag",)
    enc = fit_encoder(df, spec, unknown="keep")
    back = enc.decode(enc.encode(df, keep=["id"]), keep=["id"])
    assert dict(back.dtypes)["flag"] == "boolean" and dict(back.dtypes)["tiny"] == "tinyint"
    assert sorted(map(tuple, back.select("id", "flag", "tiny").collect())) == sorted((r[0], r[1], r[2]) for r in rows)


def test_decoded_integers_saturate_and_nan_is_null(spark):
    df = spark.createDataFrame([(i, i - 100, i % 2) for i in range(200)], T.StructType([
        T.StructField("id", T.LongType()), T.StructField("t", T.ByteType()), T.StructField("y", T.IntegerType())]))
    enc = fit_encoder(df, TableSpec(("t",), (), "y", ("id",)))
    far = spark.createDataFrame([(1, [50.0]), (2, [-50.0]), (3, [float("nan")]), (4, [1e300])], "id long, features array<double>")
    got = {r["id"]: r["t"] for r in enc.decode(far, keep=["id"]).collect()}
    assert got == {1: 127, 2: -128, 3: None, 4: 127}


def test_null_and_nan_numerics_are_left_out_of_the_fit(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 5.0), (5, 3.0)], "id long, v double")
    for kind in ("minmax", "standard", "quantile"):
        p = fit_encoder(df, TableSpec(("v",), (), None, ("id",)), kind).num_params["v"]
        assert (p["n"], p["min"], p["max"], p["mean"]) == (3, 1.0, 5.0, 3.0)


def test_threshold_of_a_group_without_positives(spark):
    from quietab.operators.metrics import best_threshold
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("b", 0, 0.7), ("b", 0, 0.1)], "g string, y int, s double")
    got = {r["g"]: (r["threshold"], r["f1"]) for r in best_threshold(df, "y", "s", ["g"]).collect()}
    assert got["a"][0] == 0.9 and got["a"][1] == pytest.approx(1.0, abs=1e-6) and got["b"] == (None, None)


def test_nan_never_is_the_best_run(spark):
    from quietab.operators.metrics import best_run
    df = spark.createDataFrame([(1, float("nan"), 1), (2, 0.5, 2), (3, 0.5, 3), (4, None, 4)], "run long, s double, p int")
    assert tuple(best_run(df, "s", "run", ["p"]).first()) == (2, 0.5, 2)
    assert tuple(best_run(df.where("run in (1, 4)"), "s", "run", ["p"]).first()) == (None, None, None)


def test_null_keys_are_in_one_set(spark):
    from quietab.operators.setops import split_keys
    df = spark.createDataFrame([(1, 5), (1, 0), (2, 0), (None, 7), (None, 0), (3, None)], "k int, v int")
    ok, bad = split_keys(df, F.col("v") > 3, "k")
    assert {r[0] for r in ok.collect()} == {1, None} and {r[0] for r in bad.collect()} == {2, 3}


def test_exactly_zero_rows(spark):
    from quietab.operators.sampling import exactly_n
    assert exactly_n(spark.range(10), 0).count() == 0 and exactly_n(spark.range(0), 5).count() == 0


def _tiny_model(spark, nan_share=0.0):
    from quietab.plans.generator import GeneratorConfig, fit_generator
    df = spark.range(400).selectExpr("id", "array(cast(id % 3 as float), cast(id % 5 as float)) as features", "id % 2 as label")
    return fit_generator(df, "id", 2, 2, [0.5, 0.5], GeneratorConfig(
        d_layers=(8,), dim_t=4, num_timesteps=4, steps=1, sample_rate=0.2, seed=1, noise_seed=1))


def test_top_up_until_n_rows_are_finite(spark, monkeypatch):
    """A third of the candidates is NaN; later batches fill up, ids stay the lowest accepted."""
    from quietab.plans import generator as g
    model = _tiny_model(spark)
    plain = g._reverse_chain

    def broken(p, s, b, ids, seed):
        out = plain(p, s, b, ids, seed)
        out["ok"] = out["ok"] & (out["id"] % 3 != 0)
        return out

    monkeypatch.setattr(g, "_reverse_chain", broken)
    got = sorted(r["id"] for r in model.generate(spark, 100, 5).select("id").collect())
    assert got == [i for i in range(200) if i % 3][:100]
    monkeypatch.setattr(g, "_reverse_chain", lambda p, s, b, ids, seed: {**plain(p, s, b, ids, seed), "ok": np.zeros(len(ids), bool)})
    with pytest.raises(RuntimeError, match="finite"):
        model.generate(spark, 10, 5)


def test_strided_keys_fill_all_files_of_a_step(spark):
    """Keys with a common stride must not leave tasks of a step empty."""
    from quietab.plans.generator import poisson_batches, row_key
    df = spark.range(0, 16_000, 8).selectExpr("id", "array(cast(1 as float)) as features", "0 as label")
    sub = poisson_batches(df, "id", "features", "label", 0.5, 2, 3).withColumn(
        "sub", F.pmod(F.xxhash64("__h", "__h2"), F.lit(8)))
    counts = [r["count"] for r in sub.where("step = 1").groupBy("sub").count().collect()]
    assert len(counts) == 8 and min(counts) > 0.5 * sum(counts) / 8


def test_shared_keys_are_refused(spark):
    from quietab.plans.generator import GeneratorConfig, fit_generator
    df = spark.createDataFrame([(1, [0.0], 0), (1, [1.0], 1)], "id long, features array<float>, label long")
    with pytest.raises(ValueError, match="share"):
        fit_generator(df, "id", 1, 2, [0.5, 0.5], GeneratorConfig(d_layers=(4,), steps=1, num_timesteps=4))


def test_incomplete_rows_are_left_out_and_counted(spark):
    from quietab.plans.generator import GeneratorConfig, fit_generator
    rows = [(i, [float(i % 3)], i % 2) for i in range(50)] + [(100, [float("nan")], 0), (101, None, 0), (102, [1.0], None)]
    df = spark.createDataFrame(rows, "id long, features array<float>, label long")
    model = fit_generator(df, "id", 1, 2, [0.5, 0.5], GeneratorConfig(d_layers=(4,), dim_t=4, steps=1, sample_rate=0.5, num_timesteps=4,
                                                                      seed=1, noise_seed=1))
    assert model.privacy["n_rows_dropped"] == 3 and np.isfinite(model.params).all()


def test_secret_noise_is_in_no_plan_and_drawn_once(spark):
    from quietab.operators.private import dp_histogram
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 20, "g string")
    h = dp_histogram(df, "g", ["a", "b"], epsilon=0.5)
    first, again = (sorted(map(tuple, h.collect())) for _ in range(2))
    assert first == again
    assert first != sorted(map(tuple, dp_histogram(df, "g", ["a", "b"], epsilon=0.5).collect()))
    plan = h._jdf.queryExecution().toString().lower()
    assert "rand" not in plan and "seed" not in plan and "mapinarrow" not in plan


def test_steps_are_stored_by_windows(spark, monkeypatch):
    """M1: the same weights with one window, several windows, and little on disk."""
    from quietab.plans import generator as g
    df = spark.range(600).selectExpr("id", "array(cast(id % 3 as float), cast(id % 5 as float)) as features", "id % 2 as label")
    cfg = g.GeneratorConfig(d_layers=(8,), dim_t=4, num_timesteps=4, steps=7, sample_rate=0.3, seed=1, noise_seed=1)
    dropped = []
    plain = g.drop_folder
    monkeypatch.setattr(g, "drop_folder", lambda s, p: (dropped.append(p), plain(s, p)))
    weights, windows = [], []
    for tables in (0.3, 1.0, 100.0):
        monkeypatch.setattr(g, "STORE_TABLES", tables)
        weights.append(g.fit_generator(df, "id", 2, 2, [0.5, 0.5], cfg).params)
        windows.append(len(dropped) - sum(windows))
    assert windows == [7, 3, 1]
    assert np.allclose(weights[0], weights[2], rtol=1e-9) and np.allclose(weights[1], weights[2], rtol=1e-9)
    import os
    assert not any(os.path.exists(p.removeprefix("file:")) for p in dropped)


def test_large_dictionary_with_nulls_and_a_hot_value(spark, monkeypatch):
    """A third of the rows null, a third one value; nothing gathers them, codes and values are whole."""
    from quietab.operators import encode as e
    monkeypatch.setattr(e, "DICT_COLLECT_MAX", 100)
    df = spark.range(30_000).selectExpr(
        "id", "case id % 3 when 0 then null when 1 then 'hot' else concat('v', cast(id as string)) end as c", "0 as y")
    spec = TableSpec((), ("c",), "y", ("id",))
    enc = fit_encoder(df, spec, unknown="keep")
    assert set(enc.large_dicts) == {"c"} and enc.sizes["c"] == 10_001
    coded = enc.with_codes(df)
    want = {v: i for i, v in enumerate(sorted(["hot", *[f"v{i}" for i in range(2, 30_000, 3)]]))}
    assert all(r["__code_c"] == want.get(r["c"], 10_001) for r in coded.collect())
    back = enc.decode(enc.encode(df, keep=["id"]), keep=["id"]).collect()
    assert all(r["c"] == (None if r["id"] % 3 == 0 else "hot" if r["id"] % 3 == 1 else f"v{r['id']}") for r in back)


def test_heavy_rows_spread_over_the_join(spark):
    from quietab.operators.dictjoin import dictionary_join
    dictionary = spark.range(5000).selectExpr("concat('v', cast(id as string)) as value", "id as code")
    df = spark.range(60_000).selectExpr("id", "case id % 3 when 0 then null when 1 then 'v7' else concat('v', cast(id % 6000 as string)) end as c")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dictionary_join(df, F.col("c"), dictionary, "value", "code")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 3 * sorted(sizes)[4]
        bad = got.where("not (code <=> case when c is null then null when cast(substr(c, 2) as int) < 5000 then cast(substr(c, 2) as long) end)")
        assert got.count() == 60_000 and bad.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dictionaries_share_one_byte_budget(spark, monkeypatch):
    from quietab.operators import encode as e
    df = spark.range(300).selectExpr("id", "concat('a', id % 150) as a", "concat('b', id) as b", "0 as y")
    monkeypatch.setattr(e, "DICT_COLLECT_BYTES", 150 * 70)
    enc = fit_encoder(df, TableSpec((), ("a", "b"), "y", ("id",)))
    assert set(enc.small_dicts) == {"a"} and set(enc.large_dicts) == {"b"}
    back = enc.decode(enc.encode(df, keep=["id"]), keep=["id"]).join(df.select("id", F.col("b").alias("want")), "id")
    assert back.where("b <> want").count() == 0


def test_normal_columns_equal_the_reference(spark):
    from quietab.functions import normal as nm
    xs = [float(x) for x in np.linspace(-12, 12, 481)] + [-38.0, 38.0, -0.0, 7.0710678118, -7.08, float("inf"), float("-inf"), float("nan")]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", nm.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r["x"] / math.sqrt(2))
        assert (math.isnan(r["p"]) and math.isnan(want)) or r["p"] == pytest.approx(want, rel=1e-11, abs=1e-300)
    ps = [0.0, 1.0, 1e-300, 1e-12, 0.5, 0.075, 0.925, 1 - 1e-12, -0.1, 1.1, float("nan")] + [float(p) for p in np.linspace(0.001, 0.999, 333)]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", nm.normal_quantile(F.col("p")).alias("x")).collect()
    for r in got:
        want = float(nm.ndtri(np.array([r["p"]]))[0])
        assert (math.isnan(r["x"]) and math.isnan(want)) or r["x"] == pytest.approx(want, rel=1e-13)


@pytest.mark.parametrize("output", ["normal", "uniform"])
def test_quantile_maps_equal_the_reference_without_python(spark, output):
    from quietab.functions import normal as nm
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(900)] + [0.5] * 300 + [float(i % 4) for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(9000, None), (9001, float("nan"))], "id long, v double")
    spec = TableSpec(("v",), (), None, ("id",))
    enc = fit_encoder(df, spec, "quantile", quantile_output=output)
    p = enc.num_params["v"]
    q, refs = np.asarray(p["quantiles"]), np.asarray(p["references"])
    coded = enc.encode(df.unionByName(spark.createDataFrame([(9002, -99.0), (9003, 99.0)], "id long, v double")), keep=["id", "v"])
    plan = coded._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "pandas" not in plan.lower()
    for r in coded.collect():
        want = nm.quantile_forward(np.array([np.nan if r["v"] is None else r["v"]]), q, refs, output == "normal")[0]
        assert (math.isnan(r["features"][0]) and math.isnan(want)) or r["features"][0] == pytest.approx(np.float32(want), rel=1e-6, abs=1e-7)
    ys = [float(y) for y in np.linspace(-6, 6, 97)] if output == "normal" else [float(y) for y in np.linspace(-0.2, 1.2, 97)]
    rows = spark.createDataFrame([(i, [y]) for i, y in enumerate(ys)], "id long, features array<double>")
    back = enc.decode(rows, keep=["id"])
    assert "Python" not in back._jdf.queryExecution().toString()
    for r in back.collect():
        want = nm.quantile_inverse(np.array([ys[r["id"]]]), q, refs, output == "normal")[0]
        assert r["v"] == pytest.approx(want, rel=1e-9, abs=1e-9)
