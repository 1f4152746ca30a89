"""Sources/sinks, table spec, label model, DP pieces, sweep and the end-to-end job."""
import math

import pytest
from pyspark.sql import functions as F

from quietab import fixtures as fx
from quietab.operators.label import LabelModel
from quietab.operators.private import Ledger, dp_histogram, gaussian_sigma
from quietab.plans.generator import GeneratorConfig
from quietab.plans.end_to_end import EndToEndConfig, run_end_to_end
from quietab.plans.sweep import draw_params
from quietab.sources.tables import read_profile, read_table, training_view, write_profile, write_table
from quietab.spec import TableSpec, infer_task, trim_headers

from conftest import SF_SMALL


def test_csv_na_tokens_and_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(" a ,b,c,d\n1,1.5,x,NA\n2,NaN,,7\nnull,2.5,y,8\n")
    df = read_table(spark, str(p), "csv")
    assert df.columns == ["a", "b", "c", "d"]
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "bigint"}
    rows = df.orderBy(F.col("d").asc_nulls_first()).collect()
    assert rows[0]["d"] is None and rows[0]["a"] == 1
    assert math.isnan(rows[1]["b"]) and rows[1]["c"] is None
    assert rows[2]["a"] is None


def test_table_spec_and_task(spark):
    df = fx.table(spark, SF_SMALL, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    spec = TableSpec.infer(df, key="o_orderkey")
    assert spec.label == "o_orderstatus"
    assert spec.num_cols == ("o_totalprice",) and spec.cat_cols == ("o_orderpriority",)
    assert infer_task(df, "o_orderstatus") == ("multiclass", 3)
    assert trim_headers(df.toDF(" x", "y ", "z", "w")).columns == ["x", "y", "z", "w"]


def test_profile_and_training_view(spark, tmp_path):
    prof = spark.createDataFrame([("t", "binclass", 2)], "name string, task_type string, n_classes long")
    write_profile(prof, str(tmp_path / "p"))
    assert read_profile(spark, str(tmp_path / "p"))["n_classes"] == 2
    df = spark.createDataFrame([(1.0, 2.0, 1)], "a double, b double, y int")
    v = training_view(df, ["a", "b"], "y", "multiclass", width=2)
    assert v.dtypes == [("features", "array<float>"), ("label", "bigint")]
    with pytest.raises(ValueError):
        training_view(df, ["a"], "y", "binclass", width=2)
    write_table(df, str(tmp_path / "w"), "parquet", partition_by="y")
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1


def test_label_model_classification_and_regression(spark):
    df = fx.table(spark, SF_SMALL, "orders")
    lm = LabelModel.fit(df, "o_orderstatus")
    assert lm.classes == ["F", "O", "P"]
    back = df.select(lm.decode_col(lm.encode_col()).alias("x"), "o_orderstatus").where("x <> o_orderstatus")
    assert back.count() == 0
    bad = spark.createDataFrame([("Z",)], "o_orderstatus string")
    with pytest.raises(Exception):
        bad.select(lm.encode_col()).collect()
    rg = LabelModel.fit(df, "o_totalprice", "regression")
    r = df.select(lm.encode_col().alias("c"), rg.encode_col().alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9


def test_dp_histogram_noise_scale_and_guard(spark):
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    sigma = gaussian_sigma(0.1, 1e-5)
    assert sigma == pytest.approx(48.4481, rel=1e-4)
    dom = [f"g{i}" for i in range(400)]  # 395 absent groups: their noisy counts are pure noise
    h = dp_histogram(df.withColumn("g", F.concat(F.lit("g"), (F.col("event_id") % 5).cast("string"))),
                     "g", dom, seed=3, clamp=-1e9)
    noise = h.where("count = 0").agg(F.avg("noisy"), F.stddev_samp("noisy")).first()
    assert abs(noise[0]) < 4 * sigma / math.sqrt(395) and noise[1] == pytest.approx(sigma, rel=0.15)
    with pytest.raises(ValueError):
        dp_histogram(df, "event_type", ["view"], epsilon=2.0)
    led = Ledger()
    dp_histogram(df, "event_type", ["view"], seed=1, ledger=led)
    assert led.to_df(spark).count() == 1


def test_sweep_draws(spark):
    t = draw_params(spark, {"lr": ("loguniform", 1e-4, 1e-1), "depth": ("int", 2, 5),
                            "kind": ("choice", ["a", "b"])}, 50, seed=1).collect()
    assert all(1e-4 <= r["lr"] <= 1e-1 and 2 <= r["depth"] <= 5 and r["kind"] in ("a", "b") for r in t)
    assert len({r["depth"] for r in t}) == 4


def test_end_to_end_real_and_synthetic(spark):
    df, spec = fx.fx3(spark, SF_SMALL)
    out = run_end_to_end(df, spec, EndToEndConfig(eval_type="real", hist_seed=1, eval_models=("tree",), eval_raw=()))
    m = {(r["split"], r["metric"]): r["value"] for r in out["metrics"].collect()}
    assert m[("test", "accuracy")] > 0.9
    gen = GeneratorConfig(d_layers=(16,), dim_t=8, num_timesteps=10, steps=2, sample_rate=0.3, noise_seed=1)
    out = run_end_to_end(df, spec, EndToEndConfig(generator=gen, hist_seed=1, n_samples=100, eval_models=("tree",),
                                                  eval_raw=("gbt",), eval_params={"gbt": {"iterations": 3}}))
    assert {r["model"] for r in out["metrics"].collect()} == {"tree", "gbt_raw"}
    assert out["synthetic"].count() == 100
    assert all(0 <= r["value"] <= 1 for r in out["metrics"].collect() if r["value"] is not None)
    assert {e["name"] for e in out["ledger"].entries} >= {"dp_histogram", "dp_sgd", "encoder_state"}


def test_raw_column_utility_multiclass(spark):
    from quietab.operators.split import stratified_split
    from quietab.plans.evaluate import evaluate_raw
    df, spec = fx.fx2(spark, SF_SMALL)
    sp = stratified_split(df, spec.label, "o_orderkey", seed=1)
    lab = LabelModel.fit(sp.where("split = 'train'"), spec.label, "multiclass")
    m = evaluate_raw(sp.where("split = 'train'"), sp.where("split = 'val'"), sp.where("split = 'test'"),
                     spec, lab, ("tree",)).collect()
    assert len(m) == 9 and all(r["value"] is None or 0 <= r["value"] <= 1 for r in m)


def test_sample_only_run_from_saved_state(spark, tmp_path):
    """Fit once, save every fitted table, then generate + decode from the saved state only."""
    from quietab.operators.encode import EncoderModel, fit_encoder
    from quietab.plans.generator import GeneratorModel, fit_generator
    df, spec = fx.fx3(spark, SF_SMALL)
    enc = fit_encoder(df, spec)
    lab = LabelModel.fit(df, "label", "binclass")
    tr = enc.encode(df, keep=["event_id", lab.encode_col().alias("label")])
    gen = fit_generator(tr, "event_id", enc.width, 2, [0.5, 0.5],
                        GeneratorConfig(d_layers=(8,), dim_t=8, num_timesteps=5, steps=1, seed=1, noise_seed=1))
    enc.save(spark, str(tmp_path / "enc"))
    lab.save(spark, str(tmp_path / "lab"))
    gen.save(spark, str(tmp_path / "gen"))
    enc2, lab2 = EncoderModel.load(spark, str(tmp_path / "enc")), LabelModel.load(spark, str(tmp_path / "lab"))
    gen2 = GeneratorModel.load(spark, str(tmp_path / "gen"))
    assert lab2 == lab
    _, dec = gen2.generate(spark, 50, seed=2, encoder=enc2, label_model=lab2)
    rows = dec.collect()
    assert len(rows) == 50 and {r["label"] for r in rows} <= {0, 1}


def test_scale_conf_sizes_partitions(spark):
    from quietab.session import scale_conf
    c = scale_conf(100 * 10 ** 12, 8000)  # 100 TB on 1000 executors x 8 cores
    assert int(c["spark.sql.shuffle.partitions"]) == -(-100 * 10 ** 12 // (256 << 20))
    assert int(scale_conf(10 ** 6, 8)["spark.sql.shuffle.partitions"]) == 16


def test_end_to_end_with_class_balancing(spark):
    df, spec = fx.fx3(spark, SF_SMALL)
    gen = GeneratorConfig(d_layers=(16,), dim_t=8, num_timesteps=10, steps=2, sample_rate=0.3, noise_seed=1, seed=2)
    out = run_end_to_end(df, spec, EndToEndConfig(generator=gen, hist_seed=1, n_samples=50, eval_models=("tree",), eval_raw=(),
                                                  balance_classes=True))
    assert out["synthetic"].count() == 50 and out["model"].config.class_weights is not None


def test_command_line_end_to_end(spark, tmp_path):
    import duckdb
    from tools.synthesize import main
    src = tmp_path / "in.csv"
    duckdb.sql(f"COPY (SELECT event_id, value, user_id, event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END"
               f" AS y FROM '{SF_SMALL}/events.parquet') TO '{src}' (HEADER)")
    out = tmp_path / "out"
    main(["--input", str(src), "--key", "event_id", "--out", str(out), "--steps", "2", "--sample-rate", "0.3",
          "--layers", "16", "--timesteps", "10", "--samples", "40", "--eval", "tree", "--eval-raw", ""])
    syn = spark.read.parquet(str(out / "synthetic"))
    assert syn.count() == 40 and set(syn.columns) >= {"value", "user_id", "event_type", "y"}
    assert {r["y"] for r in syn.select("y").distinct().collect()} <= {"high", "low"}
    assert spark.read.json(str(out / "ledger")).where("name = 'dp_sgd'").count() == 1


def test_multiclass_utility_models(spark):
    """OneVsRest boosted trees (raw and encoded columns), MLP and kNN on a 3-class label."""
    from quietab.operators.encode import fit_encoder
    from quietab.operators.split import stratified_split
    from quietab.plans.evaluate import evaluate, evaluate_raw
    df, spec = fx.fx2(spark, SF_SMALL)
    sp = stratified_split(df, spec.label, "o_orderkey", seed=1)
    tr = sp.where("split = 'train'")
    lab = LabelModel.fit(tr, spec.label, "multiclass")
    raw = evaluate_raw(tr, sp.where("split = 'val'"), sp.where("split = 'test'"), spec, lab, ("gbt",),
                       params={"gbt": {"iterations": 5}}).collect()
    enc = fit_encoder(tr, spec)
    part = lambda s: enc.encode(sp.where(F.col("split") == s),
                                keep=[F.col("o_orderkey").alias("id"), lab.encode_col().alias("label")])
    m = evaluate(part("train"), part("val"), part("test"), "multiclass", 3, ("gbt", "mlp", "knn"),
                 params={"gbt": {"iterations": 5}, "mlp": {"max_iter": 5}}).collect()
    assert len(raw) == 9 and len(m) == 27
    assert all(r["value"] is None or 0 <= r["value"] <= 1 for r in raw + m)


def test_training_view_means_make_no_row_for_every_element(spark):
    from quietab.catalog import q_training_view
    got = q_training_view(spark, SF_SMALL)
    assert "Generate posexplode" in (plan := got._jdf.queryExecution().optimizedPlan().toString())
    assert plan.index("Generate posexplode") < plan.index("Aggregate")  # the means are taken apart, not the rows
    assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(9))
