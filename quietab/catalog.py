"""Registered queries: one callable per inventory operator, ``(spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables (or data Spark derives from them).
Output columns are aliased to match the DuckDB oracles in ``oracles.py``;
doubles that are sums/products of many terms are rounded with
``floor(x * 1e6 + 0.5) / 1e6`` in both engines (their last ulps differ).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .operators.encode import fit_encoder
from .operators.label import LabelModel


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c.cast("double") * 1e6 + 0.5) / 1e6).cast("double")


def _encoded_fx1(spark, sf_dir, num_kind="minmax", cat_kind="bits"):
    df, spec = fx.fx1(spark, sf_dir)
    enc = fit_encoder(df, spec, num_kind, cat_kind)
    lab = LabelModel.fit(df, spec.label, "binclass")
    out = enc.encode(df, keep=[lab.encode_col().alias("label")])
    return enc, lab, df, spec, out


def q_encode_minmax_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7 (+A3, A4, A7, W2, H1, H4, P4, H9): FX1 encoded with min-max + bits, flattened."""
    enc, lab, df, spec, out = _encoded_fx1(spark, sf_dir)
    flat = enc.flatten(out, keep=["label"])
    return flat.select(*[F.col(c).cast("double").alias(c) for c in flat.columns if c != "label"], "label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode FX1 and return the label-wise means of every encoded column."""
    flat = q_encode_minmax_bits(spark, sf_dir)
    feats = [c for c in flat.columns if c != "label"]
    return flat.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                     *[r6(F.avg(c)).alias(f"avg_{c}") for c in feats])




# ----------------------------------------------------------------------------- encoders / decoders

def q_encode_standard_onehot(spark, sf_dir):
    """A8 + H5 + H3 on FX2 (orders x customer): standard scaling, one-hot."""
    df, spec = fx.fx2(spark, sf_dir)
    enc = fit_encoder(df, spec, "standard", "onehot")
    lab = LabelModel.fit(df, spec.label, "multiclass")
    flat = enc.flatten(enc.encode(df, keep=[lab.encode_col().alias("label")]), keep=["label"])
    return flat.select(*[F.col(c).cast("double").alias(c) for c in flat.columns if c != "label"], "label")


def _fx3_encoded(spark, sf_dir, num_kind="minmax", cat_kind="bits"):
    df, spec = fx.fx3(spark, sf_dir)
    enc = fit_encoder(df, spec, num_kind, cat_kind)
    return df, spec, enc, enc.encode(df, keep=["event_id", "label"])


def _noisy(enc_df, width, seed, scale):
    from .functions.rand import gauss
    noisy = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                        lambda j: F.col("features")[j].cast("double") + F.lit(scale) * gauss(seed, F.col("event_id"), j))
    return enc_df.withColumn("features", noisy)


def q_decode_noisy_clip(spark, sf_dir):
    """H8 + H2 + P10 + P11 + J2 + P5: decode FX3 features perturbed by seeded
    noise; bits rounded half-even, codes clipped, ints rounded."""
    df, spec, enc, e = _fx3_encoded(spark, sf_dir)
    d = enc.decode(_noisy(e, enc.width, 11, 0.3), keep=["event_id"])
    return d.select("event_id", r6("value").alias("value"), "user_id", "event_type")


def q_decode_noisy_reject(spark, sf_dir):
    """P9 + U3 reject mode: rows with any out-of-domain code are dropped."""
    df, spec, enc, e = _fx3_encoded(spark, sf_dir)
    d = enc.decode(_noisy(e, enc.width, 12, 0.6), keep=["event_id"], on_invalid="reject")
    return d.select("event_id", r6("value").alias("value"), "user_id", "event_type")


def q_quantile_fit(spark, sf_dir):
    """Exact quantile knots of FX3 numerics (nq = max(min(n//30,1000),10))."""
    from .operators.encode import fit_numeric
    df, spec = fx.fx3(spark, sf_dir)
    params = fit_numeric(df, spec.num_cols, "quantile")
    rows = [(c, i, float(r), float(q)) for c, p in params.items()
            for i, (r, q) in enumerate(zip(p["references"], p["quantiles"]))]
    t = spark.createDataFrame(rows, "col string, idx long, ref double, quantile double")
    return t.select("col", "idx", r6("ref").alias("ref"), r6("quantile").alias("quantile"))


def q_num2cat(spark, sf_dir):
    """H18 on lineitem: the value -> category mapping of every numeric column
    with < 15 distinct values, all integral (prefix = position among numerics)."""
    from .operators.num2cat import low_cardinality_mapping, mapping_df
    li = fx.table(spark, sf_dir, "lineitem")
    return mapping_df(spark, low_cardinality_mapping(li, 15))


# ----------------------------------------------------------------------------- split / profile / set ops

def _split_fx3(spark, sf_dir, seed=42):
    from .operators.split import stratified_split
    df, spec = fx.fx3(spark, sf_dir)
    return stratified_split(df, "label", "event_id", (0.6, 0.2, 0.2), seed=seed), spec


def q_stratified_split(spark, sf_dir):
    """R3 + W4 + W6 + R1: per-class seeded 60/20/20 split of FX3."""
    sp, _ = _split_fx3(spark, sf_dir)
    return sp.select("event_id", "label", "split")


def q_split_profile(spark, sf_dir):
    """A5 + A6 + P1-P3: profile of the split FX3 table."""
    from .spec import profile_df
    sp, spec = _split_fx3(spark, sf_dir)
    return profile_df(sp, spec, "events")


def q_append_tables(spark, sf_dir):
    """Stack orders and customers by column name, missing columns null."""
    from .operators.setops import append_tables
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return append_tables(o, c)


def q_split_keys(spark, sf_dir):
    """Key sets passing / failing a predicate (anti-join for the rest)."""
    from .operators.setops import split_keys
    ev = fx.table(spark, sf_dir, "events")
    ok, bad = split_keys(ev, (F.col("value") > 10) & (F.col("event_type") != "error"), "event_id")
    return ok.withColumn("part", F.lit("allowed")).unionByName(bad.withColumn("part", F.lit("rejected")))


def q_csv_roundtrip(spark, sf_dir):
    """S1 + S2: write FX3 as CSV to the shared folder, read back with type inference."""
    import os
    import uuid
    from .session import checkpoint_dir
    from .sources.tables import read_table, write_table
    ev = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = os.path.join(checkpoint_dir(spark), f"csv-{uuid.uuid4().hex[:10]}")
    write_table(ev, path, "csv")
    return read_table(spark, path, "csv")


def q_csv_prose_roundtrip(spark, sf_dir):
    """S1 + S2: whole documents -- quotes, separators, line breaks -- through CSV unchanged."""
    import os
    import uuid
    from .session import checkpoint_dir
    from .sources.tables import read_table, write_table
    path = os.path.join(checkpoint_dir(spark), f"csv-{uuid.uuid4().hex[:10]}")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    quoted = F.concat(F.lit('"'), F.col("lang"), F.lit('", '), F.col("source"), F.lit(' said ""x""\n '))
    write_table(docs.withColumn("quoted", quoted), path, "csv")
    return read_table(spark, path, "csv")


# ----------------------------------------------------------------------------- privacy

def q_dp_histogram(spark, sf_dir):
    """A2 (+A1, R2): seeded Gaussian-mechanism histogram of FX2's label over a supplied domain."""
    from .operators.private import dp_histogram
    df, spec = fx.fx2(spark, sf_dir)
    h = dp_histogram(df, "o_orderstatus", ["F", "O", "P"], epsilon=0.1, delta=1e-5, seed=7)
    return h.select("o_orderstatus", "count", r6("noisy").alias("noisy"), r6("p").alias("p"))


def q_label_distribution(spark, sf_dir):
    """A1: exact class distribution over a supplied domain with an absent class."""
    from .operators.private import label_distribution
    df, spec = fx.fx5(spark, sf_dir)
    d = label_distribution(df, "quality", [0, 1, 2])
    return d.select(F.col("quality").cast("long").alias("quality"), "count", r6("p").alias("p"))


def q_class_weights(spark, sf_dir):
    """A20 + J5: class-balancing weights from the label distribution, attached per row and summed."""
    from .operators.private import class_weights, label_distribution, with_class_weight
    df, spec = fx.fx2(spark, sf_dir)
    p = label_distribution(df, "o_orderstatus", ["F", "O", "P"])
    w = class_weights(p, "o_orderstatus")
    rows = with_class_weight(df, w, "o_orderstatus")
    return rows.groupBy("o_orderstatus").agg(r6(F.first("p")).alias("p"), r6(F.first("weight")).alias("weight"),
                                             r6(F.sum("weight")).alias("total_weight"))


# ----------------------------------------------------------------------------- metrics

def _fx3_predictions(spark, sf_dir):
    from .functions.rand import u as uni
    ev = fx.table(spark, sf_dir, "events")
    score = F.floor((F.col("value") / 500.0 + uni(5, F.col("event_id"))) * 20) / 40.0
    return ev.select("event_id", "user_id", "event_type", (F.col("value") > 50).cast("long").alias("y"),
                     score.alias("score"))


def q_binary_metrics(spark, sf_dir):
    """A11 + A12 + A14 + P12 + W6: f1/accuracy/ROC-AUC (ties half) per event type."""
    from .operators.metrics import binary_report
    r = binary_report(_fx3_predictions(spark, sf_dir), "y", "score", by=["event_type"])
    return r.select("event_type", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"),
                    r6("roc_auc").alias("roc_auc"))


def q_best_threshold(spark, sf_dir):
    """A16 + W5: F1-optimal threshold per event type."""
    from .operators.metrics import best_threshold
    r = best_threshold(_fx3_predictions(spark, sf_dir), "y", "score", by=["event_type"])
    return r.select("event_type", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


def _fx4_probs(spark, sf_dir):
    e = fx.fx4(spark, sf_dir)
    logits = F.slice("embedding", 1, 10)
    ex = F.transform(logits, lambda v: F.exp(v.cast("double")))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
    return e.select("vec_id", F.col("label").cast("long").alias("y"),
                    F.transform(ex, lambda v: v / tot).alias("probs"))


def q_multiclass_metrics(spark, sf_dir):
    """A13 + A15 + T4: macro F1, accuracy and one-vs-rest AUC of softmax scores on FX4."""
    from .operators.metrics import multiclass_report
    r = multiclass_report(_fx4_probs(spark, sf_dir), "y", "probs")
    return r.select(r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), r6("roc_auc").alias("roc_auc"))


def _runs(spark, sf_dir):
    from .operators.metrics import binary_report
    r = binary_report(_fx3_predictions(spark, sf_dir), "y", "score", by=["user_id"])
    return r


def q_average_metrics(spark, sf_dir):
    """Mean of each metric over runs (here: per-user reports), rounded half-even to 4."""
    from .operators.metrics import average_metrics
    r = _runs(spark, sf_dir)
    long = r.select("user_id", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("f1", "accuracy", "roc_auc")])
    ).alias("m")).select("user_id", "m.metric", "m.value").withColumn("split", F.lit("all"))
    return average_metrics(long).select("split", "metric", "value", "n_runs")


def q_best_run(spark, sf_dir):
    """The run with the highest accuracy (lowest id on ties) and its metrics."""
    from .operators.metrics import best_run
    r = _runs(spark, sf_dir)
    b = best_run(r, "accuracy", "user_id", ["f1"])
    return b.select("user_id", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


# ----------------------------------------------------------------------------- statistics

def q_norm_stats(spark, sf_dir):
    """A10 + H10: per-class median/mean/std/max/min of embedding L2 norms."""
    from .operators.stats import norm_stats
    s = norm_stats(fx.fx4(spark, sf_dir), "embedding", by=["label"])
    return s.select(F.col("label").cast("long").alias("label"),
                    *[r6(c).alias(c) for c in ("p50", "mean", "std", "max", "min")])


def q_loss_rollup(spark, sf_dir):
    """Events as a batch log (k = event_id, loss = value, n = 1 + user_id % 5)."""
    from .operators.stats import loss_rollup
    ev = fx.table(spark, sf_dir, "events")
    log = ev.select(F.col("event_id").alias("k"), F.col("value").alias("loss"),
                    (1 + F.col("user_id") % 5).alias("n"))
    return loss_rollup(log).select("step", r6("loss").alias("loss"))


def q_gaussian_kl(spark, sf_dir):
    """Per-column KL between Gaussian fits of FX3's train and test splits."""
    from .operators.stats import gaussian_kl
    sp, spec = _split_fx3(spark, sf_dir)
    k = gaussian_kl(sp.where("split = 'train'"), sp.where("split = 'test'"), ["value", "user_id"])
    return k.select("col", r6("kl").alias("kl"))


def q_log_likelihood(spark, sf_dir):
    """Discretised Gaussian log-likelihood of min-max encoded values per event type."""
    from .operators.stats import mean_log_likelihood
    df, spec = fx.fx3(spark, sf_dir)
    enc = fit_encoder(df, spec, "minmax", "bits")
    t = enc.encode(df, keep=["event_type"]).select("event_type", F.col("features")[0].cast("double").alias("x"))
    # per-type moments as a grouped aggregate joined back (one row per type), not a
    # window that would hold a whole type in one task
    mom = t.groupBy("event_type").agg(F.avg("x").alias("mu"), F.log(F.stddev_pop("x")).alias("ls"))
    t = t.join(mom, "event_type")
    r = mean_log_likelihood(t, "x", "mu", "ls", by=["event_type"])
    return r.select("event_type", r6("mean_log_likelihood").alias("mean_log_likelihood"), "n")


def r4(c) -> Column:
    """Rounding for outputs that amplify last-ulp libm differences (late timesteps)."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c.cast("double") * 1e4 + 0.5) / 1e4).cast("double")


# ----------------------------------------------------------------------------- diffusion schedule

def _forward_draws(spark, sf_dir, k=3, seed=3, weights_method=None):
    from .operators.schedule import noise_schedule, timestep_weights, training_draws
    df, spec, enc, e = _fx3_encoded(spark, sf_dir)
    sched = noise_schedule(spark, 500, "cosine")
    w = timestep_weights(sched, weights_method) if weights_method else None
    return training_draws(e, "features", "event_id", sched, enc.width, k=k, seed=seed, weights=w), sched


def q_forward_noise(spark, sf_dir):
    """H11 + W1 + W3 + J4 + R5 + R2 + R7 + H13: K=3 uniform-timestep noisings of encoded FX3."""
    d, _ = _forward_draws(spark, sf_dir)
    return d.select("event_id", "draw", "t", *[r6(F.col("x_t")[j]).alias(f"xt_{j}") for j in range(5)],
                    r6("q_variance").alias("q_variance"))


def q_reverse_step(spark, sf_dir):
    """One ancestral reverse step from each noised draw, given its noise
    as the prediction and fresh seeded noise z."""
    from .operators.schedule import reverse_step
    d, sched = _forward_draws(spark, sf_dir)
    from .functions.rand import gauss_vector
    d = d.withColumn("z", gauss_vector(4, 5, F.col("event_id"), F.col("draw")))
    r = reverse_step(d, sched, "x_t", "t", "noise", "z", "x_prev", dim=5)
    return r.select("event_id", "draw", "t", *[r4(F.col("x_prev")[j]).alias(f"xp_{j}") for j in range(5)])


def q_timestep_draws_snr(spark, sf_dir):
    """H12 (snr) + R4: timesteps drawn by inverse CDF of the SNR weights."""
    d, _ = _forward_draws(spark, sf_dir, k=1, seed=6, weights_method="snr")
    return d.select("event_id", "t")


def q_timestep_draws_ada(spark, sf_dir):
    """H12 (ada: Gaussian in log-SNR, sample std) + R4."""
    d, _ = _forward_draws(spark, sf_dir, k=1, seed=8, weights_method="ada")
    return d.select("event_id", "t")


def q_importance_weights(spark, sf_dir):
    """H12 (importance) + H17: p_t from the per-timestep mean MSE of the
    forward draws (uniform until every t has more than 10 draws)."""
    from .functions.arrays import row_mse
    from .operators.schedule import timestep_weights
    d, sched = _forward_draws(spark, sf_dir)
    hist = d.groupBy("t").agg(F.avg(row_mse(F.col("x_t"), F.col("noise"))).alias("loss"),
                              F.count(F.lit(1)).alias("count"))
    w = timestep_weights(sched, "importance", loss_history=hist)
    return w.select("t", r6("p").alias("p"))


# ----------------------------------------------------------------------------- sampling

def q_poisson_sample(spark, sf_dir):
    """Poisson subsample of events (q = 0.3, step 5)."""
    from .operators.sampling import poisson_sample
    return poisson_sample(fx.table(spark, sf_dir, "events"), 0.3, "event_id", 9, 5).select("event_id")


def q_minibatches(spark, sf_dir):
    """R6 + W6: shuffled 128-row batches of events (epoch 2)."""
    from .operators.sampling import minibatches
    return minibatches(fx.table(spark, sf_dir, "events"), "event_id", 128, 9, 2).select("event_id", "batch")


def q_exactly_n(spark, sf_dir):
    """The n lowest-id accepted events, n = half the table."""
    from .functions.rand import u as uni
    from .operators.sampling import exactly_n
    ev = fx.table(spark, sf_dir, "events")
    n = ev.count() // 2
    cand = ev.select("event_id", (uni(13, F.col("event_id")) < 0.7).alias("ok"))
    return exactly_n(cand, n, "event_id", "ok").select("event_id")


# ----------------------------------------------------------------------------- nearest neighbours

def q_knn_join(spark, sf_dir):
    """J6 + T3: leave-one-out 5 nearest embeddings (Euclidean, ties by id)."""
    from .operators.knn import knn_join
    e = fx.fx4(spark, sf_dir)
    nb = knn_join(e, e, 5, "vec_id", "vec_id", "embedding", exclude_self=True)
    return nb.select(F.col("q_key").alias("vec_id"), F.col("r_key").alias("neighbor"), "rank",
                     r6("dist").alias("dist"))


def q_knn_classify(spark, sf_dir):
    """M8: leave-one-out distance-weighted 5-NN vote over the 10 embedding classes."""
    from .operators.knn import knn_classify
    e = fx.fx4(spark, sf_dir)
    c = knn_classify(e, e, "label", 10, 5, "vec_id", "vec_id", "embedding", exclude_self=True)
    return c.select("vec_id", "pred", r6(F.array_max("probs")).alias("p_pred"))


# ----------------------------------------------------------------------------- persistence / streaming

def q_encoder_save_load(spark, sf_dir):
    """The fitted encoder saved as small tables, loaded back, applied -- equals encode_minmax_bits."""
    import os
    import uuid
    from .operators.encode import EncoderModel
    from .session import checkpoint_dir
    enc, lab, df, spec, _ = _encoded_fx1(spark, sf_dir)
    path = os.path.join(checkpoint_dir(spark), f"encoder-{uuid.uuid4().hex[:10]}")
    enc.save(spark, path)
    enc2 = EncoderModel.load(spark, path)
    flat = enc2.flatten(enc2.encode(df, keep=[lab.encode_col().alias("label")]), keep=["label"])
    return flat.select(*[F.col(c).cast("double").alias(c) for c in flat.columns if c != "label"], "label")


def q_streaming_encode(spark, sf_dir):
    """Structured Streaming: the batch-fitted FX3 encoder applied to events read as a file stream."""
    from .streaming.encode_stream import encode_stream, read_stream, run_available_now
    df, spec = fx.fx3(spark, sf_dir)
    enc = fit_encoder(df, spec, "minmax", "bits")
    schema = fx.table(spark, sf_dir, "events").schema
    st = read_stream(spark, sf_dir, schema, glob="events.parquet")
    st = st.select("event_id", "value", "user_id", "event_type", (F.col("value") > 50).cast("int").alias("label"))
    sink = run_available_now(encode_stream(enc, st, keep=["event_id", "label"]))
    out = enc.flatten(spark.read.parquet(sink), keep=["event_id", "label"])
    return out.select("event_id", "label", *[F.col(c).cast("double").alias(c) for c in out.columns
                                             if c not in ("event_id", "label")])


def q_training_view(spark, sf_dir):
    """S5 + P4: flattened encoded FX1 columns back into a typed training view; per-position means."""
    from .sources.tables import training_view
    flat = q_encode_minmax_bits(spark, sf_dir)
    feats = [c for c in flat.columns if c != "label"]
    v = training_view(flat, feats, "label", "binclass", width=len(feats))
    # one pass without a row for every element; no row, no position
    means = v.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("features")[j]).alias(f"m{j}") for j in range(len(feats))])
    ex = means.where("n > 0").select(F.posexplode(F.array(*[f"m{j}" for j in range(len(feats))])).alias("pos", "x"))
    return ex.select(F.col("pos").cast("long").alias("pos"), r6("x").alias("mean"))


# ----------------------------------------------------------------------------- model jobs (invariant-checked)

def _small_generator(steps=10):
    from .plans.generator import GeneratorConfig
    return GeneratorConfig(d_layers=(64, 64), dim_t=32, num_timesteps=100, steps=steps, sample_rate=0.1,
                           sigma=1.0, clip=1.0, k=3, lr=2e-3, seed=3, init_seed=0, noise_seed=5)


def _whole_generator():
    """
    batches of 128 among 6000 rows; batches grow with the table, the number of steps does not."""
    from .plans.generator import GeneratorConfig
    return GeneratorConfig(d_layers=(512, 256), num_timesteps=500, steps=1175, sample_rate=128 / 6000, sigma=2.890625, clip=1.0, k=3,
                           lr=0.0006982179585993695, seed=3, init_seed=0, noise_seed=5)


def _fx3_real_splits(spark, sf_dir):
    from .session import materialise
    sp, spec = _split_fx3(spark, sf_dir)
    sp = materialise(sp, "fx3-split")  # fit and three encodes read it: compute the split once
    train = sp.where("split = 'train'")
    enc = fit_encoder(train, spec, "minmax", "bits")
    e = lambda part: enc.encode(sp.where(F.col("split") == part),
                                keep=[F.col("event_id").alias("id"), F.col("label").cast("long").alias("label")])
    return enc, e("train"), e("val"), e("test")


def q_utility_real(spark, sf_dir):
    """M4 + M6 + M8 + M9: tree, logistic and 5-NN trained on real FX3 train, scored on train/val/test."""
    from .plans.evaluate import evaluate
    enc, tr, va, te = _fx3_real_splits(spark, sf_dir)
    m = evaluate(tr, va, te, "binclass", 2, ("tree", "logistic", "knn"))
    return m.select("model", "split", "metric", r6("value").alias("value"))


def q_evaluation_coverage(spark, sf_dir):
    """M4 + M6 + M8 + M9: every row of every split gets one finite distribution from every model."""
    from .plans.evaluate import evaluate
    enc, tr, va, te = _fx3_real_splits(spark, sf_dir)
    _, p = evaluate(tr, va, te, "binclass", 2, ("tree", "logistic", "knn"), predictions=True)
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return p.groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("n_positive"),
        F.sum((F.abs(total - 1) < 1e-9).cast("long")).alias("n_distributions"))


def q_utility_models(spark, sf_dir):
    """M3 + M5 + M7: boosted trees (validation early stopping), forest, MLP on real FX3."""
    from .plans.evaluate import evaluate
    enc, tr, va, te = _fx3_real_splits(spark, sf_dir)
    m = evaluate(tr, va, te, "binclass", 2, ("gbt", "forest", "mlp"),
                 params={"gbt": {"iterations": 30}, "forest": {"num_trees": 30}, "mlp": {"max_iter": 50}})
    return m.select("model", "split", "metric", r6("value").alias("value"))


def _fit_small(spark, sf_dir, steps=10):
    from .operators.private import dp_histogram
    from .plans.generator import fit_generator
    enc, tr, va, te = _fx3_real_splits(spark, sf_dir)
    p_y = [r["p"] for r in dp_histogram(tr, "label", [0, 1], seed=17).orderBy("label").collect()]
    return enc, tr, va, te, fit_generator(tr, "id", enc.width, 2, p_y, _small_generator(steps))


def q_generator_loss(spark, sf_dir):
    """M1 + A19: DP-SGD fit of the denoiser on encoded FX3 train; per-step loss log rolled up."""
    from .operators.stats import loss_rollup
    enc, tr, va, te, model = _fit_small(spark, sf_dir, steps=20)
    log = spark.createDataFrame(model.loss_log, "k long, loss double, n long")
    return loss_rollup(log, every=5).select("step", "loss")


def q_synthetic_rows(spark, sf_dir):
    """M2 + T2 + P8 + H8: exactly N decoded synthetic rows (N = real train size)."""
    enc, tr, va, te, model = _fit_small(spark, sf_dir)
    n = tr.count()
    _, dec = model.generate(spark, n, seed=4, encoder=enc)
    return dec


def q_synthetic_checks(spark, sf_dir):
    """M2 + T2 + P8 + H8: how many rows are generated, unique, complete and inside the fitted domains."""
    enc, tr, va, te, model = _fit_small(spark, sf_dir)
    _, dec = model.generate(spark, tr.count(), seed=4, encoder=enc)
    domain = enc.small_dicts["event_type"]
    return dec.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
                   F.sum((F.isnan("value") | F.col("value").isNull()).cast("long")).alias("n_not_finite"),
                   F.sum((~F.col("event_type").isin(domain)).cast("long")).alias("n_outside"))


def q_sweep_threshold(spark, sf_dir):
    """M10 + A17 + A18: seeded draws, one trial per draw on the FX3 validation split, the best by accuracy."""
    from .plans.sweep import draw_params, sweep
    sp, _ = _split_fx3(spark, sf_dir)

    def trial(p, seed):
        right = ((F.col("value") > p["cut"]) == (F.col("label") == 1)).cast("double")
        return (sp.where("split = 'val'").agg(F.avg(right).alias("value"))
                .select(F.lit("cut").alias("model"), F.lit("val").alias("split"), F.lit("accuracy").alias("metric"), "value"))

    params = draw_params(spark, {"cut": ("uniform", 0.0, 100.0), "depth": ("int", 2, 10)}, 12, seed=21)
    _, best = sweep(params, trial, "accuracy", "val", parallel=2)
    return best.select("run_id", "score", r6("cut").alias("cut"), "depth")


def q_end_to_end_metrics(spark, sf_dir):
    """Split -> encode -> DP histogram -> DP fit -> generate -> utility on real val/test, at the reference's settings:
    25 epochs of the (512, 256) denoiser, 500 timesteps, all five models and raw boosted trees."""
    from .plans.end_to_end import EndToEndConfig, run_end_to_end
    df, spec = fx.fx3(spark, sf_dir)
    cfg = EndToEndConfig(generator=_whole_generator(), hist_seed=17, eval_params={"mlp": {"max_iter": 1000}, "gbt": {"iterations": 3000}})
    out = run_end_to_end(df, spec, cfg)
    return out["metrics"].select("model", "split", "metric", r6("value").alias("value"))


def q_sweep_best(spark, sf_dir):
    """M10 + A17 + A18: random search over tree depth / leaf size on real FX3, best by validation AUC."""
    from .plans.evaluate import evaluate
    from .plans.sweep import draw_params, sweep
    enc, tr, va, te = _fx3_real_splits(spark, sf_dir)
    space = {"max_depth": ("int", 2, 10), "min_leaf": ("int", 1, 50)}
    params = draw_params(spark, space, 3, seed=21)
    run = lambda p, s: evaluate(tr, va, te, "binclass", 2, ("tree",), seed=s,
                                params={"tree": {"max_depth": int(p["max_depth"]), "min_leaf": int(p["min_leaf"])}})
    runs, best = sweep(params, run, "roc_auc", "val", parallel=3)
    return best


def q_layout(spark, sf_dir):
    """A4 + W7 + P6: FX2 one-hot layout (offset = exclusive running width) and the
    per-column block sums of the encoded rows."""
    df, spec = fx.fx2(spark, sf_dir)
    enc = fit_encoder(df, spec, "standard", "onehot")
    e = enc.encode(df, keep=["o_orderkey"])
    sums = e.select(*[F.aggregate(enc.column_block("features", c), F.lit(0.0),
                                  lambda a, x: a + x.cast("double")).alias(c) for c in spec.cat_cols])
    tot = sums.agg(*[F.sum(c).alias(c) for c in spec.cat_cols]).first()
    lay = enc.layout_df(spark).where("kind = 'cat'")
    vals = spark.createDataFrame([(c, float(tot[c])) for c in spec.cat_cols], "col string, block_sum double")
    return lay.join(vals, "col").select("col", "offset", "width", "block_sum")


def q_drop_nan_rows(spark, sf_dir):
    """Encoded FX3 rows with injected NaN (event_id % 23 == 0) are dropped."""
    from .functions.arrays import drop_nan_rows
    df, spec, enc, e = _fx3_encoded(spark, sf_dir)
    nan_first = F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("features", 2, enc.width - 1))
    inj = e.withColumn("features", F.when(F.col("event_id") % 23 == 0, nan_first).otherwise(F.col("features")))
    return drop_nan_rows(inj).select("event_id", "label")


def q_profile_roundtrip(spark, sf_dir):
    """S3: the split profile written as JSON to the shared folder and read back."""
    import os
    import uuid
    from .session import checkpoint_dir
    from .sources.tables import write_profile
    path = os.path.join(checkpoint_dir(spark), f"profile-{uuid.uuid4().hex[:10]}")
    write_profile(q_split_profile(spark, sf_dir), path)
    return spark.read.schema(q_split_profile(spark, sf_dir).schema).json(path)


def q_metrics_roundtrip(spark, sf_dir):
    """The per-event-type metric table written long-format and read back."""
    import os
    import uuid
    from .session import checkpoint_dir
    from .sources.tables import write_metrics
    m = q_binary_metrics(spark, sf_dir)
    long = m.select("event_type", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"))
                                                      for k in ("f1", "accuracy", "roc_auc")])).alias("m")) \
        .select("event_type", "m.metric", "m.value")
    path = os.path.join(checkpoint_dir(spark), f"metrics-{uuid.uuid4().hex[:10]}")
    write_metrics(long, path, "parquet")
    return spark.read.parquet(path)


def q_quantile_encode_uniform(spark, sf_dir):
    """H6 uniform stage: FX3 numerics through the fitted piecewise-linear CDF
    (mean of forward and backward interpolation, so tied knots map to the
    middle of their range), saturating at both ends."""
    df, spec = fx.fx3(spark, sf_dir)
    enc = fit_encoder(df, spec, "quantile", "bits", quantile_output="uniform")
    flat = enc.flatten(enc.encode(df, keep=["event_id"]), keep=["event_id"])
    return flat.select("event_id", F.col("num_0").cast("double").alias("num_0"),
                       F.col("num_1").cast("double").alias("num_1"))


def q_utility_raw_gbt(spark, sf_dir):
    """M3: boosted trees on raw mixed FX5 columns (documents x labels), string-indexed
    categoricals, validation early stopping, after a stratified split on quality."""
    from .operators.split import stratified_split
    from .plans.evaluate import evaluate_raw
    df, spec = fx.fx5(spark, sf_dir)
    sp = stratified_split(df, "quality", "doc_id", seed=42)
    lab = LabelModel.fit(sp.where("split = 'train'"), "quality", "binclass")
    parts = {s: sp.where(F.col("split") == s) for s in ("train", "val", "test")}
    m = evaluate_raw(parts["train"], parts["val"], parts["test"], spec, lab, ("gbt", "tree"),
                     params={"gbt": {"iterations": 50}})
    return m.select("model", "split", "metric", r6("value").alias("value"))


def q_quantile_encode_normal(spark, sf_dir):
    """H6: FX3 numerics through the fitted piecewise-linear CDF and the normal quantile, as Column expressions."""
    df, spec = fx.fx3(spark, sf_dir)
    enc = fit_encoder(df, spec, "quantile", "bits")
    flat = enc.flatten(enc.encode(df, keep=["event_id"]), keep=["event_id"])
    return flat.select("event_id", r6("num_0").alias("num_0"), r6("num_1").alias("num_1"))


def q_group_quantiles(spark, sf_dir):
    """A10's quantiles: exact deciles of the event values of every user."""
    from .operators.quantiles import grouped_quantiles
    ev = fx.table(spark, sf_dir, "events")
    q = grouped_quantiles(ev, "value", ["user_id"], [0.1, 0.5, 0.9], ["p10", "p50", "p90"], {"n": F.count("value")})
    return q.select("user_id", "n", *[r6(c).alias(c) for c in ("p10", "p50", "p90")])


def q_running_totals(spark, sf_dir):
    """Running event numbers and sums per type in the order of the value; a third of the rows are one group's."""
    from .operators.rank import running_totals
    ev = fx.table(spark, sf_dir, "events").select(
        "event_id", "value", "user_id", F.when(F.col("event_id") % 3 == 0, "hot").when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("g"))
    run = running_totals(ev, ["value", "event_id"], {"users": F.col("user_id")}, by=["g"])
    return run.select("event_id", "g", "rank", "users")


def q_ordered_target_stats(spark, sf_dir):
    """M3: ordered target statistics of FX5's language and source for the label quality."""
    from .operators.target_stats import ordered_statistics
    df, spec = fx.fx5(spark, sf_dir)
    rows, _ = ordered_statistics(df.where("quality is not null"), spec.cat_cols, "quality", "doc_id", seed=3)
    return rows.select("doc_id", *[r6(f"{c}__ts1").alias(f"{c}_stat") for c in spec.cat_cols])


def q_evaluation_report(spark, sf_dir):
    """M9: the metrics of a fixed table of two models' predictions on three splits."""
    from .plans.evaluate import metric_table
    pr = _fx3_predictions(spark, sf_dir)
    which = F.get(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("event_id") % 3).cast("int"))
    score = F.least(F.col("score"), F.lit(1.0))
    two = pr.select("y", which.alias("split"), F.explode(F.array(
        F.struct(F.lit("a").alias("model"), score.alias("s")), F.struct(F.lit("b").alias("model"), (1.0 - score * score).alias("s")))).alias("m"))
    table = two.select("m.model", "split", "y", F.array(1.0 - F.col("m.s"), F.col("m.s")).alias("probs"))
    return metric_table(table, "binclass").select("model", "split", "metric", r6("value").alias("value"))


def q_knn_join_cells(spark, sf_dir):
    """J6 pruned by cells: the rows of ``knn_join``."""
    from .operators.knn import knn_join
    e = fx.fx4(spark, sf_dir)
    nb = knn_join(e, e, 5, "vec_id", "vec_id", "embedding", exclude_self=True, block_rows=500, method="cells")
    return nb.select(F.col("q_key").alias("vec_id"), F.col("r_key").alias("neighbor"), "rank", r6("dist").alias("dist"))


def q_label_codes(spark, sf_dir):
    """H9: codes of 37 integer classes follow the integers, not their text."""
    df = fx.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 37 * 3).cast("int").alias("y"))
    coded = LabelModel.fit(df, "y", "multiclass").encode(df, "code")
    return coded.groupBy("y").agg(F.min("code").alias("least"), F.max("code").alias("most"), F.count(F.lit(1)).alias("n"))


def q_decode_saturating(spark, sf_dir):
    """P2 + P11 + J1 + J2: a tinyint scaled beyond its range saturates, a nullable boolean is a category and comes back."""
    from .spec import TableSpec
    df = fx.table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 250 - 125).cast("tinyint").alias("t"),
        F.when(F.col("event_id") % 5 != 0, F.col("value") > 50).alias("flag"))
    enc = fit_encoder(df, TableSpec(("t",), ("flag",), None, ("event_id",)), unknown="keep")
    e = enc.encode(df, keep=["event_id"])
    wide = e.withColumn("features", F.transform("features", lambda x, i: F.when(i == 0, x.cast("double") * 3.0).otherwise(x.cast("double"))))
    return enc.decode(wide, keep=["event_id"]).select("event_id", F.col("t").cast("int").alias("t"), "flag")


def q_split_keys_null(spark, sf_dir):
    """The key sets of a nullable key."""
    from .operators.setops import split_keys
    ev = fx.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("k"), "value")
    ok, bad = split_keys(ev, F.col("value") > 95, "k")
    return ok.withColumn("part", F.lit("allowed")).unionByName(bad.withColumn("part", F.lit("rejected")))


def q_threshold_sparse(spark, sf_dir):
    """A16 per user where some users have no positive event (no threshold)."""
    from .operators.metrics import best_threshold
    pr = _fx3_predictions(spark, sf_dir).withColumn("y", F.when(F.col("user_id") % 3 != 0, F.col("y")).otherwise(0).cast("long"))
    r = best_threshold(pr, "y", "score", by=["user_id"])
    return r.select("user_id", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


QUERIES = {
    "encode_minmax_bits": q_encode_minmax_bits,
    "encoded_label_means": flagship,
    "encode_standard_onehot": q_encode_standard_onehot,
    "decode_noisy_clip": q_decode_noisy_clip,
    "decode_noisy_reject": q_decode_noisy_reject,
    "quantile_fit": q_quantile_fit,
    "num2cat": q_num2cat,
    "stratified_split": q_stratified_split,
    "split_profile": q_split_profile,
    "append_tables": q_append_tables,
    "split_keys": q_split_keys,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_prose_roundtrip": q_csv_prose_roundtrip,
    "evaluation_coverage": q_evaluation_coverage,
    "synthetic_checks": q_synthetic_checks,
    "sweep_threshold": q_sweep_threshold,
    "dp_histogram": q_dp_histogram,
    "label_distribution": q_label_distribution,
    "class_weights": q_class_weights,
    "binary_metrics": q_binary_metrics,
    "best_threshold": q_best_threshold,
    "multiclass_metrics": q_multiclass_metrics,
    "average_metrics": q_average_metrics,
    "best_run": q_best_run,
    "norm_stats": q_norm_stats,
    "loss_rollup": q_loss_rollup,
    "gaussian_kl": q_gaussian_kl,
    "log_likelihood": q_log_likelihood,
    "forward_noise": q_forward_noise,
    "reverse_step": q_reverse_step,
    "timestep_draws_snr": q_timestep_draws_snr,
    "timestep_draws_ada": q_timestep_draws_ada,
    "importance_weights": q_importance_weights,
    "poisson_sample": q_poisson_sample,
    "minibatches": q_minibatches,
    "exactly_n": q_exactly_n,
    "knn_join": q_knn_join,
    "knn_classify": q_knn_classify,
    "encoder_save_load": q_encoder_save_load,
    "streaming_encode": q_streaming_encode,
    "training_view": q_training_view,
    "utility_real": q_utility_real,
    "utility_models": q_utility_models,
    "generator_loss": q_generator_loss,
    "synthetic_rows": q_synthetic_rows,
    "end_to_end_metrics": q_end_to_end_metrics,
    "sweep_best": q_sweep_best,
    "layout": q_layout,
    "drop_nan_rows": q_drop_nan_rows,
    "profile_roundtrip": q_profile_roundtrip,
    "metrics_roundtrip": q_metrics_roundtrip,
    "quantile_encode_uniform": q_quantile_encode_uniform,
    "utility_raw_gbt": q_utility_raw_gbt,
    "quantile_encode_normal": q_quantile_encode_normal,
    "group_quantiles": q_group_quantiles,
    "running_totals": q_running_totals,
    "ordered_target_stats": q_ordered_target_stats,
    "evaluation_report": q_evaluation_report,
    "knn_join_cells": q_knn_join_cells,
    "label_codes": q_label_codes,
    "decode_saturating": q_decode_saturating,
    "split_keys_null": q_split_keys_null,
    "threshold_sparse": q_threshold_sparse,
}
