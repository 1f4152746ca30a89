"""Benchmark the headline jobs on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]``; prints one JSON line.

Each timed job is executed to completion through the ``noop`` sink (the full
plan runs, nothing is collected).  Fits that return small state (encoder,
quantiles, generator) are timed as the fit call itself.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from quietab import catalog as cat
    from quietab import fixtures as fx
    from quietab.operators.encode import fit_encoder, fit_numeric
    from quietab.operators.label import LabelModel
    from quietab.plans.generator import GeneratorConfig, fit_generator
    from quietab.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times, info, errors = {}, {}, {}

    def run(name, make):
        t0 = time.time()
        try:
            df = make()
            if df is not None:
                df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # record and keep going: one job must not cost the whole report
            errors[name] = repr(e)[:300]

    # warm-up: JVM, parquet footers, Python workers (not timed)
    try:
        cat.q_split_keys(spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception as e:
        errors["warm_up"] = repr(e)[:300]

    df1, spec1 = fx.fx1(spark, sf_dir)
    state = {}

    def fit_fx1():
        state["enc"] = fit_encoder(df1, spec1, "minmax", "bits")
        state["lab"] = LabelModel.fit(df1, spec1.label, "binclass")

    run("encoder_fit_fx1", fit_fx1)
    run("encode_fx1", lambda: state["enc"].encode(df1, keep=[state["lab"].encode_col().alias("label")]))
    run("decode_fx1", lambda: state["enc"].decode(state["enc"].encode(df1, keep=["l_orderkey"]), keep=["l_orderkey"]))
    df2, spec2 = fx.fx2(spark, sf_dir)
    run("encode_standard_onehot_fx2", lambda: fit_encoder(df2, spec2, "standard", "onehot").encode(df2, keep=["o_orderkey"]))
    run("quantile_fit_exact_fx1", lambda: fit_numeric(df1, spec1.num_cols, "quantile", "exact") and None)
    run("quantile_fit_approx_fx1", lambda: fit_numeric(df1, spec1.num_cols, "quantile", "approx") and None)
    for name in ("stratified_split", "dp_histogram", "binary_metrics", "best_threshold", "multiclass_metrics",
                 "norm_stats", "loss_rollup", "forward_noise", "reverse_step", "timestep_draws_snr",
                 "minibatches", "exactly_n", "knn_join", "knn_classify", "num2cat", "decode_noisy_clip"):
        run(name, lambda n=name: cat.QUERIES[n](spark, sf_dir))

    # R7 at scale: noised training draws with the xxhash64 generator (K = 3)
    from quietab.operators.schedule import noise_schedule, training_draws
    sched = noise_schedule(spark, 500).cache()
    run("training_draws_xxhash_fx1", lambda: training_draws(
        state["enc"].encode(df1, keep=list(spec1.key)),  # the 6-column key is unique
        "features", list(spec1.key), sched, state["enc"].width, k=3, seed=3, hashing="xxhash"))

    # M1: DP-SGD steps on encoded FX3 train (512/256 denoiser, 500 timesteps)
    try:
        _model_jobs(spark, sf_dir, cat, fit_generator, GeneratorConfig, times, info)
    except Exception as e:
        errors["model_jobs"] = repr(e)[:300]
    run("utility_real", lambda: cat.q_utility_real(spark, sf_dir))

    total = round(sum(times.values()), 3)
    out = {"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": times,
           "info": info, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


def _model_jobs(spark, sf_dir, cat, fit_generator, GeneratorConfig, times, info):
    enc3, tr, va, te = cat._fx3_real_splits(spark, sf_dir)
    tr = tr.cache()
    n_train = tr.count()
    cfg = GeneratorConfig(d_layers=(512, 256), dim_t=128, num_timesteps=500, steps=5, sample_rate=0.02,
                          sigma=1.0, clip=1.0, k=3, lr=1e-3, seed=3, noise_seed=5)
    t0 = time.time()
    model = fit_generator(tr, "id", enc3.width, 2, [0.5, 0.5], cfg)
    fit_s = time.time() - t0
    times["dp_sgd_5_steps"] = round(fit_s, 3)
    info["dp_sgd_rows_per_step"] = round(cfg.sample_rate * n_train)
    cfg25 = GeneratorConfig(**{**cfg.__dict__, "steps": 25})
    t0 = time.time()
    fit_generator(tr, "id", enc3.width, 2, [0.5, 0.5], cfg25)
    per_step = (time.time() - t0 - fit_s) / 20
    info["dp_sgd_sec_per_step"] = round(per_step, 3)
    # BASELINE's adult configuration: 5725 optimiser steps, 21600 generated rows
    info["projected_adult_fit_sec"] = round(5725 * per_step, 1)
    # M2: generation throughput (500 reverse steps per row through the 512/256 MLP)
    n_gen = 2000
    t0 = time.time()
    enc_gen, dec_gen = model.generate(spark, n_gen, seed=4, encoder=enc3)
    dec_gen.write.format("noop").mode("overwrite").save()
    gen_s = time.time() - t0
    times["generate_2000_rows"] = round(gen_s, 3)
    info["generate_rows_per_sec"] = round(n_gen / gen_s, 1)
    info["projected_adult_sample_sec"] = round(21600 / (n_gen / gen_s), 1)


if __name__ == "__main__":
    main()
