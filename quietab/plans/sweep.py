"""Random-search parameter sweep.

Parameter sets are rows of a table drawn with the seeded uniform (log-uniform
for rates, integer ranges for sizes); each trial runs a distributed job and
appends its validation metrics; the best trial is an ``max_by`` aggregate.
The driver loop runs over trials (a bounded, user-chosen count), never over
data rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import u
from ..operators.metrics import average_metrics, best_run


def draw_params(spark: SparkSession, space: dict, n_trials: int, seed: int = 0) -> DataFrame:
    """``space``: name -> ("loguniform", lo, hi) | ("int", lo, hi) | ("uniform", lo, hi) | ("choice", [..])."""
    t = spark.range(n_trials).select(F.col("id").alias("run_id"))
    cols = {}
    for name, spec in space.items():
        x = u(seed, F.col("run_id"), name)
        kind = spec[0]
        if kind == "loguniform":
            lo, hi = math.log(spec[1]), math.log(spec[2])
            cols[name] = F.exp(F.lit(lo) + x * (hi - lo))
        elif kind == "uniform":
            cols[name] = F.lit(spec[1]) + x * (spec[2] - spec[1])
        elif kind == "int":
            cols[name] = (F.lit(spec[1]) + F.floor(x * (spec[2] - spec[1] + 1))).cast("long")
        elif kind == "choice":
            arr = F.array(*[F.lit(v) for v in spec[1]])
            cols[name] = F.element_at(arr, (F.floor(x * len(spec[1])) + 1).cast("int"))
        else:
            raise ValueError(f"unknown parameter kind: {kind}")
    return t.withColumns(cols)


def sweep(param_table: DataFrame, run, metric: str = "roc_auc", split: str = "val",
          seeds=(0,), parallel: int = 1) -> tuple[DataFrame, DataFrame]:
    """Run ``run(params: dict, seed) -> metrics (model, split, metric, value)``
    for every parameter row and seed; return (runs table, best run).

    ``parallel > 1`` submits trials from that many driver threads: each trial
    is its own set of Spark jobs, so small trials share the cluster instead of
    queueing (Spark schedules jobs from concurrent threads)."""
    from concurrent.futures import ThreadPoolExecutor

    trials = [(row.asDict(), s) for row in param_table.collect() for s in seeds]  # bounded: trials x seeds

    def one(item):
        params, s = item
        m = run(params, s).withColumn("run_id", F.lit(params["run_id"])).withColumn("seed", F.lit(s))
        rows = m.collect()  # a handful of metric rows per trial
        return rows, m.schema

    if parallel > 1:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            done = list(pool.map(one, trials))
    else:
        done = [one(t) for t in trials]
    spark = param_table.sparkSession
    runs = spark.createDataFrame([r for rows, _ in done for r in rows], done[0][1])
    per_run = average_metrics(runs.where((F.col("split") == split) & (F.col("metric") == metric)),
                              by=("run_id",)).withColumnRenamed("value", "score")
    scored = per_run.join(param_table, "run_id")
    pcols = [c for c in param_table.columns if c != "run_id"]
    return runs, best_run(scored, "score", "run_id", pcols)


def layer_widths(p: dict) -> tuple:
    """Hidden layers from a drawn number of them and log2 widths of the first, the middle and the last."""
    n = int(p["n_layers"])
    first, middle, last = (2 ** int(p[f"{k}_log2"]) for k in ("first", "middle", "last"))
    return (first,) if n == 1 else (first, *[middle] * (n - 2), last)


#: the denoiser's search space: layers of 128 to 1024 units, learning rate, steps
GENERATOR_SPACE = {"n_layers": ("int", 1, 4), "first_log2": ("int", 7, 10), "middle_log2": ("int", 7, 10), "last_log2": ("int", 7, 10),
                   "lr": ("loguniform", 1e-5, 3e-3), "steps": ("choice", [500, 1000, 2000])}


def tune_generator(df: DataFrame, spec, cfg, folder: str, n_trials: int = 30, seeds=range(5), space: dict | None = None,
                   metric: str = "roc_auc", split: str = "val", seed: int = 0) -> dict:
    """M10 over M11: every trial fits a denoiser of drawn layers, widths, rate and steps, samples it with each of the
    seeds and scores the samples; the best mean validation score wins.  All trials share the stages of one run
    folder (splits, encoders and histogram are made once, a killed sweep resumes).

    Returns ``runs`` (all metrics), ``best`` (its parameters and score), ``config`` (of the best) and ``report``, the best
    trial's metrics averaged over the seeds."""
    from dataclasses import replace

    from .end_to_end import run_end_to_end
    table = draw_params(df.sparkSession, space or GENERATOR_SPACE, n_trials, seed)

    def config(p: dict, s: int):
        changed = {k: type(getattr(cfg.generator, k))(p[k]) for k in ("lr", "steps") if k in p}
        if "n_layers" in p:
            changed["d_layers"] = layer_widths(p)
        return replace(cfg, generator=replace(cfg.generator, **changed), sample_seed=s)

    runs, best = sweep(table, lambda p, s: run_end_to_end(df, spec, config(p, s), folder)["metrics"], metric, split, tuple(seeds))
    won = best.first().asDict()
    own = runs.where(F.col("run_id") == won["run_id"])
    return {"runs": runs, "best": best, "config": config(won, tuple(seeds)[0]),
            "report": average_metrics(own, by=("model", "split", "metric"))}
