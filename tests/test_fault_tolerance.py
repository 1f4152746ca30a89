"""Retried tasks recompute identical results (deterministic keyed randomness,
no rand(), written intermediate tables): the first attempt of every task of a
pass-through Python stage fails, Spark retries it, and the split, the DP-SGD
fit and the generated rows equal those of a clean run."""
import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r'''
import json, sys
sys.path.insert(0, ROOT)
import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from quietab import fixtures as fx
from quietab.operators.encode import fit_encoder
from quietab.operators.split import stratified_split
from quietab.plans.generator import GeneratorConfig, fit_generator
from quietab.session import checkpoint_dir

spark = (SparkSession.builder.master("local[4,4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
checkpoint_dir(spark)
FAIL = sys.argv[1] == "fail"

def flaky(it):
    ctx = TaskContext.get()
    if FAIL and ctx.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    for pdf in it:
        yield pdf

df, spec = fx.fx3(spark, "/root/testdata/sf0.001")
df = df.mapInPandas(flaky, df.schema)           # every task of this stage fails once
sp = stratified_split(df, "label", "event_id", seed=42)
split = sorted((r[0], r[1]) for r in sp.select("event_id", "split").collect())
enc = fit_encoder(df, spec)
tr = enc.encode(df, keep=["event_id", F.col("label").cast("long").alias("label")])
cfg = GeneratorConfig(d_layers=(16,), dim_t=8, num_timesteps=10, steps=3, sample_rate=0.3, seed=7, noise_seed=9)
m = fit_generator(tr, "event_id", enc.width, 2, [0.5, 0.5], cfg)
gen = m.generate(spark, 40, seed=3)
rows = sorted((r["id"], r["label"], [round(float(x), 6) for x in r["features"]]) for r in gen.collect())
print("RESULT " + json.dumps({"split": split, "theta": float(np.sum(m.params)), "gen": rows}))
'''


def _run(mode):
    code = "ROOT = %r\n" % ROOT + SCRIPT
    out = subprocess.run([sys.executable, "-c", code, mode], capture_output=True, text=True, timeout=900)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT ")]
    assert line, out.stderr[-3000:]
    res = json.loads(line[0][len("RESULT "):])
    res["failures"] = (out.stdout + out.stderr).count("injected task failure")
    return res


def test_retried_tasks_give_identical_results():
    clean, flaky = _run("clean"), _run("fail")
    assert clean["failures"] == 0 and flaky["failures"] > 0  # the retries really happened
    assert clean["split"] == flaky["split"]
    assert abs(clean["theta"] - flaky["theta"]) < 1e-9 * (1 + abs(clean["theta"]))
    assert clean["gen"] == flaky["gen"]
