"""End-to-end private synthesis of one table from the command line.

    python tools/synthesize.py --input data.csv --label y --key id --out /shared/run1 \
        [--format csv|parquet] [--num-encoder minmax|standard|quantile] [--cat-encoder bits|onehot] \
        [--steps 200 --sample-rate 0.02 --sigma 1.0 --clip 1.0 --k 3 --lr 1e-3] [--no-dp] \
        [--samples N] [--eval tree,logistic] [--eval-real]

Writes under --out: splits/ (partitioned by split), synthetic/ (decoded rows),
metrics/ (model, split, metric, value), ledger/ (every released statistic),
encoder/, label/ and generator/ (fitted state as small tables).
"""

from __future__ import annotations

import argparse
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--input", required=True)
    ap.add_argument("--format", default="csv")
    ap.add_argument("--label", default=None, help="label column (default: last column)")
    ap.add_argument("--key", required=True, help="unique row key column")
    ap.add_argument("--out", required=True)
    ap.add_argument("--num-encoder", default="minmax")
    ap.add_argument("--cat-encoder", default="bits")
    ap.add_argument("--steps", type=int, default=200)
    ap.add_argument("--sample-rate", type=float, default=0.02)
    ap.add_argument("--sigma", type=float, default=1.0)
    ap.add_argument("--clip", type=float, default=1.0)
    ap.add_argument("--k", type=int, default=3)
    ap.add_argument("--lr", type=float, default=1e-3)
    ap.add_argument("--layers", default="512,256")
    ap.add_argument("--timesteps", type=int, default=500)
    ap.add_argument("--no-dp", action="store_true")
    ap.add_argument("--samples", type=int, default=None)
    ap.add_argument("--eval", default="tree,logistic")
    ap.add_argument("--eval-raw", default="gbt", help="models on raw columns")
    ap.add_argument("--run-folder", default=None, help="shared folder of a resumable run")
    ap.add_argument("--eval-real", action="store_true", help="train the evaluators on real rows (the ceiling)")
    a = ap.parse_args(argv)

    from quietab.plans.generator import GeneratorConfig
    from quietab.plans.end_to_end import EndToEndConfig, run_end_to_end
    from quietab.session import get_session
    from quietab.sources.tables import read_table, write_metrics, write_table
    from quietab.spec import TableSpec

    spark = get_session()
    df = read_table(spark, a.input, a.format)
    spec = TableSpec.infer(df, label=a.label, key=a.key)
    gen = GeneratorConfig(d_layers=tuple(int(x) for x in a.layers.split(",") if x), num_timesteps=a.timesteps,
                          steps=a.steps, sample_rate=a.sample_rate, sigma=a.sigma, clip=a.clip, k=a.k, lr=a.lr,
                          dp=not a.no_dp)
    cfg = EndToEndConfig(num_kind=a.num_encoder, cat_kind=a.cat_encoder, generator=gen, n_samples=a.samples,
                         eval_models=tuple(m for m in a.eval.split(",") if m),
                         eval_raw=tuple(m for m in a.eval_raw.split(",") if m),
                         eval_type="real" if a.eval_real else "synthetic")
    out = run_end_to_end(df, spec, cfg, a.run_folder)
    write_table(out["splits"], os.path.join(a.out, "splits"), "parquet", partition_by="split")
    write_metrics(out["metrics"], os.path.join(a.out, "metrics"), "json")
    out["ledger"].to_df(spark).write.mode("overwrite").json(os.path.join(a.out, "ledger"))
    out["encoder"].save(spark, os.path.join(a.out, "encoder"))
    out["label_model"].save(spark, os.path.join(a.out, "label"))
    if "model" in out:
        out["model"].save(spark, os.path.join(a.out, "generator"))
        write_table(out["synthetic"], os.path.join(a.out, "synthetic"), "parquet")
    out["metrics"].orderBy("model", "split", "metric").show(100, truncate=False)


if __name__ == "__main__":
    main()
