"""W6 equals the plain window; the split is exact and partition-independent."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from quietab import fixtures as fx
from quietab.operators.rank import global_rank, running_totals
from quietab.operators.split import stratified_split

from conftest import SF_SMALL


def test_running_totals_equal_plain_window(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    got = running_totals(ev, ["value", "event_id"], {"cum": F.col("user_id")}, by=["event_type"], buckets=7)
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    ref = ev.withColumns({"cum": F.sum("user_id").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                          "rank": F.row_number().over(w).cast("long")})
    cols = ["event_id", "rank", "cum"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, ref.select(cols).collect()))


def test_global_rank_strings(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source")
    got = global_rank(docs, ["source", "doc_id"], buckets=5)
    ref = docs.withColumn("rank", F.row_number().over(Window.orderBy("source", "doc_id")).cast("long"))
    assert sorted(map(tuple, got.select("doc_id", "rank").collect())) == \
        sorted(map(tuple, ref.select("doc_id", "rank").collect()))


def test_split_sizes_and_partition_invariance(spark):
    df, spec = fx.fx3(spark, SF_SMALL)
    outs = []
    for parts in (1, 3, 16):
        sp = stratified_split(df.repartition(parts), "label", "event_id", seed=42)
        outs.append(sorted(map(tuple, sp.select("event_id", "split").collect())))
    assert outs[0] == outs[1] == outs[2]
    sp = stratified_split(df, "label", "event_id", seed=42)
    counts = {(r["label"], r["split"]): r["count"] for r in sp.groupBy("label", "split").count().collect()}
    for lab in (0, 1):
        n = sum(v for (l, _), v in counts.items() if l == lab)
        assert counts[(lab, "train")] == int(0.6 * n + 0.5)
        assert counts[(lab, "train")] + counts[(lab, "val")] == int(0.8 * n + 0.5)
    assert sum(counts.values()) == df.count()


def test_sampling_ops_partition_invariant(spark):
    from quietab.functions.rand import u
    from quietab.operators.private import dp_histogram
    from quietab.operators.sampling import exactly_n, minibatches, poisson_sample
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    outs = []
    for parts in (1, 3, 16):
        d = ev.repartition(parts)
        ps = sorted(r[0] for r in poisson_sample(d, 0.3, "event_id", 9, 5).select("event_id").collect())
        mb = sorted(map(tuple, minibatches(d, "event_id", 64, 9, 2).select("event_id", "batch").collect()))
        ex = sorted(r[0] for r in exactly_n(d.withColumn("ok", u(13, F.col("event_id")) < 0.7), 300,
                                             "event_id", "ok").select("event_id").collect())
        dp = sorted(map(tuple, dp_histogram(d, "event_type", ["click", "error", "purchase", "signup", "view"],
                                            seed=3).select("event_type", "noisy").collect()))
        outs.append((ps, mb, ex, dp))
    assert outs[0] == outs[1] == outs[2]
    assert len(outs[0][2]) == 300
