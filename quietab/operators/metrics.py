"""Classification metrics as aggregations over a prediction table.

A prediction table has ``by`` columns (e.g. model, split), the true label and
either a positive-class score (binary) or a probability array (multiclass).
Every metric is a groupBy over that table; ROC-AUC uses per-distinct-score
counts and a bucketed running sum, so no window ever spans all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..session import materialise
from .bounded import broadcast_checked
from .rank import running_totals


def predict_label(score: Column, threshold: float = 0.5) -> Column:
    """P12 binary: strictly above the threshold is class 1."""
    return (score > F.lit(threshold)).cast("long")


def predict_class(probs: Column) -> Column:
    """P12 multiclass: arg-max, first wins."""
    return argmax(probs)


def accuracy_f1(df: DataFrame, y: str, pred: str, by=()) -> DataFrame:
    """A11 + A12: accuracy and positive-class F1 (0 when undefined)."""
    by = list(by)
    tp = F.sum(((F.col(y) == 1) & (F.col(pred) == 1)).cast("long"))
    fp = F.sum(((F.col(y) != 1) & (F.col(pred) == 1)).cast("long"))
    fn = F.sum(((F.col(y) == 1) & (F.col(pred) != 1)).cast("long"))
    acc = F.avg((F.col(y) == F.col(pred)).cast("double"))
    g = df.groupBy(*by).agg(acc.alias("accuracy"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(F.lit(0.0))
    return g.select(*by, "accuracy", f1.alias("f1"))


def macro_f1(df: DataFrame, y: str, pred: str, by=()) -> DataFrame:
    """Per-class F1 over the union of true and predicted labels, averaged."""
    by = list(by)
    cm = df.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("n"))
    return macro_f1_from_counts(cm, y, pred, by)


def macro_f1_from_counts(cm: DataFrame, y: str, pred: str, by=()) -> DataFrame:
    by = list(by)
    as_true = cm.groupBy(*by, F.col(y).alias("cls")).agg(
        F.sum(F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("n_true"))
    as_pred = cm.groupBy(*by, F.col(pred).alias("cls")).agg(F.sum("n").alias("n_pred"))
    per = as_true.join(as_pred, on=[*by, "cls"], how="full_outer").select(
        *by, "cls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n_true", F.lit(0)).alias("n_true"),
        F.coalesce("n_pred", F.lit(0)).alias("n_pred"))
    denom = F.col("n_true") + F.col("n_pred")
    f1 = F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(0.0)
    return per.groupBy(*by).agg(F.avg(f1).alias("f1_macro"))


def roc_auc(df: DataFrame, y: str, score: str, by=(), positive=1) -> DataFrame:
    """Mann-Whitney AUC with ties counted half; null when one class is absent.

    Rows collapse to one per distinct (group, score) first; the running
    negative count over ascending scores uses the bucketed prefix sum.
    """
    by = list(by)
    pos = (F.col(y) == F.lit(positive)).cast("long")
    g = df.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(
        F.sum(pos).alias("__pos"), F.sum(1 - pos).alias("__neg"))
    run = running_totals(g, ["__s"], {"__neg_le": F.col("__neg")}, by=by, rank_col=None)
    contrib = F.col("__pos") * (F.col("__neg_le") - F.col("__neg") + F.col("__neg") / 2.0)
    t = run.groupBy(*by).agg(F.sum(contrib).alias("__num"), F.sum("__pos").alias("__P"),
                            F.sum("__neg").alias("__N"))
    auc = F.when((F.col("__P") > 0) & (F.col("__N") > 0), F.col("__num") / (F.col("__P") * F.col("__N")))
    return t.select(*by, auc.alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, y: str, probs: str, by=()) -> DataFrame:
    """One-vs-rest AUC per class, unweighted mean over classes present."""
    by = list(by)
    ex = df.select(*by, y, F.posexplode(probs).alias("__cls", "__p"))
    ex = ex.withColumn("__is", (F.col(y) == F.col("__cls")).cast("long"))
    per = roc_auc(ex, "__is", "__p", by=[*by, "__cls"])
    return per.groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc"))


def _grouped(df: DataFrame, by):
    """Ungrouped metrics run as one constant group."""
    by = list(by)
    if by:
        return df, by, by
    return df.withColumn("__all", F.lit(0)), ["__all"], []


def _combine(parts, by, cols):
    """Side-by-side columns of per-group metric tables without a join: union
    (missing columns null) and one small group-by.  Ungrouped (one-row) tables
    would otherwise be joined on a constant, which plans as a cross join."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.groupBy(*by).agg(*[F.max(c).alias(c) for c in cols])


def binary_report(df: DataFrame, y: str, score: str, by=(), threshold: float = 0.5) -> DataFrame:
    """f1 / accuracy / roc_auc per group for a binary prediction table."""
    df, gb, out = _grouped(df, by)
    p = df.withColumn("__pred", predict_label(F.col(score), threshold))
    a = accuracy_f1(p, y, "__pred", gb)
    r = roc_auc(df, y, score, gb)
    return _combine([a, r], gb, ["f1", "accuracy", "roc_auc"]).select(*out, "f1", "accuracy", "roc_auc")


def multiclass_report(df: DataFrame, y: str, probs: str, by=()) -> DataFrame:
    """macro F1 / accuracy / one-vs-rest ROC-AUC per group; accuracy comes from
    the same confusion counts as F1 (one pass over the predictions)."""
    df, gb, out = _grouped(df, by)
    p = df.withColumn("__pred", predict_class(F.col(probs)))
    cm = materialise(p.groupBy(*gb, y, "__pred").agg(F.count(F.lit(1)).alias("n")), "confusion")
    f1 = macro_f1_from_counts(cm, y, "__pred", gb)
    acc = cm.groupBy(*gb).agg((F.sum(F.when(F.col(y) == F.col("__pred"), F.col("n")).otherwise(0))
                               / F.sum("n")).alias("accuracy"))
    auc = roc_auc_ovr(df, y, probs, gb)
    res = _combine([f1, acc, auc], gb, ["f1_macro", "accuracy", "roc_auc"])
    return res.select(*out, F.col("f1_macro").alias("f1"), "accuracy", "roc_auc")


def best_threshold(df: DataFrame, y: str, score: str, by=(), compat: bool = False) -> DataFrame:
    """The score threshold maximising F1 on the PR curve
    (predict positive when score >= threshold); ties pick the lowest threshold.
    ``compat=True`` returns the next lower distinct score instead (Q12)."""
    df, by, out_by = _grouped(df, by)
    pos = (F.col(y) == 1).cast("long")
    g = df.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(
        F.sum(pos).alias("__pos"), F.sum(1 - pos).alias("__neg"))
    # running counts in descending score order == ascending order of -score
    g = g.withColumn("__ns", -F.col("__s"))
    run = running_totals(g, ["__ns"], {"tp": F.col("__pos"), "fp": F.col("__neg")}, by=by, rank_col="__r")
    tot = run.groupBy(*by).agg(F.sum("__pos").alias("__P"))
    j = run.join(broadcast_checked(tot), on=by, how="inner")  # one row per group
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.when(F.col("__P") > 0, F.col("tp") / F.col("__P"))  # no positive: no threshold
    f1 = 2 * prec * rec / (prec + rec + F.lit(1e-8))
    j = j.withColumn("f1", f1)
    best = j.groupBy(*by).agg(F.max_by(F.struct("__s", "f1", "__r"),
                                        F.when(F.col("f1").isNotNull(), F.struct(F.col("f1"), -F.col("__s"))))
                               .alias("b"))
    best = best.select(*by, F.col("b.__s").alias("threshold"), F.col("b.f1").alias("f1"),
                       F.col("b.__r").alias("__r"))
    if not compat:
        return best.select(*out_by, "threshold", "f1")
    nxt = j.select(*by, F.col("__r"), F.col("__s").alias("__prev"))
    res = best.withColumn("__r", F.col("__r") + 1).join(nxt, on=[*by, "__r"], how="left")
    return res.select(*out_by, F.coalesce("__prev", "threshold").alias("threshold"), "f1")


def average_metrics(runs: DataFrame, by=("split", "metric"), value: str = "value", digits: int = 4) -> DataFrame:
    """Mean of each metric over models/seeds, half-even rounded."""
    by = list(by)
    return runs.groupBy(*by).agg(F.bround(F.avg(value), digits).alias("value"),
                                 F.count(F.lit(1)).alias("n_runs"))


def best_run(runs: DataFrame, score: str, run_id: str, params, by=()) -> DataFrame:
    """Arg-max of the score; ties go to the lowest run id; a null or NaN
    score never wins (a group with no other score gives nulls)."""
    by = list(by)
    params = list(params)
    best = F.max_by(F.struct(F.col(run_id), F.col(score), *[F.col(p) for p in params]),
                    F.when(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")), F.struct(F.col(score), -F.col(run_id))))
    return runs.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
