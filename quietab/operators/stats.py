"""A10 row-norm statistics, A19 loss roll-up, H15 Gaussian KL of column
moments, H16 discretised Gaussian log-likelihood."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import l2_norm
from .quantiles import grouped_quantiles


def norm_stats(df: DataFrame, vec: str, by=(), q: float = 0.5) -> DataFrame:
    """A10: per group, the q-quantile (linear interpolation), mean, population
    std, max and min of the rows' L2 norms."""
    by = list(by)
    n = F.col("__norm")
    moments = {"mean": F.avg(n), "std": F.stddev_pop(n), "max": F.max(n), "min": F.min(n)}
    d = df.select(*by, l2_norm(F.col(vec)).alias("__norm"))
    return grouped_quantiles(d, "__norm", by, [q], [f"p{int(round(q * 100))}"], moments)


def loss_rollup(log: DataFrame, k: str = "k", loss: str = "loss", n: str = "n", every: int = 10,
                digits: int = 3) -> DataFrame:
    """Batch-size-weighted mean loss per logging window.

    Batch k (0-based) falls in window ``floor((k+1)/every)``; window b closes
    after batch ``every*(b+1) - 2`` and is labelled step ``every*(b+1)`` (the
    first window therefore spans every-1 batches).  Only closed windows are
    reported; the mean is half-even rounded to ``digits``.
    """
    b = F.floor((F.col(k) + 1) / every).cast("long")
    g = log.groupBy(b.alias("window")).agg(
        (F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("__m"), F.max(k).alias("__last"))
    closed = g.where(F.col("__last") >= F.col("window") * every + every - 2)
    return closed.select(((F.col("window") + 1) * every).alias("step"),
                         F.bround("__m", digits).alias("loss"))


def normal_divergence(m1: Column, lv1: Column, m2: Column, lv2: Column) -> Column:
    """KL(N(m1, e^lv1) || N(m2, e^lv2)): half of ratio - 1 - ln(ratio) for the
    ratio of the variances, plus half the squared shift in units of the second."""
    log_ratio = lv1 - lv2
    shift = F.pow(m1 - m2, F.lit(2)) / F.exp(lv2)
    return (F.expm1(log_ratio) - log_ratio + shift) / 2


def gaussian_kl(real: DataFrame, synth: DataFrame, cols) -> DataFrame:
    """H15 re-aimed: per column, KL between Gaussians fitted to real and
    synthetic moments (population variance).  Two one-pass aggregations."""
    cols = list(cols)

    def moments(df, tag):
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.avg(c).alias(f"m{i}"), F.log(F.var_pop(c)).alias(f"lv{i}")]
        r = df.agg(*aggs).first()
        return r

    a, b = moments(real, "r"), moments(synth, "s")
    rows = [(c, a[f"m{i}"], a[f"lv{i}"], b[f"m{i}"], b[f"lv{i}"]) for i, c in enumerate(cols)]
    t = real.sparkSession.createDataFrame(rows, "col string, m1 double, lv1 double, m2 double, lv2 double")
    return t.select("col", normal_divergence(F.col("m1"), F.col("lv1"), F.col("m2"), F.col("lv2")).alias("kl"))


def _normal_cdf(z: Column) -> Column:
    """Page's (1977) approximation: a logistic curve of a cubic."""
    return 1.0 / (1.0 + F.exp(F.lit(-math.sqrt(8.0 / math.pi)) * (z + 0.044715 * z * z * z)))


def binned_normal_logprob(x: Column, mean: Column, log_scale: Column, levels: int = 256) -> Column:
    """Log-mass that a normal puts on the cell of x, for ``levels`` equal cells on
    [-1, 1] whose outermost ones reach to infinity (Ho et al., 2020, sec. 3.3); the
    mass is at least 1e-12."""
    half = 1.0 / (levels - 1)
    below = F.when(x < -0.999, F.lit(0.0)).otherwise(_normal_cdf((x - half - mean) / F.exp(log_scale)))
    upto = F.when(x > 0.999, F.lit(1.0)).otherwise(_normal_cdf((x + half - mean) / F.exp(log_scale)))
    return F.log(F.greatest(upto - below, F.lit(1e-12)))


def mean_log_likelihood(df: DataFrame, x: str, mean: str, log_scale: str, by=()) -> DataFrame:
    """H16 re-aimed: average discretised log-likelihood per group."""
    by = list(by)
    ll = binned_normal_logprob(F.col(x), F.col(mean), F.col(log_scale))
    return df.groupBy(*by).agg(F.avg(ll).alias("mean_log_likelihood"), F.count(F.lit(1)).alias("n"))
