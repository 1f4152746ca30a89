"""Standard-normal CDF and quantile, and the piecewise-linear maps of the quantile encoder.

Spark has neither ``erf`` nor a normal quantile function, so both are rational
approximations written as Column expressions (no Python in the plan): the quantile by
Wichura's AS 241 (PPND16), the CDF by Hart's rational function (West 2005) with Laplace's continued fraction in the far tails, both with a relative accuracy of 1e-13 or better.  A knot is found by Spark's
``Bucketizer``, a binary search in the JVM.  The numpy forms are the reference of the tests.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import literal_array

# fixed coefficients of AS 241 (PPND16), Wichura 1988, Applied Statistics 37(3)
_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
      1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
      3.3430575583588128105e4, 2.5090809287301226727e3]
_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
      5.2264952788528545610e3]
_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
      3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
      2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
      1.05075007164441684324e-9]
_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
      2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
      2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
      2.04426310338993978564e-15]


def _poly(coefs, x):
    out = np.zeros_like(x)
    for c in reversed(coefs):
        out = out * x + c
    return out


def ndtri(p) -> np.ndarray:
    """Inverse standard normal CDF; -inf at 0, +inf at 1, NaN outside."""
    p = np.asarray(p, dtype=np.float64)
    out = np.full(p.shape, np.nan)
    q = p - 0.5
    central = np.abs(q) <= 0.425
    if central.any():
        qc = q[central]
        r = 0.180625 - qc * qc
        out[central] = qc * _poly(_A, r) / _poly(_B, r)
    tail = ~central & (p > 0) & (p < 1)
    if tail.any():
        pt = p[tail]
        qt = q[tail]
        r = np.where(qt < 0, pt, 1.0 - pt)
        r = np.sqrt(-np.log(r))
        near = r <= 5.0
        val = np.empty_like(r)
        rn = r[near] - 1.6
        val[near] = _poly(_C, rn) / _poly(_D, rn)
        rf = r[~near] - 5.0
        val[~near] = _poly(_E, rf) / _poly(_F, rf)
        out[tail] = np.where(qt < 0, -val, val)
    out[p == 0] = -np.inf
    out[p == 1] = np.inf
    return out


def ndtr(x) -> np.ndarray:
    """Standard normal CDF, accurate in both tails."""
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in np.asarray(x, np.float64).ravel()]).reshape(np.shape(x))


# sklearn's QuantileTransformer constants (fixed values)
BOUNDS_THRESHOLD = 1e-7
_SPACING_ONE = float(np.spacing(1))
CLIP_MIN = float(ndtri(np.array([BOUNDS_THRESHOLD - _SPACING_ONE]))[0])
CLIP_MAX = float(ndtri(np.array([1 - (BOUNDS_THRESHOLD - _SPACING_ONE)]))[0])


def quantile_forward(x: np.ndarray, quantiles: np.ndarray, references: np.ndarray,
                     to_normal: bool = True) -> np.ndarray:
    """Piecewise-linear CDF (mean of forward and backward interpolation, so
    tied quantiles map to the middle of their reference range), saturating at
    the ends, then optionally the normal quantile with clipping."""
    x = np.asarray(x, dtype=np.float64).copy()
    lo_x, hi_x = quantiles[0], quantiles[-1]
    finite = ~np.isnan(x)
    lower = np.zeros(x.shape, bool)
    upper = np.zeros(x.shape, bool)
    lower[finite] = x[finite] - BOUNDS_THRESHOLD < lo_x
    upper[finite] = x[finite] + BOUNDS_THRESHOLD > hi_x
    xf = x[finite]
    x[finite] = 0.5 * (np.interp(xf, quantiles, references)
                       - np.interp(-xf, -quantiles[::-1], -references[::-1]))
    x[upper] = references[-1]
    x[lower] = references[0]
    if to_normal:
        x = np.clip(ndtri(x), CLIP_MIN, CLIP_MAX)
    return x


def quantile_inverse(y: np.ndarray, quantiles: np.ndarray, references: np.ndarray,
                     from_normal: bool = True) -> np.ndarray:
    y = np.asarray(y, dtype=np.float64)
    if from_normal:
        y = ndtr(y)
    lower = y - BOUNDS_THRESHOLD < references[0]
    upper = y + BOUNDS_THRESHOLD > references[-1]
    out = np.interp(y, references, quantiles)
    out[upper] = quantiles[-1]
    out[lower] = quantiles[0]
    return out


# --------------------------------------------------------------------------- Column expressions

# fixed coefficients of Hart's approximation (algorithm 5666), numerator and denominator by falling power
_HART_P = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376]
_HART_Q = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752]


def _horner(falling, x: Column) -> Column:
    out = F.lit(falling[0])
    for c in falling[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """P(Z <= x); 0 and 1 at the infinities, NaN stays."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    far = a  # Laplace's continued fraction
    for k in range(24, 0, -1):
        far = a + F.lit(float(k)) / far
    upper = F.when(a > 37, F.lit(0.0)).when(a < 4, e * _horner(_HART_P, a) / _horner(_HART_Q, a)) \
        .otherwise(e / far / math.sqrt(2 * math.pi))
    return F.when(F.isnan(x), x).when(x > 0, 1 - upper).otherwise(upper)


def _quantile_variable(p: Column) -> Column:
    """The variable of AS 241's polynomials: of the centre or of a tail."""
    q = p - 0.5
    return F.when(F.abs(q) <= 0.425, F.lit(0.180625) - q * q).otherwise(F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p))))


def _quantile_at(p: Column, r: Column) -> Column:
    q = p - 0.5
    size = F.when(r <= 5, _horner(_C[::-1], r - 1.6) / _horner(_D[::-1], r - 1.6)) \
        .otherwise(_horner(_E[::-1], r - 5) / _horner(_F[::-1], r - 5))
    return (F.when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf)).when(F.isnan(p) | (p < 0) | (p > 1), F.lit(math.nan))
            .when(F.abs(q) <= 0.425, q * _horner(_A[::-1], r) / _horner(_B[::-1], r))
            .otherwise(F.when(q < 0, -size).otherwise(size)))


def normal_quantile(p: Column) -> Column:
    """Inverse of the CDF: -inf at 0, +inf at 1, NaN outside.  Where p is itself an expression, add its
    stages as columns (:func:`with_normal`): an expression repeats what it uses."""
    return _quantile_at(p, _quantile_variable(p))


def with_uniform(df: DataFrame, maps: dict[str, tuple[str, np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds for each ``out: (column, quantiles, references)`` the piecewise-linear CDF of the value (mean of
    forward and backward interpolation, so tied quantiles map to the middle of their reference
    range), saturating at both ends; null is NaN.  One projection a stage: x, knot, its neighbours, result."""
    knots = {out: np.unique(q + 0.0, return_index=True) for out, (_, q, _) in maps.items()}
    df = df.withColumns({f"{out}_x": F.col(c).cast("double") for out, (c, _, _) in maps.items()})
    df = Bucketizer(inputCols=[f"{out}_x" for out in maps], outputCols=[f"{out}_k" for out in maps], handleInvalid="keep",
                    splitsArray=[[-math.inf, *q.tolist(), math.inf] for q, _ in knots.values()]).transform(df)
    near = {}
    for out, (_, quantiles, references) in maps.items():
        q, first = knots[out]
        low = references[first]
        high = references[np.append(first[1:], len(quantiles)) - 1]  # references of the first and last of equal quantiles
        i = F.col(f"{out}_k").cast("int") - 1
        for name, values, at in (("q0", q, i), ("q1", q, i + 1), ("low0", low, i), ("low1", low, i + 1), ("high0", high, i)):
            near[f"{out}_{name}"] = F.get(literal_array(values.tolist()), at)
    df, made = df.withColumns(near), {}
    for out, (_, quantiles, references) in maps.items():
        x, q0, q1, low0, low1, high0 = (F.col(f"{out}_{n}") for n in ("x", "q0", "q1", "low0", "low1", "high0"))
        slope = (low1 - high0) / (q1 - q0)
        inside = F.when(x == q0, 0.5 * (high0 + low0)).otherwise(0.5 * ((slope * (x - q0) + high0) - (slope * (q1 - x) - low1)))
        made[out] = (F.when(x.isNull() | F.isnan(x), F.lit(math.nan))
                     .when(x - BOUNDS_THRESHOLD < float(quantiles[0]), F.lit(float(references[0])))
                     .when(x + BOUNDS_THRESHOLD > float(quantiles[-1]), F.lit(float(references[-1]))).otherwise(inside))
    return df.withColumns(made)


def with_normal(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each ``out: uniform`` the normal quantile, clipped."""
    df = df.withColumns({f"{out}_r": _quantile_variable(F.col(u)) for out, u in columns.items()})
    df = df.withColumns({f"{out}_n": _quantile_at(F.col(u), F.col(f"{out}_r")) for out, u in columns.items()})
    return df.withColumns({out: F.when(F.isnan(f"{out}_n"), F.col(f"{out}_n")).otherwise(
        F.least(F.greatest(f"{out}_n", F.lit(CLIP_MIN)), F.lit(CLIP_MAX))) for out in columns})


def from_uniform(u: Column, quantiles: np.ndarray, references: np.ndarray) -> Column:
    """The inverse map of a plain column; references are evenly spaced, so the knot needs no search."""
    n = len(quantiles)
    if n == 1:
        return F.when(F.isnan(u), u).otherwise(F.lit(float(quantiles[0])))
    q, r = literal_array(quantiles.tolist()), literal_array(references.tolist())
    i = F.greatest(F.least(F.floor(u * (n - 1)), F.lit(n - 2)), F.lit(0)).cast("int")
    q0, q1, r0, r1 = F.get(q, i), F.get(q, i + 1), F.get(r, i), F.get(r, i + 1)
    return (F.when(u.isNull() | F.isnan(u), F.lit(math.nan))
            .when(u + BOUNDS_THRESHOLD > float(references[-1]), F.lit(float(quantiles[-1])))
            .when(u - BOUNDS_THRESHOLD < float(references[0]), F.lit(float(quantiles[0])))
            .otherwise((q1 - q0) / (r1 - r0) * (u - r0) + q0))
