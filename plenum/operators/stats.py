"""Group comparisons: Welch, Cohen, Mann-Whitney, Wilcoxon, Spearman, ellipses. Sums are distributed; p-values are one pandas UDF."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import average_ranks


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null for nulls or no freedom."""
    return pd.Series([None if not (np.isfinite(a) and np.isfinite(b) and b > 0) else t_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_of_z(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return pd.Series([None if not np.isfinite(v) else math.erfc(abs(v) / math.sqrt(2)) for v in z.astype(float)], dtype="float64")


def welch(df: DataFrame, keys: list[str], group: str, one: str, two: str, value: str, least: int = 5) -> DataFrame:
    """(keys, n, means, gap, t, df, cohen_d) of two groups of `least` values or more."""
    a, b = F.col(group) == one, F.col(group) == two
    g = df.groupBy(*keys).agg(*[f(F.when(k, F.col(value))).alias(f"{n}_{s}") for s, k in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    g = g.filter((F.col("n_a") >= least) & (F.col("n_b") >= least))
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    gap, pooled = F.col("m_a") - F.col("m_b"), F.sqrt((F.col("v_a") + F.col("v_b")) / 2)
    t = F.when(sa + sb > 0, gap / F.sqrt(sa + sb))
    free = F.when(sa + sb > 0, F.pow(sa + sb, 2) / (sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)))
    return g.select(*keys, "n_a", "n_b", F.round(gap, 6).alias("gap"), F.round(t, 5).alias("t"), F.round(free, 4).alias("df"), F.round(F.when(pooled > 0, gap / pooled), 5).alias("cohen_d"))


def correlation(x: str, y: str):
    """Pearson's correlation, null where one side does not vary."""
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(spread > 0, F.covar_samp(x, y) / F.when(spread > 0, spread))


def mann_whitney(df: DataFrame, keys: list[str], group: str, one: str, two: str, value: str) -> DataFrame:
    """(keys, n_a, n_b, u, z): U of the first group and its tie-corrected normal deviate."""
    r = average_ranks(df.filter(F.col(group).isin(one, two) & F.col(value).isNotNull()), keys, value)
    ties = r.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    g = r.groupBy(*keys).agg(F.count_if(F.col(group) == one).alias("n_a"), F.count_if(F.col(group) == two).alias("n_b"), F.sum(F.when(F.col(group) == one, F.col("rank"))).alias("ra")).join(ties, keys)
    na, nb = F.col("n_a"), F.col("n_b")
    n, u = na + nb, F.col("ra") - na * (na + 1) / 2
    var = na * nb / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return g.filter((na > 0) & (nb > 0)).select(*keys, "n_a", "n_b", F.round(u, 2).alias("u"), F.round(F.when(var > 0, (u - na * nb / 2.0) / F.sqrt(var)), 5).alias("z"))


def wilcoxon(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, W+ and W- of the non-zero values, and the tie-corrected normal deviate."""
    r = average_ranks(df.filter(F.col(value) != 0).select(F.abs(value).alias("x"), (F.col(value) > 0).alias("up"), F.col(value).alias("v")), [], "x")
    ties = r.groupBy("x").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    g = r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_delta"), F.coalesce(F.sum(F.when(F.col("up"), F.col("rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(~F.col("up"), F.col("rank"))), F.lit(0.0)).alias("w_minus")).crossJoin(ties)  # one row each
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return g.select("n", "mean_delta", "w_plus", "w_minus", F.round(F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(var)), 5).alias("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rank correlation of a small table (terms, parties); under three rows null."""
    r = average_ranks(average_ranks(df.select(x, y).dropna(), [], x, "rx"), [], y, "ry")
    return r.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.round(correlation("rx", "ry"), 6)).alias("rho"))


def ellipse(df: DataFrame, keys: list[str], x: str, y: str, sd: float = 1.0) -> DataFrame:
    """(keys, n, cx, cy, pearson, radius_x, radius_y) of the covariance ellipse; three points or more."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), correlation(x, y).alias("r"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy")).filter("n >= 3")
    return g.select(*keys, "n", F.round("mx", 6).alias("cx"), F.round("my", 6).alias("cy"), F.round("r", 6).alias("pearson"), F.round(F.sqrt(1 + F.col("r")) * F.col("sx") * sd, 6).alias("radius_x"), F.round(F.sqrt(1 - F.col("r")) * F.col("sy") * sd, 6).alias("radius_y"))
