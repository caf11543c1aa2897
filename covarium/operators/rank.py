"""Rank correlation, least squares and resampling over result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covarium.functions.distributions import NORMAL, fisher_interval


#: Ranges of values whose counts are summed to number them without ordering all in one task.
RANGES = 64


def average_rank(df: DataFrame, column: str, output: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, equals share their mean rank.

    Without ``keys`` distinct values are counted, ranged by quantiles of a sketch and
    numbered in their range behind the counts of the ranges before.
    """
    keys = list(keys)
    if keys:
        tied = Window.partitionBy(*keys, column)
        return df.withColumn(output, F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (F.count(F.lit(1)).over(tied) - 1) / 2)
    value = F.col(column).cast("double")
    bounds = sorted(set(df.select(value.alias("v")).approxQuantile("v", [k / RANGES for k in range(1, RANGES)], 0.01)))
    part = sum(((value > b).cast("int") for b in bounds), F.lit(0))
    cells = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rank_n")).withColumn("rank_part", part)
    sums = cells.groupBy("rank_part").agg(F.sum("rank_n").alias("rank_sum"))  # a row for each range
    starts = sums.select("rank_part", (F.sum("rank_sum").over(Window.orderBy("rank_part")) - F.col("rank_sum")).alias("rank_start"))
    before = Window.partitionBy("rank_part").orderBy(column)
    numbered = cells.withColumn("rank_before", F.sum("rank_n").over(before) - F.col("rank_n")).join(F.broadcast(starts), "rank_part")
    ranks = numbered.select(column, (F.col("rank_start") + F.col("rank_before") + (F.col("rank_n") + 1) / 2).alias(output))
    return df.join(ranks, column, "left")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    ranked = average_rank(average_rank(df, x, "rank_x", keys), y, "rank_y", keys)
    return ranked.groupBy(*keys).agg(F.corr("rank_x", "rank_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def ols(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Spearman correlation of the residuals of both on 1 and ln z."""
    logged = df.withColumn("log_z", F.log(z))
    line = logged.agg(*(f(F.col(v), F.col("log_z")).alias(f"{n}_{v}") for v in (x, y) for f, n in ((F.regr_slope, "slope"), (F.regr_intercept, "cut"))))
    both = logged.join(F.broadcast(line))  # one row of four numbers
    left = both.select(*((F.col(v) - F.col(f"cut_{v}") - F.col(f"slope_{v}") * F.col("log_z")).alias(o) for v, o in ((x, "res_x"), (y, "res_y"))))
    return spearman(left, "res_x", "res_y")


def group_mean_join_back(df: DataFrame, keys: Sequence[str], value: str, least: float, order: Sequence[str] = ()) -> DataFrame:
    """Rows of groups whose mean ``value`` is over ``least``, with that mean.

    A sum of doubles depends on the order of its terms, by which a mean near
    ``least`` or near a rounding tie falls on either side. With ``order`` values are
    added in that order, however rows are dealt to partitions.
    """
    group = Window.partitionBy(*keys)
    if order:
        group = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("group_mean", F.avg(value).over(group)).where(F.col("group_mean") > least)


def jackknife(df: DataFrame, value: str = "d") -> DataFrame:
    """Leave-one-out means of each row, from the total: no pairs."""
    whole = df.agg(F.sum(value).alias("loo_sum"), F.count(value).alias("loo_n"))  # one row
    return df.join(F.broadcast(whole)).withColumn("loo_mean", (F.col("loo_sum") - F.col(value)) / (F.col("loo_n") - 1)).drop("loo_sum", "loo_n")


@dataclass(frozen=True)
class Bootstrap:
    estimate: float
    lower: float
    upper: float
    method: str
    n_resamples: int

    @property
    def width(self) -> float:
        return self.upper - self.lower

    def contains(self, value: float) -> bool:
        return self.lower <= value <= self.upper


def bootstrap_ci(values: Sequence[float], statistic: Callable = np.mean, confidence: float = 0.95, n_resamples: int = 10_000, method: str = "bca", seed: int = 0) -> Bootstrap:
    """Seeded bootstrap of a few values on the driver: percentile, or bias-corrected and accelerated."""
    x = np.asarray(values, float)
    if len(x) < 2 or method not in ("bca", "percentile"):
        raise ValueError("two values or more; method is bca or percentile")
    rng = np.random.default_rng(seed)
    draws = np.array([statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n_resamples)])
    estimate, tail = float(statistic(x)), (1 - confidence) / 2
    levels = (tail, 1 - tail)
    if method == "bca":
        below = float((draws < estimate).mean())
        left_out = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
        dev = left_out.mean() - left_out
        spread = (dev**2).sum()
        if 0 < below < 1 and spread > 0:
            z0, a = NORMAL.inv_cdf(below), (dev**3).sum() / (6 * spread**1.5)
            shift = lambda z: NORMAL.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
            levels = tuple(shift(NORMAL.inv_cdf(q)) for q in levels)
        else:
            method = "percentile"
    lower, upper = np.quantile(draws, levels)
    return Bootstrap(estimate, float(lower), float(upper), method, n_resamples)


def distributed_bootstrap(df: DataFrame, value: str, n_resamples: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``estimate, lower, upper`` of the mean by the Poisson bootstrap: each row is drawn a Poisson number of times in every resample.

    Each partition gives one weighted sum for a resample, so what is shuffled is
    resamples times partitions, whatever the rows.
    """

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        top, low, plain, n = np.zeros(n_resamples), np.zeros(n_resamples), 0.0, 0
        for pdf in batches:
            for k in range(0, len(pdf), 4096):
                x = pdf["v"].to_numpy(float)[k : k + 4096]
                w = rng.poisson(1.0, (n_resamples, len(x)))
                top, low, plain, n = top + w @ x, low + w.sum(axis=1), plain + x.sum(), n + len(x)
        yield pd.DataFrame({"r": np.arange(n_resamples), "s": top, "w": low, "t": plain, "n": float(n)})

    parts = df.select(F.col(value).cast("double").alias("v")).mapInPandas(run, "r long, s double, w double, t double, n double")
    means = parts.groupBy("r").agg((F.sum("s") / F.sum("w")).alias("m"), (F.sum("t") / F.sum("n")).alias("e"))
    tail = (1 - confidence) / 2
    return means.agg(F.max("e").alias("estimate"), F.percentile("m", tail).alias("lower"), F.percentile("m", 1 - tail).alias("upper"))


def spearman_ci(x: Sequence[float], y: Sequence[float], n_boot: int = 2000, seed: int = 0) -> dict:
    """Rho with a percentile bootstrap, which drops degenerate draws and gives up if few are left, and Fisher's interval."""
    from pandas import Series

    x, y = np.asarray(x, float), np.asarray(y, float)
    rho = lambda a, b: float(np.corrcoef(Series(a).rank(), Series(b).rank())[0, 1])
    rng, draws = np.random.default_rng(seed), []
    for _ in range(n_boot):
        at = rng.integers(0, len(x), len(x))
        if len(set(x[at])) > 1 and len(set(y[at])) > 1:
            draws.append(rho(x[at], y[at]))
    seen = rho(x, y)
    usable = len(draws) >= n_boot / 10
    return {"rho": seen, "n": len(x), "bootstrap": tuple(np.quantile(draws, (0.025, 0.975))) if usable else None, "fisher": fisher_interval(seen, len(x))}


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``n, mean, std, least, q25, q50, q75, most`` of a column by group, quartiles interpolated."""
    quarters = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), quarters.alias("q"), F.max(value).alias("most"))
    return out.select(*keys, "n", "mean", "std", "least", *(F.get("q", F.lit(k)).alias(f"q{25 * (k + 1)}") for k in range(3)), "most")


def slope_error(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """``slope, se, n`` of a least-squares line by group: the interval is the slope and its error times a t quantile of n - 2."""
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_count(y, x).alias("n"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    return out.select(*keys, "slope", F.sqrt(rest / (F.col("n") - 2) / F.col("sxx")).alias("se"), "n")


def slope_interval(slope: float, se: float, n: int, confidence: float = 0.95) -> tuple[float, float]:
    from covarium.functions.distributions import t_ppf

    half = t_ppf((1 + confidence) / 2, n - 2) * se
    return slope - half, slope + half
