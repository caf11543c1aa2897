"""Paired comparison of fold scores: corrected t, equivalence, effect size, sign flips, multiple testing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from math import inf, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covarium.functions.distributions import hedges_factor, t_ppf, t_sf


def correction_factor(n_train: float, n_test: float, n_folds: int) -> float:
    return 1 / n_folds + n_test / n_train


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """``keys, d``: differences of the folds both have."""
    return a.select(*keys, F.col("score").alias("sa")).join(b.select(*keys, F.col("score").alias("sb")), list(keys)).select(*keys, (F.col("sa") - F.col("sb")).alias("d"))


def negligible(sd: Column, largest: Column) -> Column:
    return F.coalesce(sd, F.lit(0.0)) <= 1e-12 * F.greatest(largest, F.lit(1.0))


def corrected_t(diffs: DataFrame, keys: Sequence[str] = (), n_train: str | float = "n_train", n_test: str | float = "n_test") -> DataFrame:
    """``k, mean_diff, sd_diff, se, t_stat, hedges_g`` of differences ``d`` by group, natively.

    Variance is inflated by 1/k + n_test/n_train. A spread that is negligible gives
    an infinite statistic of the mean's sign, or 0 for no difference.
    """
    train, test = (F.avg(x) if isinstance(x, str) else F.lit(float(x)) for x in (n_train, n_test))
    out = diffs.groupBy(*keys).agg(
        F.count("d").alias("k"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"), F.max(F.abs("d")).alias("largest"), F.round(train).alias("tr"), F.round(test).alias("te")
    )
    flat = negligible(F.col("sd_diff"), F.col("largest"))
    se = F.when(flat, 0.0).otherwise(F.sqrt((1 / F.col("k") + F.col("te") / F.col("tr")) * F.col("sd_diff") * F.col("sd_diff")))
    endless = F.when(F.abs("mean_diff") <= 1e-12 * F.greatest(F.col("largest"), F.lit(1.0)), 0.0).otherwise(F.signum("mean_diff") * float("inf"))
    df = F.col("k") - 1
    return out.select(
        *keys, "k", "mean_diff", "sd_diff", se.alias("se"), F.when(flat, endless).otherwise(F.col("mean_diff") / se).alias("t_stat"),
        F.when(flat, 0.0).otherwise((1 - 3 / (4 * df - 1)) * F.col("mean_diff") / F.col("sd_diff")).alias("hedges_g"),
    )


@dataclass(frozen=True)
class Comparison:
    k: int
    mean: float
    se: float
    t: float
    p: float
    lower: float
    upper: float
    hedges_g: float
    detectable: float
    bound: float | None = None
    tost_p: float | None = None
    alpha: float = 0.05

    @property
    def significant(self) -> bool:
        return self.p < self.alpha

    @property
    def equivalent(self) -> bool:
        return self.tost_p is not None and self.tost_p < self.alpha

    def verdict(self) -> str:
        names = {(True, True): "contradictory", (True, False): "difference", (False, True): "equivalent", (False, False): "inconclusive"}
        return names[self.significant, self.equivalent]

    def to_dict(self) -> dict:
        return asdict(self) | {"verdict": self.verdict()}


def tost_p(mean: float, se: float, df: int, bound: float) -> float:
    """The larger of two one-sided p-values against differences of ``bound`` and more."""
    if bound <= 0:
        raise ValueError("the bound must be positive")
    if se == 0:
        return 0.0 if abs(mean) < bound else 1.0
    return max(t_sf((mean + bound) / se, df), 1 - t_sf((mean - bound) / se, df))


def compare(a: DataFrame, b: DataFrame, *, n_train: float, n_test: float, alpha: float = 0.05, bound: float | None = None, power: float = 0.8, keys: Sequence[str] = ("fold",)) -> Comparison:
    """Compare two models on the same folds; both must have the same ones."""
    if a.select(*keys).exceptAll(b.select(*keys)).limit(1).count() or b.select(*keys).exceptAll(a.select(*keys)).limit(1).count():
        raise ValueError("the two results have different folds")
    r = corrected_t(paired(a, b, keys), (), n_train, n_test).first()
    if r["k"] < 2:
        raise ValueError("a comparison needs two folds")
    k, mean, se, t = r["k"], r["mean_diff"], r["se"], r["t_stat"]
    df = k - 1
    p = (0.0 if abs(t) == inf else 1.0) if se == 0 else 2 * t_sf(abs(t), df)
    half = t_ppf(1 - alpha / 2, df) * se
    detectable = (t_ppf(1 - alpha / 2, df) + t_ppf(power, df)) * se
    return Comparison(k, mean, se, t, p, mean - half, mean + half, r["hedges_g"], detectable, bound, None if bound is None else tost_p(mean, se, df, bound), alpha)


def holm(df: DataFrame, p: str = "p_value", family: Sequence[str] = ()) -> DataFrame:
    """Add ``p_holm``: step-down adjusted p-values within each family."""
    keys = list(family) or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(p)
    scaled = F.col(p) * (F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1)
    return df.withColumn("p_scaled", scaled).withColumn("p_holm", F.least(F.lit(1.0), F.max("p_scaled").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("p_scaled")


def hochberg(df: DataFrame, p: str = "p_value", family: Sequence[str] = ()) -> DataFrame:
    """Add ``p_hochberg``: step-up adjusted p-values within each family."""
    keys = list(family) or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(p)
    scaled = F.col(p) * (F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1)
    return df.withColumn("p_scaled", scaled).withColumn("p_hochberg", F.least(F.lit(1.0), F.min("p_scaled").over(order.rowsBetween(0, Window.unboundedFollowing)))).drop("p_scaled")


def sign_flip_p(diffs: DataFrame, keys: Sequence[str] = (), most: int = 20) -> DataFrame:
    """``p_value, n_flips``: exact sign-flip test of the mean of ``d`` by group, all 2^k flips of up to ``most`` differences."""
    keys = list(keys)
    lists = diffs.groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("ds")).withColumn("k", F.size("ds"))
    checked = lists.withColumn("k", F.when(F.col("k") > most, F.raise_error(F.lit(f"more than {most} differences"))).otherwise(F.col("k")))
    flips = checked.select(*keys, "ds", "k", F.explode(F.expr("sequence(0L, shiftleft(1L, k) - 1)")).alias("mask"))
    null = F.expr("aggregate(transform(ds, (d, i) -> if((shiftright(mask, i) & 1L) = 1L, -d, d)), 0D, (a, x) -> a + x)")
    seen = F.expr("aggregate(ds, 0D, (a, x) -> a + x)")
    return flips.withColumn("hit", F.when(F.abs(null) / F.col("k") >= F.abs(seen) / F.col("k") - 1e-12, 1.0).otherwise(0.0)).groupBy(*keys).agg(F.avg("hit").alias("p_value"), F.count(F.lit(1)).alias("n_flips"))


def hedges_g(mean: float, sd: float, k: int) -> float:
    return hedges_factor(k - 1) * mean / sd if sd else 0.0


def minimum_detectable_effect(sd: float, k: int, n_train: float, n_test: float, alpha: float = 0.05, power: float = 0.8) -> float:
    se = sqrt(correction_factor(n_train, n_test, k)) * sd
    return (t_ppf(1 - alpha / 2, k - 1) + t_ppf(power, k - 1)) * se
