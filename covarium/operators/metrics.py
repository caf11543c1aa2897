"""Classification metrics as aggregates over one confusion count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABEL_METRICS = ("accuracy", "balanced_accuracy", "kappa", "f1_macro")
METRICS = (*LABEL_METRICS, "roc_auc")


def confusion(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return df.groupBy(*keys, truth, guess).agg(F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """``accuracy, balanced_accuracy, kappa, f1_macro`` for each group.

    Recall averages over classes that occur in the truth, F1 over those that occur
    in either; kappa of a single class that is always met is 0.
    """
    keys = list(keys)
    cells = confusion(df, keys, truth, guess)
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).cast("long").alias("h")), F.struct(F.col(guess).alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))).alias("s")).select(*keys, "s.*")
    classes = sides.groupBy(*keys, "c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    out = classes.groupBy(*keys).agg(
        F.sum("t").alias("n"), F.sum("h").alias("hits"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("balanced_accuracy"),
        F.sum(F.col("t").cast("double") * F.col("g")).alias("chance"), F.avg(2 * F.col("h") / (F.col("t") + F.col("g"))).alias("f1_macro"),
    )
    po, pe = F.col("hits") / F.col("n"), F.col("chance") / F.col("n").cast("double") / F.col("n")
    return out.select(*keys, "n", po.alias("accuracy"), "balanced_accuracy", F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe)).alias("kappa"), "f1_macro")


def roc_auc(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the curve by average ranks. Ranks come from counts of distinct scores, not from a sort of all rows."""
    keys = list(keys)
    cells = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(truth) > 0).cast("long")).alias("pos"))
    before = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return out.select(*keys, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p").cast("double") * F.col("q"))).alias("roc_auc"))


def roc_auc_of_probabilities(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true", proba: str = "proba", classes: Sequence = ()) -> DataFrame:
    """Area under the curve of class probabilities, in the order of ``classes``: of the second of two, else the mean over each against the rest."""
    keys = list(keys)
    if len(classes) == 2:
        return roc_auc(df.select(*keys, (F.col(truth) == F.lit(classes[1])).cast("int").alias("hit"), F.get(proba, F.lit(1)).alias("score")), keys, "hit", "score")
    each = df.select(*keys, truth, F.posexplode(F.arrays_zip(F.array(*map(F.lit, classes)).alias("c"), F.col(proba).alias("p"))).alias("k", "s"))
    each = each.select(*keys, "k", (F.col(truth) == F.col("s.c")).cast("int").alias("hit"), F.col("s.p").alias("score"))
    return roc_auc(each, [*keys, "k"], "hit", "score").groupBy(*keys).agg(F.avg("roc_auc").alias("roc_auc"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("proportion"))


def chance_accuracy(df: DataFrame, label: str = "label") -> DataFrame:
    return class_balance(df, label).agg(F.max("proportion").alias("chance_accuracy"))
