"""Classifiers over trial rows: nearest centroid, linear discriminant, logistic, kernel SVM. Fitted state is small."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.functions import linalg
from covarium.functions import matrices as M
from covarium.operators import means


class MDM:
    """Nearest centroid: one mean for each class, the nearest wins, the first of equals."""

    def __init__(self, metric: str = "airm", n: int | None = None, **options) -> None:
        if metric == "stein":
            raise ValueError("the Stein distance has no mean here")
        if metric not in M.NATIVE_2:
            raise ValueError(f"unknown metric {metric!r}")
        self.metric, self.n, self.options = metric, n, options
        self.classes: list = []

    def fit(self, df: DataFrame, label: str = "label", matrix: str = "cov", weight: str | None = None) -> MDM:
        self.matrix = matrix
        if weight is not None:
            odd = df.agg(F.count_if(F.col(weight).isNull() | F.isnan(F.col(weight).cast("double")) | (F.col(weight) < 0)).alias("n")).first()["n"]
            if odd:
                raise ValueError(f"{odd} weights that are missing or negative")
        rows = means.group_mean(df, [label], matrix, self.metric, self.n, weight, **self.options).collect()  # one row for each class
        rows.sort(key=lambda r: r[label])
        if len(rows) < 2:
            raise ValueError("a classifier needs two classes")
        self.classes, self.centroids = [r[label] for r in rows], [list(r[matrix]) for r in rows]
        return self

    def transform(self, df: DataFrame, output: str = "distances") -> DataFrame:
        """Distances to the centroids in class order."""
        points = [F.array(*map(F.lit, c)) for c in self.centroids]
        return df.withColumn(output, F.array(*(M.distance(p, F.col(self.matrix), self.metric, self.n) for p in points)))

    def predict(self, df: DataFrame) -> DataFrame:
        named = F.array(*map(F.lit, self.classes))
        return self.transform(df).withColumn("y_pred", F.get(named, (F.array_position("distances", F.array_min("distances")) - 1).cast("int")))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Softmax of the negative squared distances."""
        return self.predict(df).withColumn("proba", softmax_of_distances(F.col("distances")))


def softmax_of_distances(distances):
    least = F.array_min(distances)
    e = F.transform(distances, lambda d: F.exp(least * least - d * d))
    return F.transform(e, lambda x: x / M.total(e))


def mdm_fold_predictions(df: DataFrame, folds: DataFrame, metric: str = "logeuclid", n: int = 2, label: str = "label", matrix: str = "cov") -> DataFrame:
    """All folds in one plan: class means of each fold's training rows, joined to its test rows by fold.

    Returns ``fold, trial_id, y_true, y_pred, distances``. For the log-Euclidean
    metric the logarithms are taken once, before rows are joined to folds: means
    and distances are then Euclidean ones.
    """
    if metric == "logeuclid":
        df, metric = df.withColumn(matrix, M.logm2(matrix) if n == 2 else M.logm(matrix)), "euclid"
    staged = folds.join(df.select("trial_id", label, matrix), "trial_id")
    centroids = means.group_mean(staged.where("role = 'train'"), ["fold", label], matrix, metric, n)
    each = centroids.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), F.col(matrix).alias("m")))).alias("centres"))
    tested = staged.where("role = 'test'").join(each, "fold")
    distances = F.transform("centres", lambda c: M.NATIVE_2[metric](c["m"], F.col(matrix)))
    out = tested.withColumn("distances", distances)
    nearest = (F.array_position("distances", F.array_min("distances")) - 1).cast("int")
    return out.select("fold", "trial_id", F.col(label).alias("y_true"), F.get(F.col("centres.c"), nearest).alias("y_pred"), "distances")


class LinearDiscriminant:
    """Gaussian classes with one covariance: moments by one aggregate, a solve on the driver, native scoring."""

    def __init__(self, shrinkage: float | None = None) -> None:
        self.shrinkage = shrinkage

    def fit(self, df: DataFrame, features: str = "features", label: str = "label") -> LinearDiscriminant:
        self.features = features
        d = len(df.select(features).first()[0])

        def moments(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["x"].to_numpy())
            return pd.DataFrame({"c": [pdf["c"].iloc[0]], "n": [len(x)], "s": [x.sum(axis=0)], "q": [(x.T @ x).ravel()]})

        rows = df.select(F.col(label).alias("c"), F.col(features).alias("x"), F.pmod(F.xxhash64(features), F.lit(64)).alias("part"))
        kind = rows.schema["c"].dataType.simpleString()
        parts = rows.groupBy("c", "part").applyInPandas(moments, f"c {kind}, n long, s array<double>, q array<double>")
        total: dict = {}
        for r in parts.collect():  # at most 64 rows for each class
            n, s, q = total.get(r["c"], (0, np.zeros(d), np.zeros(d * d)))
            total[r["c"]] = n + r["n"], s + np.array(r["s"]), q + np.array(r["q"])
        if len(total) < 2:
            raise ValueError("a classifier needs two classes")
        self.classes = sorted(total)
        count = np.array([total[c][0] for c in self.classes], float)
        mean = np.array([total[c][1] / total[c][0] for c in self.classes])
        within = sum(total[c][2].reshape(d, d) - total[c][0] * np.outer(m, m) for c, m in zip(self.classes, mean)) / count.sum()
        if self.shrinkage is not None:
            within = linalg.shrink(within, self.shrinkage)
        solved = np.linalg.lstsq(within, mean.T, rcond=None)[0].T
        self.weights, self.bias = solved, -0.5 * (solved * mean).sum(axis=1) + np.log(count / count.sum())
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        scores = F.array(*(M.dot(F.col(self.features), F.array(*map(F.lit, map(float, w)))) + float(b) for w, b in zip(self.weights, self.bias)))
        named = F.array(*map(F.lit, self.classes))
        return df.withColumn("lda_scores", scores).withColumn("y_pred", F.get(named, (F.array_position("lda_scores", F.array_max("lda_scores")) - 1).cast("int")))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Softmax of the scores, which are log posteriors up to a constant."""
        e = F.transform("lda_scores", lambda x: F.exp(x - F.array_max("lda_scores")))
        return self.predict(df).withColumn("proba", e).withColumn("proba", F.transform("proba", lambda x: x / M.total(F.col("proba"))))


def logistic(df: DataFrame, features: str = "features", label: str = "label", c: float = 1.0, max_iter: int = 1000):
    """Spark's logistic regression with the penalty of a fit by ``c``: standardised inputs, regParam 1 / (c n)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("raw_vector", array_to_vector(features))
    stages = [
        StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True),
        LogisticRegression(featuresCol="vector", labelCol=label, predictionCol="y_pred", regParam=1 / (c * df.count()), standardization=False, maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(data), data


def smo(gram: np.ndarray, y: np.ndarray, c: float = 1.0, tol: float = 1e-3, max_iter: int = 20_000) -> tuple[np.ndarray, float]:
    """Dual of the soft-margin SVM on a given Gram matrix: the most violating pair is optimised until none is left."""
    y = np.where(np.asarray(y) > 0, 1.0, -1.0)
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(max_iter):
        up = ((alpha < c - 1e-12) & (y > 0)) | ((alpha > 1e-12) & (y < 0))
        low = ((alpha < c - 1e-12) & (y < 0)) | ((alpha > 1e-12) & (y > 0))
        v = -y * grad
        if not up.any() or not low.any():
            break
        i, j = int(np.where(up, v, -np.inf).argmax()), int(np.where(low, v, np.inf).argmin())
        if v[i] - v[j] < tol:
            break
        curve = max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        step = (v[i] - v[j]) / curve
        room_i = c - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += y * (gram[:, i] - gram[:, j]) * step
    v = -y * grad
    free = (alpha > 1e-8) & (alpha < c - 1e-8)
    if free.any():
        bias = float(v[free].mean())
    else:
        up = ((alpha < c - 1e-12) & (y > 0)) | ((alpha > 1e-12) & (y < 0))
        bias = float((np.where(up, v, -np.inf).max() + np.where(~up, v, np.inf).min()) / 2)
    return alpha * y, bias


class KernelSVM:
    """SVM on a precomputed Gram matrix; several classes by one against each other."""

    def __init__(self, c: float = 1.0) -> None:
        self.c = c

    def fit(self, gram: np.ndarray, labels: Sequence) -> KernelSVM:
        self.classes = sorted(set(labels))
        y = np.asarray(labels)
        if len(self.classes) < 2:
            raise ValueError("a classifier needs two classes")
        self.pairs = []
        for a in range(len(self.classes)):
            for b in range(a + 1, len(self.classes)):
                at = np.flatnonzero((y == self.classes[a]) | (y == self.classes[b]))
                self.pairs.append((a, b, at, *smo(gram[np.ix_(at, at)], y[at] == self.classes[a], self.c)))
        return self

    def predict(self, kernel: np.ndarray) -> list:
        """``kernel``: new rows against all training rows."""
        votes = np.zeros((len(kernel), len(self.classes)))
        for a, b, at, coef, bias in self.pairs:
            first = kernel[:, at] @ coef + bias > 0
            votes[np.arange(len(kernel)), np.where(first, a, b)] += 1
        return [self.classes[k] for k in votes.argmax(axis=1)]
