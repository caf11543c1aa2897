"""Kernel matrices over feature rows: closed-form ones natively, fidelity kernels from states simulated once a row."""

from __future__ import annotations

import logging
from functools import partial
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions import matrices as M
from covarium.functions import statevector as S
from covarium.operators.means import blocked_pairs

log = logging.getLogger(__name__)


def angle_kernel(x: Column, y: Column, scale: float = 1.0) -> Column:
    cosines = F.zip_with(x, y, lambda a, b: F.cos(scale * (a - b) / 2))
    return F.aggregate(cosines, F.lit(1.0), lambda acc, c: acc * c * c)


def rbf_kernel(x: Column, y: Column, gamma: float = 1.0) -> Column:
    d = F.zip_with(x, y, lambda a, b: a - b)
    return F.exp(-gamma * M.dot(d, d))


def gram(df: DataFrame, kernel, key: str = "trial_id", features: str = "features") -> DataFrame:
    """``(i, j, value)`` for i <= j of a feature table; ``kernel`` is over columns x and y.

    The matrix is what is asked for, so it has a row for each pair; pairs are made
    in blocks of rows.
    """
    a = df.select(F.col(key).alias("i"), F.col(features).alias("x"))
    b = df.select(F.col(key).alias("j"), F.col(features).alias("y"))
    return blocked_pairs(a, b, "i", "j").where("i <= j").select("i", "j", kernel(F.col("x"), F.col("y")).alias("value"))


def states(df: DataFrame, feature_map: str = "zz", reps: int = 1, scale: float = 1.0, key: str = "trial_id", features: str = "features") -> DataFrame:
    """``(key, re, im)``: each row's state, simulated once."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                psi = S.feature_state(scale * np.stack(pdf["x"].to_numpy()), feature_map, reps)
                yield pd.DataFrame({key: pdf[key], "re": list(psi.real), "im": list(psi.imag)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(features).alias("x")).mapInPandas(run, f"{key} {kind}, re array<double>, im array<double>")


def fidelity_gram(df: DataFrame, feature_map: str = "zz", reps: int = 1, scale: float = 1.0, key: str = "trial_id", features: str = "features") -> DataFrame:
    """Fidelity kernel ``(i, j, value)`` for i <= j; the angle map by its closed form."""
    if feature_map == "angle" and reps == 1:
        return gram(df, lambda x, y: angle_kernel(x, y, scale), key, features)
    psi = states(df, feature_map, reps, scale, key, features)
    a = psi.select(F.col(key).alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = psi.select(F.col(key).alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    real = M.dot(F.col("ar"), F.col("br")) + M.dot(F.col("ai"), F.col("bi"))
    imag = M.dot(F.col("ar"), F.col("bi")) - M.dot(F.col("ai"), F.col("br"))
    return blocked_pairs(a, b, "i", "j").where("i <= j").select("i", "j", (real * real + imag * imag).alias("value"))


def concentration(matrix: DataFrame) -> DataFrame:
    """Mean and population deviation of the off-diagonal entries; a deviation under 0.01 says the kernel tells rows apart poorly."""
    return matrix.where("i <> j").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))


def effective_rank(values: np.ndarray) -> float:
    """Exponential of the entropy of the normalised spectrum of a Gram matrix."""
    w = np.linalg.eigvalsh(np.asarray(values))
    p = w[w > 1e-12] / w[w > 1e-12].sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def select_scale(x: np.ndarray, feature_map: str, scales=(0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5)) -> float:
    """The scale of the widest spread of off-diagonal entries on a probe of rows; the first of equals."""
    best, spread = scales[0], -1.0
    off = ~np.eye(len(x), dtype=bool)
    for s in scales:
        psi = S.feature_state(s * x, feature_map)
        if (now := float(S.fidelity(psi, psi)[off].std())) > spread:
            best, spread = s, now
    return best


def _signed(axes: np.ndarray) -> np.ndarray:
    """Columns turned so that the greatest entry of each is positive, as a decomposition leaves the sign open."""
    return axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)


class KernelClassifier:
    """Standardise, project to principal components, scale by the largest training value, pad, then a fidelity-kernel SVM."""

    def __init__(self, n_qubits: int = 8, feature_map: str = "zz", reps: int = 1, scale: float = 1.0, c: float = 1.0) -> None:
        if not 1 <= n_qubits <= S.MAX_QUBITS or scale <= 0 or feature_map not in S.MAPS:
            raise ValueError("1 to 20 qubits, a positive scale and a known feature map")
        self.q, self.map, self.reps, self.scale, self.c = n_qubits, feature_map, reps, scale, c

    def _reduce(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.std) @ self.axes / self.top
        return np.pad(z, ((0, 0), (0, self.q - z.shape[1])))

    def fit(self, x: np.ndarray, labels) -> KernelClassifier:
        from covarium.operators.classify import KernelSVM

        self.mean, self.std = x.mean(axis=0), x.std(axis=0)
        self.std[self.std == 0] = 1
        z = (x - self.mean) / self.std
        self.axes = _signed(np.linalg.svd(z, full_matrices=False)[2][: min(self.q, *x.shape)].T)
        self.top = np.abs(z @ self.axes).max() or 1.0
        self.psi = S.feature_state(self.scale * self._reduce(x), self.map, self.reps)
        self.gram = S.fidelity(self.psi, self.psi)
        self.svm = KernelSVM(self.c).fit(self.gram, labels)
        return self

    def predict(self, x: np.ndarray) -> list:
        return self.svm.predict(S.fidelity(S.feature_state(self.scale * self._reduce(x), self.map, self.reps), self.psi))


def overlaps(psi: np.ndarray) -> np.ndarray:
    """Features whose dot products are the fidelities of states: the entries of psi psi*, real and imaginary parts, those beside the diagonal times the root of 2."""
    n = psi.shape[1]
    i, j = np.triu_indices(n, 1)
    beside = psi[:, i] * psi[:, j].conj() * np.sqrt(2)
    return np.concatenate([np.abs(psi) ** 2, beside.real, beside.imag], axis=1)


#: Half widths of the quadratic that rounds the hinge's corner, each a start for the next; steps of the line search; Newton steps at one width.
WIDTHS, STEPS, MAX_STEPS = (2.0, 0.5, 0.1, 0.02, 0.004, 0.001), 2.0 ** -np.arange(16), 200
#: Qubits up to which a state's 4^q overlaps are features, rows simulated at once, and folds solved side by side.
EXPLICIT_QUBITS, CHUNK, SIDE_BY_SIDE = 5, 2048, 8


class FoldClassifier:
    """``KernelClassifier`` of two classes for each left-out value of ``fold``, over training sets of any size.

    The fidelity of q qubits is a dot product of 4^q features, so the support vector
    machine is one of 4^q weights: its primal is solved by Newton steps over sums of
    rows, without a Gram matrix, and no row comes to the driver. The hinge's corner
    is rounded by a quadratic of half width ``WIDTHS[-1]``, the tolerance of ``smo``.
    """

    def __init__(self, n_qubits: int = 4, feature_map: str = "zz", reps: int = 1, scale: float = 1.0, c: float = 1.0, fold: str = "subject", features: str = "features", label: str = "label") -> None:
        if n_qubits > EXPLICIT_QUBITS:
            raise ValueError(f"{EXPLICIT_QUBITS} qubits at most")
        self.machine = partial(KernelClassifier, n_qubits, feature_map, reps, scale, c)
        self.q, self.c, self.fold, self.features, self.label = n_qubits, c, fold, features, label

    def _sums(self, data: DataFrame, parts, count: int) -> list[np.ndarray]:
        """What ``parts(x, y, fold)`` gives for some rows, ``count`` arrays of one size, summed over all rows."""

        def run(batches):
            total = None
            for pdf in batches:
                for k in range(0, len(pdf), CHUNK):
                    some = pdf.iloc[k : k + CHUNK]
                    new = parts(np.stack(some["x"].to_numpy()), some["y"].to_numpy(), some["fold"].to_numpy())
                    total = new if total is None else [a + b for a, b in zip(total, new)]
            if total is not None:
                yield pd.DataFrame({"s": [np.concatenate([t.ravel() for t in total]).tobytes()]})

        rows = data.mapInPandas(run, "s binary").collect()  # one for each partition, of which there are few
        total = 0
        while rows:
            total = total + np.frombuffer(rows.pop()["s"])
        return np.split(total, count)

    def _simulated(self, m: KernelClassifier, x: np.ndarray) -> np.ndarray:
        psi = overlaps(S.feature_state(m.scale * m._reduce(x), m.map, m.reps))
        return np.c_[psi, np.ones(len(psi))]

    def _solve(self, data: DataFrame) -> None:
        models, c = self.models, self.c
        size = 4**self.q + 1
        upper = np.triu_indices(size)
        own = np.r_[np.ones(size - 1), 0.0]  # the bias has no penalty
        w = [np.zeros(size) for _ in models]
        for h in WIDTHS:
            open_, damping = set(range(len(models))), [1e-9] * len(models)
            for _ in range(MAX_STEPS):
                if not open_:
                    break

                todo = sorted(open_)

                def slopes(x, y, fold, w=tuple(w), todo=todo):
                    out = []
                    for k in todo:
                        m, acc = models[k], np.zeros(size + size * (size + 1) // 2)
                        if (at := fold != m.left_out).any():
                            f = self._simulated(m, x[at]) * y[at, None]
                            short = np.clip((1 + h - f @ w[k]) / (2 * h), 0, 1)  # minus the slope of the loss
                            near = f[(short > 0) & (short < 1)]
                            acc = np.r_[-c * (short @ f), c / (2 * h) * (near.T @ near)[np.triu_indices(size)]]
                        out.append(acc)
                    return out

                d, drop = [np.zeros(size) for _ in models], [0.0] * len(models)
                for k, s in zip(todo, self._sums(data, slopes, len(todo))):
                    g, curve = s[:size] + own * w[k], np.zeros((size, size))
                    curve[upper] = s[size:]
                    d[k] = -np.linalg.solve(curve + np.triu(curve, 1).T + np.diag(own + damping[k]), g)
                    drop[k] = float(-g @ d[k])

                def losses(x, y, fold, w=tuple(w), d=tuple(d), todo=todo):
                    out = []
                    for k in todo:
                        m, acc = models[k], np.zeros(len(STEPS) + 1)
                        if (at := fold != m.left_out).any():
                            f = self._simulated(m, x[at]) * y[at, None]
                            gap = 1 - (f @ w[k])[:, None] - (f @ d[k])[:, None] * np.r_[0, STEPS]
                            acc = c * np.where(gap > h, gap, np.clip(gap + h, 0, None) ** 2 / (4 * h)).sum(axis=0)
                        out.append(acc)
                    return out

                for k, loss in zip(todo, self._sums(data, losses, len(todo))):
                    value = loss + [((own * (w[k] + t * d[k])) ** 2).sum() / 2 for t in (0, *STEPS)]
                    best = int(value[1:].argmin())
                    gained = value[0] - value[1 + best]
                    if gained > 0:
                        w[k] = w[k] + STEPS[best] * d[k]
                    if drop[k] <= 1e-9 * value[0] or 0 < gained <= 1e-9 * value[0]:
                        open_.discard(k)
                    damping[k] = max(1e-9, damping[k] / 100) if gained > 0 else damping[k] * 100
            if open_:
                log.warning("support vector machines of %d folds have not settled at a width of %g", len(open_), h)
        for m, weights in zip(models, w):
            m.weights = weights

    def fit(self, df: DataFrame) -> FoldClassifier:
        spark = df.sparkSession
        counts = df.groupBy(self.fold, self.label).agg(F.count(F.lit(1)).alias("n")).collect()
        self.classes = sorted({r[self.label] for r in counts})
        folds = sorted({r[self.fold] for r in counts})
        for k in folds:
            if len({r[self.label] for r in counts if r[self.fold] != k}) != 2:
                raise ValueError("a classifier needs two classes")
        if len(self.classes) != 2:
            raise ValueError("two classes are needed")
        y = F.when(F.col(self.label) == F.lit(self.classes[0]), 1.0).otherwise(-1.0)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        data = df.select(F.col(self.features).alias("x"), y.alias("y"), F.col(self.fold).alias("fold")).repartition(n).persist()
        self.fitted = {}
        try:
            for k in range(0, len(folds), SIDE_BY_SIDE):
                self._fit_some(data, folds[k : k + SIDE_BY_SIDE])
        finally:
            data.unpersist()
        return self

    def _fit_some(self, data: DataFrame, folds: list) -> None:
        self.models = models = [self.machine() for _ in folds]
        for m, k in zip(models, folds):
            m.left_out = k

        def moments(x, y, fold):
            return [np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()]) for m in models for z in (x[fold != m.left_out],)]

        for m, s in zip(models, self._sums(data, moments, len(models))):
            dim = (isqrt(4 * len(s) - 3) - 1) // 2
            m.mean, square = s[1 : dim + 1] / s[0], s[dim + 1 :].reshape(dim, dim) / s[0]
            spread = square - np.outer(m.mean, m.mean)
            m.std = np.sqrt(np.clip(np.diag(spread), 0, None))
            m.std[m.std <= 1e-12 * np.sqrt(np.diag(square))] = 1
            m.axes = _signed(np.linalg.eigh(spread / np.outer(m.std, m.std))[1][:, ::-1][:, : min(self.q, dim, int(s[0]))])
            m.top = 1.0

        def tops(batches):
            for pdf in batches:
                if len(pdf):
                    x, fold = np.stack(pdf["x"].to_numpy()), pdf["fold"].to_numpy()
                    yield pd.DataFrame([[float(np.abs(m._reduce(x[fold != m.left_out])).max(initial=0)) for m in models]])

        names = [f"m{k}" for k in range(len(models))]
        row = data.mapInPandas(lambda b: (p.set_axis(names, axis=1) for p in tops(b)), ", ".join(f"{c} double" for c in names)).agg(*(F.max(c).alias(c) for c in names)).first()
        for m, c in zip(models, names):
            m.top = row[c] or 1.0
        self._solve(data)
        self.fitted |= dict(zip(folds, models))

    def predict(self, df: DataFrame, key: str = "trial_id") -> DataFrame:
        """``(key, y_pred)`` of every row by the machine that has not seen its fold."""
        fitted, classes = self.fitted, self.classes

        def run(batches):
            for pdf in batches:
                for k in range(0, len(pdf), CHUNK):
                    some = pdf.iloc[k : k + CHUNK]
                    x, fold, out = np.stack(some["x"].to_numpy()), some["fold"].to_numpy(), np.zeros(len(some), np.int64)
                    for value in np.unique(fold):
                        at, m = fold == value, fitted[value]
                        out[at] = np.where(self._simulated(m, x[at]) @ m.weights > 0, classes[0], classes[1])
                    yield pd.DataFrame({key: some[key].to_numpy(), "y_pred": out})

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, F.col(self.features).alias("x"), F.col(self.fold).alias("fold")).mapInPandas(run, f"{key} {kind}, y_pred long")
