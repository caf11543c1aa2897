"""Matrix functions as Columns. A matrix is an ``array<double>`` in row-major order.

Entrywise functions and the closed forms for 2 x 2 matrices are built-in
expressions. Spectral functions of any size are Arrow-batched: a whole batch goes
through one call of LAPACK.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from covarium.functions import linalg

ROOT2 = 2**0.5


def _col(m: Column | str) -> Column:
    return F.col(m) if isinstance(m, str) else m


# entrywise, native


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean_of(values: Column) -> Column:
    return total(values) / F.size(values)


def symmetrize(m: Column | str, n: int) -> Column:
    m = _col(m)
    return F.transform(m, lambda x, i: 0.5 * (x + F.get(m, (i % n) * n + F.floor(i / n).cast("int"))))


def trace(m: Column | str, n: int) -> Column:
    return sum((F.get(_col(m), F.lit(i * (n + 1))) for i in range(1, n)), F.get(_col(m), F.lit(0)))


def frobenius(m: Column | str) -> Column:
    return F.sqrt(dot(_col(m), _col(m)))


def is_symmetric(m: Column | str, n: int, rtol: float = linalg.SYMMETRY_RTOL) -> Column:
    m = _col(m)
    off = F.transform(m, lambda x, i: x - F.get(m, (i % n) * n + F.floor(i / n).cast("int")))
    size = frobenius(m)
    return frobenius(off) <= rtol * F.when(size == 0, 1.0).otherwise(size)


def _toward_identity(m: Column, n: int, keep: float, add: float) -> Column:
    level = trace(m, n) / n
    return F.transform(m, lambda x, i: keep * x + F.when(i % (n + 1) == 0, add * level).otherwise(0.0))


def regularize(m: Column | str, n: int, epsilon: float = 1e-8) -> Column:
    return _toward_identity(_col(m), n, 1.0, epsilon)


def shrink(m: Column | str, n: int, alpha: float) -> Column:
    return _toward_identity(_col(m), n, 1 - alpha, alpha)


def euclid(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(_col(a), _col(b), lambda x, y: x - y)
    return F.sqrt(dot(d, d))


def vech(m: Column | str, n: int) -> Column:
    i, j, w = linalg.upper(n)
    return F.array(*(F.get(_col(m), F.lit(int(a * n + b))) * float(c) for a, b, c in zip(i, j, w)))


def unvech(v: Column | str, n: int) -> Column:
    i, j, w = linalg.upper(n)
    place = {(int(a), int(b)): (k, float(c)) for k, (a, b, c) in enumerate(zip(i, j, w))}
    return F.array(*(F.get(_col(v), F.lit(place[min(r, c), max(r, c)][0])) / place[min(r, c), max(r, c)][1] for r in range(n) for c in range(n)))


def vector_dimension(n: Column | str) -> Column:
    n = _col(n)
    return (n * (n + 1) / 2).cast("int")


def scm(signal: Column | str, channels: int, assume_centered: bool = False) -> Column:
    """Sample covariance of a channels x times signal, natively; divided by the number of times."""
    rows = [F.get(_col(signal), F.lit(i)) for i in range(channels)]
    means = [F.lit(0.0) if assume_centered else mean_of(r) for r in rows]
    cell = {(i, j): dot(rows[i], rows[j]) / F.size(rows[i]) - means[i] * means[j] for i in range(channels) for j in range(i, channels)}
    return F.array(*(cell[min(i, j), max(i, j)] for i in range(channels) for j in range(channels)))


# closed forms for 2 x 2, native


def _abc(m: Column | str) -> tuple[Column, Column, Column]:
    m = _col(m)
    return F.get(m, F.lit(0)), F.get(m, F.lit(1)), F.get(m, F.lit(3))


def det2(m: Column | str) -> Column:
    a, b, c = _abc(m)
    return a * c - b * b


def eigen2(m: Column | str) -> tuple[Column, Column]:
    """The larger and the smaller eigenvalue."""
    a, b, c = _abc(m)
    large = (a + c) / 2 + F.sqrt((a - c) * (a - c) / 4 + b * b)
    return large, det2(m) / large


def logdet2(m: Column | str) -> Column:
    return F.log(det2(m))


def condition2(m: Column | str) -> Column:
    large, small = eigen2(m)
    return large / small


def logm2(m: Column | str) -> Column:
    a, b, c = _abc(m)
    large, small = eigen2(m)
    beta = F.when(large - small <= 1e-12 * large, 1 / large).otherwise((F.log(large) - F.log(small)) / (large - small))
    alpha = F.log(large) - beta * large
    return F.array(alpha + beta * a, beta * b, beta * b, alpha + beta * c)


def expm2(m: Column | str) -> Column:
    """Of a symmetric matrix, definite or not."""
    a, b, c = _abc(m)
    half = F.sqrt((a - c) * (a - c) / 4 + b * b)
    large, small = (a + c) / 2 + half, (a + c) / 2 - half
    beta = F.when(half <= 1e-12, F.exp(large)).otherwise((F.exp(large) - F.exp(small)) / (2 * half))
    alpha = F.exp(large) - beta * large
    return F.array(alpha + beta * a, beta * b, beta * b, alpha + beta * c)


def airm2(x: Column | str, y: Column | str) -> Column:
    a, b, c = _abc(x)
    p, q, r = _abc(y)
    t, d = (c * p - 2 * b * q + a * r) / det2(x), det2(y) / det2(x)
    first = (t + F.sqrt(F.greatest(t * t - 4 * d, F.lit(0.0)))) / 2
    return F.sqrt(F.log(first) ** 2 + F.log(d / first) ** 2)


def stein2(x: Column | str, y: Column | str) -> Column:
    mid = F.zip_with(_col(x), _col(y), lambda u, v: (u + v) / 2)
    return F.sqrt(F.greatest(F.log(det2(mid)) - 0.5 * F.log(det2(x) * det2(y)), F.lit(0.0)))


def logeuclid2(x: Column | str, y: Column | str) -> Column:
    return euclid(logm2(x), logm2(y))


NATIVE_2 = {"airm": airm2, "stein": stein2, "logeuclid": logeuclid2, "euclid": euclid}


# any size, Arrow-batched


def _square(values: pd.Series) -> np.ndarray:
    flat = np.stack(values.to_numpy()) if len(values) else np.empty((0, 1))
    n = round(flat.shape[1] ** 0.5)
    return flat.reshape(len(flat), n, n)


def _flat(a: np.ndarray) -> pd.Series:
    return pd.Series(list(a.reshape(len(a), -1)))


@lru_cache(None)
def _unary(name: str, *args: float):
    f = getattr(linalg, name)

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        return _flat(f(_square(m), *args)) if len(m) else m

    return run


@lru_cache(None)
def _scalar(name: str, kind: str = "double"):
    f = getattr(linalg, name)

    @F.pandas_udf(kind)
    def run(m: pd.Series) -> pd.Series:
        return pd.Series(f(_square(m)) if len(m) else [])

    return run


@lru_cache(None)
def _binary(name: str, kind: str, *args):
    f = getattr(linalg, name)

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([])
        out = f(_square(a), _square(b), *args)
        return pd.Series(out) if kind == "double" else _flat(out)

    return run


def logm(m):
    return _unary("logm")(m)


def expm(m):
    return _unary("expm")(m)


def sqrtm(m):
    return _unary("sqrtm")(m)


def invsqrtm(m):
    return _unary("invsqrtm")(m)


def inv(m):
    return _unary("inv")(m)


def powm(m, p: float):
    return _unary("powm", p)(m)


def project(m, floor: float = 1e-10):
    return _unary("project", floor)(m)


def logdet(m):
    return _scalar("logdet")(m)


def condition_number(m):
    return _scalar("condition_number")(m)


def is_spd(m):
    return _scalar("is_spd", "boolean")(m)


def distance(a, b, metric: str = "airm", n: int | None = None) -> Column:
    """Distance of two matrix columns; 2 x 2 and Euclidean distances stay native."""
    if metric not in NATIVE_2:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(NATIVE_2)}")
    return NATIVE_2[metric](a, b) if n == 2 or metric == "euclid" else _binary("distance", "double", metric)(a, b)


def rotation_split(a, b):
    """Array of total, spectral and rotational distance and the rotational share, for matrices of any size."""
    return _rows("rotation_split")(_col(a), _col(b))


@lru_cache(None)
def _rows(name: str):
    f = getattr(linalg, name)

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(f(_square(a), _square(b)))) if len(a) else a

    return run


def whiten(reference, target):
    return _binary("whiten", "array<double>")(reference, target)


def log_map(reference, target):
    return _binary("log_map", "array<double>")(reference, target)


def exp_map(reference, tangent):
    return _binary("exp_map", "array<double>")(reference, tangent)


def tangent(m, reference, metric: str = "airm"):
    return _binary("tangent", "array<double>", metric)(m, reference)


def geodesic(a, b, t, metric: str = "airm"):
    """The point at ``t`` (a Column or number) of the way from a to b."""
    if metric not in ("airm", "logeuclid", "euclid"):
        raise ValueError(f"no geodesic for metric {metric!r}")

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series, s: pd.Series) -> pd.Series:
        return _flat(linalg.geodesic(_square(x), _square(y), s.to_numpy(float), metric)) if len(x) else x

    return run(a, b, t if isinstance(t, (Column, str)) else F.lit(float(t)))


def transport(source, destination, vector):
    @F.pandas_udf("array<double>")
    def run(s: pd.Series, d: pd.Series, v: pd.Series) -> pd.Series:
        return _flat(linalg.transport(_square(s), _square(d), _square(v))) if len(s) else s

    return run(source, destination, vector)


def untangent(v, reference, metric: str = "airm"):
    @F.pandas_udf("array<double>")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return _flat(linalg.untangent(np.stack(x.to_numpy()), _square(r), metric)) if len(x) else x

    return run(v, reference)


def covariance(signal, estimator: str = "scm", assume_centered: bool = False):
    """Covariance of a channels x times signal (array<array<double>>) by ``scm``, ``ledoit_wolf`` or ``oas``."""
    if estimator not in ("scm", "ledoit_wolf", "oas"):
        raise ValueError(f"unknown estimator {estimator!r}")
    f = getattr(linalg, estimator)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        # trials of one shape go through one call
        shapes = x.map(lambda s: (len(s), len(s[0])))
        out = pd.Series(index=x.index, dtype=object)
        for _, part in x.groupby(shapes):
            done = f(np.stack([np.stack(s) for s in part]).astype(float), assume_centered)
            for at, m in zip(part.index, done):
                out[at] = m.ravel()
        return out

    return run(signal)
