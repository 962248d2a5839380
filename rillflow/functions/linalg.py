"""Dense linear algebra on small matrices, one a row, as nested arrays of doubles. Matrices of one shape in a batch are worked on together by numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATRIX, VECTOR = "array<array<double>>", "array<double>"


def _stacked(function: Callable[..., np.ndarray | tuple], returns: str, count: int = 1) -> Callable[..., Column]:
    """``function`` of stacks of ``count`` operands each; None for rows with a null operand, an error for matrices it can't be of."""

    def run(series: tuple[pd.Series, ...]) -> list:
        out: list = [None] * len(series[0])
        shapes: dict[tuple, list[tuple[int, list[np.ndarray]]]] = {}
        for k, row in enumerate(zip(*series, strict=True)):
            if any(x is None for x in row):
                continue
            arrays = [np.array([np.asarray(r, float) for r in x]) if len(x) and isinstance(x[0], (list, np.ndarray)) else np.asarray(x, float) for x in row]
            shapes.setdefault(tuple(a.shape for a in arrays), []).append((k, arrays))
        for group in shapes.values():
            made = function(*[np.stack(x) for x in zip(*[a for _, a in group], strict=True)])
            for n, (k, _) in enumerate(group):
                out[k] = tuple(m[n].tolist() for m in made) if isinstance(made, tuple) else made[n].tolist()
        return out

    def one(a: pd.Series) -> pd.Series:
        return pd.Series(run((a,)))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(run((a, b)))

    def fields(a: pd.Series) -> pd.DataFrame:
        names = [f.split(":")[0].strip() for f in returns[len("struct<") : -1].split(", ")]
        return pd.DataFrame([(None,) * len(names) if r is None else r for r in run((a,))], columns=names)

    for f in (one, two, fields):
        f.__annotations__ = {k: {"pd.Series": pd.Series, "pd.DataFrame": pd.DataFrame}[v] for k, v in f.__annotations__.items()}
    chosen = fields if returns.startswith("struct") else one if count == 1 else two
    return lambda *columns: F.pandas_udf(chosen, returns)(*columns)


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, b)


cholesky = _stacked(np.linalg.cholesky, MATRIX)
inverse = _stacked(np.linalg.inv, MATRIX)
determinant = _stacked(np.linalg.det, "double")
log_determinant = _stacked(lambda a: tuple(np.linalg.slogdet(a)), "struct<sign: double, log: double>")
#: The signs that a decomposition leaves open are set: R's diagonal, each singular and each eigen vector's largest component are not below 0.
qr = _stacked(lambda a: _signed_qr(*np.linalg.qr(a)), "struct<q: array<array<double>>, r: array<array<double>>>")
singular_values = _stacked(lambda a: np.linalg.svd(a, compute_uv=False), VECTOR)
svd = _stacked(lambda a: _signed_svd(*np.linalg.svd(a, full_matrices=False)), "struct<u: array<array<double>>, s: array<double>, v: array<array<double>>>")
eigen = _stacked(lambda a: _signed_eigen(*np.linalg.eigh(a)), "struct<values: array<double>, vectors: array<array<double>>>")
solve = _stacked(solved, MATRIX, 2)
least_squares = _stacked(lambda a, b: np.linalg.pinv(a) @ b, MATRIX, 2)
triangular_solve = _stacked(lambda a, b: np.linalg.solve(np.tril(a), b), MATRIX, 2)


def _signed_qr(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
    return q * sign[:, None, :], r * sign[:, :, None]


def _signs(columns: np.ndarray) -> np.ndarray:
    largest = np.take_along_axis(columns, np.abs(columns).argmax(1)[:, None, :], 1)
    return np.where(largest < 0, -1.0, 1.0)


def _signed_svd(u: np.ndarray, s: np.ndarray, vt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign = _signs(u)
    return u * sign, s, np.swapaxes(vt, 1, 2) * sign


def _signed_eigen(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values, vectors * _signs(vectors)
