"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never made: only its products with a thin block are, each one pass over the centred rows (XᵀXQ), summed in tasks. From a
first block and its product, Rayleigh-Ritz values bound the spectrum. Then a Chebyshev polynomial, by its three-term recurrence, damps all
below the block's smallest Ritz value; QR and another Rayleigh-Ritz follow. The iteration ends when each wanted vector is certified: its
residual over its distance to the other Ritz values bounds the sine of its angle to the eigenvector. A block that makes no way is widened, at last to
all dimensions, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import finite, matrix, per_dimension

COMPONENTS = 4
#: Vectors of the block beyond the wanted ones; degree of the filter; rounds before the block is widened.
GUARD, DEGREE, ROUNDS = 20, 12, 5
#: A vector is certified at this sine of its angle, or where its residual is down to rounding.
CERTIFIED, ROUNDING = 1e-10, 2e-14
BLOCK = 4096
#: Parts that partial products are summed in; each gives one row to the driver.
SUMS = 8
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Components of more than this would not be whole numbers of doubles.
LIMIT = 2.0**40


def _packed(rows: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                yield pd.DataFrame({"rows": [matrix(pdf["x"].iloc[at : at + BLOCK]).tobytes()]})

    return rows.select("x").mapInPandas(pack, "rows binary")


class Centred:
    """Passes over the packed rows of the fit list, less their mean."""

    def __init__(self, packed: DataFrame, n: int, mean: np.ndarray):
        self.packed, self.n, self.mean = packed, n, mean

    def summed(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``of`` over all blocks: within a task, then in at most ``SUMS`` parts, of which the driver adds up the rest."""
        mean, dim, total = self.mean, len(self.mean), np.zeros(shape)

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, any_ = np.zeros(shape), False
            for pdf in batches:
                for rows in pdf["rows"]:
                    out += of(np.frombuffer(rows, np.int64).reshape(-1, dim) - mean)
                    any_ = True
            if any_:
                yield pd.DataFrame({"sum": [out.tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(shape)
            for pdf in batches:
                out += sum(np.frombuffer(x).reshape(shape) for x in pdf["sum"])
            yield pd.DataFrame({"sum": [out.tobytes()]})

        parts = self.packed.mapInPandas(one, "sum binary").repartition(SUMS).mapInPandas(add, "sum binary")
        for part in parts.toPandas()["sum"]:
            total += np.frombuffer(part).reshape(shape)
        return total

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``."""
        return self.summed(lambda x: x.T @ (x @ q), q.shape) / self.n


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residual norms of an orthonormal basis, of which ``product`` is the covariance's product."""
    t = basis.T @ product
    values, turn = np.linalg.eigh((t + t.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def certificates(values: np.ndarray, residuals: np.ndarray, k: int, dim: int) -> np.ndarray:
    """A bound on the sine of the angle between each of the first ``k`` Ritz vectors and its eigenvector: residual over the gap to the others."""
    out = np.zeros(k)
    for j in range(k):
        others = np.delete(values, j)
        gap = np.abs(others - values[j]).min() if len(others) else np.inf
        if dim > len(values) and j == len(values) - 1:
            gap = 0.0  # what lies beyond the block is not known
        out[j] = residuals[j] / gap if gap > 0 else (np.inf if residuals[j] > 0 else 0.0)
    return out


def principal(fit: Centred, k: int, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS, certified: float = CERTIFIED, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues, falling, unit eigenvectors as columns, and the bounds that certify them."""
    dim = len(fit.mean)
    width = min(dim, k + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    first = fit.times(q)
    both = np.linalg.qr(np.hstack([q, first]))[0][:, : min(dim, 2 * width)]
    values, vectors, residuals = _ritz(both, fit.times(both))
    low = max(0.0, values[-1] - residuals[-1])
    while True:
        for _ in range(rounds):
            bounds = certificates(values, residuals, k, dim)
            if np.all((bounds <= certified) | (residuals[:k] <= ROUNDING * values[0])) or len(values) == dim:
                return values[:k], vectors[:, :k], bounds
            values, vectors, residuals = values[:width], vectors[:, :width], residuals[:width]
            high, top = values[-1], values[0]
            if not low < high < top:
                break  # nothing to damp: the spectrum is flat to rounding, or the block is too thin
            half, middle = (high - low) / 2, (high + low) / 2
            # The recurrence, scaled by its value at the greatest Ritz value, so that nothing overflows.
            sigma = first_sigma = half / (top - middle)
            before, now = vectors, (fit.times(vectors) - middle * vectors) * (sigma / half)
            for _ in range(1, degree):
                after = 1 / (2 / first_sigma - sigma)
                before, now = now, (fit.times(now) - middle * now) * (2 * after / half) - (sigma * after) * before
                sigma = after
            basis = np.linalg.qr(now)[0]
            values, vectors, residuals = _ritz(basis, fit.times(basis))
            low = max(0.0, min(low, values[-1]))
        width = min(dim, 2 * width)
        wider = np.random.default_rng(seed + width).standard_normal((dim, width - min(width, vectors.shape[1])))
        basis = np.linalg.qr(np.hstack([vectors[:, :width], wider]))[0]
        values, vectors, residuals = _ritz(basis, fit.times(basis))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: of each row on each of the first components.

    Entries c become x = floor(256 c); the fit list is each distinct x once: n vectors with sums S. ``deviation`` is the exact sum of
    (n x - S)² over dimensions, null where it leaves the range of a long. ``whitened`` is x - S/n on the component over its standard deviation,
    ``explained`` the component's share of the variance, ``identity_error`` the largest entry of the covariance of ``whitened`` over the fit
    list less the identity. Equal eigenvalues have no vectors of their own; any of their space serve.

    Rows whose vector is null or has null or non-finite entries are left out, and those that ``vectors.finite`` tells. Components without variance
    are left out, so fewer than two distinct vectors give an empty result, as an empty table does. Repeated rows and null ids
    are rows of their own; further columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = scratch.keep(finite(vectors, vector_col, LIMIT, vec_id=f"cast(`{id_col}` as long)"))
    distinct = scratch.keep(rows.select("x").distinct())
    stats = per_dimension(distinct)
    n = int(stats["n"].iloc[0]) if len(stats) else 0
    sums, trace = stats["s"].tolist(), sum(n * q - s * s for s, q in zip(stats["s"], stats["q"], strict=True))
    if trace == 0:
        return spark.createDataFrame([], RESULT)
    mean = np.array([s / n for s in sums])
    fit = Centred(scratch.keep(_packed(distinct)), n, mean)
    values, axes, _ = principal(fit, min(components, len(mean)))
    some = values > 1e-12 * values[0]
    values, axes = values[some], axes[:, some]
    project = axes / np.sqrt(values)
    gram = fit.summed(lambda x: (y := x @ project).T @ y, (len(values), len(values))) / n
    centre = fit.summed(lambda x: (x @ project).sum(0, keepdims=True), (1, len(values))) / n
    error = float(np.abs(gram - centre.T @ centre - np.eye(len(values))).max())
    explained = [float(e) / (trace / n**2) for e in values]
    most = int(max(stats["hi"].abs().max(), stats["lo"].abs().max()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(explained)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                x = matrix(part["x"])
                wide = x if len(mean) * (2 * n * most) ** 2 < 2**63 else x.astype(object)
                far = n * wide - np.array(sums, wide.dtype)
                deviation = [int(d) if d < 2**63 else None for d in (far * far).sum(1)]
                yield pd.DataFrame(
                    {
                        "vec_id": pd.array(part["vec_id"], "Int64").repeat(k),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)),
                        "n": n,
                        "deviation": pd.array(deviation, "Int64").repeat(k),
                        "whitened": ((x - mean) @ project).ravel(),
                        "explained": np.tile(explained, len(part)),
                        "identity_error": error,
                    }
                )

    return rows.mapInPandas(score, RESULT)
