"""How many items a movement study needs: cells of a design grid, simulated in tasks, one group a cell."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPEATS = 2
CELL = "shape string, n int, j double, icc double, n_sims int, p_closes double, p_survives double, p_indeterminate double, coverage double, mean_width double, mean_point double"


def rates_for(shape: Column, j: Column, sensitivity: float = 0.95) -> Column:
    """Struct (governing, matched) of change rates with a difference of j: about one half, or below a fixed sensitivity."""
    symmetric = F.struct(((1 + j) / 2).alias("governing"), ((1 - j) / 2).alias("matched"))
    return F.when(shape == "symmetric", symmetric).otherwise(F.struct(F.lit(sensitivity).alias("governing"), (F.lit(sensitivity) - j).alias("matched")))


def build_grid(spark: SparkSession, ns: Sequence[int], js: Sequence[float], iccs: Sequence[float], shape: str = "symmetric") -> DataFrame:
    """(shape, n, j, icc); at j = 1 the rates are 0 and 1, so all iccs are one cell."""
    at = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    grid = spark.range(1).select(F.lit(shape).alias("shape"), at(ns, "n")).select("*", at(js, "j")).select("*", at(iccs, "icc"))
    return grid.withColumn("icc", F.when(F.col("j") == 1.0, F.lit(0.0)).otherwise(F.col("icc"))).distinct()


def _cell_seed(seed: int, shape: str, n: int, j: float, icc: float) -> np.random.Generator:
    """Depends on the cell alone, not on its place in the grid."""
    return np.random.default_rng([seed, n, round(j * 10**6), round(icc * 10**6), sum(map(ord, shape))])


def _rates(rng: np.random.Generator, size: tuple[int, int], mean: float, icc: float) -> np.ndarray:
    if icc == 0 or mean in (0.0, 1.0):
        return np.full(size, mean)
    nu = (1 - icc) / icc
    return rng.beta(mean * nu, (1 - mean) * nu, size=size)


def run_cells(grid: DataFrame, sims: int = 200, resamples: int = 400, seed: int = 0, rho: float = 0.0, threshold: float = 0.70, sensitivity: float = 0.95) -> DataFrame:
    """Per cell the shares of the three states of the bootstrap interval of J, its coverage, width and mean point."""
    normal = NormalDist()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape, n, j, icc = pdf.iloc[0][["shape", "n", "j", "icc"]]
        n = int(n)
        rng = _cell_seed(seed, shape, n, j, icc)
        p, q = ((1 + j) / 2, (1 - j) / 2) if shape == "symmetric" else (sensitivity, sensitivity - j)
        a = rng.standard_normal((sims, n, REPEATS))
        b = rho * a + (1 - rho**2) ** 0.5 * rng.standard_normal((sims, n, REPEATS))
        cdf = np.vectorize(normal.cdf, otypes=[float])
        moved = (cdf(a) <= _rates(rng, (sims, n), p, icc)[..., None]).astype(int) - (cdf(b) <= _rates(rng, (sims, n), q, icc)[..., None]).astype(int)
        sums = moved.sum(axis=2)
        draws = rng.integers(0, n, size=(resamples, n))
        low, high = np.empty(sims), np.empty(sims)
        for k in range(sims):
            low[k], high[k] = np.quantile(sums[k][draws].mean(axis=1) / REPEATS, (0.025, 0.975))
        point = sums.mean(axis=1) / REPEATS
        closes, survives = low >= threshold, high < threshold
        row = (shape, n, j, icc, sims, closes.mean(), survives.mean(), (~closes & ~survives).mean(), ((low <= j) & (j <= high)).mean(), (high - low).mean(), point.mean())
        return pd.DataFrame([row], columns=[c.split()[0] for c in CELL.split(", ")])

    return grid.groupBy("shape", "n", "j", "icc").applyInPandas(run, CELL)


def point_sd(governing: Column, matched: Column, icc: Column, n: Column) -> Column:
    """Closed form of the standard deviation of J over n items with REPEATS repeats."""
    spread = lambda p: p * (1 - p) * (1 + (REPEATS - 1) * icc) / REPEATS
    return F.sqrt((spread(governing) + spread(matched)) / n)


def known_answers(cells: DataFrame, z_most: float = 4.5) -> DataFrame:
    """Cells whose mean point is further from its j than the closed form allows."""
    r = rates_for(F.col("shape"), F.col("j"))
    sd = point_sd(r["governing"], r["matched"], F.col("icc"), F.col("n")) / F.sqrt("n_sims")
    z = F.when(sd > 0, F.abs(F.col("mean_point") - F.col("j")) / sd).otherwise(F.lit(0.0))
    return cells.withColumn("z", z).filter(F.col("z") > z_most).select("shape", "n", "j", "icc", "z")


def smallest_usable_n(cells: DataFrame, ceiling: float = 0.20) -> DataFrame:
    return cells.groupBy("shape", "j", "icc").agg(F.min(F.when(F.col("p_indeterminate") <= ceiling, F.col("n"))).alias("n"))


def table(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    return cells.groupBy(row).pivot(column).agg(F.round(F.max(value), 3)).orderBy(row)
