"""What the operators on vectors share: which rows take part, their whole-number form, statistics per dimension."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors are multiplied by this and rounded down.
SCALE = 256


def finite(vectors: DataFrame, vector_col: str, limit: float, **columns: str) -> DataFrame:
    """Columns by their new names (of SQL expressions) and x: floor(256 c) of vectors that are not null and have only finite components.

    Vectors of another length than the most common one (the greater of equally common ones) take no part: they have no inner product
    with the others. Nor do those with a component of ``limit`` or more in size, whose products would leave the range of a long.
    """
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < limit), F.lit(False)))
    named = vectors.select(*(F.expr(e).alias(c) for c, e in columns.items()), v.alias("v")).filter(F.col("v").isNotNull() & good)
    sizes = named.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return named.filter(F.size("v") == (sizes["n"] if sizes else 0)).select(*columns, F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def matrix(column: pd.Series, dtype: type = np.int64) -> np.ndarray:
    return np.stack([np.asarray(x, dtype) for x in column])


def per_dimension(rows: DataFrame) -> pd.DataFrame:
    """(n, sum, sum of squares, least, greatest) of each dimension of ``x``, exact, as Python numbers: one small row per dimension and batch is summed up."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["x"])
                wide = x if int(np.abs(x).max(initial=0)) ** 2 * len(x) < 2**62 else x.astype(object)
                sums, squares = wide.sum(0), (wide * wide).sum(0)
                yield pd.DataFrame({"d": range(x.shape[1]), "n": len(x), "s": [Decimal(int(s)) for s in sums], "q": [Decimal(int(q)) for q in squares], "lo": x.min(0), "hi": x.max(0)})

    parts = rows.select("x").mapInPandas(partial, "d int, n long, s decimal(38,0), q decimal(38,0), lo long, hi long")
    total = lambda c: F.sum(c).cast("string").alias(c)
    out = parts.groupBy("d").agg(F.sum("n").alias("n"), total("s"), total("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").toPandas()
    return out.assign(s=[int(s) for s in out["s"]], q=[int(q) for q in out["q"]])
