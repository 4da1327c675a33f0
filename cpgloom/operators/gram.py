"""Normal-equation sums of a design matrix, per fold, in one pass.

Tasks add up their rows with BLAS and emit one small matrix; the sums over tasks run on the
cluster.  What reaches the driver has the size features x features x folds, independent of the
number of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Above this width the sums are no longer small for the driver; callers that check it refuse.
MAX_FEATURES = 3000


def fold_grams(
    df: DataFrame, vec: str, fold: str | None = None, prepare: Callable[[np.ndarray], np.ndarray] | None = None
) -> dict[int, np.ndarray]:
    """Z'Z per fold for Z = [1, vec]; ``prepare`` may rewrite a block of rows first."""
    key = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.select(key.alias("fold"), F.col(vec).alias("v"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf["v"].to_numpy()).astype("float64")
            x = prepare(x) if prepare else x
            z = np.hstack([np.ones((len(x), 1)), x])
            f = pdf["fold"].to_numpy()
            for one in np.unique(f):
                part = z[f == one]
                sums[int(one)] = sums.get(int(one), 0.0) + part.T @ part
        for one, g in sums.items():
            yield pd.DataFrame({"fold": one, "i": np.arange(len(g)), "row": list(g)})

    parts = rows.mapInPandas(partial, "fold INT, i INT, row ARRAY<DOUBLE>")
    total = parts.groupBy("fold", "i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in total.collect():
        out.setdefault(r["fold"], {})[r["i"]] = r["row"].toArray()
    return {f: np.vstack([rows_[i] for i in sorted(rows_)]) for f, rows_ in out.items()}


def centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and centred cross products of the columns behind Z'Z."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, mean, g[1:, 1:] - n * np.outer(mean, mean)
