"""The most frequent of many counted values, as sorted arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.workspace import release, stored


def most_frequent(counted: DataFrame, least: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, n) summed by value: (values in ascending order as uint64, their counts) of those with a count of at least `least`.

    Where these are more than limit, only the most frequent are returned, cut at
    a step of an eighth of a doubling: 16 * limit bytes come to the driver at
    most. The counts themselves stay on the executors.
    """
    counts = stored(counted.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    cut, total = 1 << 62, 0
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("values")).collect()
    for step in sorted(steps, key=lambda s: -s["n"]):
        total += step["values"]
        if total > limit:
            break
        cut = step["n"]
    chosen = counts.where(F.col("n") >= cut).toArrow()
    values, weights = chosen.column("value").to_numpy().view(np.uint64), chosen.column("n").to_numpy()
    order = np.argsort(values)
    release(counts)
    return values[order], weights[order]


class Weights:
    """Counts of known values, 0 for others; a bitmap answers most questions about others."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts
        self.known = np.zeros(1 << 20, bool)
        self.known[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(codes), np.int64)
        if len(self.values):
            maybe = np.flatnonzero(self.known[(codes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.values, codes[maybe]), len(self.values) - 1)
            found[maybe] = np.where(self.values[at] == codes[maybe], self.counts[at], 0)
        return found
