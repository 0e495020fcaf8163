"""Sums of slopes over the rows of a table, and the optimiser's step that uses them. What is fitted this way has its weights on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, slopes: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum of slopes(batch), a vector of that size, over all Arrow batches. A task adds up its batches; the vectors of the tasks meet in one aggregation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                got = slopes(b)
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    out = np.zeros(size)
    for r in df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as weights
        out[r["i"]] = r["v"]
    return out


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.t, self.first, self.second = rate, 0, np.zeros(size), np.zeros(size)

    def step(self, slopes: np.ndarray) -> np.ndarray:
        """What to subtract from the weights."""
        self.t += 1
        self.first, self.second = 0.9 * self.first + 0.1 * slopes, 0.99 * self.second + 0.01 * slopes**2
        return self.rate * (self.first / (1 - 0.9**self.t)) / (np.sqrt(self.second / (1 - 0.99**self.t)) + 1e-8)
