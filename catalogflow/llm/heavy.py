"""Frequent word runs, found while a table passes by, to be put last in every global order.

The order only steers the work: any set of frequent runs gives the same results. What it bounds is skew:
a run that is left out occurs less often than each of the LIMIT runs of the table, or too thinly to be
reported, so at most in a share of 1 / LIMIT + (LOCAL - 1) / BLOCK, seven millionths, of all runs. Its list is
less than a fair share of up to 140,000 tasks, however large the table is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run counts as frequent from this many occurrences on; the most frequent LIMIT ones are used (8
#: bytes each reach every task).
FREQUENT, LIMIT = 8, 200_000
#: A task counts within blocks of so many runs, and reports those that occur LOCAL times in a block.
BLOCK, LOCAL = 1_000_000, 3


class BlockCounter:
    """Counts, block by block, how often each run occurs in what is added."""

    def __init__(self) -> None:
        self.held, self.size = [], 0

    def add(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.held.append(runs)
        self.size += len(runs)
        return self.flush() if self.size >= BLOCK else None

    def flush(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        runs, self.held, self.size = np.concatenate(self.held), [], 0
        runs.sort()  # in place: a task has little memory
        starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        counts = np.diff(np.append(starts, len(runs)))
        often = counts >= LOCAL
        return runs[starts[often]].view(np.int64), counts[often]


def frequent(counts: DataFrame) -> np.ndarray:
    """The frequent runs of (run, n), sorted, as unsigned numbers; at most LIMIT of them."""
    found = counts.groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "run").limit(LIMIT).select("run").toPandas()
    return np.sort(found["run"].to_numpy(np.int64).view(np.uint64)) if len(found) else np.empty(0, np.uint64)


class Known:
    """Membership in a sorted array of hashes: a table of their top bits first, then binary search for
    what it lets through."""

    def __init__(self, ordered: np.ndarray) -> None:
        self.ordered, self.table = ordered, np.zeros(1 << 22, bool)
        self.table[(ordered >> np.uint64(42)).astype(np.int64)] = True

    def among(self, values: np.ndarray) -> np.ndarray:
        """Which of ``values`` stand in the array."""
        if not len(self.ordered):
            return np.zeros(len(values), bool)
        found = self.table[(values >> np.uint64(42)).astype(np.int64)]
        maybe = np.flatnonzero(found)
        at = np.minimum(np.searchsorted(self.ordered, values[maybe]), len(self.ordered) - 1)
        found[maybe] = self.ordered[at] == values[maybe]
        return found
