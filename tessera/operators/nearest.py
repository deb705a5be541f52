"""Top-k lists inside a task: scores of a batch of rows meet the best of each query so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that travel to the executors in one pass over the base, and those that a task compares at a time.
PASS, BLOCK = 16_384, 512
#: Rows of the base that are compared at a time.
ROWS = 2048


class Best:
    """The k smallest (value, id) of every query."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.value, self.id = np.full((queries, k), np.inf), np.zeros((queries, k), np.int64)

    def add(self, at: int, values: np.ndarray, ids: np.ndarray) -> None:
        """values: queries from number `at` on x rows; inf is no candidate."""
        last = self.value[at : at + len(values), -1:]
        near = np.isfinite(values) & (values <= last)
        for r in np.flatnonzero(near.any(axis=1)):
            new = np.flatnonzero(near[r])
            v, i = np.concatenate([self.value[at + r], values[r, new]]), np.concatenate([self.id[at + r], ids[new]])
            order = np.lexsort((i, v))[: self.k]
            self.value[at + r], self.id[at + r] = v[order], i[order]

    def rows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, id, value of what is filled."""
        r, c = np.nonzero(np.isfinite(self.value))
        return queries[r], self.id[r, c], self.value[r, c]


def passes(asked: DataFrame, key: str) -> Iterator[list]:
    """Rows of asked in lots of about PASS, by a hash of their key; each lot is what a pass sends to the executors."""
    n = max(1, -(-asked.count() // PASS))
    for k in range(n):
        yield (asked if n == 1 else asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)).collect()


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)
