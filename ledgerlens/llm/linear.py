"""Sparse linear classifiers in numpy, and bounded samples to fit them on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ragged


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, mod k; -1 (no fold) for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % k, F.lit(-1))


@dataclass
class Rows:
    """Sparse 0/1 rows: the features of row i are `ids[starts[i]:starts[i + 1]]`."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        self.starts, self.owner = ragged(self.lengths)

    def __len__(self) -> int:
        return len(self.lengths)

    def take(self, rows: np.ndarray) -> Rows:
        parts = [self.ids[self.starts[i] : self.starts[i] + self.lengths[i]] for i in rows.tolist()]
        return Rows(np.concatenate(parts) if parts else self.ids[:0], self.lengths[rows])

    def keep(self, place: np.ndarray) -> Rows:
        """Only features with a place (>= 0), renumbered."""
        new = place[self.ids]
        kept = new >= 0
        return Rows(new[kept], np.bincount(self.owner[kept], minlength=len(self)))

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.ids], minlength=len(self)) + bias

    def gradient(self, errors: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.ids, weights=errors[self.owner], minlength=n)

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.ids, minlength=n)


def without_copies(rows: Rows, tables: int = 6, width: int = 4) -> np.ndarray:
    """Row numbers with one of each group of near copies: rows that agree in all minima of a table of min-hashes.

    In a fit sample a passage that was copied a hundred times would pass for a hundred witnesses.
    """
    first = np.arange(len(rows))
    some = np.flatnonzero(rows.lengths)
    with np.errstate(over="ignore"):
        for t in range(tables):
            keys = []
            for k in range(width):
                x = (rows.ids.astype(np.uint64) + np.uint64(1 + 97 * (t * width + k))) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                keys.append(np.minimum.reduceat(x ^ (x >> np.uint64(32)), rows.starts[some]) if len(some) else x[:0])
            seen: dict[tuple, int] = {}
            for row, key in zip(some.tolist(), zip(*(k.tolist() for k in keys), strict=True), strict=True):
                first[row] = min(first[row], first[seen.setdefault(key, row)])
    return np.flatnonzero(first == np.arange(len(rows)))


def from_binary(column: pa.ChunkedArray) -> Rows:
    """Rows from a column of little-endian int32 arrays."""
    values = [np.frombuffer(x or b"", "<i4") for x in column.to_pylist()]
    return Rows(np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64), np.array([len(v) for v in values], np.int64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps with a proximal L1 step on the weights."""

    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, x: np.ndarray, gradient: np.ndarray, l1: float = 0.0) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.99 * self.v + 0.01 * gradient * gradient
        x = x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9)
        if l1:
            x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - self.rate * l1, 0)
        return x


def fit_logistic(rows: Rows, y: np.ndarray, n: int, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 250, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression; soft labels are allowed."""
    x, adam = np.zeros(n + 1), Adam(n + 1, rate)
    weight = np.ones(len(rows)) if weight is None else weight
    total = max(float(weight.sum()), 1.0)
    for _ in range(steps):
        errors = weight * (sigmoid(rows.logits(x[:-1], x[-1])) - y) / total
        x = adam.step(x, np.append(rows.gradient(errors, n) + l2 * x[:-1], errors.sum()))
    return x[:-1], float(x[-1])


def fit_scale(z: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Platt scaling: slopes over the columns of z, and an intercept, with smoothed targets."""
    z = z.reshape(len(y), -1)
    pos = y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    x, adam = np.append(np.full(z.shape[1], 0.5), 0.0), Adam(z.shape[1] + 1, rate)
    for _ in range(steps if len(y) else 0):
        errors = (sigmoid(z @ x[:-1] + x[-1]) - target) / len(y)
        x = adam.step(x, np.append(errors @ z + 1e-4 * x[:-1], errors.sum()))
    return x[:-1], float(x[-1])


def bounded_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` distinct ids, the first by a hash of the id: a sample that doesn't depend on the partitions."""
    return ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def texts_for(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The documents (one a sampled id, whichever text is least) with the sample's columns. The sample is bounded, so it may be broadcast."""
    found = docs.join(F.broadcast(sample), "id")
    return found.groupBy(*sample.columns).agg(F.min("text").alias("text"))
