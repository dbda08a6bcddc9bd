"""Hashed byte n-gram features and small linear models over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage.llm import words as W

BITS = 12
WIDTH = 1 << BITS
_STEP = 1 << 20


def gram_counts(text: np.ndarray) -> np.ndarray:
    """How often each hashed pair and triple of bytes occurs in a text of any length."""
    total = np.zeros(WIDTH, np.int64)
    for at in range(0, max(len(text) - 1, 0), _STEP):
        x = text[at : at + _STEP + 2].astype(np.uint32)
        two = (x[:-1] << np.uint32(8)) | x[1:]
        three = (two[:-1] << np.uint32(8)) | x[2:]
        both = np.concatenate([two[:_STEP] + np.uint32(1 << 24), three[:_STEP]]) * np.uint32(0x9E3779B1)
        total += np.bincount(both >> np.uint32(32 - BITS), minlength=WIDTH)
    return total


def shares(column: pa.Array, fold: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Feature vector of each text: counts over their sum."""
    data, offsets = W.buffer_of(column)
    for i in range(len(offsets) - 1):
        x = data[offsets[i] : offsets[i + 1]]
        counts = gram_counts(x if fold is None else fold[x])
        yield (counts / max(1, counts.sum())).astype(np.float32)


def sparse(x: np.ndarray) -> bytes:
    """The values of a row that are not zero, with their places: 6 bytes each."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def dense(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows written by ``sparse``, in one array."""
    x, i = np.zeros((len(rows), width), np.float32), 0
    for chunk in rows.chunks:
        for row in chunk:
            raw = memoryview(row.as_buffer())
            n = len(raw) // 6
            x[i, np.frombuffer(raw[: 2 * n], "<u2")] = np.frombuffer(raw[2 * n :], "<f4")
            i += 1
    return x


def fit(x: np.ndarray, y: np.ndarray, steps: int = 200, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic models, one per column of y (values 0 to 1): weights over raw features, offsets, margins of the rows of x.

    Features are standardized with a floor on their spread, so rare n-grams do not count for
    much; the standardization is folded into the result. Accelerated full gradient steps.
    ``x`` is standardized in place, so that the sample is held once.
    """
    mean, total = x.mean(0, dtype=np.float64), np.zeros(x.shape[1])
    blocks = [slice(i, i + 256) for i in range(0, len(x), 256)]
    for b in blocks:
        total += ((x[b] - mean) ** 2).sum(0)
    mean, spread = mean.astype(np.float32), np.sqrt(total / len(x)).astype(np.float32)
    spread = spread + max(float(np.median(spread)), 1e-6)
    for b in blocks:
        x[b] -= mean
        x[b] /= spread
    rate = 4.0 / max(float(np.einsum("ij,ij->i", x, x).max()) / 4, 1.0)
    weights, offset = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    ahead_w, ahead_b = weights, offset
    for step in range(steps):
        error = (1 / (1 + np.exp(-(x @ ahead_w + ahead_b))) - y).astype(np.float32)
        new_w = ahead_w - rate * (x.T @ error / len(x) + decay * ahead_w)
        new_b = ahead_b - rate * error.mean(0)
        push = step / (step + 3)
        ahead_w, ahead_b = new_w + push * (new_w - weights), new_b + push * (new_b - offset)
        weights, offset = new_w, new_b
    margins = x @ weights + offset
    weights = weights / spread[:, None]
    return weights, offset - mean @ weights, margins


def in_sample(key: Column, share: Column) -> Column:
    """Whether a row falls into a share (0 to 1) of all rows, the same on every run."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)


def collected(sample: DataFrame, limit: int) -> pa.Table:
    """The rows of a sample that is small by its share; the limit only guards against repeated keys."""
    return sample.limit(limit).toArrow()
