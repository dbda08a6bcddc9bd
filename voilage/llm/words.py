"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

A text column is one byte buffer with offsets. Blocks of it are split by a byte table, and each
word's hash is a difference of running sums of a polynomial over per-byte random values:
``sum(T[byte] * P**i)`` from the word's start. Odd P has an inverse modulo 2**64, which moves the
sum to position 0. A last mix spreads it over all bits. Working memory is a block, not a batch;
what remains is eight bytes a word and hash or place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, 5 modulo 8: powers differ in their high bits soonest
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_JOIN = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _letters() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(p: np.uint64) -> np.ndarray:
        x = np.full(n, p, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return run(_P), run(_PINV)


@functools.cache
def outside(separators: bytes) -> np.ndarray:
    """Table of the bytes that belong to words: all but the separators."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: all ASCII but digits and lower-case letters
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


@functools.cache
def lower() -> np.ndarray:
    """Byte table that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@dataclass
class Words:
    hashes: np.ndarray  # uint64, of all texts in order
    bounds: np.ndarray  # int64, text i has the words bounds[i]:bounds[i + 1]
    starts: np.ndarray | None = None  # byte places in the column's buffer
    ends: np.ndarray | None = None


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null text has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    places = places[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def slices(batches: Iterator[pa.RecordBatch], text: int | str = 1, size: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of about ``size`` bytes of text, one row at least, so that memory does not follow theirs."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < len(batch):
            to = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows)
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def _blocks(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end behind a separator, or at the end."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + BLOCK, n)
        if to < n:
            free = np.flatnonzero(~inside[data[at:to]])
            while not len(free) and to < n:  # one long word: go on to its end
                upto = min(to + BLOCK, n)
                free = np.flatnonzero(~inside[data[to:upto]]) + (to - at)
                to = upto
            if len(free):
                to = at + int(free[-1]) + 1
        yield at, to
        at = to


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = None, places: bool = False) -> Words:
    """Words of each text, as hashes of their bytes after folding."""
    hashes, starts, ends = [], [], []
    letters = _letters()
    for at, to in _blocks(data, inside if fold is None else inside[fold]):
        x = data[at:to] if fold is None else fold[data[at:to]]
        is_word = inside[x]
        cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
        before = np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        before[cuts] = False
        after = np.empty_like(is_word)
        after[-1], after[:-1] = False, is_word[1:]
        after[cuts - 1] = False
        s, e = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        up, down = _powers(max(BLOCK, 1 << (to - at - 1).bit_length()))
        run = np.zeros(to - at + 1, np.uint64)
        np.cumsum(letters[x] * up[: to - at], out=run[1:])
        hashes.append(mix((run[e] - run[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
    none = np.zeros(0, np.int64)
    s = np.concatenate(starts) if starts else none
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.searchsorted(s, offsets).astype(np.int64),
        s if places else None,
        (np.concatenate(ends) if ends else none) if places else None,
    )


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words; shorter input gives no run."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    at, last, power = n, len(hashes), np.uint64(1)
    total = np.zeros(last - n + 1, np.uint64)
    for i in range(n):
        total += hashes[n - 1 - i : last - i] * power
        power = np.uint64((int(power) * int(_JOIN)) & 0xFFFFFFFFFFFFFFFF)
    return mix(total + np.uint64(at))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The same kind of hash for long runs: one running sum for any n."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(max(BLOCK, 1 << (len(hashes) - 1).bit_length()))
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=run[1:])
    return mix((run[n:] - run[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest value of each run of w values, the rightmost among equals."""
    n = len(x)
    if n < w:
        return np.zeros(0, np.int64)
    # doubling: the minimum over 2**k values from those over 2**(k - 1)
    best, span = np.arange(n), 1
    while span * 2 <= w:
        a, b = best[:-span], best[span:]
        best, span = np.where(x[b] <= x[a], b, a), span * 2
    a, b = best[: n - w + 1], best[w - span : w - span + n - w + 1]
    return np.where(x[b] <= x[a], b, a)
