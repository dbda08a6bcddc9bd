"""Fill-in-middle: texts cut at unit ends and put together anew for infilling.

The ends of a text's units (runs of ASCII letters, or any other single character) are kept as a set
of byte places in the manner of Roaring bitmaps: one container for each 65,536 places, stored as a
sorted array, as a bitmap or as runs, whichever is smallest, with the cumulated cardinalities of
the containers before it. The k-th end is found by a binary search for its container and a selection
inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voilage.llm import words as W
from voilage.llm.shared import documents_only

CHUNK = 1 << 16  # places in a container
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
SEED = "1:"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BITS_SET = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# --- the set of boundaries ---------------------------------------------------------------


@dataclass(frozen=True)
class Listed:
    """A container of few places: the places in order."""

    values: np.ndarray  # uint16

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass(frozen=True)
class Bitmap:
    """A container of many scattered places: a bit for each possible place."""

    bits: np.ndarray  # uint8, lowest bit first
    counted: np.ndarray  # bits set up to the end of each byte

    @classmethod
    def of(cls, values: np.ndarray) -> Bitmap:
        flags = np.zeros(CHUNK, bool)
        flags[values] = True
        bits = np.packbits(flags, bitorder="little")
        return cls(bits, np.cumsum(_BITS_SET[bits], dtype=np.int32))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.counted, k, "right"))
        inside = k - (int(self.counted[at - 1]) if at else 0)
        return at * 8 + int(np.flatnonzero(np.unpackbits(self.bits[at : at + 1], bitorder="little"))[inside])


@dataclass(frozen=True)
class Runs:
    """A container of places that lie side by side: first places, and places counted up to each run's end."""

    firsts: np.ndarray
    counted: np.ndarray

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.counted, k, "right"))
        return int(self.firsts[at]) + k - (int(self.counted[at - 1]) if at else 0)


def container(values: np.ndarray) -> Listed | Bitmap | Runs:
    """The smallest container of sorted places from 0 to 65,535."""
    opens = np.flatnonzero(np.diff(values.astype(np.int32), prepend=-2) != 1)
    sizes = {Listed: 2 * len(values), Bitmap: CHUNK // 8, Runs: 4 * len(opens)}
    kind = min(sizes, key=sizes.get)
    if kind is Listed:
        return Listed(values.astype(np.uint16))
    if kind is Bitmap:
        return Bitmap.of(values)
    return Runs(values[opens], np.concatenate([opens[1:], [len(values)]]))


class Boundaries:
    """A sorted set of places, of any size, that tells its k-th member."""

    def __init__(self, places: np.ndarray) -> None:
        high = places >> 16
        self.keys, first = np.unique(high, return_index=True)
        edges = np.concatenate([first, [len(places)]])
        self.containers = [container(places[a:b] & (CHUNK - 1)) for a, b in zip(edges[:-1], edges[1:])]
        self.counted = edges[1:]

    def __len__(self) -> int:
        return int(self.counted[-1]) if len(self.counted) else 0

    def select(self, k: int) -> int:
        """The member that k members are smaller than."""
        at = int(np.searchsorted(self.counted, k, "right"))
        before = int(self.counted[at - 1]) if at else 0
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - before)


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where a unit of any of the texts ends, for texts that lie one after the other."""
    if not len(data):
        return np.zeros(0, np.int64)
    letter, ends = _LETTER[data], np.ones(len(data), bool)
    ends[:-1] = ((data[1:] & 0xC0) != 0x80) & ~(letter[:-1] & letter[1:])
    bounds = offsets[1:]
    ends[bounds[bounds > 0] - 1] = True
    return np.flatnonzero(ends) + 1


# --- the transformation ------------------------------------------------------------------


@dataclass(frozen=True)
class Markers:
    prefix: str = PREFIX
    suffix: str = SUFFIX
    middle: str = MIDDLE

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] for m in marks):
            raise ValueError("markers must differ, and none may hold its first character twice")
        if any(a in b for a in marks for b in marks if a != b) or len({m[0] for m in marks}) > 1:
            raise ValueError("markers must begin alike and not hold one another")


def _draws(key: bytes) -> tuple[int, int, int, int]:
    found = hashlib.sha256(key).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in (0, 4, 8, 12))


def _transformed(markers: Markers, plain_from: int, spm_below: int, seed: str):
    p, s, m = (x.encode() for x in (markers.prefix, markers.suffix, markers.middle))

    def arranged(key: bytes, text: bytes, ends: np.ndarray) -> tuple:
        """(units, form, characters of prefix and of middle, output) of one text and its unit ends."""
        n = len(ends)
        h1, h2, h3, h4 = _draws(key)
        if not text or h3 % 100 >= plain_from or p in text or s in text or m in text:
            return n, "plain", None, None, text
        units, cuts = Boundaries(ends), sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (units.select(k - 1) if k else 0 for k in cuts)
        before, middle, after = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < spm_below
        out = s + after + p + before + m + middle if spm else p + before + s + after + m + middle
        return n, "spm" if spm else "psm", _characters(before), _characters(middle), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            data, offsets = W.buffer_of(part.column(1))
            ends, body = unit_ends(data, offsets), data.tobytes()
            edges = np.searchsorted(ends, offsets, "right")
            rows = []
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                start = int(offsets[i])
                key = f"{seed}{'' if doc_id is None else doc_id}".encode()
                rows.append(arranged(key, body[start : offsets[i + 1]], ends[edges[i] : edges[i + 1]] - start))
            n, form, prefix, middle, out = zip(*rows)
            columns = [
                part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _characters(text: bytes) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def fill_in_middle(
    docs: DataFrame, markers: Markers = Markers(), *, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: str = SEED
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of ``docs``.

    ``n`` counts the units. What is drawn depends on ``seed`` and doc_id only, so repeated rows are
    cut alike; rows without doc_id are drawn by the seed alone. A null or empty text, a text that
    holds a marker, and the share drawn for it stay ``plain``: the output is the text (empty for
    null) and the character counts are null. Texts of any length are taken whole; columns besides
    doc_id and text are not looked at; an empty table gives an empty one.
    """
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return documents_only(docs, "doc_id", "text").mapInArrow(_transformed(markers, plain_from, spm_below, seed), schema)


def restore(done: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``done`` with the text rebuilt from output and form alone, as column ``restored``.

    A text that holds no marker holds none when cut either: a marker's first character begins only
    it. So the first marker of a kind is the one put there.
    """
    out = F.col("output")
    after_first = F.substring(out, len(markers.prefix) + 1, 2147483647)  # markers of the head are taken off by length
    after_suffix = F.substring(out, len(markers.suffix) + 1, 2147483647)
    middle = F.substring_index(out, markers.middle, -1)
    psm_head = F.substring_index(after_first, markers.middle, 1)
    spm_head = F.substring_index(after_suffix, markers.middle, 1)
    psm = F.concat(F.substring_index(psm_head, markers.suffix, 1), middle, F.substring_index(psm_head, markers.suffix, -1))
    spm = F.concat(F.substring_index(spm_head, markers.prefix, -1), middle, F.substring_index(spm_head, markers.prefix, 1))
    return done.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    done = restore(fill_in_middle(docs))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
