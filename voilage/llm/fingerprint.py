"""Document fingerprints as homomorphic multiset hashes of paragraphs.

A paragraph is a line. It is hashed to a wide vector: 16 lanes of 32 bits from SHAKE-128 of its
bytes, and 96 lanes of 32 bits to which each pair of neighbouring words adds 1 or -1 at a hashed
place. A document's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**32.
So the order of paragraphs does not matter, a paragraph is inserted or deleted by one
addition or subtraction, and equal texts have equal fingerprints. As the second part is a linear
sketch of the word pairs, the cosine of two of them estimates how alike two texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voilage.llm import words as W
from voilage.llm.shared import documents_only

EQUAL_LANES = 16
LIKE_LANES = 96
BYTES = 4 * EQUAL_LANES + 4 * LIKE_LANES
_LOWEST = -(1 << 63)
_NONE = np.iinfo(np.int64).max


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's fingerprint: rows of uint32."""
    data, offsets = W.buffer_of(column)
    n = len(offsets) - 1
    equal = np.zeros((n, EQUAL_LANES), np.uint32)
    body = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            told = b"".join([hashlib.shake_128(line).digest(4 * EQUAL_LANES) for line in body[a:b].split(b"\n")])
            equal[i] = np.frombuffer(told, np.uint32).reshape(-1, EQUAL_LANES).sum(0, dtype=np.uint32)
    found = W.split(data, offsets, W.outside(W.WHITE), places=True)
    h, row = found.hashes, np.repeat(np.arange(n), np.diff(found.bounds))
    if not len(h):
        return equal, np.zeros((n, LIKE_LANES), np.uint32)
    line = np.searchsorted(np.flatnonzero(data == 10), found.starts)
    joined = (line[1:] == line[:-1]) & (row[1:] == row[:-1])
    alone = ~np.concatenate([[False], joined]) & ~np.concatenate([joined, [False]])
    pairs = W.mix(h[:-1][joined] * np.uint64(0x9E3779B97F4A7C15) + h[1:][joined])
    marks, where = np.concatenate([pairs, W.mix(h[alone])]), np.concatenate([row[:-1][joined], row[alone]])
    lane = (marks % np.uint64(LIKE_LANES)).astype(np.int64)
    sign = 1.0 - 2.0 * ((marks >> np.uint64(40)) & np.uint64(1)).astype(float)
    sums = np.bincount(where * LIKE_LANES + lane, sign, n * LIKE_LANES).reshape(n, LIKE_LANES)
    return equal, (sums.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32)


def packed(equal: np.ndarray, like: np.ndarray) -> list[str]:
    return [a.astype("<u4").tobytes().hex() + b.astype("<u4").tobytes().hex() for a, b in zip(equal, like)]


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw, "<u4", EQUAL_LANES), np.frombuffer(raw, "<u4", LIKE_LANES, 4 * EQUAL_LANES)


def _joined(fingerprint: str, paragraphs: list[str], sign: int) -> str:
    equal, like = (x.astype(np.int64) for x in unpacked(fingerprint))
    for more_equal, more_like in zip(*fingerprints(pa.array(paragraphs, pa.string()))):
        equal, like = equal + sign * more_equal.astype(np.int64), like + sign * more_like.astype(np.int64)
    return packed([(equal & 0xFFFFFFFF).astype(np.uint32)], [(like & 0xFFFFFFFF).astype(np.uint32)])[0]


def inserted(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint after adding these (non-empty) paragraphs."""
    return _joined(fingerprint, paragraphs, 1)


def deleted(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint after removing these (non-empty) paragraphs."""
    return _joined(fingerprint, paragraphs, -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1; 1 for equal fingerprints."""
    x, y = (p[1].astype(np.uint32).view(np.int32).astype(float) for p in (a, b))
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.where(size > 0, (x * y).sum(1) / np.maximum(size, 1e-300), 0.0)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed(*fingerprints(part.column(1))))], names=["doc_id", "fingerprint"])

    return documents_only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def _with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt into ranges of doc_id, each range followed by the first document of the next.

    Ranges are as many as the input has splits; their bounds and first ids are all that the driver
    learns, eight bytes each, and tasks look them up by bisection. The last range is followed by the
    first document of all.
    """
    texts = documents_only(docs, "doc_id", "text").withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST)))
    many = max(8, docs.rdd.getNumPartitions())
    quantiles = texts.approxQuantile("k", [i / many for i in range(1, many)], 0.25 / many)
    bounds = np.array(sorted({int(x) for x in quantiles}), np.int64)

    def firsts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest, held = np.full(len(bounds) + 1, _NONE), np.zeros(len(bounds) + 1, bool)
        for batch in batches:
            k = batch.column(0).to_numpy()
            own = np.searchsorted(bounds, k, "right")
            np.minimum.at(lowest, own, k)
            held[own] = True
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(lowest[seen])], names=["range", "first"])

    told = texts.select("k").mapInArrow(firsts_of, "range bigint, first bigint").groupBy("range").agg(F.min("first").alias("first")).toArrow()
    order = np.argsort(told.column("range").to_numpy())
    ranges, firsts = (told.column(c).to_numpy()[order] for c in ("range", "first"))
    lowest, previous = np.full(len(bounds) + 1, _NONE), np.zeros(len(bounds) + 1, np.int64)
    lowest[ranges], previous[ranges] = firsts, np.roll(ranges, 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            k = part.column(2).to_numpy()
            own = np.searchsorted(bounds, k, "right")
            first = np.flatnonzero(k == lowest[own])
            rows = np.concatenate([np.arange(len(k)), first])
            taken = part.take(pa.array(rows)) if len(first) else part
            place = np.concatenate([own, previous[own[first]]]).astype(np.int32)
            columns = [*taken.columns, pa.array(place), pa.array(np.arange(len(rows)) >= len(k))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "k", "range", "tail"])

    return texts.mapInArrow(deal, "doc_id bigint, text string, k bigint, range int, tail boolean")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range, tail, doc_id; each is held until the row after it is known."""
    held: tuple | None = None  # (range, doc_id, text), not a tail
    for part in W.slices(batches, "text", 2 << 20, 500):
        pairs = []
        for doc_id, text, place, tail in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "range", "tail"))):
            text = text or ""
            if held is not None and held[0] == place:
                pairs.append((held[1], held[2], text))
            held = None if tail else (place, doc_id, text)
        if not pairs:
            continue
        texts, nexts = [p[1] for p in pairs], [p[2] for p in pairs]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
        own, other, new = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, nexts, edited))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(packed(*own)),
                pa.array(packed(*new)),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, other)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and their likeness.

    The edit replaces the last half of the code points (rounded down) by the first as many of the
    next document in ascending doc_id order, the first one following the last. A null text is
    empty. Rows without doc_id come first; rows with the same doc_id follow one another in the
    order of their text's hash. A single document follows itself.
    """
    rows = _with_next(docs).repartitionByRange("range").sortWithinPartitions("range", "tail", "k", F.xxhash64("text"))
    return rows.mapInArrow(
        _compared,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
