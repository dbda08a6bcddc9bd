"""Packing of token sequences by length patterns.

Documents are cut into pieces of at most CAPACITY tokens. Only the histogram of piece lengths (at
most CAPACITY numbers) is planned with: patterns of two to four lengths that fill a sequence
exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and what remains is packed largest first into the fullest place it
fits, again by patterns with repeat counts. A piece finds its sequence by its rank among the
pieces of its length; ranks are counted in many small groups, so no length gathers in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voilage.llm.shared import documents_only, materialize
from voilage.llm.tokens import pieces_of

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 1000
PARTNERS = 12


def patterns(histogram: np.ndarray, partners: int = PARTNERS) -> np.ndarray:
    """Patterns (rows of four lengths, 0 for none) that fill a sequence exactly, from lengths there are."""
    top = len(histogram) - 1
    have = np.flatnonzero(histogram[:top] > 0)
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    common = have[np.argsort(-histogram[have], kind="stable")[:partners]]
    rng = np.random.default_rng(7)
    spread = have[rng.integers(0, len(have), (len(have), partners))]
    two = np.stack([have, top - have], 1)
    first = np.repeat(have, 2 * partners)
    second = np.concatenate([np.tile(common, (len(have), 1)), spread[:, : 2 * partners - len(common)]], 1)
    second = np.resize(second, (len(have), 2 * partners)).ravel()
    three = np.stack([first, second, top - first - second], 1)
    third = have[rng.integers(0, len(have), len(first))]
    four = np.stack([first, second, third, top - first - second - third], 1)
    rows = np.zeros((len(two) + len(three) + len(four), 4), np.int64)
    rows[: len(two), :2], rows[len(two) : len(two) + len(three), :3], rows[len(two) + len(three) :] = two, three, four
    last = (rows > 0).sum(1) - 1
    ok = (rows >= 0).all(1) & (last >= 1)
    used = histogram[np.clip(rows, 0, top)] > 0
    ok &= (used | (rows == 0)).all(1) & (rows.sum(1) == top)
    rows = np.sort(rows[ok], 1)[:, ::-1]
    return np.unique(rows, axis=0)


def fit_repeats(rows: np.ndarray, histogram: np.ndarray, steps: int = 600) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - histogram|, by accelerated projected gradients."""
    wide = len(histogram)
    target = histogram.astype(float)
    target[0] = 0
    x = np.zeros(len(rows))
    if not len(rows):
        return x

    def made(v: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(v, rows.shape[1]), wide)
        out[0] = 0
        return out

    v = np.ones(len(rows)) / np.sqrt(len(rows))
    for _ in range(20):  # largest eigenvalue of A'A
        w = made(v)[rows].sum(1)
        size = np.linalg.norm(w)
        v = w / size
    ahead = x
    for step in range(steps):
        slope = (made(ahead) - target)[rows].sum(1)
        new = np.maximum(0, ahead - slope / size)
        ahead = new + step / (step + 3) * (new - x)
        x = new
    return x


@dataclass
class Plan:
    """Slots of each length in order: the ranks from ``first`` on belong to a pattern's repeats."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)  # pieces of this length in one sequence
    sequence: list[int] = field(default_factory=list)  # number of the pattern's first sequence
    offset: list[int] = field(default_factory=list)  # of the first such piece; others follow it
    sequences: int = 0

    def add(self, row: dict[int, int], repeats: int, taken: np.ndarray) -> None:
        at = 0
        for length in sorted(row, reverse=True):
            self.length.append(length)
            self.first.append(int(taken[length]))
            self.each.append(row[length])
            self.sequence.append(self.sequences)
            self.offset.append(at)
            at += length * row[length]
            taken[length] += repeats * row[length]
        self.sequences += repeats


def make_plan(histogram: np.ndarray, shares: tuple[float, ...] = (1.0, 0.95, 0.85, 0.7)) -> Plan:
    """Plan for ``histogram[length]`` pieces of each length up to the capacity.

    The fitted repeats leave small remainders of many lengths; leaving a little more may pack
    better, so a few shares of them are tried and the plan of the fewest sequences is taken.
    """
    rows = patterns(histogram)
    x = fit_repeats(rows, histogram)
    return min((_planned(histogram, rows, np.floor(share * x).astype(np.int64)) for share in shares), key=lambda p: p.sequences)


def _planned(histogram: np.ndarray, rows: np.ndarray, x: np.ndarray) -> Plan:
    """The patterns' whole repeats, then the rest from the largest piece down, repeated while pieces last."""
    top = len(histogram) - 1
    left, taken, plan = histogram.astype(np.int64).copy(), np.zeros(top + 1, np.int64), Plan()
    left[0] = 0
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        kinds, each = np.unique(rows[k][rows[k] > 0], return_counts=True)
        repeats = int(min(x[k], (left[kinds] // each).min()))
        if repeats > 0:
            plan.add(dict(zip(kinds.tolist(), each.tolist())), repeats, taken)
            left[kinds] -= repeats * each
    lengths = np.flatnonzero(left).tolist()  # those still there, ascending
    while lengths:
        row: dict[int, int] = {}
        room = top
        at = len(lengths)
        while at:
            at = bisect.bisect_right(lengths, room, 0, at)
            if not at:
                break
            length = lengths[at - 1]
            many = int(min(left[length], room // length))
            row[length] = many
            room -= many * length
            at -= 1
        repeats = int(min(left[length] // each for length, each in row.items()))
        plan.add(row, repeats, taken)
        for length, each in row.items():
            left[length] -= repeats * each
            if not left[length]:
                del lengths[bisect.bisect_left(lengths, length)]
    return plan


def _cut(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = pieces_of(path, False), np.array([end_id], np.uint32)
        for batch in batches:
            rows, numbers, lengths, sums = [], [], [], []
            for at, ids, bounds in pieces.batches(batch.column(1)):
                for i in range(len(bounds) - 1):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]], end])
                    for number, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append(at + i)
                        numbers.append(number)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array([n * capacity for n in numbers], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _placed(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    order = np.lexsort([plan.first, plan.length])
    length, first, each, sequence, offset = (
        np.array(x, np.int64)[order] for x in (plan.length, plan.first, plan.each, plan.sequence, plan.offset)
    )
    key = (length << 48) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = np.searchsorted(key, (own << 48) + rank, "right") - 1
            turn, place = np.divmod(rank - first[slot], each[slot])
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[slot] + turn), pa.array(offset[slot] + place * own)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut. A null or
    empty text is the end id alone. Repeated rows and rows without doc_id are packed like any
    other. An empty table gives no pieces. Full pieces have negative sequence numbers.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = materialize(documents_only(docs, "doc_id", "text").mapInArrow(_cut(tokenizer, capacity, end_id), schema))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    full = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    part = pieces.where(F.col("length") < capacity)
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n if length < capacity else 0
    if not histogram.any():
        return full
    groups = 1 + int(histogram.sum()) // GROUP_ROWS
    dealt = part.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")
    sizes = sizes.select("length", "group", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(sizes, ["length", "group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    placed = ranked.mapInArrow(_placed(make_plan(histogram)), f"{schema}, sequence_id bigint, offset bigint")
    return placed.unionByName(full)
