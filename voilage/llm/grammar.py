"""Token ids in files, compressed by a grammar of id pairs (Re-Pair).

Each block of documents replaces its frequent neighbouring pairs by new ids, round after round,
many pairs a round. The block keeps the rules, the expanded length of every rule, and what
remains of the sequence. The expanded lengths tell where any id of the block lies, so a document
is decoded from the symbols that cover it alone.

Block format, little-endian: ``RPR1``; four unsigned 32-bit numbers (first new id, rules, symbols,
ids); rules as pairs of 32-bit ids; a 32-bit expanded length per rule; the symbols' low 16 bits;
their next 8 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voilage.llm.shared import documents_only
from voilage.llm.tokens import pieces_of
from voilage.session import scratch_path

BLOCK_IDS = 1 << 20
PAIRS_A_ROUND = 1500  # replaced at once; rounds go on until no pair is frequent
LEAST_COUNT = 6
END_ID = 2
FIRST_NEW = 1 << 16
_MAGIC = b"RPR1"
_HASH_BITS = 18


def _spots(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int32)


def _best(pairs: np.ndarray, most: int, least: int) -> tuple[np.ndarray, bool]:
    """The most frequent pairs that occur ``least`` times or more, in order, and whether these are all."""
    kept, counts = np.unique(pairs, return_counts=True)
    kept, counts = kept[counts >= least], counts[counts >= least]
    if len(kept) <= most:
        return kept, True
    return np.sort(kept[np.argsort(-counts, kind="stable")[:most]]), False


def _frequent(pairs: np.ndarray, spot: np.ndarray, most: int, least: int) -> tuple[np.ndarray, bool]:
    """The same; pairs in the less crowded places of the hash table are looked at only where the others are too few."""
    crowd = np.bincount(spot, minlength=1 << _HASH_BITS)
    floor = int(np.partition(crowd, len(crowd) - most)[len(crowd) - most])
    if floor > least:
        chosen, _ = _best(pairs[(crowd >= floor)[spot]], most, least)
        if len(chosen) == most:
            return chosen, False
    return _best(pairs[(crowd >= least)[spot]], most, least)


def compress(ids: np.ndarray, first_new: int = FIRST_NEW) -> bytes:
    """A block of the ids, which must be below ``first_new``: no pair of symbols is left LEAST_COUNT times.

    Once a round has replaced all frequent pairs, only pairs that hold one of its new symbols can be
    frequent in the next, and only these are looked at.
    """
    symbols = ids.astype(np.uint32)
    rules = [np.zeros((0, 2), np.uint32)]
    made = 0
    look: np.ndarray | None = None  # places whose pairs may be frequent; None: all
    while len(symbols) > 1:
        if look is None:
            pairs = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
            spot = _spots(pairs)
            chosen, all_told = _frequent(pairs, spot, PAIRS_A_ROUND, LEAST_COUNT)
            possible = np.zeros(1 << _HASH_BITS, bool)
            possible[_spots(chosen)] = True
            at = np.flatnonzero(possible[spot])
            pairs = pairs[at]
        else:
            at = look
            pairs = (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1]
            chosen, all_told = _best(pairs, PAIRS_A_ROUND, LEAST_COUNT)
        if not len(chosen):
            break
        where = np.minimum(np.searchsorted(chosen, pairs), len(chosen) - 1)
        hit = chosen[where] == pairs
        at, where = at[hit], where[hit]
        # of neighbouring hits every other one, from the left
        run_start = np.concatenate([[True], np.diff(at) > 1])
        turn = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        at, where = at[turn % 2 == 0], where[turn % 2 == 0]
        symbols[at] = first_new + made + where
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += len(chosen)
        look = None
        if all_told:
            now = at - np.arange(len(at))  # each replacement before took one symbol away
            look = np.unique(np.concatenate([now - 1, now]))
            look = look[(look >= 0) & (look < len(symbols) - 1)]
    table = np.concatenate(rules)
    lengths = np.ones(made, np.uint32)
    at = 0
    for part in rules:  # a rule uses ids of earlier rounds only
        old = part.astype(np.int64) - first_new
        lengths[at : at + len(part)] = np.where(old < 0, 1, lengths[np.maximum(old, 0)] if made else 1).sum(1)
        at += len(part)
    head = _MAGIC + struct.pack("<4I", first_new, made, len(symbols), len(ids))
    body = (table.astype("<u4"), lengths.astype("<u4"), (symbols & 0xFFFF).astype("<u2"), (symbols >> 16).astype(np.uint8))
    return head + b"".join(x.tobytes() for x in body)


class Block:
    """A block read back."""

    def __init__(self, body: bytes) -> None:
        if body[:4] != _MAGIC:
            raise ValueError("not a block of token ids")
        self.first_new, made, count, self.n_ids = struct.unpack_from("<4I", body, 4)
        at = 20
        self.rules = np.frombuffer(body, "<u4", 2 * made, at).reshape(made, 2)
        self.lengths = np.frombuffer(body, "<u4", made, at + 8 * made)
        low = np.frombuffer(body, "<u2", count, at + 12 * made)
        self.symbols = low.astype(np.uint32) | (np.frombuffer(body, np.uint8, count, at + 12 * made + 2 * count).astype(np.uint32) << 16)
        old = self.symbols.astype(np.int64) - self.first_new
        sizes = np.where(old < 0, 1, self.lengths[np.maximum(old, 0)] if made else 1).astype(np.int64)
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.told = self._expanded(np.arange(self.first_new, self.first_new + made, dtype=np.uint32))
        self.told_at = np.cumsum(self.lengths.astype(np.int64)) - self.lengths

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        while len(symbols) and symbols.max() >= self.first_new:
            old = symbols.astype(np.int64) - self.first_new
            is_rule = old >= 0
            place = np.cumsum(1 + is_rule) - 1 - is_rule
            out = np.empty(len(symbols) + int(is_rule.sum()), np.uint32)
            out[place[~is_rule]] = symbols[~is_rule]
            out[place[is_rule]], out[place[is_rule] + 1] = self.rules[old[is_rule], 0], self.rules[old[is_rule], 1]
            symbols = out
        return symbols

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop, from the symbols that cover them."""
        stop = self.n_ids if stop is None else stop
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        base = int(self.ends[first - 1]) if first else 0
        symbols, sizes = self.symbols[first:last], self.sizes[first:last]
        old = symbols.astype(np.int64) - self.first_new
        plain = len(self.told) + np.arange(len(symbols))
        at = np.where(old < 0, plain, self.told_at[np.maximum(old, 0)]) if len(self.told) else plain
        ends = np.cumsum(sizes)
        places = np.repeat(at - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        return np.concatenate([self.told, symbols])[places][start - base : stop - base]


def _blocks(path: str, end_id: int, block_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        pieces, end = pieces_of(path, True), np.array([end_id], np.uint32)
        docs, lengths, held, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            body = compress(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([body], pa.binary()),
                ],
                names=["part", "block", "n_ids", "docs", "lengths", "body"],
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, ids, bounds in pieces.batches(batch.column(1)):
                for i in range(len(bounds) - 1):
                    docs.append(keys[at + i])
                    lengths.append(int(bounds[i + 1] - bounds[i]) + 1)
                    held += [ids[bounds[i] : bounds[i + 1]], end]
                    size += lengths[-1]
                    if size >= block_ids:
                        yield block()
                        number += 1
                        docs, lengths, held, size = [], [], [], 0
        if docs:
            yield block()

    return run


BLOCK_SCHEMA = "part int, block bigint, n_ids bigint, docs array<bigint>, lengths array<bigint>, body binary"


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write its blocks below ``path``, in ascending doc_id order.

    A null or empty text is the end id alone. Rows without doc_id come first; rows with the same
    doc_id stand side by side. An empty table writes a table without blocks. A block holds
    ``block_ids`` ids and up to one document more.
    """
    texts = documents_only(docs, "doc_id", "text")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_blocks(tokenizer, end_id, block_ids), BLOCK_SCHEMA).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bounds = np.cumsum([0, *row["lengths"]])
            ids = Block(row["body"]).ids().astype("<u4")
            n = len(row["docs"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["block"]] * n, pa.int64()),
                    pa.array(row["docs"], pa.int64()),
                    pa.array(bounds[:-1]),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64()),
                ],
                names=["part", "block", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_ids(blocks: DataFrame) -> DataFrame:
    """One row per document of written blocks: doc_id, start, n_tokens, ids_crc32, all from the files."""
    told = blocks.select("part", "block", "docs", "lengths", "body").mapInArrow(
        _read, "part int, block bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part, so as many as tasks wrote blocks
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.select("part", "block", inner.alias("inner")).join(parts, "part")
    starts = starts.select("part", "block", (F.col("base") + F.col("inner")).alias("first"))
    return told.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write_ids(docs, tokenizer, path)
    return read_ids(spark.read.schema(BLOCK_SCHEMA).parquet(path))
