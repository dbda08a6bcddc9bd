"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes (a blank and the text), A byte-level, B by SentencePiece. Every
token points to the token reaching farthest right among those it overlaps, which is the other side's
token over its last byte. Doubling the successors until nothing changes leads every token to the
last token of its component: the one that ends where both sides end. Tokens with the same last token
are a group; the tokens that end there together are linked.

How often a pair of ids is linked in the whole corpus is counted from blocks: a Python worker folds
the links of some megabytes of text before anything is shuffled, and gets back the counts of its own
pairs only. So what travels is the distinct pairs of each block, not links, and no task holds the
whole table of pairs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voilage.llm import words as W
from voilage.llm.sentencepieces import PieceModel
from voilage.llm.shared import documents_only, materialize
from voilage.llm.tokens import Pieces, pieces_of

BLOCK = 16 << 20  # bytes of text whose links are folded together
PART = 1 << 20  # bytes of text aligned at once
_PAIR_BITS = 24  # of B's id in a pair
_PAIR_MASK = (1 << _PAIR_BITS) - 1


# --- both tokenizers -----------------------------------------------------------------


class ModelPieces(PieceModel):
    """The model's own encoder. Parts cut before runs of blanks are encoded once each: no piece crosses such a start."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        super().__init__(path)
        self.model = SentencePieceProcessor(model_file=path)
        self.blank = self.model.piece_to_id("▁")

    def _many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # the encoder adds the blank that every part starts with; alone it would give nothing
        told = self.model.encode([p[1:].decode() for p in pieces], num_threads=1)
        told = [ids or [self.blank] for ids in told]
        sizes = np.array([len(ids) for ids in told], np.int64)
        return np.array([i for ids in told for i in ids], np.uint32), np.cumsum(sizes) - sizes, sizes


@functools.lru_cache(maxsize=1)
def model_pieces(path: str) -> ModelPieces:
    return ModelPieces(path)


def _byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


@dataclass(frozen=True)
class Spelling:
    """The bytes of every id of a vocabulary, one after the other."""

    body: np.ndarray
    at: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, spelled: list[bytes]) -> Spelling:
        size = np.array([len(s) for s in spelled], np.int64)
        return cls(np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.body[np.repeat(self.at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


@functools.lru_cache(maxsize=2)
def byte_spelling(path: str) -> Spelling:
    tokenizer, alphabet = pieces_of(path, True).tokenizer, _byte_alphabet()
    spelled = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        # a special token never comes out of plain text; its own string may stand for it
        spelled.append(bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode())
    return Spelling.of(spelled)


@functools.lru_cache(maxsize=2)
def decimals(n: int) -> Spelling:
    """The ids below n as decimal digits, each with room for a separator before it."""
    return Spelling.of([b" %d" % i for i in range(n)])


def spaced(column: pa.Array) -> pa.Array:
    """The column's texts with a blank before each that is not empty; null is empty."""
    data, offsets = W.buffer_of(column)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    wide = np.zeros(len(offsets), np.int64)
    wide[filled + 1] = 1
    data = np.insert(data, offsets[filled], 0x20)
    places = (offsets + np.cumsum(wide)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])


# --- alignment -----------------------------------------------------------------------


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each A and each B token, for two cuts of the same bytes.

    ``a_ends`` and ``b_ends`` ascend and have the same last value. Groups are numbered from 0.
    """
    n, m = len(a_ends), len(b_ends)
    # nodes 0..n-1 are A's tokens, n..n+m-1 are B's; at a common end A's token is the last one
    over_a = np.searchsorted(b_ends, a_ends)  # B's token over the last byte of each A token
    over_b = np.searchsorted(a_ends, b_ends)
    ahead_a = b_ends[over_a] > a_ends
    step = np.concatenate([np.where(ahead_a, over_a + n, np.arange(n)), over_b])
    while True:
        further = step[step]
        if np.array_equal(further, step):
            break
        step = further
    last = np.flatnonzero(step[:n] == np.arange(n))
    number = np.searchsorted(last, step)
    return number[:n], number[n:]


@dataclass
class Aligned:
    """Alignment of the texts of a slice; tokens of texts that do not come back from either side are left out."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_bounds: np.ndarray  # text i has the A tokens a_bounds[i]:a_bounds[i + 1]
    b_bounds: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int

    @functools.cached_property
    def group_bounds(self) -> np.ndarray:
        """Text i has the groups group_bounds[i]:group_bounds[i + 1]."""
        return np.concatenate([self.a_group, [self.n_groups]])[self.a_bounds] if len(self.a_bounds) else self.a_bounds

    def links(self) -> np.ndarray:
        """The pair (A id, B id) that ends each group, as one number."""
        last_a = np.searchsorted(self.a_group, np.arange(self.n_groups), "right") - 1
        last_b = np.searchsorted(self.b_group, np.arange(self.n_groups), "right") - 1
        return (self.a_ids[last_a].astype(np.int64) << _PAIR_BITS) | self.b_ids[last_b]

    def written(self, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2`` of all texts as bytes, and the bounds of each text's part, its first separator left out."""
        n, m = len(self.a_ids), len(self.b_ids)
        width = max(sizes)
        spelled = decimals(width)
        # place of each token among all: A's of a group, then B's
        groups = np.arange(self.n_groups)
        a_place = np.arange(n) + np.searchsorted(self.b_group, groups)[self.a_group]
        b_place = np.arange(m) + np.searchsorted(self.a_group, groups, "right")[self.b_group]
        ids, marks = np.zeros(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a_ids, self.b_ids
        marks[a_place[np.searchsorted(self.a_group, groups)]] = ord(";")
        marks[b_place[np.searchsorted(self.b_group, groups)]] = ord("|")
        size = spelled.size[ids]
        starts = np.concatenate([[0], np.cumsum(size)])
        body = spelled.joined(ids)
        body[starts[:-1]] = marks
        return body, starts[self.a_bounds + self.b_bounds]


class Aligner:
    def __init__(self, a_file: str, b_file: str) -> None:
        self.a, self.b = pieces_of(a_file, True), model_pieces(b_file)
        self.a_spelling = byte_spelling(a_file)
        self.b_spelling = Spelling(self.b.text, self.b.text_at, self.b.text_size)
        self.sizes = len(self.a_spelling.size), len(self.b_spelling.size)
        if self.sizes[1] > _PAIR_MASK:
            raise ValueError("the second vocabulary has too many ids")

    def slices(self, column: pa.Array) -> Iterator[tuple[int, Aligned]]:
        """(first row, alignment) of slices of a text column."""
        texts = spaced(column)
        data, offsets = W.buffer_of(texts)
        for (at, a_ids, a_bounds), (_, b_ids, b_bounds) in zip(self.a.batches(texts), Pieces.batches(self.b, texts)):
            rows = slice(at, at + len(a_bounds))
            want, places = data[offsets[at] : offsets[at + len(a_bounds) - 1]], offsets[rows] - offsets[at]
            good = self._same(self.a_spelling, a_ids, a_bounds, want, places) & self._same(self.b_spelling, b_ids, b_bounds, want, places)
            if not good.all():
                a_ids, a_bounds = _only(a_ids, a_bounds, good)
                b_ids, b_bounds = _only(b_ids, b_bounds, good)
            a_group, b_group = groups_of(np.cumsum(self.a_spelling.size[a_ids]), np.cumsum(self.b_spelling.size[b_ids]))
            yield at, Aligned(a_ids, b_ids, a_bounds, b_bounds, a_group, b_group, int(a_group[-1]) + 1 if len(a_group) else 0)

    @staticmethod
    def _same(spelling: Spelling, ids: np.ndarray, bounds: np.ndarray, want: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each text's tokens, joined, are its bytes."""
        ends = np.concatenate([[0], np.cumsum(spelling.size[ids])])[bounds]
        sizes = np.diff(places)
        good = np.diff(ends) == sizes
        body = spelling.joined(ids)
        if good.all():
            wrong = np.flatnonzero(body != want)
            good[np.searchsorted(places, wrong, "right") - 1] = False
            return good
        for i in np.flatnonzero(good).tolist():
            good[i] = np.array_equal(body[ends[i] : ends[i + 1]], want[places[i] : places[i + 1]])
        return good


def _only(ids: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the good texts; the others have none."""
    sizes = np.diff(bounds)
    return ids[np.repeat(good, sizes)], np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])


@functools.lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values).cast(kind))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, a_ids, b_ids, a_group, b_group (arrays of int): both token lists and the group of each token.

    A null or empty text, or one that either side's tokens do not spell byte for byte (with its
    blank before it), has empty lists. Groups are numbered from 0 in each text. Every row is aligned
    by itself, so repeated rows and rows without doc_id are like any other, and texts of any length
    are taken whole; columns besides doc_id and text are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_file, b_file)
        for part in W.slices(batches, size=PART):
            for at, found in both.slices(part.column(1)):
                first = found.group_bounds[:-1]
                a_own = found.a_group - np.repeat(first, np.diff(found.a_bounds))
                b_own = found.b_group - np.repeat(first, np.diff(found.b_bounds))
                columns = [
                    part.column(0).slice(at, len(first)),
                    _lists(found.a_ids, found.a_bounds, pa.int32()),
                    _lists(found.b_ids, found.b_bounds, pa.int32()),
                    _lists(a_own, found.a_bounds, pa.int32()),
                    _lists(b_own, found.b_bounds, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "a_group", "b_group"])

    schema = "doc_id bigint, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>"
    return documents_only(docs, "doc_id", "text").mapInArrow(run, schema)


# --- links of the whole corpus ----------------------------------------------------------

_FOUND = (
    "block bigint, whole boolean, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, n array<int>"
)
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _digests(found: Aligned, sizes: tuple[int, int]) -> list[str]:
    body, bounds = found.written(sizes)
    raw = memoryview(body)
    return [hashlib.sha256(raw[a + 1 : b]).hexdigest() if b > a else "" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _folded(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each text in order, how often each is linked there, and the bounds of each text."""
    links, bounds = found.links(), found.group_bounds
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort([links, text])
    links, text = links[order], text[order]
    new = np.ones(len(links), bool)
    new[1:] = (links[1:] != links[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return links[at], np.diff(np.concatenate([at, [len(links)]])), np.searchsorted(text[at], np.arange(len(bounds)))


def _blocks(a_file: str, b_file: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task = aligner(a_file, b_file), TaskContext.get().partitionId() << 32
        block, held, pairs, counts = 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def totals() -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            bounds = np.array([0, len(pairs)])
            lists = [_lists(pairs, bounds, pa.int64()), _lists(counts, bounds, pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([task + block]), pa.array([True]), *none, *lists], names=_NAMES)

        for part in W.slices(batches, size=PART):
            for at, found in both.slices(part.column(1)):
                own, n, bounds = _folded(found)
                pairs, where = np.unique(np.concatenate([pairs, own]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
                rows = len(bounds) - 1
                columns = [
                    pa.array(np.full(rows, task + block)),
                    pa.array(np.zeros(rows, bool)),
                    part.column(0).slice(at, rows),
                    pa.array(np.diff(found.a_bounds)),
                    pa.array(np.diff(found.b_bounds)),
                    pa.array(np.diff(found.group_bounds)),
                    pa.array(_digests(found, both.sizes), pa.string()),
                    _lists(own, bounds, pa.int64()),
                    _lists(n, bounds, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
            held += part.column(1).nbytes
            if held >= size:
                yield totals()
                block, held, pairs, counts = block + 1, 0, pairs[:0], counts[:0]
        if held:
            yield totals()

    return run


def _answered(texts: pa.Table, told: pa.Table) -> pa.Table:
    """The texts of one block with the corpus-wide counts of their links."""
    told = told.sort_by("pair")
    pair, count, best = (told.column(c).to_numpy() for c in ("pair", "count", "best"))
    own = texts.column("pairs").combine_chunks()
    sizes = np.diff(own.offsets.to_numpy())
    n = texts.column("n").combine_chunks().flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    spot = np.searchsorted(pair, own.flatten().to_numpy())
    sums = np.zeros(len(sizes), np.int64)
    np.add.at(sums, row, n * count[spot] if len(spot) else n)
    bests = np.bincount(row[best[spot]], n[best[spot]], len(sizes)) if len(spot) else np.zeros(len(sizes))
    out = texts.select(["doc_id", "n_a", "n_b", "n_groups"])
    out = out.append_column("n_links", texts.column("n_groups")).append_column("n_best", pa.array(bests.astype(np.int64)))
    return out.append_column("count_sum", pa.array(sums)).append_column("groups_sha256", texts.column("groups_sha256"))


def link_counts(docs: DataFrame, a_file: str, b_file: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    A link is an A and a B token that end together. ``n_best`` counts the links whose pair of ids is
    linked as often, in all of ``docs``, as the most frequent pair of that B id; ``count_sum`` adds up
    how often the pairs of all links are linked. Texts without tokens (see ``align``) have zeros and
    an empty digest. Repeated rows count each, as do rows without doc_id; an empty table gives none.
    """
    texts = documents_only(docs, "doc_id", "text")
    found = materialize(texts.mapInArrow(_blocks(a_file, b_file, block), _FOUND))
    asked = found.where("whole").select("block", F.explode(F.arrays_zip("pairs", "n")).alias("x")).select("block", "x.pairs", "x.n")
    asked = asked.withColumnRenamed("pairs", "pair")
    counts = materialize(asked.groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit(_PAIR_MASK))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    judged = counts.join(highest, b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = asked.select("block", "pair").join(judged, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    linked = found.where(~F.col("whole")).select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "n")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return linked.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_answered, schema)
