"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives Viterbi.

The automaton reads a text once. At each character its output links name every piece that ends
there, longest first, and each relaxes the best score at that place. A character that is no piece
costs more than any piece and becomes its UTF-8 bytes. Of equal scores the longer last piece wins.

No piece holds the space mark behind another character (this is checked), so no piece crosses the
start of a run of blanks, and the best path of a text is that of its parts cut there. Parts met
before are looked up.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voilage.llm import words as W
from voilage.llm.shared import documents_only
from voilage.llm.tokens import CACHE, Pieces

SPACE = "▁"
UNKNOWN_COST = 10.0  # below the lowest score of a piece
_LITERAL = "\ud800"  # stands for a space mark that is in the text itself; no text holds it


class PieceModel(Pieces):
    """Pieces and scores of a model file; encodes by best total score and decodes exactly."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.blank_ends, self.cache = True, cache
        self.scores, self.widths, self.machine = {}, {}, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.byte_ids, self.single, text_of = [0] * 256, set(), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                text_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text_of.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} crosses the start of a run of blanks")
                self.machine.add_word(piece, i)
                self.scores[i], self.widths[i] = model.get_score(i), len(piece)
                if len(piece) == 1:
                    self.single.add(piece)
                text_of.append(piece.replace(SPACE, " ").encode())
        self.machine.make_automaton()
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_COST
        sizes = np.array([len(t) for t in text_of], np.int64)
        self.text_at, self.text_size = np.cumsum(sizes) - sizes, sizes
        self.text = np.frombuffer(b"".join(text_of), np.uint8)
        self._forget()

    def best(self, part: str) -> list[int]:
        """Ids of the best path over a part, whose blanks are space marks."""
        n = len(part)
        score, last = [0.0] + [-np.inf] * n, [-1] * (n + 1)
        filled, single, unknown, scores, widths = 0, self.single, self.unknown, self.scores, self.widths
        for end, piece in self.machine.iter(part):
            end += 1
            while filled < end:
                filled += 1
                if part[filled - 1] not in single:
                    score[filled] = score[filled - 1] + unknown
            reached = score[end - widths[piece]] + scores[piece]
            if reached > score[end]:
                score[end], last[end] = reached, piece
        ids, at = [], n
        while at:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= widths[piece]
            else:
                at -= 1
                char = SPACE if part[at] == _LITERAL else part[at]
                ids += [self.byte_ids[b] for b in reversed(char.encode())]
        ids.reverse()
        return ids

    def _many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.best(p.decode().replace(SPACE, _LITERAL).replace(" ", SPACE)) for p in pieces]
        sizes = np.array([len(f) for f in found], np.int64)
        pool = np.array([i for f in found for i in f], np.uint32)
        return pool, np.cumsum(sizes) - sizes, sizes

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts: a run of blanks and what follows it. ``data`` has the dummy blank before each text."""
        found = W.split(data, offsets, W.outside(b" "), places=True)
        counts, ends = np.diff(found.bounds), found.ends
        before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        full = np.flatnonzero(counts)
        before[found.bounds[full]] = offsets[full]
        mark = np.uint64(0x8CB92BA72F3D8DD7)
        keys = W.mix(found.hashes + (found.starts - before + 1).astype(np.uint64) * mark)
        last = np.where(counts > 0, ends[np.maximum(found.bounds[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
        tails = np.flatnonzero(offsets[1:] > last)
        where = found.bounds[tails + 1]
        keys = np.insert(keys, where, W.mix((offsets[tails + 1] - last[tails]).astype(np.uint64) * mark))
        before, ends = np.insert(before, where, last[tails]), np.insert(ends, where, offsets[tails + 1])
        extra = np.zeros(len(counts) + 1, np.int64)
        extra[tails + 1] = 1
        return keys, before, ends, found.bounds + np.cumsum(extra)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text whose ids these are, as UTF-8."""
        sizes = self.text_size[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.text_at[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.text[places].tobytes()[1:]  # without the dummy blank

    def batches(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data, offsets = W.buffer_of(column)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        wide = np.zeros(len(offsets), np.int64)
        wide[filled + 1] = 1
        data = np.insert(data, offsets[filled], 0x20)
        prefixed = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets + np.cumsum(wide)).astype(np.int64)), pa.py_buffer(data)]
        )
        yield from super().batches(prefixed)


@functools.lru_cache(maxsize=1)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


def encode_and_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, same: ids of each text and what they decode to.

    A null or empty text has no ids and decodes to the empty text. ``same`` tells whether the
    decoded text is the text, byte for byte. Every row is encoded by itself: rows without doc_id are
    like any other, repeated rows have equal results, texts of any length are taken whole. Columns
    besides doc_id and text are not looked at; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in W.slices(batches):
            data, offsets = W.buffer_of(batch.column(1))
            counts, sums, shas, same = [], [], [], []
            for at, ids, bounds in model.batches(batch.column(1)):
                for i in range(len(bounds) - 1):
                    own = ids[bounds[i] : bounds[i + 1]]
                    text = model.decode(own)
                    counts.append(len(own))
                    sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                    shas.append(hashlib.sha256(text).hexdigest())
                    same.append(text == data[offsets[at + i] : offsets[at + i + 1]].tobytes())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(shas, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same"])

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, same boolean"
    return documents_only(docs, "doc_id", "text").mapInArrow(run, schema)


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in W.slices(batches):
            for at, ids, bounds in model.batches(batch.column(1)):
                rows = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bounds) - 1), rows], names=["doc_id", "ids"])

    return documents_only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
