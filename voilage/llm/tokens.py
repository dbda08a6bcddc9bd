"""Token ids of whole texts by a tokenizers file, each distinct piece encoded once.

A text is cut only where its tokenizer is sure to cut it, so the ids of the pieces, joined, are
the ids of the text:

* ``blank_ends=False`` (the tokenizer drops white space): pieces are the runs between ASCII white space.
* ``blank_ends=True`` (byte-level: white space belongs to tokens): a piece is a run with the white
  space before it. There is no cut behind other white space of Unicode, since the tokenizer looks
  at white space as a whole.

Pieces are told apart by 64-bit hashes. Ids of pieces met before lie in a sorted table of bounded
size in each Python worker; new ones are encoded many to a call, with a separator whose id parts
the result.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from voilage.llm import words as W

CACHE = 2_000_000  # pieces remembered per worker, about 25 bytes each
SLICE = 8 << 20  # bytes of text cut and looked up at once
_GAP = np.uint64(0x8CB92BA72F3D8DD7)
_WHITE = np.zeros(256, bool)
_WHITE[list(W.WHITE)] = True
#: last bytes of white space outside ASCII, as UTF-8
_WIDE_SPACES = tuple(c.encode() for c in "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


class Pieces:
    def __init__(self, path: str, blank_ends: bool, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.blank_ends, self.cache = blank_ends, cache
        self.separator = "\n" if blank_ends else "~"
        (self.mark,) = self._plain([self.separator])[0]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [told.ids for told in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in any order, and where each piece's ids start and how many they are."""
        mark, blank, white = self.separator.encode(), 0x20, frozenset(W.WHITE)
        if self.blank_ends:  # white space at either end, but for one blank, would merge with the separator
            easy = [
                i
                for i, p in enumerate(pieces)
                if mark not in p and p[-1] not in white and p[p[0] == blank] not in white
                and (p.isascii() or not (p[p[0] == blank :].startswith(_WIDE_SPACES) or p.endswith(_WIDE_SPACES)))
            ]
        else:
            easy = [i for i, p in enumerate(pieces) if mark not in p]
        hard = sorted(set(range(len(pieces))).difference(easy)) if len(easy) < len(pieces) else []
        glue = mark if self.blank_ends else b" " + mark + b" "
        at, size, pool, filled = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        for start in range(0, len(easy), 50_000):
            runs = [easy[i : i + 500] for i in range(start, min(start + 50_000, len(easy)), 500)]
            for run, ids in zip(runs, self._plain([glue.join([pieces[i] for i in run]).decode() for run in runs])):
                ids = np.array(ids, np.uint32)
                marks = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
                at[run], size[run] = marks[:-1] + 1 + filled, np.diff(marks) - 1
                pool.append(ids)
                filled += len(ids)
        for i, ids in zip(hard, self._plain([pieces[i].decode() for i in hard])):
            at[i], size[i] = filled, len(ids)
            pool.append(np.array(ids, np.uint32))
            filled += len(ids)
        return (np.concatenate(pool) if pool else np.zeros(0, np.uint32)), at, size

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, start, end of each piece, and the first piece of each text."""
        found = W.split(data, offsets, W.outside(W.WHITE), places=True)
        if not self.blank_ends:
            return found.hashes, found.starts, found.ends, found.bounds
        starts, ends, counts = found.starts, found.ends, np.diff(found.bounds)
        before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        full = np.flatnonzero(counts)
        before[found.bounds[full]] = offsets[full]
        gap = starts - before
        code = np.where(gap == 0, 256, data[np.minimum(before, len(data) - 1)] if len(data) else 0).astype(np.uint64)
        keys = W.mix(found.hashes + (code + np.uint64(1)) * _GAP)
        for i in np.flatnonzero(gap > 1).tolist():
            keys[i] = self._key(data[before[i] : ends[i]])
        # white space at the end of a text, or a text of nothing else
        last = np.where(counts > 0, ends[np.maximum(found.bounds[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
        tails = np.flatnonzero(offsets[1:] > last)
        where = found.bounds[tails + 1]
        keys = np.insert(keys, where, [self._key(data[last[i] : offsets[i + 1]]) for i in tails.tolist()] if len(tails) else keys[:0])
        before, ends = np.insert(before, where, last[tails]), np.insert(ends, where, offsets[tails + 1])
        extra = np.zeros(len(counts) + 1, np.int64)
        extra[tails + 1] = 1
        bounds = found.bounds + np.cumsum(extra)
        return self._rejoined(data, keys, before, ends, bounds)

    @staticmethod
    def _key(piece: np.ndarray) -> np.uint64:
        whole = W.split(piece, np.array([0, len(piece)]), np.ones(256, bool))
        return W.mix(whole.hashes + (_GAP ^ np.uint64(259)))[0]

    def _rejoined(self, data, keys, starts, ends, bounds):
        """Undo the cuts behind wide white space."""
        if len(ends) == 0:
            return keys, starts, ends, bounds
        suspect = np.flatnonzero((data[ends - 1] >= 0x80) & (data[ends - 1] <= 0xAF))
        first = np.zeros(len(ends) + 1, bool)
        first[bounds] = True
        wide = [i for i in suspect.tolist() if not first[i + 1] and data[max(starts[i], ends[i] - 3) : ends[i]].tobytes().endswith(_WIDE_SPACES)]
        if not wide:
            return keys, starts, ends, bounds
        keep = np.ones(len(ends), bool)
        keep[wide] = False
        for i in wide:
            starts[i + 1] = starts[i]
            keys[i + 1] = self._key(data[starts[i + 1] : ends[i + 1]])
        kept = np.concatenate([[0], np.cumsum(keep)])
        return keys[keep], starts[keep], ends[keep], kept[bounds]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts in a row, and the bounds of each text's ids."""
        keys, starts, ends, bounds = self._cut(data, offsets)
        distinct, sample, piece = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.cache:
            self._forget()
        spot = np.searchsorted(self.keys, distinct)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            body = data.tobytes()
            ids, at, sizes = self._many([body[a:b] for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())])
            at += len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
            where = spot[new]
            self.keys = np.insert(self.keys, where, distinct[new])
            self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, sizes)
            spot = np.searchsorted(self.keys, distinct)
        sizes = self.size[spot][piece]
        ends_at = np.cumsum(sizes)
        total = int(ends_at[-1]) if len(ends_at) else 0
        places = np.repeat(self.at[spot][piece] - (ends_at - sizes), sizes) + np.arange(total)
        return self.pool[places], np.concatenate([[0], ends_at])[bounds]

    def batches(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) for slices of a text column; null texts are empty."""
        data, offsets = W.buffer_of(column)
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield (at, *self.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            at = to


@functools.lru_cache(maxsize=2)
def pieces_of(path: str, blank_ends: bool) -> Pieces:
    """One for each file in each Python worker."""
    return Pieces(path, blank_ends)
