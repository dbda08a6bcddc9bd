"""Passages that repeat across documents, word for word.

1. Propose. Every run of WINDOW words holds a run of half as many words that is chosen by content
   alone (winnowing), so equal windows hold equal chosen runs. Documents that share a chosen run
   with another one are candidates; of these, every window around a shared run is counted by its
   smallest doc_id. What is not proposed cannot repeat.
2. Confirm and compile. The passages that a smaller doc_id holds first are sent to the shards of
   the documents that repeat them. Each shard compiles the half-window blocks of its passages into
   an Aho-Corasick automaton over word numbers.
3. Stream. The shard's documents run through the automaton. Each block found is extended to both
   sides word by word, so hashes only propose and never decide; matches of WINDOW words or more
   cover what is to be removed.

Texts equal to one of a smaller doc_id repeat as a whole and need no window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage.llm import words as W
from voilage.llm.shared import documents_only, materialize, moved

WINDOW = 50
SHARD_BYTES = 1 << 19
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _chosen(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the half-window runs, and for each window the place of its chosen run."""
    half = window // 2
    runs = W.rolling(hashes, half)
    return runs, W.sliding_min(runs, window - half + 1)


def _split(column: pa.Array) -> tuple[np.ndarray, W.Words]:
    data, offsets = W.buffer_of(column)
    return data, W.split(data, offsets, W.outside(W.WHITE), places=True)


def _sketches(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, digest, number of words, chosen runs and the digest of all words, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, 2):
            data, found = _split(batch.column(2))
            chosen, plain, bounds = [np.zeros(0, np.uint64)], [], [0]
            for a, b in zip(found.bounds[:-1], found.bounds[1:]):
                runs, places = _chosen(found.hashes[a:b], window)
                chosen.append(np.unique(runs[places]))
                bounds.append(bounds[-1] + len(chosen[-1]))
                plain.append(_sha(_WORD.findall(data[found.starts[a] : found.ends[b - 1]].tobytes()) if b > a else []))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(found.bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(chosen).view(np.int64))),
                    pa.array(plain, pa.string()),
                ],
                names=["doc_id", "digest", "n_words", "runs", "sha"],
            )

    return run


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _passages(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole texts (seg -1), and the stretches of each whose windows hold a shared run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, 2, 2 << 20):
            data, found = _split(part.column(2))
            shared, ends = part.column(3).flatten().to_numpy().view(np.uint64), part.column(3).value_lengths().to_numpy()
            ends = np.cumsum(ends)
            row, seg, text, windows = [], [], [], []
            for i in range(len(part)):
                a, b = found.bounds[i], found.bounds[i + 1]
                row.append(i)
                seg.append(-1)
                text.append(data[found.starts[a] : found.ends[b - 1]].tobytes() if b > a else b"")
                windows.append(np.zeros(0, np.int64))
                runs, places = _chosen(found.hashes[a:b], window)
                hit = np.isin(runs[places], shared[ends[i - 1] if i else 0 : ends[i]])
                hashes = W.rolling(found.hashes[a:b], window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                for first, last in edges.reshape(-1, 2):
                    row.append(i)
                    seg.append(int(first))
                    text.append(data[found.starts[a + first] : found.ends[a + last + window - 2]].tobytes())
                    windows.append(hashes[first:last].view(np.int64))
            bounds = np.cumsum([0, *map(len, windows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)),
                    part.column(1).take(pa.array(row)),
                    pa.array(seg, pa.int32()),
                    pa.array(text, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(windows))),
                ],
                names=["doc_id", "digest", "seg", "text", "windows"],
            )

    return run


class Automaton:
    """Half-window blocks of passages, over word numbers that are exact within one shard.

    Every window of a passage holds one of its blocks whole. So the automaton tells which windows of
    a document may stand in a passage; these are looked up among the passages' windows by hash, and
    compared word by word with one that has the hash. The work grows with the document and its
    windows, however often words repeat in it.
    """

    def __init__(self, passages: list[tuple[int, bytes]], window: int) -> None:
        self.window, self.half = window, window // 2
        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        told, hashes, starts, owners, filled = [], [], [], [], 0
        for owner, text in passages:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in _WORD.findall(text)]
            for at in range(0, len(words) - self.half + 1, self.half):
                self.machine.add_word(tuple(words[at : at + self.half]), 1)
            told.append(np.array(words, np.int64))
            hashes.append(self._hashed(told[-1]))
            starts.append(filled + np.arange(len(hashes[-1])))
            owners.append(np.full(len(hashes[-1]), owner, np.int64))
            filled += len(words)
        self.empty = not len(self.machine)
        if self.empty:
            return
        self.machine.make_automaton()
        self.words = np.concatenate(told)
        hashes, starts, owners = (np.concatenate(x) for x in (hashes, starts, owners))
        order = np.lexsort([owners, hashes])  # the smallest owner of a hash first
        self.hashes, self.starts, self.owners = hashes[order], starts[order], owners[order]

    def _hashed(self, words: np.ndarray) -> np.ndarray:
        return W.rolling(W.mix(words.astype(np.uint64)), self.window)

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray:
        """Which words stand in a window that a passage of a smaller doc_id holds too."""
        n, window = len(words), self.window
        out = np.zeros(n, bool)
        if self.empty or n < window:
            return out
        ids = [self.numbers.get(w, 0) for w in words]
        ends = np.array([end for end, _ in self.machine.iter(tuple(ids))], np.int64)
        if not len(ends):
            return out
        ids = np.array(ids, np.int64)
        edge = np.zeros(n + 1, np.int64)  # windows that hold a block that was met
        np.add.at(edge, np.maximum(ends - window + 1, 0), 1)
        np.add.at(edge, ends - self.half + 2, -1)
        spots = np.flatnonzero(np.cumsum(edge)[: n - window + 1] > 0)
        wanted = self._hashed(ids)[spots]
        first = np.searchsorted(self.hashes, wanted)
        met = first < len(self.hashes)
        met[met] = self.hashes[first[met]] == wanted[met]
        spots, first = spots[met], first[met]
        edge = np.zeros(n + 1, np.int64)
        for at in range(0, len(spots), 4096):
            s, f = spots[at : at + 4096], first[at : at + 4096]
            held = self.owners[f] < doc_id
            same = (ids[s[:, None] + np.arange(window)] == self.words[self.starts[f][:, None] + np.arange(window)]).all(1)
            for i in np.flatnonzero(~same).tolist():  # another window with this hash came first
                held[i] = self._stands(doc_id, ids[s[i] : s[i] + window], f[i])
            edge[s[held]] += 1
            edge[s[held] + window] -= 1
        return np.cumsum(edge)[:n] > 0

    def _stands(self, doc_id: int, words: np.ndarray, first: int) -> bool:
        at = first
        while at < len(self.hashes) and self.hashes[at] == self.hashes[first]:
            if self.owners[at] < doc_id and np.array_equal(self.words[self.starts[at] : self.starts[at] + self.window], words):
                return True
            at += 1
        return False


def _located(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        machine = Automaton(list(zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist())), window)
        ids, digests, counts, gone, left = [], [], [], [], []
        for doc_id, key, text in zip(docs.column("doc_id").to_pylist(), docs.column("digest").to_pylist(), docs.column("text").to_pylist()):
            words = _WORD.findall(text)
            out = machine.covered(doc_id, words)
            if out.any():
                ids.append(doc_id)
                digests.append(key)
                counts.append(len(words))
                gone.append(int(out.sum()))
                left.append(b" ".join([w for w, o in zip(words, out.tolist()) if not o]).decode())
        return pa.table(
            [
                pa.array(ids, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(counts, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(left, pa.string()),
            ],
            names=["doc_id", "digest", "n_words", "n_removed", "kept_text"],
        )

    return run


def _changes(texts: DataFrame, sketches: DataFrame, window: int) -> DataFrame:
    """doc_id, digest, n_removed, kept_text of the documents that lose words."""
    long = sketches.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = materialize(long.groupBy("digest").agg(F.min("doc_id").alias("first")))
    copies = (
        long.select("doc_id", "digest", "n_words")
        .join(firsts, "digest")
        .where("doc_id > first")
        .select("doc_id", "digest", F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text"))
        .distinct()
    )
    reps = long.join(firsts.select("digest", F.col("first").alias("doc_id")), ["doc_id", "digest"], "left_semi")
    runs = reps.select(F.explode("runs").alias("run"), "doc_id", "digest")
    shared = runs.groupBy("run").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    near = (
        runs.join(shared.select(moved(F.col("run")).alias("key")), moved(F.col("run")) == F.col("key"), "left_semi")
        .groupBy("doc_id", "digest")
        .agg(F.collect_set("run").alias("shared"))
    )
    candidates = materialize(
        texts.join(near, ["doc_id", "digest"])
        .select("doc_id", "digest", "text", "shared")
        .mapInArrow(_passages(window), "doc_id bigint, digest binary, seg int, text binary, windows array<bigint>")
    )
    each = candidates.where("seg >= 0").select(F.explode("windows").alias("w"), "doc_id", "seg")
    held = each.groupBy("w").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi"), F.min_by("seg", "doc_id").alias("owner_seg")
    )
    held = held.where("owner < hi").select(moved(F.col("w")).alias("key"), "owner", "owner_seg")
    total = candidates.where("seg < 0").agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + total // SHARD_BYTES
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    asked = (
        each.join(held, moved(F.col("w")) == F.col("key"))
        .where("owner < doc_id")
        .select("owner", "owner_seg", shard)
        .distinct()
    )
    passages = candidates.where("seg >= 0").select(F.col("doc_id").alias("o"), F.col("seg").alias("s"), F.col("text").alias("passage"))
    sent = asked.join(passages, (F.col("owner") == F.col("o")) & (F.col("owner_seg") == F.col("s"))).select("shard", "owner", "passage")
    streamed = candidates.where("seg < 0").select(shard, "doc_id", "digest", "text")
    found = (
        streamed.groupBy("shard")
        .cogroup(sent.groupBy("shard"))
        .applyInArrow(_located(window), "doc_id bigint, digest binary, n_words bigint, n_removed bigint, kept_text string")
    )
    kept = found.groupBy("doc_id", "digest").agg(F.max("n_removed").alias("n_removed"), F.first("kept_text").alias("kept_text"))
    return copies.unionByName(kept)


def _judged(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """One sketch per row, and the changes to the rows that lose words."""
    texts = documents_only(docs, "doc_id", "text").withColumn("digest", digest(F.col("text")))
    sketches = materialize(
        texts.select("doc_id", "digest", "text").mapInArrow(
            _sketches(window), "doc_id bigint, digest binary, n_words bigint, runs array<bigint>, sha string"
        )
    )
    return sketches, materialize(_changes(texts, sketches, window))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words taken out of text, and n_chars, if there, counted anew.

    Judges like ``removed_repeats``. Texts that lose nothing stay as they are, white space
    included; kept words of others are joined by one space. Rows that lose all their words go.
    """
    _, changes = _judged(docs, window)
    told = changes.select(
        F.col("doc_id").alias("_changed"), F.col("digest").alias("_digest"), F.col("kept_text").alias("_kept")
    )
    here = {c: f"_doc{i}" for i, c in enumerate(docs.columns)}  # any name may occur in docs
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in here.items()])
    key, text = F.col(here["doc_id"]).cast("bigint"), F.col(here["text"])
    joined = plain.join(told, (key == F.col("_changed")) & (digest(text) == F.col("_digest")), "left")
    new = F.coalesce("_kept", text)
    columns = []
    for c, n in here.items():
        if c == "text":
            columns.append(new.alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col("_kept").isNull(), F.col(n)).otherwise(F.length(new)).cast(kind).alias(c))
        else:
            columns.append(F.col(n).alias(c))
    return joined.where("_kept is null or _kept <> ''").select(*columns)


def removed_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Words stand between ASCII white space and are compared as they are. A word goes if it is in a
    run of ``window`` words that also starts in a row with a smaller doc_id; all runs are judged
    on the input. A null or empty text has no words. A row without doc_id is neither compared nor
    changed. Rows that repeat a doc_id are judged alike, each by the smaller ids.
    """
    sketches, changes = _judged(docs, window)
    told = changes.select("doc_id", "digest", "n_removed", F.sha2("kept_text", 256).alias("new_sha"))
    return sketches.join(told, ["doc_id", "digest"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("new_sha", "sha").alias("kept_sha256"),
    )
