"""Near duplicates by min-max hashing.

Of each of P cheap permutations of a document's shingle set both the smallest and the largest
value are kept, so P evaluations give 2P signature values whose agreement estimates the Jaccard
similarity without bias (and with less variance than 2P minima, as the two ends are drawn without
replacement). Bands of R values propose pairs: with 40 bands of 5 a pair at similarity 0.8 is
missed with probability 1.2e-7. Every link is confirmed on full sets of 64-bit shingle hashes.

Pairs of a band are never all emitted. Documents with equal sets are one class with one
representative. Within a band, representatives meet its smallest one first; classes that link
become one component. In bands whose other members still belong to different components, the
members outside the band's largest component are compared with all of its members, in blocks of
bounded size and on full sets; only links leave these blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage.llm import words as W
from voilage.llm.shared import components, documents_only, materialize, moved

BANDS = 40
ROWS = 5
SEED = 20240229
BLOCK = 400_000  # shingles of a band that are compared at once, on either side
_CHUNK = 512


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words as one shingle if there are fewer."""
    data, offsets = W.buffer_of(column)
    found = W.split(data, offsets, W.outside(W.WHITE), W.lower())
    for i in range(len(offsets) - 1):
        own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
        yield np.unique(W.grams(own, min(size, len(own)))) if len(own) else own


@functools.cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    a = draw.integers(0, 1 << 32, (count, 1), np.uint32) | np.uint32(1)
    return a, draw.integers(0, 1 << 32, (count, 1), np.uint32)


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """Minimum and maximum under each of ``count`` permutations, in turn."""
    a, b = _permutations(count)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(count, 0xFFFFFFFF, np.uint32), np.zeros(count, np.uint32)
    for at in range(0, len(x), _CHUNK):
        seen = a * x[at : at + _CHUNK] + b
        np.minimum(low, seen.min(1), out=low)
        np.maximum(high, seen.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = values.astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        key = W.mix(key ^ parts[:, i]) + parts[:, i]
    return key.view(np.int64)


def _sketches(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            counts, sums, mixes, keys, bounds = [], [], [], [], [0]
            for own in shingle_sets(batch.column(1), size):
                counts.append(len(own))
                sums.append(own.sum(dtype=np.uint64))
                mixes.append(W.mix(own ^ np.uint64(SEED)).sum(dtype=np.uint64))
                if len(own):
                    keys.append(band_keys(signature(own, bands * rows // 2), bands, rows))
                bounds.append(bounds[-1] + (bands if len(own) else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(np.array(sums, np.uint64).view(np.int64)),
                    pa.array(np.array(mixes, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def _full_sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            sets = list(shingle_sets(part.column(1), size))
            bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["doc", "shingles"]
            )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets share at least ``percent`` hundredths of their union."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc").alias(name), F.col("shingles").alias(f"set_{name}"))

    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * either).select("a", "b").distinct()


def _across(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between the asking rows of a block and its rows of other components."""

    def run(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        doc, root, major = (block.column(c).to_numpy() for c in ("doc", "root", "major"))
        lists = block.column("shingles").combine_chunks()
        flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        rows = np.flatnonzero(~asks)
        a, b = [], []
        if len(rows):
            own = np.concatenate([flat[ends[r] - size[r] : ends[r]] for r in rows])
            words, place = np.unique(own, return_inverse=True)
            starts, mark = np.cumsum(size[rows]) - size[rows], np.zeros(len(words), np.int32)
            for q in np.flatnonzero(asks):
                other = flat[ends[q] - size[q] : ends[q]]
                spot = np.minimum(np.searchsorted(words, other), len(words) - 1)
                spot = spot[words[spot] == other]
                mark[spot] = 1
                both = np.add.reduceat(mark[place], starts)
                mark[spot] = 0
                linked = (100 * both >= percent * (size[rows] + size[q] - both)) & (root[rows] != root[q])
                # two asking documents of a band meet twice; once is enough
                linked &= (root[rows] == major[rows]) | (doc[rows] > doc[q])
                a += [doc[q]] * int(linked.sum())
                b += doc[rows[linked]].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rows of different roots, each band's smaller components asking all rows."""
    dealt = rows.join(bands, F.col("band") == F.col("key"))

    def block(many: str) -> Column:
        return F.pmod(F.xxhash64("doc"), F.col(many)).cast("int")

    def each(many: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(many) - 1))

    told = ["band", "doc", "root", "major"]
    answer = dealt.select(*told, block("blocks").alias("block"), each("asked").alias("part"), F.lit(False).alias("asks"))
    ask = dealt.where("root != major")
    ask = ask.select(*told, each("blocks").alias("block"), block("asked").alias("part"), F.lit(True).alias("asks"))
    full = answer.unionByName(ask).join(sets, "doc")
    found = full.groupBy("band", "block", "part").applyInArrow(_across(percent), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are what stands between ASCII white space, with A-Z in lower case. Needs doc_id and
    text; other columns are ignored. A null or empty text, or one without words, has an empty set
    and links with nothing. Rows with the same doc_id are one document: a link of one is a link of
    all. A row without doc_id links with nothing, has no component and is kept. An empty table
    gives an empty result.
    """
    texts = documents_only(docs, "doc_id", "text")
    sketches = materialize(
        texts.mapInArrow(_sketches(size, bands, rows), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")
    )
    same = ["n_shingles", "d1", "d2"]
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    chosen = real.join(classes.select(*same, F.col("rep").alias("doc_id")), [*same, "doc_id"], "left_semi")
    keyed = chosen.select(F.explode("bands").alias("band"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    shared = keyed.groupBy("band").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    members = materialize(
        keyed.join(shared.select(moved(F.col("band")).alias("key")), moved(F.col("band")) == F.col("key"), "left_semi").distinct()
    )
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = materialize(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(size), "doc bigint, shingles array<bigint>"))
    centres = materialize(
        members.groupBy("band").agg(F.min(F.struct("doc", "n")).alias("c")).select(
            F.col("band").alias("key"), F.col("c.doc").alias("centre"), F.col("c.n").alias("n_c")
        )
    )
    pairs = (
        members.join(centres, F.col("band") == F.col("key"))
        .where((F.col("doc") > F.col("centre")) & (100 * F.least("n", "n_c") >= percent * F.greatest("n", "n_c")))
        .select(F.col("centre").alias("a"), F.col("doc").alias("b"))
        .distinct()
    )
    near = materialize(_confirmed(pairs, sets, percent))
    first = components(near)
    rest = members.join(centres, (F.col("band") == F.col("key")) & (F.col("doc") == F.col("centre")), "left_anti")
    rest = rest.join(first, F.col("doc") == F.col("node"), "left").select("band", "doc", "n", F.coalesce("root", "doc").alias("root"))
    rest = materialize(rest)
    tally = rest.groupBy("band", "root").agg(F.sum("n").alias("n"))
    bands_left = tally.groupBy("band").agg(F.count("*").alias("roots"), F.max_by("root", "n").alias("major"), F.sum("n").alias("all_n"), F.max("n").alias("major_n"))
    bands_left = materialize(
        bands_left.where("roots > 1").select(
            F.col("band").alias("key"),
            "major",
            (1 + F.floor(F.col("all_n") / BLOCK)).cast("int").alias("blocks"),
            (1 + F.floor((F.col("all_n") - F.col("major_n")) / BLOCK)).cast("int").alias("asked"),
        )
    )
    links = near.unionByName(_in_blocks(rest, bands_left, sets, percent))
    labelled = sketches.select("doc_id", *same).join(classes, same, "left")
    links = materialize(links)
    top = labelled.join(components(links), F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return top.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document of each near-duplicate group.

    The smallest doc_id of a group stays; of rows that repeat a doc_id one stays. Rows without
    doc_id all stay, as they cannot be told apart.
    """
    verdicts = near_duplicates(docs, size, percent)
    gone = materialize(verdicts.where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    twice = materialize(
        verdicts.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice"))
    )
    left = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(twice, F.col("doc_id") == F.col("twice"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, F.col("doc_id") == F.col("twice"), "left_anti").unionByName(once)
