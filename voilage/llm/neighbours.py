"""Near-duplicate vectors by NN-descent.

1. Start. Random hyperplane trees deal the vectors into leaves, large leaves into blocks of
   bounded size; within a block each vector keeps its nearest neighbours of useful likeness.
2. Descend. Neighbours of a common neighbour are compared and enter each other's lists, until a
   round brings few new ones.
3. Ask. A vector whose whole list lies above the threshold may have more links than places, also
   to vectors outside its component as found so far. All vectors of such a component are asked
   against the whole table, in chunks. A tile of asking vectors meets only those rows that the
   triangle inequality lets come near it; what is reported are counts, and for each chunk one link
   a row to grow the components by.
4. Audit. The links of a sample of vectors are found by brute force; it is drawn on until it holds
   AUDIT linked vectors, or the whole table. Below the wanted recall more trees are added and the
   search goes on. If the recall stays short after ATTEMPTS, all vectors are asked as in step 3.

Equal vectors are one class with a weight, so copies never meet one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voilage.llm.shared import components, materialize
from voilage.session import scratch_path, spread

THRESHOLD = 0.95
USEFUL = 0.8  # likeness from which a neighbour is kept to search on from
PLACES = 16
TREES = 12
LEAF = 256
BLOCK = 512
CHUNK = 1 << 20  # numbers in the vectors that are asked in one pass over the table
TILE = 512
LEADERS = 256
ROUNDS = 8
AUDIT = 200
RECALL = 0.99
ATTEMPTS = 3


def unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all lists must have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _leaves(seed: int, trees: int, depth: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng([seed, width]).standard_normal((width, trees * depth))
        for batch in batches:
            bits = (unit(batch.column("v")) @ planes > 0).reshape(len(batch), trees, depth)
            codes = (bits @ (1 << np.arange(depth, dtype=np.int64))) * trees + np.arange(trees)
            row = np.repeat(np.arange(len(batch)), trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(row)), pa.array(codes.ravel())], names=["node", "leaf"]
            )

    return run


def _within(group: pa.Table) -> pa.Table:
    """Useful pairs (a < b, likeness) of a block, each row's best places."""
    ids = group.column("node").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = unit(group.column("v"))[order]
    likeness, ids = x @ x.T, ids[order]
    np.fill_diagonal(likeness, -1)
    if len(ids) > PLACES:
        best = np.argpartition(-likeness, PLACES - 1, axis=1)[:, :PLACES]
        chosen = np.zeros(likeness.shape, bool)
        np.put_along_axis(chosen, best, True, 1)
        chosen |= chosen.T
    else:
        chosen = np.ones(likeness.shape, bool)
    a, b = np.nonzero(np.triu(chosen & (likeness >= USEFUL), 1))
    return pa.table([pa.array(ids[a]), pa.array(ids[b]), pa.array(likeness[a, b])], names=["a", "b", "likeness"])


def _tiles(x: np.ndarray) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """An order of the rows, their tiles in it, the tiles' centres, and the least cosine to a centre of all that links with its tile."""
    left, groups = np.arange(len(x)), []
    while len(left) and len(groups) < LEADERS:
        near = x[left] @ x[left[0]] >= THRESHOLD
        near[0] = True
        groups.append(left[near])
        left = left[~near]
    parts = [g[i : i + TILE] for g in [*groups, left] for i in range(0, len(g), TILE)]
    ends = np.cumsum([len(part) for part in parts])
    centres = np.array([x[part[0]] for part in parts])
    radius = np.array([np.arccos(np.clip((x[part] @ x[part[0]]).min(), -1, 1)) for part in parts])
    reach = np.cos(np.minimum(np.pi, radius + np.arccos(THRESHOLD))) - 1e-6
    return np.concatenate(parts), [slice(int(e) - len(part), int(e)) for e, part in zip(ends, parts)], centres, reach


def _joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that all have a link: the first column reachable from each row, and from each column."""
    columns = np.arange(near.shape[1])
    while True:
        rows = np.where(near, columns, near.shape[1]).min(1)
        more = np.minimum(columns, np.where(near, rows[:, None], near.shape[1]).min(0))
        if (more == columns).all():
            return rows, columns
        columns = more


ASKED = "asked boolean, node bigint, n bigint, other bigint"


def _ask(ids: np.ndarray, weight: np.ndarray, x: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of these vectors with all rows: counts of both sides, and links that join what is connected."""
    order, tiles, centres, reach = _tiles(x)
    ids, weight, x = ids[order], weight[order], x[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, total = list(range(len(ids))), np.zeros(len(ids), np.int64)

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        def rows(asked: bool, node: np.ndarray, n: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), asked)), pa.array(node), pa.array(n), pa.array(other)], names=["asked", "node", "n", "other"]
            )

        for batch in batches:
            for at in range(0, len(batch), 4 * TILE):
                part = batch.slice(at, 4 * TILE)
                y, own = unit(part.column("v")), part.column("node").to_numpy()
                copies, n, first = part.column("weight").to_numpy(), np.zeros(len(own), np.int64), np.full(len(own), -1)
                close = y @ centres.T >= reach
                for t, tile in enumerate(tiles):
                    some = np.flatnonzero(close[:, t])
                    near = (y[some] @ x[tile].T >= THRESHOLD) & (own[some][:, None] != ids[tile][None, :])
                    hit = near.any(1)
                    if not hit.any():
                        continue
                    near, some = near[hit], some[hit]
                    n[some] += near @ weight[tile]
                    total[tile] += copies[some] @ near
                    told, columns = _joined(near)
                    known = first[some] >= 0
                    links = np.concatenate(
                        [
                            np.stack([np.arange(len(columns)), columns], 1) + tile.start,
                            np.stack([first[some][known], told[known] + tile.start], 1),
                        ]
                    )
                    for a, b in np.unique(links[links[:, 0] != links[:, 1]], axis=0).tolist():
                        top[root(a)] = root(b)
                    first[some[~known]] = told[~known] + tile.start
                linked = first >= 0
                if linked.any():
                    yield rows(False, own[linked], n[linked], ids[first[linked]])
        linked = total > 0
        if linked.any():
            yield rows(True, ids[linked], total[linked], ids[[root(i) for i in np.flatnonzero(linked).tolist()]])

    return run


def _asked(asks: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Links of the asking vectors (node, v, weight, root) with all vectors, exactly.

    Those of a root stay together unless they are many, so that a chunk has few centres.
    """
    size = max(1, CHUNK // width)
    many = max(1, math.ceil(asks.count() / size))
    large = asks.groupBy("root").count().where(F.col("count") > size // 2).select(F.col("root").alias("r"), F.lit(True).alias("large"))
    key = F.when(F.col("large"), F.col("node")).otherwise(F.col("root"))
    dealt = materialize(asks.join(large, F.col("root") == F.col("r"), "left").select("node", "v", "weight", F.pmod(F.xxhash64(key), F.lit(many)).alias("chunk")))
    path, rows = scratch_path(nodes.sparkSession, "asked"), spread(nodes.select("node", "v", "weight"))
    nodes.sparkSession.createDataFrame([], ASKED).write.parquet(path)
    for chunk in range(many):
        own = dealt.where(F.col("chunk") == chunk).select("node", "v", "weight").toArrow()
        if len(own):
            run = _ask(own.column("node").to_numpy(), own.column("weight").to_numpy(), unit(own.column("v")))
            rows.mapInArrow(run, ASKED).write.mode("append").parquet(path)
    return nodes.sparkSession.read.schema(ASKED).parquet(path)


def _pair_likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = unit(batch.column("va")), unit(batch.column("vb"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x * y).sum(1))], names=["a", "b", "likeness"])


PAIR = "a bigint, b bigint, likeness double"


def _start(nodes: DataFrame, width: int, count: int, seed: int) -> DataFrame:
    depth = max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))
    if depth:
        leaves = materialize(nodes.mapInArrow(_leaves(seed, TREES, depth, width), "node bigint, leaf bigint"))
    else:
        leaves = nodes.select("node", F.lit(0).cast("bigint").alias("leaf"))
    sizes = leaves.groupBy("leaf").agg((1 + F.floor(F.count("*") / BLOCK)).alias("blocks"))
    sizes = materialize(sizes).withColumnRenamed("leaf", "l")
    dealt = leaves.join(sizes, F.col("leaf") == F.col("l")).select(
        "node", "leaf", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).alias("block")
    )
    return dealt.join(nodes, "node").select("node", "v", "leaf", "block").groupBy("leaf", "block").applyInArrow(_within, PAIR).distinct()


def _lists(edges: DataFrame) -> DataFrame:
    """Each vector's best places: node, other, likeness, rank."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "likeness").unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "likeness")
    )
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("likeness"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= PLACES)


def _full(lists: DataFrame) -> DataFrame:
    """Vectors whose list is full of links."""
    full = lists.groupBy("node").agg(F.count("*").alias("n"), F.min("likeness").alias("least"))
    return full.where((F.col("n") >= PLACES) & (F.col("least") >= THRESHOLD)).select("node")


def _descend(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges after comparing neighbours of common neighbours until few are new."""
    vectors = nodes.select("node", "v")
    for _ in range(ROUNDS):
        lists = materialize(_lists(edges))
        full = materialize(_full(lists))
        around = lists.select("node", F.col("other").alias("a"))
        pairs = around.join(around.withColumnRenamed("a", "b"), "node").where("a < b").select("a", "b").distinct()
        # two full lists gain nothing from each other here; they are asked later
        marked = pairs.join(full.select(F.col("node").alias("a"), F.lit(True).alias("fa")), "a", "left")
        marked = marked.join(full.select(F.col("node").alias("b"), F.lit(True).alias("fb")), "b", "left")
        fresh = marked.where("fa is null or fb is null").select("a", "b").join(edges, ["a", "b"], "left_anti")
        known = fresh.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("va")), "a")
        known = known.join(vectors.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
        found = materialize(known.select("a", "b", "va", "vb").mapInArrow(_pair_likeness, PAIR).where(F.col("likeness") >= USEFUL))
        new, old = found.count(), edges.count()
        edges = materialize(edges.unionByName(found))
        if new <= 0.001 * old:
            break
    return edges


def _answer(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """node, root, links (weights of the classes linked), from threshold edges."""
    links = edges.where(F.col("likeness") >= THRESHOLD).select("a", "b")
    roots = components(links)
    full = _full(_lists(edges)).join(roots, "node").select(F.col("root").alias("r")).distinct()
    crowded = materialize(roots.join(full, F.col("root") == F.col("r"), "left_semi").join(nodes, "node").select("node", "v", "weight", "root"))
    if crowded.isEmpty():
        told = nodes.sparkSession.createDataFrame([], ASKED)
    else:
        told = _asked(crowded, nodes, width)
        roots = components(links.unionByName(told.select(F.col("node").alias("a"), F.col("other").alias("b"))))
    weights = nodes.select(F.col("node").alias("other"), "weight")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    # what links two vectors that were not asked is listed; all else was counted on asking
    asking = crowded.select("node")
    listed = both.join(asking, "node", "left_anti").join(asking.withColumnRenamed("node", "other"), "other", "left_anti")
    listed = listed.join(weights, "other").select("node", F.col("weight").alias("n"))
    answering = told.where("not asked").join(asking, "node", "left_anti").select("node", "n")
    counts = listed.unionByName(answering).unionByName(told.where("asked").select("node", "n"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("links"))
    return materialize(roots.join(counts, "node", "left").select("node", "root", F.coalesce("links", F.lit(0)).alias("links")))


def _recall(nodes: DataFrame, answer: DataFrame, width: int, count: int) -> float:
    """Share of the brute-force links that were found, of a sample that holds AUDIT linked vectors or is the whole table.

    The share of all links or the mean of each linked vector's own share, whichever is less.
    """
    place = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    n = found = linked = shares = 0
    low, high = 0.0, min(1.0, AUDIT / max(1, count))
    while True:
        sample = nodes.where((place >= low) & (place < high)).withColumn("root", F.col("node"))
        true = _asked(sample, nodes, width).where("asked").groupBy("node").agg(F.sum("n").alias("n"))
        told = true.join(answer, "node", "left").select("n", F.least("n", F.coalesce("links", F.lit(0))).alias("found"))
        row = told.agg(F.sum("n").alias("n"), F.sum("found").alias("found"), F.count("*").alias("linked"), F.sum(F.col("found") / F.col("n")).alias("shares")).first()
        linked += row["linked"]
        if row["linked"]:
            n, found, shares = n + row["n"], found + row["found"], shares + row["shares"]
        if linked >= AUDIT or high >= 1:
            return min(found / n, shares / linked) if linked else 1.0
        low, high = high, min(1.0, 4 * high)


def _whole(nodes: DataFrame, width: int) -> DataFrame:
    """The answer by asking every vector."""
    told = _asked(nodes.withColumn("root", F.col("node")), nodes, width)
    roots = components(told.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = told.where("asked").groupBy("node").agg(F.sum("n").alias("links"))
    return materialize(roots.join(counts, "node").select("node", "root", "links"))


def _classes(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, v, fit), and the distinct vectors that can link: node, v, weight, width."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    nodes = rows.where("fit").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("weight"))
    return rows, nodes.withColumn("width", F.size("v"))


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per row: its id, n_links, component_id, kept.

    n_links counts the other rows at cosine THRESHOLD or above, in double precision; component_id
    is the smallest id reachable by links. A vector that is null, empty, zero or holds null or
    non-finite numbers links with nothing, nor does a row without id (its component is null; it is
    kept). Vectors of different lengths do not link. Rows that repeat an id count as rows of their
    own; those that share an id with a row of another vector join its component. An empty table
    gives an empty result.
    """
    rows, nodes = _classes(vectors, id_column, vector_column)
    nodes = materialize(nodes)
    told = None
    for width in sorted(r["width"] for r in nodes.select("width").distinct().collect()):
        own = nodes.where(F.col("width") == width).select("node", "v", "weight")
        count, edges = own.count(), None
        for attempt in range(ATTEMPTS):
            start = _start(own, width, count, attempt)
            edges = materialize(start if edges is None else edges.unionByName(start).dropDuplicates(["a", "b"]))
            edges = _descend(edges, own)
            answer = _answer(own, edges, width)
            if _recall(own, answer, width, count) >= RECALL:
                break
        else:
            answer = _whole(own, width)
        told = answer if told is None else told.unionByName(answer)
    classes = nodes.select("v", "node", "weight")
    if told is None:
        labelled = classes.withColumns({"root": F.col("node"), "links": F.lit(0).cast("bigint")})
    else:
        labelled = classes.join(told, "node", "left")
    labelled = materialize(
        labelled.select("v", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    )
    linked = rows.where("fit").join(labelled, "v").select(
        F.col("id").alias(id_column), F.col("n").cast("bigint").alias("n_links"), F.col("root").alias("component_id"), (F.col("root") == F.col("id")).alias("kept")
    )
    alone = rows.where("not fit").select(
        F.col("id").alias(id_column), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)
