"""Helpers of several operators: tables in the shared folder, and connected components."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voilage.session import materialize

__all__ = ["components", "documents_only", "fresh", "materialize", "moved", "table", "with_columns_schema"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_only(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that columns of other names cannot clash with those made here."""
    return docs.select(*[F.col(f"`{c}`").cast("bigint" if c == "doc_id" else "string").alias(c) for c in columns])


def fresh(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """The names, with underscores added where a column is called so already."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def with_columns_schema(df: DataFrame, more: dict[str, str]) -> T.StructType:
    """The schema of ``df`` with further columns."""
    added = [T.StructField(name, T.DataType.fromDDL(kind), True) for name, kind in more.items()]
    return T.StructType([*df.schema.fields, *added])


def moved(key: Column) -> Column:
    """The key in other clothes.

    An aggregate is partitioned by its keys, so a join on them would take it as it is and leave
    adaptive execution no exchange to split for skew. A computed key asks for a new exchange of
    the (few) aggregated rows.
    """
    return key.bitwiseXOR(F.lit(0x5BD1E995).cast("bigint"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as pairs (a, b) of bigint.

    Returns (node, root), one row per node of a pair, root being the smallest node reachable.
    Every round points each node at its smallest neighbour, follows the pointers to their ends
    by doubling and contracts the graph to these ends; at least half the nodes that still have
    edges vanish, so there are few rounds. Each result is a written table, from which lost
    executors can go on; hubs are only ever summed or joined, never gathered.
    """
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    left = materialize(pairs)
    labels = materialize(left.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not left.isEmpty():
        parents = materialize(left.groupBy(F.col("hi").alias("child")).agg(F.min("lo").alias("parent")))
        while True:
            above = parents.select(F.col("child").alias("mid"), F.col("parent").alias("top"))
            step = parents.join(above, F.col("parent") == F.col("mid"), "left")
            parents = materialize(step.select("child", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("more")))
            open_ends = parents.where("more").isEmpty()
            parents = parents.drop("more")
            if open_ends:
                break
        labels = materialize(
            labels.join(parents, F.col("root") == F.col("child"), "left").select("node", F.coalesce("parent", "root").alias("root"))
        )
        ends = functools.reduce(
            lambda df, side: df.join(parents, F.col(side) == F.col("child"), "left")
            .withColumn(side, F.coalesce("parent", side))
            .drop("child", "parent"),
            ("lo", "hi"),
            left,
        )
        ends = ends.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo < hi")
        left = materialize(ends.distinct())
    return labels
