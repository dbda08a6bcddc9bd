"""Row numbers and the order of first appearance, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voilage.columns import field
from voilage.operators.classes import lookup
from voilage.session import materialize

_WITHIN = (1 << 33) - 1  # the part of a monotonic id that counts inside a partition


def numbered(df: DataFrame, by: Sequence[str], name: str = "position", descending: bool = False) -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of the columns ``by``.

    Rows are dealt out by ranges, sorted and counted range by range; a row's place is the number of
    rows in the ranges before its own, and its place there. Rows equal in ``by`` get places side by
    side in no certain order.
    """
    order = [F.desc(c) if descending else F.asc(c) for c in (field(b) for b in by)]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))})
    )
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    told = placed.join(F.broadcast(starts), "_range")  # as many rows as there are ranges
    return told.select(*[field(c) for c in df.columns], (F.col("_start") + F.col("_at") + 1).alias(name))


def first_appearance(df: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """``df`` with ``_first``, the smallest ``place`` of any row of the row's class.

    A class's first place is folded on the map side; classes of any size meet it in one pass (see
    ``lookup``). ``keys`` must not be NULL.
    """
    at = F.struct(*[field(p) for p in place])
    firsts = materialize(df.groupBy(*keys).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_size")))
    total = firsts.agg(F.sum("_size")).scalar()
    return lookup(df, firsts, list(keys), weight="_size", total=total).drop("_size")


def in_order_of_appearance(df: DataFrame, keys: Sequence[str], place: Sequence[str], name: str | None = None) -> DataFrame:
    """Classes in the order in which they first appear, the rows of each in the order of ``place``.

    With ``name``, each row's place in that order as a column; else the sorted rows.
    """
    placed = first_appearance(df, keys, place)
    if name:
        return numbered(placed, ["_first", *place], name).drop("_first")
    return placed.orderBy("_first", *[field(p) for p in place]).drop("_first")
