"""Column profile and whole-row audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage.columns import field, text_or_empty


# Longer values travel as their digest, which is longer than this and so never taken for a value.
_LONG = 64


def _short(value: Column) -> Column:
    return F.when(F.length(value) > _LONG, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(value)


def profile(df: DataFrame, *, absent_as_empty: bool = True) -> DataFrame:
    """(colonne, distinct, vides, total, colonnes), exact, one row per column.

    Cells are turned into (column, value) pairs and counted per pair, so the work is
    one shuffle of already counted values however many columns there are, and a value
    that fills most of a column is folded on the map side. Long texts are told apart
    by their SHA-256, so no text is shuffled.
    """
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("colonne"),
                    _short(text_or_empty(c) if absent_as_empty else field(c).cast("string")).alias("value"),
                )
                for c in df.columns
            ]
        )
    ).alias("cell")
    counts = df.select(cells).groupBy("cell.colonne", "cell.value").agg(F.count(F.lit(1)).alias("c"))
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    return counts.groupBy("colonne").agg(
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(empty, F.col("c"))), F.lit(0)).alias("vides"),
        F.sum("c").alias("total"),
        F.lit(len(df.columns)).alias("colonnes"),
    )


def row_audit(df: DataFrame, k: int, *, by_digest: bool = True) -> DataFrame:
    """One row (total, groupes, nonConformes, conforme) over groups of identical rows.

    Rows are told apart by the SHA-256 of their cells, each preceded by its length,
    so that 32 bytes per distinct row are shuffled and not the row. ``by_digest=False``
    groups by the cells themselves.
    """
    cells = [text_or_empty(c) for c in df.columns]
    if by_digest:
        framed = F.concat(*[part for c in cells for part in (F.length(c).cast("string"), F.lit(":"), c)])
        rows = df.select(F.unhex(F.sha2(framed, 256)).alias("_row"))
    else:
        rows = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    sizes = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    small = F.count_if(F.col("n") < k)
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("groupes"),
        small.alias("nonConformes"),
        (small == 0).alias("conforme"),
    )
