"""Equivalence classes: their keys, sizes and distributions, and their suppression.

Rows are never gathered per class. They are counted per (class, sensitive value)
with map-side partial aggregation, which is what keeps a class, or a value, that
holds a third of all rows from becoming one task. Everything after that works on
those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage.columns import field, text_or_empty
from voilage.config import Roles
from voilage.operators.rules import AREA, BIN, YEAR
from voilage.session import materialize

# A key is heavy when it holds at least 1/HEAVY of the rows to be matched. There are
# at most HEAVY such keys whatever the data, which bounds what gets broadcast.
HEAVY = 1000
# A wider set of keys is broadcast only after its size was measured to be below this.
BROADCAST_BYTES = 32 * 1024 * 1024
# Up to here every product of two counts fits in 64 bits.
EXACT_ROWS = 3_000_000_000


def qi_column(name: str, roles: Roles, columns: list[str]) -> Column:
    """The value a quasi-identifier is grouped by: its helper if there is one.

    Both date roles share the one year helper.
    """
    helper = None
    if name in (roles.date1, roles.date2):
        helper = YEAR
    elif name == roles.postal:
        helper = AREA
    elif name == roles.revenue:
        helper = BIN
    raw = field(name).cast("string")
    return F.coalesce(field(helper), raw) if helper in columns else raw


def class_key(
    roles: Roles, columns: list[str], *, compat: bool = False, absent: str = "undefined"
) -> dict[str, Column]:
    """Grouping columns by name. ``absent`` stands for a missing cell.

    By default one column per quasi-identifier. ``compat=True`` joins them with an
    unescaped bar, which merges classes when values hold bars themselves.
    """
    values = [F.coalesce(qi_column(q, roles, columns), F.lit(absent)) for q in roles.qids]
    if compat:
        return {"_qk": F.concat_ws("|", *values)}
    return {f"_q{i}": v for i, v in enumerate(values)}


def class_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n)"""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_class_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the size of its class, as ``n``. Key columns must not be NULL.

    The input is read once to count and once to meet the sizes; see :func:`lookup`.
    """
    sizes = class_sizes(df, keys)
    return lookup(df, sizes, keys, weight="n", total=sizes.agg(F.sum("n")).scalar())


def distribution(df: DataFrame, name: str) -> DataFrame:
    """(value, c, n): occurrences of each value, absent read as empty, out of n rows."""
    counts = df.groupBy(text_or_empty(name).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    return counts.withColumn("n", counts.agg(F.sum("c")).scalar())


def tvd(p: DataFrame, q: DataFrame) -> DataFrame:
    """Total variation distance of two distributions, one row ``tvd``."""
    n_p, n_q = (F.max(F.when(F.col("side") == s, F.col("n"))) for s in (0, 1))
    sides = p.withColumn("side", F.lit(0)).unionByName(q.withColumn("side", F.lit(1)))
    totals = sides.agg(F.struct(n_p.alias("p"), n_q.alias("q"))).scalar()
    per_value = sides.groupBy("value").agg(
        *(F.sum(F.when(F.col("side") == s, F.col("c")).otherwise(0)).alias(n) for s, n in ((0, "cp"), (1, "cq")))
    )
    gap = F.abs(F.col("cp") / totals.getField("p") - F.col("cq") / totals.getField("q"))
    return per_value.agg((F.sum(gap) / 2).alias("tvd"))


def lookup(
    left: DataFrame, right: DataFrame, on: list[str], *, weight: str, total: Column, spread: list[str] | None = None
) -> DataFrame:
    """Left join of ``right``, unique by ``on``, safe under any skew, in one pass over ``left``.

    ``weight`` is the number of left rows a right row will meet, out of ``total``.
    Heavy keys (at most HEAVY of them) are broadcast. The rest is joined on the key
    plus a slot: 0 for light keys, and for rows already served some other slot taken
    from the ``spread`` columns, or from their place in the input where rows may be
    equal, so that they scatter instead of piling up.
    """
    payload = [c for c in right.columns if c not in on]
    is_heavy = F.col(weight) * F.lit(HEAVY) >= total
    heavy = right.filter(is_heavy).select(*on, F.struct(*payload).alias("_heavy"))
    light = right.filter(~is_heavy).select(*on, F.lit(0).alias("_slot"), F.struct(*payload).alias("_light"))
    place = F.xxhash64(*[field(c) for c in spread]) if spread else F.monotonically_increasing_id()
    scattered = F.pmod(place, F.lit(1 << 20)).cast("int") + 1
    served = left.join(F.broadcast(heavy), on, "left").withColumn(
        "_slot", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(scattered)
    )
    found = F.coalesce("_heavy", "_light")
    return served.join(light, [*on, "_slot"], "left").select(
        *[field(c) for c in left.columns], *[found.getField(c).alias(c) for c in payload]
    )


def class_stats(
    df: DataFrame, keys: list[str], sensitive: str | None = None, *, distance: bool = True, write_counts: bool = False
) -> DataFrame:
    """(keys..., n, l, tvd) per class.

    ``write_counts`` writes the counts per class and value to the shared folder first:
    what follows uses them several times, and then plans over a small table instead of
    over copies of the whole input plan.

    n rows, l distinct sensitive values, and the total variation distance between
    the class's and the whole table's sensitive values. The distance is the sum over
    the class of max(0, c*N - C*n), divided once by n*N, so it is exact up to that
    one division; values the class lacks need no term.
    """
    nothing = F.lit(None).cast("double").alias("tvd")
    if not sensitive:
        return class_sizes(df, keys).select(*keys, "n", F.lit(None).cast("bigint").alias("l"), nothing)

    counts = df.groupBy(*keys, text_or_empty(sensitive).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    if write_counts and distance:
        counts = materialize(counts)
    classes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("l"))
    if not distance:
        return classes.select(*keys, "n", "l", nothing)

    values = counts.groupBy("_s").agg(F.sum("_c").alias("_cc"), F.count(F.lit(1)).alias("_classes"))
    totals = values.agg(F.struct(F.sum("_cc").alias("rows"), F.sum("_classes").alias("pairs"))).scalar()
    rows, pairs = totals.getField("rows"), totals.getField("pairs")

    pairs_of = lookup(counts, classes, keys, weight="l", total=pairs, spread=["_s"])
    pairs_of = lookup(pairs_of, values, ["_s"], weight="_classes", total=pairs, spread=keys)

    exact = F.sum(
        F.when(rows <= EXACT_ROWS, F.greatest(F.col("_c") * rows - F.col("_cc") * F.col("n"), F.lit(0)))
    )
    wide = F.sum(
        F.when(
            rows > EXACT_ROWS,
            F.greatest(
                F.col("_c").cast("decimal(18,0)") * rows.cast("decimal(18,0)")
                - F.col("_cc").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)"),
                F.lit(0).cast("decimal(37,0)"),
            ),
        )
    )
    grouped = pairs_of.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("l").alias("l"), exact.alias("_e"), wide.alias("_w")
    )
    above = F.coalesce(F.col("_e").cast("double"), F.col("_w").cast("double"))
    whole = F.col("n").cast("double") * rows.cast("double")
    return grouped.select(*keys, "n", "l", (above / whole).alias("tvd"))


def class_verdicts(
    df: DataFrame,
    keys: list[str],
    sensitive: str | None = None,
    *,
    k: int,
    l: int,  # noqa: E741
    t: float,
    suppress_extras: bool = True,
    write_counts: bool = False,
) -> DataFrame:
    """(keys..., n, l, tvd, kept): which classes reach k, l and t.

    l and t apply only with a sensitive column, t only with ``suppress_extras``.
    """
    stats = class_stats(df, keys, sensitive, distance=suppress_extras, write_counts=write_counts)
    kept = F.col("n") >= k
    if sensitive:
        kept = kept & (F.col("l") >= l)
        if suppress_extras:
            kept = kept & (F.col("tvd") <= t)
    return stats.withColumn("kept", kept)


def class_counts(verdicts: DataFrame) -> DataFrame:
    """One row (kept, total): rows of surviving classes, and all rows."""
    return verdicts.agg(
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def keep_rows(df: DataFrame, verdicts: DataFrame, keys: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of surviving classes. ``verdicts`` should be a written table.

    One small job measures the surviving and the failing keys. The smaller set is
    broadcast if it fits, and no row is shuffled. Otherwise every row looks its class
    up, in one pass: heavy classes by a broadcast of those few, the others by a shuffle.
    """
    width = sum((F.octet_length(field(key)) for key in keys), F.lit(64))
    kept, n = F.col("kept"), F.col("n")
    size = verdicts.agg(
        F.sum(F.when(kept, width)).alias("kept"), F.sum(F.when(~kept, width)).alias("failed"), F.sum("n").alias("rows")
    ).first()
    survivors = verdicts.filter(kept).select(*keys)
    if not size["failed"]:
        return df
    if not size["kept"]:
        return df.limit(0)
    if min(size["kept"], size["failed"]) <= broadcast_bytes:
        if size["kept"] <= size["failed"]:
            return df.join(F.broadcast(survivors), keys, "left_semi")
        return df.join(F.broadcast(verdicts.filter(~kept).select(*keys)), keys, "left_anti")
    told = verdicts.select(*keys, n.alias("_n"), kept.alias("_kept"))
    judged = lookup(df, told, keys, weight="_n", total=F.lit(size["rows"]))
    return judged.filter("_kept").select(*[field(c) for c in df.columns])


def class_audit(df: DataFrame, qids: list[str], k: int) -> DataFrame:
    """One row (total, classes, smallest, below_k, conforming) over the classes of a published table.

    Unlike a row audit it groups by the quasi-identifiers alone, which is what k-anonymity
    speaks of. Absent cells count as a value of their own. An empty table conforms.
    """
    if not qids:
        raise ValueError("choose at least one quasi-identifier")
    sizes = df.groupBy(*[field(q).cast("string").alias(f"_a{i}") for i, q in enumerate(qids)]).agg(F.count(F.lit(1)).alias("n"))
    small = F.count_if(F.col("n") < k)
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("smallest"),
        small.alias("below_k"),
        (small == 0).alias("conforming"),
    )


def suppress_classes(
    df: DataFrame,
    keys: list[str],
    sensitive: str | None = None,
    *,
    k: int,
    l: int = 1,  # noqa: E741
    t: float = 1.0,
    suppress_extras: bool = True,
) -> DataFrame:
    """Only the rows whose class reaches k, l and t. Runs the class statistics."""
    columns = [field(c) for c in dict.fromkeys([*keys, *([sensitive] if sensitive else [])])]
    verdicts = class_verdicts(
        df.select(*columns), keys, sensitive, k=k, l=l, t=t, suppress_extras=suppress_extras, write_counts=True
    )
    return keep_rows(df, materialize(verdicts), keys)
