"""Disclosure risk of a table, before, in preview, and after a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage import fixed_values as fixed
from voilage.columns import field, matching, round_half_up, text_or_empty
from voilage.config import Roles
from voilage.functions.text import strip_blanks
from voilage.operators.classes import class_key
from voilage.operators.rules import HELPERS, with_helpers


def direct_pii_columns(columns: Sequence[str]) -> list[str]:
    """The columns whose name tells a direct identifier."""
    return matching(columns, fixed.DIRECT_PII)


def carries_pii(columns: Sequence[str]) -> Column:
    """Whether any directly identifying column of the row is filled in."""
    filled = F.lit(False)
    for name in direct_pii_columns(columns):
        filled = filled | (F.coalesce(strip_blanks(field(name).cast("string")), F.lit("")) != "")
    return filled


_ROWS, _PII_ROWS = "_rows", "_pii_rows"


def _percent(share: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * share))


def _entropy(counts: DataFrame) -> DataFrame:
    """One row: entropy in bits of the values ``_s`` with counts ``_c``, and the sum of ``_p``.

    From the counts alone: log2(N) - sum(C*log2(C)) / N, one pass, no total needed.
    The sum is there so that this plan needs the same columns of ``counts`` as its
    caller's does; Spark then counts and shuffles once for both.
    """
    values = counts.groupBy("_s").agg(F.sum("_c").cast("double").alias("c"), F.sum("_p").alias("p"))
    total = F.sum("c")
    bits = F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total
    return values.agg(F.struct(bits.alias("bits"), F.sum("p").alias("pii")).alias("values"))


def risk_metrics(
    df: DataFrame,
    roles: Roles,
    columns: Sequence[str] | None = None,
    *,
    compat: bool = False,
) -> DataFrame:
    """One row (individualization, correlation, inference) in percent.

    Rows that carry helper columns are grouped by them, others by the raw values.
    A score that cannot be told (no row, no quasi-identifier, no sensitive column)
    is NULL. ``columns`` are those searched for direct identifiers.
    """
    columns = [c for c in (columns or df.columns) if c not in HELPERS]
    one = F.lit(1).cast("bigint")
    return _scores(df.withColumns({_ROWS: one, _PII_ROWS: carries_pii(columns).cast("bigint")}), roles, compat)


def _scores(df: DataFrame, roles: Roles, compat: bool) -> DataFrame:
    """The scores of a table whose rows each stand for a number of rows, some of them with direct identifiers."""
    keys = class_key(roles, df.columns, compat=compat, absent="")
    sensitive = text_or_empty(roles.sensitive) if roles.sensitive else F.lit("")
    counts = (
        df.select(*[k.alias(n) for n, k in keys.items()], sensitive.alias("_s"), _ROWS, _PII_ROWS)
        .groupBy(*keys, "_s")
        .agg(F.sum(_ROWS).alias("_c"), F.sum(_PII_ROWS).alias("_p"))
    )
    classes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("_c").alias("top"), F.sum("_p").alias("p"))
    total = classes.agg(
        F.sum("n").alias("rows"),
        F.sum("p").alias("pii"),
        F.count_if(F.col("n") == 1).alias("single"),
        F.count(F.lit(1)).alias("classes"),
        F.sum(F.col("top") / F.col("n")).alias("shares"),
    )
    any_row = F.col("rows") > 0
    pii = F.col("pii")
    alone = F.col("single") / F.col("classes") if roles.qids else F.lit(0.0)
    correlation = inference = F.lit(None).cast("double")
    if roles.qids:
        correlation = F.when(any_row, _percent(alone))
    if roles.qids and roles.sensitive:
        values = _entropy(counts).scalar()
        pii = F.greatest(pii, values.getField("pii"))
        spread = F.least(F.lit(1.0), values.getField("bits") / 4.0)
        average = F.col("shares") / F.col("classes")
        inference = F.when(any_row, _percent(average * (0.6 + 0.4 * (1.0 - spread))))
    individualization = F.when(any_row, _percent(0.6 * (pii / F.col("rows")) + 0.4 * alone))
    return total.select(
        individualization.alias("individualization"),
        correlation.alias("correlation"),
        inference.alias("inference"),
    )


def metrics_before_after(df: DataFrame, roles: Roles, *, compat: bool = False) -> DataFrame:
    """Two rows (stage, individualization, correlation, inference): raw, and with helpers.

    One scan with two grouping sets, the raw keys and the keys with helpers, each with the sensitive
    value. Only these columns are shuffled, and rows of the coarser set are folded before.
    """
    searched = [c for c in df.columns if c not in HELPERS]
    helped = with_helpers(df, roles)
    before = class_key(roles, searched, compat=compat, absent="")
    after = class_key(roles, helped.columns, compat=compat, absent="")
    sensitive = text_or_empty(roles.sensitive) if roles.sensitive else F.lit("")
    raw, coarse = [f"_b{n}" for n in before], [f"_a{n}" for n in after]
    plain = helped.select(
        *[c.alias(n) for c, n in zip(before.values(), raw)], *[c.alias(n) for c, n in zip(after.values(), coarse)],
        sensitive.alias("_s"), carries_pii(searched).alias("_pii"),
    )
    sizes = F.count(F.lit(1)).alias("_c"), F.count_if("_pii").alias("_p")
    if not raw:  # without quasi-identifiers both stages are one class
        once = plain.groupBy("_s").agg(*sizes)
        counts = once.select(F.explode(F.array(F.lit("before"), F.lit("after"))).alias("stage"), "_s", "_c", "_p")
    else:
        sets = [[*map(F.col, raw), F.col("_s")], [*map(F.col, coarse), F.col("_s")]]
        both = plain.groupingSets(sets, *[F.col(c) for c in (*raw, *coarse, "_s")])
        counted = both.agg(F.grouping(raw[0]).alias("_folded"), *sizes)
        stage = F.when(F.col("_folded") == 0, F.lit("before")).otherwise(F.lit("after"))
        keys = [F.coalesce(b, a).alias(n) for b, a, n in zip(raw, coarse, before)]
        counts = counted.select(stage.alias("stage"), *keys, "_s", "_c", "_p")
    return _staged_scores(counts, roles, list(before))


def _staged_scores(counts: DataFrame, roles: Roles, keys: Sequence[str]) -> DataFrame:
    """The scores of both stages from counts by stage, key and sensitive value."""
    classes = counts.groupBy("stage", *keys).agg(F.sum("_c").alias("n"), F.max("_c").alias("top"), F.sum("_p").alias("p"))
    total = classes.groupBy("stage").agg(
        F.sum("n").alias("rows"), F.sum("p").alias("pii"), F.count_if(F.col("n") == 1).alias("single"),
        F.count(F.lit(1)).alias("classes"), F.sum(F.col("top") / F.col("n")).alias("shares"),
    )
    alone = F.col("single") / F.col("classes") if roles.qids else F.lit(0.0)
    nothing = F.lit(None).cast("double")
    correlation = _percent(alone) if roles.qids else nothing
    inference = nothing
    if roles.qids and roles.sensitive:
        # the sensitive values are the same in both stages: their spread is told by one of them
        values = counts.where("stage = 'after'").groupBy("_s").agg(F.sum("_c").cast("double").alias("c"))
        size = F.sum("c")
        bits = values.agg((F.log2(size) - F.sum(F.col("c") * F.log2("c")) / size).alias("bits")).scalar()
        spread = F.least(F.lit(1.0), bits / 4.0)
        inference = _percent(F.col("shares") / F.col("classes") * (0.6 + 0.4 * (1.0 - spread)))
    individualization = _percent(0.6 * (F.col("pii") / F.col("rows")) + 0.4 * alone)
    told = total.select(
        F.col("stage").alias("of"), individualization.alias("individualization"), correlation.alias("correlation"), inference.alias("inference")
    )
    # an empty table has both stages too, without scores
    stages = counts.sparkSession.range(2).select(F.when(F.col("id") == 0, F.lit("before")).otherwise(F.lit("after")).alias("stage"))
    return stages.join(told, F.col("stage") == F.col("of"), "left").drop("of")


def verdict(score: Column, threshold: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(fixed.VERDICT_UNKNOWN))
        .when(score <= threshold, F.lit(fixed.VERDICT_OK))
        .otherwise(F.lit(fixed.VERDICT_BAD))
    )


def compliance(metrics: DataFrame) -> DataFrame:
    """(criterion, before, after, threshold, verdict, reduction) from before/after metrics."""
    names = [name for name, _ in fixed.COMPLIANCE_THRESHOLDS]
    long = metrics.unpivot(["stage"], names, "criterion", "score")
    wide = long.groupBy("criterion").agg(
        F.max(F.when(F.col("stage") == "before", F.col("score"))).alias("before"),
        F.max(F.when(F.col("stage") == "after", F.col("score"))).alias("after"),
    )
    threshold = F.lit(None).cast("int")
    for name, limit in fixed.COMPLIANCE_THRESHOLDS:
        threshold = F.when(F.col("criterion") == name, F.lit(limit)).otherwise(threshold)
    gain = round_half_up(F.col("before") - F.col("after"))
    return wide.withColumn("threshold", threshold).select(
        "criterion",
        "before",
        "after",
        "threshold",
        verdict(F.col("after"), F.col("threshold")).alias("verdict"),
        F.when(gain.isNotNull(), F.greatest(F.lit(0).cast("bigint"), gain)).alias("reduction"),
    )


def evaluate(df: DataFrame, qids: Sequence[str], sensitive: str | None = None, k: int = 2) -> DataFrame:
    """One row (individualisation, correlation, inference) of a published table, in percent.

    Groups by the columns as published. Unique rows; rows in classes below ``k``; and
    how well a class gives its sensitive value away, weighted by rows.
    """
    if not qids:
        return df.sparkSession.range(1).select(
            *(F.lit(0.0).alias(n) for n in ("individualisation", "correlation", "inference"))
        )
    keys = {f"_q{i}": text_or_empty(q) for i, q in enumerate(qids)}
    shown = [c.alias(n) for n, c in keys.items()]
    if sensitive:
        counts = df.select(*shown, text_or_empty(sensitive).alias("_s")).groupBy(*keys, "_s").agg(
            F.count(F.lit(1)).alias("_c")
        )
        classes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("d"))
    else:
        classes = df.select(*shown).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("d"))
    n, d, rows = F.col("n"), F.col("d"), F.sum("n")
    given_away = F.when(d <= 1, F.lit(100.0)).otherwise((1.0 - 1.0 / d) * 100.0)
    unique = F.count_if(n == 1) / rows * 100.0
    small = F.sum(F.when(n < k, n).otherwise(F.lit(0))) / rows * 100.0
    told = F.sum(given_away * n) / rows if sensitive else F.lit(0.0)
    zero = F.lit(0.0)
    return classes.agg(
        F.coalesce(unique, zero).alias("individualisation"),
        F.coalesce(small, zero).alias("correlation"),
        F.coalesce(told, zero).alias("inference"),
    )
