"""Amounts written as text: parsing, binning, printing.

A value that is tested and then used is written so that both places are always
evaluated (``x * when(test(x), 1)``, ``concat(x, when(x == '', ...))``): Spark then
computes the shared part once per row, which it does not do across ``when`` branches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voilage import fixed_values as fixed


def _where(x: Column, test: Column) -> Column:
    """``x`` where the test holds, else NULL."""
    return x * F.when(test, F.lit(1.0))


def _number(kept: Column) -> Column:
    """What is left as a number; nothing left is 0, and only then is it looked at twice."""
    return F.coalesce(kept.try_cast("double"), F.when(kept == "", F.lit(0.0)))


def parse_amount(c: Column) -> Column:
    """The finite number left after dropping all but digits, dot and minus.

    Nothing left reads as 0; text that is no number, or overflows, gives NULL.
    """
    n = _number(F.regexp_replace(c, "[^0-9.-]+", ""))
    return _where(n, F.abs(n) < F.lit(float("inf")))


def overflows(c: Column) -> Column:
    """Whether an amount has more digits before its dot than any number holds (leading zeros count)."""
    return c.rlike(r"^[^0-9.]*+(?:[0-9][^0-9.]*+){309}")


def parse_unsigned(c: Column) -> Column:
    """Like :func:`parse_amount`, but the minus sign is dropped too."""
    return _number(F.regexp_replace(c, "[^0-9.]+", ""))


def floor_text(x: Column) -> Column:
    """``x`` rounded down, in decimal digits.

    From 1e37 on no built-in number holds all digits: those of the shortest notation stand there,
    then zeros.
    """
    return F.coalesce(exact_floor_text(x), _long_text(x))


def exact_floor_text(x: Column) -> Column:
    """``x`` rounded down, in all its decimal digits; NULL from 1e37 on.

    Below 1e18 a floor is a 64-bit number. A larger number is whole, and two parts of 60 bits
    make it up without loss; its shortest notation would not name it exactly.
    """
    high = F.floor(_where(x, (F.abs(x) >= 1e18) & (F.abs(x) < 1e37)) / 2.0**60)
    low = (x - high.cast("double") * 2.0**60).cast("bigint")
    whole = high.cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return F.coalesce(F.floor(_where(x, F.abs(x) < 1e18)).cast("string"), whole.cast("string"))


def _long_text(x: Column) -> Column:
    """A large whole number: its shortest digits, then zeros; NULL, which prints as nothing, stays NULL."""
    return F.nullif(F.format_string("%.0f", x), F.lit(""))


def long_amount(c: Column) -> Column:
    """An amount of 30 digits or more as :func:`floor_text` prints it, others as NULL.

    It refers to the cell and not to a number made from it, so that it adds little to the code of
    an expression that it ends.
    """
    return F.when(c.rlike(r"^[^0-9.]*+(?:[0-9][^0-9.]*+){30}"), _long_text(parse_amount(c)))


def bin_income(c: Column, step: int = fixed.INCOME_STEP) -> Column:
    """An amount to its bin ``low–highk`` in thousands; no number gives empty.

    Up to 1e31 a bin is exact. Larger amounts are binned as the floating-point numbers they are
    read as, which lie farther apart than bins: both bounds may be the same.
    """
    if step <= 0 or step % 1000:
        raise ValueError("the bin width must be a positive multiple of 1000")
    thousands = step // 1000
    amount = parse_amount(c)

    def label(index: Column) -> Column:
        low, high = index * thousands, (index + 1) * thousands
        return F.concat(low.cast("string"), F.lit("–"), high.cast("string"), F.lit("k"))

    # the next bin's bound is the same number at this size
    bounds = F.format_string("%1$.0f–%1$.0fk", amount / float(step) * float(thousands))
    return F.coalesce(
        label(F.floor(_where(amount, F.abs(amount) < 2.0**53) / float(step))),
        label(_floor_div(F.floor(F.regexp_replace(c, "[^0-9.-]+", "").try_cast("decimal(37,6)")), step)),
        F.nullif(bounds, F.lit("–k")),
        F.when(c.isNotNull(), F.lit("")),
    )


def _floor_div(whole: Column, step: int) -> Column:
    """A whole decimal divided by ``step`` and rounded down, digit for digit."""
    width = F.lit(step).cast("decimal(10,0)")
    return ((whole - F.pmod(whole, width)) / width).cast("decimal(32,0)")


def _limit_text(limit: float) -> str:
    return str(int(limit)) if float(limit).is_integer() else repr(float(limit))


def income_below(c: Column, thresholds: Sequence[float]) -> Column:
    """The first threshold, in the given order, that exceeds the amount."""
    if not thresholds:
        raise ValueError("give at least one threshold")
    # a threshold that does not exceed all earlier ones can never come first
    limits = [float(t) for i, t in enumerate(thresholds) if all(t > u for u in thresholds[:i])]
    labels = ["<" + _limit_text(t) for t in limits] + ["≥" + _limit_text(thresholds[-1])]
    return F.coalesce(_label_by_limit(parse_amount(c), limits, labels), F.when(c.isNotNull(), F.lit("")))


def _label_by_limit(n: Column, limits: Sequence[float], labels: Sequence[str]) -> Column:
    """``labels[i]`` for the number ``i`` of limits that ``n`` has reached.

    A lookup by position keeps ``n`` out of ``when`` branches; ``get`` and not
    ``element_at``, whose result Spark takes for never NULL under a NULL position.
    """
    reached = F.when(n.isNotNull(), F.lit(0))
    for limit in limits:
        reached = reached + F.when(n >= limit, F.lit(1)).otherwise(F.lit(0))
    return F.get(F.array(*[F.lit(label) for label in labels]), reached)


def income_band(c: Column) -> Column:
    """The fixed four bands; text that is no number stays as it is."""
    limits = [limit for limit, _ in fixed.INCOME_BANDS]
    labels = [label for _, label in fixed.INCOME_BANDS] + [fixed.TOP_INCOME_BAND]
    return F.coalesce(_label_by_limit(parse_unsigned(c), limits, labels), c)
