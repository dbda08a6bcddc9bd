"""Laplace noise that is random to an outsider and repeatable for the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voilage import fixed_values as fixed
from voilage.functions.numbers import exact_floor_text, long_amount, overflows, parse_amount


def uniform_draw(seed: str, *parts: Column) -> Column:
    """A uniform number strictly between 0 and 1, from SHA-256 of seed and parts.

    A pure function of the record: a retried task, or a second pass over the same
    rows, draws the same number. 52 bits, so the half-step offset is exact.
    """
    shown = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.sha2(F.concat_ws("\u001f", F.lit(seed), *shown), 256)
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def laplace(x: Column, epsilon: float, draw: Column, sensitivity: float = 1.0) -> Column:
    """``x`` plus Laplace noise of scale ``sensitivity / epsilon``."""
    if not epsilon or epsilon <= 0:
        return x
    u = draw - 0.5
    return x - F.lit(sensitivity / epsilon) * F.signum(u) * F.ln(1.0 - 2.0 * F.abs(u))


def noisy_amount(c: Column, epsilon: float, draw: Column) -> Column:
    """A noised amount as text, rounded with halves going up; no number stays as it is.

    Amounts of 1e37 or more are far too large for the noise to change, and are printed as the
    numbers they are read as. One too large for any number becomes empty: it must not be published
    as it came.
    """
    noised = laplace(parse_amount(c), epsilon, draw, fixed.NOISE_SENSITIVITY)
    return F.coalesce(exact_floor_text(noised + 0.5), long_amount(c), F.when(overflows(c), F.lit("")), c)


def rounded_amount(c: Column, step: int) -> Column:
    """An amount as text, to the nearest multiple of ``step``, halves going up; no number stays as it is.

    So does one of 1e37 or more, whose digits already say less than steps do.
    """
    places = parse_amount(c) / float(step) + 0.5
    return F.coalesce(exact_floor_text((places - F.pmod(places, F.lit(1.0))) * float(step)), c)
