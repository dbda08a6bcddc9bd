"""Seeded synthetic clients, the same rows whatever the number of partitions.

Row i uses draws 20*(i-1)+1 to 20*i of one xorshift32 sequence. A step is linear over
GF(2), so any row's state is a 32x32 bit matrix power away from the seed: a task jumps
to its first row and then works on whole batches. Tasks return the 20 raw draws of a
row; names, dates and numbers are put together by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voilage import fixed_values as fixed
from voilage.functions.text import unaccent

DRAWS = 20
_BITS = 32
_JUMPS = 48  # rows up to 2**48

Matrix = np.ndarray  # 32 columns: the image of each single bit


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint32(13))
    x = x ^ (x >> np.uint32(17))
    return x ^ (x << np.uint32(5))


def _apply(matrix: Matrix, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(_BITS):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _row_jumps() -> list[Matrix]:
    """Matrices that jump 1, 2, 4, 8, ... rows ahead."""
    row = np.uint32(1) << np.arange(_BITS, dtype=np.uint32)
    for _ in range(DRAWS):
        row = _step(row)
    jumps = [row]
    while len(jumps) < _JUMPS:
        jumps.append(_apply(jumps[-1], jumps[-1]))
    return jumps


def row_states(rows: np.ndarray, seed: int, jumps: list[Matrix]) -> np.ndarray:
    """The generator's state before the first draw of each (1-based) row."""
    ahead = rows.astype(np.uint64) - np.uint64(1)
    base = int(ahead.min())
    state = np.array([seed], dtype=np.uint32)
    for bit in range(base.bit_length()):
        if base >> bit & 1:
            state = _apply(jumps[bit], state)
    states = np.repeat(state, len(ahead))
    offset = ahead - np.uint64(base)
    for bit in range(int(offset.max()).bit_length()):
        moved = (offset >> np.uint64(bit)) & np.uint64(1) == 1
        states[moved] = _apply(jumps[bit], states[moved])
    return states


def raw_draws(df: DataFrame, row: str = "row", seed: int = fixed.CLIENT_SEED) -> DataFrame:
    """(row, d1..d20): the 32-bit draws of each row number, narrow and order-free."""
    if not 0 < seed < 2**32:
        raise ValueError("the seed must be a positive 32-bit number")
    jumps = _row_jumps()
    names = [f"d{i}" for i in range(1, DRAWS + 1)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            numbers = batch["row"].to_numpy()
            x = row_states(numbers, seed, jumps)
            drawn = {"row": numbers}
            for name in names:
                x = _step(x)
                drawn[name] = x.astype(np.int64)
            yield pd.DataFrame(drawn)

    schema = "row bigint, " + ", ".join(f"{n} bigint" for n in names)
    return df.select(F.col(row).cast("bigint").alias("row")).mapInPandas(draw, schema)


def _between(draw: str, low: Column | int, high: Column | int) -> Column:
    """A whole number in [low, high] from a 32-bit draw."""
    low, high = (v if isinstance(v, Column) else F.lit(v).cast("bigint") for v in (low, high))
    return F.shiftright(F.col(draw) * (high - low + 1), 32) + low


def _pick(draw: str, words: Sequence[object]) -> Column:
    chosen = F.get(F.array(*[F.lit(w) for w in words]), _between(draw, 0, len(words) - 1).cast("int"))
    return chosen.cast("string")


def _text(c: Column) -> Column:
    return c.cast("string")


def _birth_date() -> Column:
    year, month = _between("d16", *fixed.BIRTH_YEARS), _between("d17", 1, 12)
    first = F.make_date(year.cast("int"), month.cast("int"), F.lit(1))
    day = _between("d18", 1, F.dayofmonth(F.last_day(first)).cast("bigint"))
    return F.concat(F.substring(first.cast("string"), 1, 8), F.lpad(_text(day), 2, "0"))


def _income() -> Column:
    share = F.col("d19") / float(2**32)
    amount = F.lit(None).cast("bigint")
    for bound, low, high in reversed(fixed.INCOME_MIX):
        amount = F.when(share < bound, _between("d20", low, high)).otherwise(amount)
    return amount


def client_rows(draws: DataFrame) -> DataFrame:
    """The 11 client columns. Draws in order: names and city, telephone, address, postal code, birth, income."""
    letters = list(fixed.POSTAL_LETTERS)
    named = draws.select(
        _text(F.col("row")).alias("id_client"),
        _pick("d1", fixed.FIRST_NAMES).alias("prenom"),
        _pick("d2", fixed.LAST_NAMES).alias("nom"),
        F.concat_ws(
            "-", _pick("d4", fixed.AREA_CODES), _text(_between("d5", 200, 999)), _text(_between("d6", 1000, 9999))
        ).alias("telephone"),
        F.concat_ws(
            " ", _text(_between("d7", 10, 9999)), _pick("d9", fixed.STREET_TYPES), _pick("d8", fixed.STREETS)
        ).alias("adresse"),
        _pick("d3", fixed.CITIES).alias("ville"),
        F.lit(fixed.PROVINCE).alias("province"),
        F.concat(
            _pick("d10", fixed.POSTAL_REGIONS), _text(_between("d11", 0, 9)), _pick("d12", letters),
            _text(_between("d13", 0, 9)), _pick("d14", letters), _text(_between("d15", 0, 9)),
        ).alias("code_postal"),
        _birth_date().alias("date_naissance"),
        _text(_income()).alias("revenu_annuel"),
    )
    mail = F.concat(
        F.concat_ws(".", unaccent(F.col("prenom")), unaccent(F.col("nom")), F.col("id_client")),
        F.lit("@" + fixed.MAIL_DOMAIN),
    )
    return named.withColumn("email", mail).select(*fixed.CLIENT_COLUMNS)


def synth_clients(spark: SparkSession, rows: int, seed: int = fixed.CLIENT_SEED, partitions: int | None = None) -> DataFrame:
    """``rows`` synthetic clients, numbered from 1, in the client file's columns."""
    return client_rows(raw_draws(spark.range(1, rows + 1, 1, partitions).toDF("row"), seed=seed))
