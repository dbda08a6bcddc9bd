"""Row treatments: per-column rules, the role switches, the grouping helpers.

Each step is its own projection, so a digest or a noised amount that later columns
read is computed once per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage import fixed_values as fixed
from voilage.columns import field, matching
from voilage.config import Roles, Rule, Settings
from voilage.functions.actions import Noise, build
from voilage.functions.numbers import bin_income, income_band
from voilage.functions.text import hmac12, leading_year, mask_simple, only_year, sha256_hex, short_fsa, to_fsa

YEAR, AREA, BIN = "_year", "_fsa", "_revBin"
HELPERS = (YEAR, AREA, BIN)

# holds the record's name for the noise while its own columns are being rewritten
_RECORD = "_record"


def apply_rules(
    df: DataFrame,
    rules: Mapping[str, Rule],
    settings: Settings | None = None,
    record: tuple[str, ...] | None = None,
) -> DataFrame:
    """One action per listed column; columns the table lacks are passed over.

    ``record`` names the columns that identify a record to the noise, by default
    all of them: give a key where there is one, so that fewer columns are read.
    """
    noise = Noise.of(settings or Settings(), record or tuple(df.columns))
    present = set(df.columns)
    treated = {
        name: build(rule.action)(field(name), rule, noise, name)
        for name, rule in rules.items()
        if name in present and rule.action != "none"
    }
    return df.withColumns(treated) if treated else df


def hash_id(df: DataFrame, roles: Roles) -> DataFrame:
    """Replace the identifier by its digest."""
    return df.withColumn(roles.id, sha256_hex(field(roles.id))) if roles.id else df


def mask_contacts(df: DataFrame) -> DataFrame:
    """Mask every column whose name tells an e-mail address or a telephone number."""
    names = matching(df.columns, fixed.MASKED_CONTACT)
    return df.withColumns({n: mask_simple(field(n)) for n in names}) if names else df


def _reduce_date(roles: Roles, write: bool) -> dict[str, Column]:
    if not roles.date:
        return {YEAR: F.lit("")}
    year = F.coalesce(only_year(field(roles.date)), F.lit(""))
    return {YEAR: year, roles.date: year} if write else {YEAR: year}


def _reduce_postal(roles: Roles, write: bool) -> dict[str, Column]:
    if not roles.postal:
        return {AREA: F.lit("")}
    area = to_fsa(field(roles.postal))
    helper = {AREA: F.coalesce(area, F.lit(""))}
    return {**helper, roles.postal: area} if write else helper


def noise_revenue(df: DataFrame, roles: Roles, settings: Settings, record: tuple[str, ...]) -> DataFrame:
    """Noise and round the revenue column."""
    if not roles.revenue:
        return df
    noise = Noise.of(settings, record)
    return df.withColumn(roles.revenue, noise.on(field(roles.revenue), "revenue"))


def bin_revenue(df: DataFrame, roles: Roles) -> DataFrame:
    """The income bin of the revenue column as it now stands."""
    if not roles.revenue:
        return df.withColumn(BIN, F.lit(""))
    return df.withColumn(BIN, F.coalesce(bin_income(field(roles.revenue)), F.lit("")))


def reduce_roles(df: DataFrame, roles: Roles, settings: Settings, record: tuple[str, ...]) -> DataFrame:
    """The role switches in their order, then the three grouping helpers."""
    if settings.hash_ids:
        df = hash_id(df, roles)
    if settings.mask_pii:
        df = mask_contacts(df)
    df = df.withColumns({**_reduce_date(roles, settings.year_only), **_reduce_postal(roles, settings.zip3)})
    if settings.noise_revenue:
        df = noise_revenue(df, roles, settings, record)
    return bin_revenue(df, roles)


def treat_rows(
    df: DataFrame, roles: Roles, rules: Mapping[str, Rule] | None = None, settings: Settings | None = None
) -> DataFrame:
    """Rules, then role switches, then helpers: every row as it would be published.

    The noise knows a record by its identifier as it came in, or by the whole row
    where no identifier is mapped.
    """
    settings = settings or Settings()
    rules = dict(rules or {})
    noisy = settings.noise_revenue and roles.revenue or any(r.action == "noise" for r in rules.values())
    if not noisy:
        return reduce_roles(apply_rules(df, rules, settings), roles, settings, ())
    named = (roles.id,) if roles.id else tuple(df.columns)
    parts = [F.coalesce(field(c).cast("string"), F.lit("")) for c in named]
    df = df.withColumn(_RECORD, F.concat_ws("\u001f", *parts))
    record = (_RECORD,)
    return reduce_roles(apply_rules(df, rules, settings, record), roles, settings, record).drop(_RECORD)


def with_helpers(df: DataFrame, roles: Roles) -> DataFrame:
    """Only the helpers a risk preview groups by, on otherwise untouched rows.

    A helper exists only for a mapped role, except the year, which is always there.
    """
    added = _reduce_date(roles, write=False)
    if roles.postal:
        added |= {AREA: F.coalesce(to_fsa(field(roles.postal)), F.lit(""))}
    if roles.revenue:
        added |= {BIN: F.coalesce(bin_income(F.coalesce(field(roles.revenue), F.lit(""))), F.lit(""))}
    return df.withColumns(added)


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*HELPERS)


def fixed_rules(df: DataFrame, salt: str | None = None) -> DataFrame:
    """The fixed treatment of client files, by column name; blank cells are left alone.

    Stateless and free of shuffles, so it serves batches and streams alike.
    """
    fixed_by_name = {
        "id_client": lambda c: hmac12(c, salt),
        "date_naissance": leading_year,
        "code_postal": short_fsa,
        "revenu_annuel": income_band,
    }
    present = [n for n in fixed_by_name if n in df.columns]
    # not a `when`: Spark would compute the parts that a treatment shares once per use
    treated = {n: F.coalesce(fixed_by_name[n](F.nullif(field(n), F.lit(""))), field(n)) for n in present}
    return df.withColumns(treated) if treated else df


def search_columns(catalog: DataFrame, text: str) -> DataFrame:
    """The catalog rows whose column name contains ``text``, in any case."""
    return catalog.filter(F.contains(F.lower("column_name"), F.lit(text.lower())))
