"""Whole jobs: treat, suppress, score; and the ways to start them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from voilage.config import Roles, Rule, Settings
from voilage.operators.classes import class_counts, class_key, class_verdicts, keep_rows, qi_column
from voilage.operators.ordering import in_order_of_appearance
from voilage.operators.policy import choose_rules, guess_roles, recommended_rules
from voilage.operators.policy import catalog_of
from voilage.operators.profiling import profile
from voilage.operators.risk import compliance, evaluate, metrics_before_after
from voilage.operators.rules import drop_helpers, fixed_rules, treat_rows
from voilage.columns import field
from voilage.session import materialize
from voilage.sinks.files import anonymized_name, journal_append, write_csv
from voilage.sources.delimited import read_delimited


@dataclass(frozen=True)
class Anonymized:
    """The published rows, and what is known about the run. All frames are lazy."""

    rows: DataFrame
    counts: DataFrame
    metrics: DataFrame
    verdicts: DataFrame


@dataclass(frozen=True)
class Processed:
    profile: DataFrame
    rules: dict[str, Rule]
    result: Anonymized


def anonymize(
    df: DataFrame,
    roles: Roles,
    rules: Mapping[str, Rule] | None = None,
    settings: Settings | None = None,
    *,
    compat: bool = False,
    journal: str | None = None,
    export: str = "treated",
    order_by: Sequence[str] = (),
    appearance: Sequence[str] = (),
    position: str | None = None,
) -> Anonymized:
    """Treat every row, then drop the classes that fail k, l or t.

    ``export="generalized"`` publishes each quasi-identifier as the value its class was
    judged by (year, postal area, income bin), so that the published rows themselves are
    k-anonymous; ``"treated"`` publishes the treated cells, a noised amount among them.
    ``order_by`` sorts the published rows by columns. ``appearance`` names the columns that tell
    a row's place in the input (for files: name, line); the published classes then stand in the
    order of their first row, the rows of a class in that of the input, and ``position`` adds
    each row's place as a column of that name.

    Two passes over the input: one reads only the grouping and sensitive columns to
    judge the classes, whose verdicts are written to the shared folder; the other
    yields the surviving rows when a caller asks for them. Noise is a function of the
    record, so both passes see the same amounts.
    """
    if export not in ("treated", "generalized"):
        raise ValueError("export is 'treated' or 'generalized'")
    roles.require(df.columns)
    free_names(df.columns)
    settings = settings or Settings()
    rules = without_options(rules or {}) if compat else rules
    placed = df.withColumns({f"_p{i}": field(c) for i, c in enumerate(appearance)}) if appearance else df
    treated = treat_rows(placed, roles, rules, settings)
    keys = class_key(roles, treated.columns, compat=compat)
    keyed = treated.withColumns(keys)
    judged = list(dict.fromkeys([*keys, *([roles.sensitive] if roles.sensitive else [])]))
    verdicts = materialize(
        class_verdicts(
            keyed.select(*[field(c) for c in judged]),
            list(keys),
            roles.sensitive,
            k=settings.k,
            l=settings.l,
            t=settings.t,
            suppress_extras=settings.suppress_extras,
            write_counts=True,
        )
    )
    rows = keep_rows(keyed, verdicts, list(keys))
    if appearance:
        # the place is that of the input, also where a rule treats its columns
        rows = in_order_of_appearance(rows, list(keys), [f"_p{i}" for i in range(len(appearance))], position)
        rows = rows.drop(*[f"_p{i}" for i in range(len(appearance))])
    rows = rows.drop(*keys)
    if export == "generalized":
        rows = rows.withColumns({q: qi_column(q, roles, rows.columns) for q in roles.qids})
    rows = drop_helpers(rows)
    if order_by:
        rows = rows.orderBy(*[field(c) for c in order_by])
    counts = class_counts(verdicts)
    done = Anonymized(rows, counts, evaluate(rows, roles.qids, roles.sensitive, settings.k), verdicts)
    if journal:
        _note(df.sparkSession, journal, done, settings)
    return done


def _note(spark: SparkSession, journal: str, done: Anonymized, settings: Settings) -> None:
    counted = done.counts.first()
    facts = {"kept": counted["kept"], "total": counted["total"], "k": settings.k, "l": settings.l, "t": settings.t}
    journal_append(spark, journal, "anonymize", facts)


RESERVED = ("_year", "_fsa", "_revBin", "_record", "_qk", "_s", "_c", "_heavy", "_light", "_slot", "_n", "_kept")


def free_names(columns: Sequence[str]) -> None:
    """Refuse columns whose names the job gives to its own."""
    taken = [c for c in columns if c in RESERVED or re.fullmatch(r"_[qp]\d+", c)]
    if taken:
        raise ValueError(f"rename these columns, the job uses their names: {taken}")


def without_options(rules: Mapping[str, Rule]) -> dict[str, Rule]:
    """Rules as the original reads them: granularity, a rule's own epsilon and rounding do nothing."""
    unread = ("granularity", "epsilon", "round")
    return {
        c: Rule(r.action, {k: v for k, v in r.param.items() if k not in unread} or None) if r.param else r
        for c, r in rules.items()
    }


def auto_anonymize(
    df: DataFrame, roles: Roles | None = None, settings: Settings | None = None, *, compat: bool = False,
    journal: str | None = None,
) -> Anonymized:
    """Recommended rules by column name, then :func:`anonymize`. A table without rows is refused."""
    rules = recommended_rules(df.columns, compat=compat)
    done = anonymize(df, roles or guess_roles(df.columns), rules, settings, compat=compat)
    if done.verdicts.isEmpty():  # they are written: no second look at the table
        raise ValueError("the table has no row")
    if journal:
        _note(df.sparkSession, journal, done, settings or Settings())
    return done


def profile_and_anonymize(
    df: DataFrame, roles: Roles | None = None, settings: Settings | None = None, *, compat: bool = False,
    journal: str | None = None,
) -> Processed:
    """Profile, recommended rules, :func:`anonymize`."""
    result = auto_anonymize(df, roles, settings, compat=compat, journal=journal)
    return Processed(profile(df), recommended_rules(df.columns, compat=compat), result)


def chosen_rules(df: DataFrame, roles: Roles | None = None) -> dict[str, Rule]:
    """The rule per column that the risk of the previewed table calls for."""
    roles = roles or guess_roles(df.columns)
    after = metrics_before_after(df, roles).filter("stage = 'after'")
    catalog = catalog_of(df.sparkSession, {"table": df.columns})
    rules = {}
    for row in choose_rules(catalog, after).select("column_name", "rule").collect():  # one row per column
        rule = row["rule"]
        param = {k: rule[k] for k in ("granularity", "epsilon", "round") if rule[k] is not None}
        rules[row["column_name"]] = Rule(rule["action"], param or None)
    return rules


def risk_report(df: DataFrame, roles: Roles, *, compat: bool = False) -> DataFrame:
    """(criterion, before, after, threshold, verdict, reduction)."""
    return compliance(metrics_before_after(df, roles, compat=compat))


def fixed_file_job(
    spark: SparkSession, source: str, target: str | None = None, *, salt: str | None = None, bom: bool = True,
    sniff: str = "head", multiline: bool = True,
) -> str:
    """Apply the fixed client rules to delimited files; returns where the result is.

    Line ends inside quotes are kept, for which large files are read twice;
    ``multiline=False`` reads once files that have none.
    """
    target = target or anonymized_name(source)
    rows = read_delimited(spark, source, sniff=sniff, multiline=multiline)
    write_csv(fixed_rules(rows, salt), target, bom=bom, allow_empty=True)
    return target
