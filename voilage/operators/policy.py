"""Policy over a column catalog: roles, classification, risk, recommended rules.

A catalog is a DataFrame (table_name, column_name, ordinal), so one job covers the
columns of any number of tables. The same rule tables also answer for one list of
names on the driver, which is how a job plans the treatment of its own columns. Where a
table's names come as one list (table_name, columns), they need not be taken apart.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voilage import fixed_values as fixed
from voilage.columns import first_match, matching, occurs, round_half_up
from voilage.config import Roles, Rule, Settings
from voilage.session import materialize

QID_ROLES = ("date1", "postal", "revenue")


def catalog_of(spark: SparkSession, tables: dict[str, Sequence[str]]) -> DataFrame:
    """The catalog of the given tables' column names."""
    rows = [(t, c, i) for t, columns in tables.items() for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int")


def _lower() -> Column:
    return F.lower("column_name")


# --- roles -------------------------------------------------------------------


def guess_mapping(catalog: DataFrame) -> DataFrame:
    """(table_name, id, postal, date1, date2, revenue, sensitive, qids): one row per table.

    For each role the first column, in table order, whose name fits. One pass: the smallest
    (place, name) of each role is folded on the map side, and names that play no role carry none.
    A catalog of one row a table, (table_name, columns), is looked through row by row: no name is
    sorted or shuffled but the roles'.
    """
    if "columns" in catalog.columns:
        firsts = _first_fits(catalog)
    else:
        name, placed = _lower(), F.struct("ordinal", "column_name")
        firsts = catalog.select("table_name", *[F.when(occurs(name, p), placed).alias(r) for r, p in fixed.ROLE_PATTERNS.items()])
    found = firsts.groupBy("table_name").agg(*[F.min(r).getField("column_name").alias(r) for r in fixed.ROLE_PATTERNS])
    return found.withColumn("qids", _qids())


def _qids() -> Column:
    return F.array_compact(F.array(*[F.col(r) for r in QID_ROLES]))


def _first_fits(tables: DataFrame) -> DataFrame:
    """``tables`` with, for each role, the first (ordinal, column_name) of ``columns`` that fits, or NULL."""
    lowered = tables.where("columns is not null").withColumn("_lower", F.transform("columns", F.lower))
    places = {f"_{r}": F.array_position(F.transform("_lower", functools.partial(_fits, p)), True) for r, p in fixed.ROLE_PATTERNS.items()}

    def placed(place: Column) -> Column:
        at = (place - 1).cast("int")
        return F.when(place > 0, F.struct(at.alias("ordinal"), F.get("columns", at).alias("column_name")))

    found = lowered.withColumns(places).withColumns({r: placed(F.col(f"_{r}")) for r in fixed.ROLE_PATTERNS})
    return found.drop("_lower", *places)


def _fits(pattern: str, name: Column) -> Column:
    return occurs(name, pattern)


def whole_tables(tables: DataFrame) -> DataFrame:
    """(table_name, columns) with one row a table and each name once, where it stands first.

    Where each table is one row already, only the tables' names are shuffled, to see that. Rows of one
    table are laid over one another by place; tables without a name are left out.
    """
    given = tables.where("table_name is not null and columns is not null").select("table_name", "columns")
    once = given.withColumn("columns", F.array_distinct("columns"))
    several = materialize(given.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table_name"))
    if several.isEmpty():
        return once
    names = given.join(several, "table_name", "left_semi").select("table_name", F.posexplode("columns").alias("ordinal", "column_name"))
    first = names.groupBy("table_name", "column_name").agg(F.min("ordinal").alias("ordinal"))
    folded = first.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("found"))
    laid = folded.select("table_name", F.transform("found", lambda c: c["column_name"]).alias("columns"))
    return once.join(several, "table_name", "left_anti").unionByName(laid)


def described(tables: DataFrame) -> DataFrame:
    """Whole tables with their guessed roles, ``qids``, and ``rules``: name and simple rule of each column that has one."""
    roles = _first_fits(tables).withColumns({r: F.col(f"{r}.column_name") for r in fixed.ROLE_PATTERNS})

    def ruled(c: Column) -> Column:
        action, kind = _recommended(F.lower(c))
        return F.struct(c.alias("column_name"), action.alias("action"), kind.alias("param_type"))

    rules = roles.withColumn("rules", F.transform("columns", ruled))
    return rules.withColumns({"qids": _qids(), "rules": F.filter("rules", lambda c: c["action"] != "none")})


def guess_roles(columns: Sequence[str]) -> Roles:
    """The roles of one table's columns."""
    first = {role: next(iter(matching(columns, p)), None) for role, p in fixed.ROLE_PATTERNS.items()}
    return Roles(**first, qids=tuple(first[r] for r in QID_ROLES if first[r]))


# --- classification ----------------------------------------------------------


def column_type(name: Column) -> Column:
    return first_match(name, fixed.TYPE_RULES, fixed.TYPE_DEFAULT)


def column_category(name: Column) -> Column:
    return first_match(name, fixed.CATEGORY_RULES, fixed.CATEGORY_DEFAULT)


def column_risk(name: Column) -> Column:
    return first_match(name, fixed.RISK_RULES, fixed.RISK_DEFAULT)


def risk_bucket(score: Column) -> Column:
    bucket = F.lit(fixed.RISK_BUCKET_DEFAULT)
    for limit, label in reversed(fixed.RISK_BUCKETS):
        bucket = F.when(score >= limit, F.lit(label)).otherwise(bucket)
    return bucket


def classify(catalog: DataFrame) -> DataFrame:
    """Adds type, cat, pii, risk and bucket."""
    name = _lower()
    return catalog.withColumns(
        {
            "type": column_type(name),
            "cat": column_category(name),
            "pii": occurs(name, fixed.PERSONAL),
            "risk": column_risk(name),
        }
    ).withColumn("bucket", risk_bucket(F.col("risk")))


def _is_money() -> Column:
    return (F.col("type") == "Numérique") | (F.col("cat") == "Finance")


def allowed_actions(catalog: DataFrame) -> DataFrame:
    """Adds ``actions``: what may be chosen for the column, in menu order."""
    kind = F.col("type")

    def offered(test: Column, *actions: str) -> Column:
        return F.when(test, F.array(*[F.lit(a) for a in actions])).otherwise(F.array().cast("array<string>"))

    menu = F.concat(
        F.array(F.lit("none")),
        offered(kind == "Identifiant", "pseudonymize", "mask"),
        offered(_is_money(), "generalize", "noise"),
        offered(kind.isin("Date", "Géoloc"), "generalize"),
        offered(kind == "Texte", "mask"),
        F.array(F.lit("suppress")),
    )
    return classify(catalog).withColumn("actions", F.array_distinct(menu))


# --- recommended rules -------------------------------------------------------

_RULE = "struct<action:string,granularity:string,epsilon:double,round:int>"


def _rule(action: str, granularity: str | None = None, epsilon: float | None = None, rounding: int | None = None) -> Column:
    return F.struct(
        F.lit(action).alias("action"),
        F.lit(granularity).cast("string").alias("granularity"),
        F.lit(epsilon).cast("double").alias("epsilon"),
        F.lit(rounding).cast("int").alias("round"),
    ).cast(_RULE)


def _default_rule() -> Column:
    return (
        F.when(F.col("type") == "Identifiant", _rule("pseudonymize"))
        .when(_is_money(), _rule("generalize", "bin"))
        .when(F.col("type") == "Date", _rule("generalize", "year"))
        .when(F.col("type") == "Géoloc", _rule("generalize", "postal_fsa"))
        .otherwise(_rule("none"))
    )


def default_rules(catalog: DataFrame) -> DataFrame:
    """Classification plus ``rule``: the default by type."""
    return classify(catalog).withColumn("rule", _default_rule())


def choose_rules(catalog: DataFrame, metrics: DataFrame) -> DataFrame:
    """Classification plus ``rule``: the default, hardened by a one-row metrics frame.

    The metrics enter as a scalar subquery, so they never leave the cluster.
    """
    scores = metrics.select(F.struct("individualization", "correlation", "inference")).scalar()
    alone, linked, told = (
        F.coalesce(scores.getField(n), F.lit(0.0)) for n in ("individualization", "correlation", "inference")
    )
    kind = F.col("type")
    rule = (
        F.when((kind == "Identifiant") | (alone >= 70), _rule("pseudonymize"))
        .when((linked >= 60) & (kind == "Date"), _rule("generalize", "year"))
        .when((linked >= 60) & (kind == "Géoloc"), _rule("generalize", "postal_fsa"))
        .when((told >= 60) & _is_money(), _rule("noise", epsilon=2, rounding=10))
        .otherwise(_default_rule())
    )
    return classify(catalog).withColumn("rule", rule)


def fill_rules(columns: Sequence[str], rules: dict[str, Rule] | None = None) -> dict[str, Rule]:
    """Default rules for one table's columns that have none yet."""
    rules = dict(rules or {})
    for name in columns:
        rules.setdefault(name, _default_for(name))
    return rules


def _default_for(name: str) -> Rule:
    kind = _first(name, fixed.TYPE_RULES, fixed.TYPE_DEFAULT)
    if kind == "Identifiant":
        return Rule("pseudonymize")
    if kind == "Numérique" or _first(name, fixed.CATEGORY_RULES, fixed.CATEGORY_DEFAULT) == "Finance":
        return Rule("generalize", {"granularity": "bin"})
    grain = {"Date": "year", "Géoloc": "postal_fsa"}.get(kind)
    return Rule("generalize", {"granularity": grain}) if grain else Rule()


def _first(name: str, rules: Sequence[tuple], default: object) -> object:
    return next((r[1] for r in rules if re.search(r[0], name.lower())), default)


def recommend(catalog: DataFrame) -> DataFrame:
    """Adds ``action`` and ``param_type``: the simple rule for the name alone."""
    action, kind = _recommended(_lower())
    return catalog.withColumns({"action": action, "param_type": kind})


def _recommended(name: Column) -> tuple[Column, Column]:
    """The simple rule for a lower-cased name: its action, and what it generalizes to."""
    actions = [(pattern, action) for pattern, action, _ in fixed.RECOMMENDATION_RULES]
    chosen = F.lit(None).cast("string")
    for pattern, _, kind in reversed(fixed.RECOMMENDATION_RULES):
        chosen = F.when(occurs(name, pattern), F.lit(kind).cast("string")).otherwise(chosen)
    return first_match(name, actions, "none"), chosen


def recommended_rules(columns: Sequence[str], *, compat: bool = False) -> dict[str, Rule]:
    """The simple rules for one table's columns.

    ``compat=True`` leaves out what the rules generalize to, so that generalize rules
    change nothing by themselves and only the role switches act.
    """
    rules = {}
    for name in columns:
        hit = next((r for r in fixed.RECOMMENDATION_RULES if re.search(r[0], name.lower())), (None, "none", None))
        param = {"type": hit[2]} if hit[2] else {"beta": fixed.RECOMMENDED_NOISE_BETA} if hit[1] == "noise" else None
        rules[name] = Rule(hit[1], None if compat else param)
    return rules


# --- risk scores -------------------------------------------------------------


def column_reduction(name: Column, settings: Settings) -> Column:
    """Risk points that the switched-on treatments take off a column."""
    points = F.lit(0)
    for switch, (pattern, gain) in (
        (settings.hash_ids, fixed.REDUCTION_IDS),
        (settings.year_only, fixed.REDUCTION_DATES),
        (settings.zip3, fixed.REDUCTION_POSTAL),
    ):
        if switch:
            points = points + F.when(occurs(name, pattern), F.lit(gain)).otherwise(F.lit(0))
    gain = next((g for limit, g in fixed.REDUCTION_MONEY_BY_EPSILON if settings.epsilon <= limit), 0)
    points = points + F.when(occurs(name, fixed.REDUCTION_MONEY), F.lit(gain)).otherwise(F.lit(0))
    return F.least(F.lit(fixed.REDUCTION_MAX), points)


def risk_reduction(catalog: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Adds ``risk``, ``reduction`` and ``risk_after`` per column."""
    name = _lower()
    return catalog.withColumns(
        {"risk": column_risk(name), "reduction": column_reduction(name, settings or Settings())}
    ).withColumn("risk_after", F.greatest(F.lit(0), F.col("risk") - F.col("reduction")))


def risk_target(k_anon: Column, epsilon: Column) -> Column:
    """The score a table should reach for a given k and privacy budget."""
    by_k = F.least(F.lit(25.0), F.greatest(F.lit(0.0), k_anon.cast("double") - 5.0))
    by_epsilon = F.least(F.lit(20.0), F.greatest(F.lit(0.0), 8.0 - epsilon.cast("double")) * 2.5)
    return F.greatest(F.lit(15).cast("bigint"), round_half_up(55.0 - by_k - by_epsilon))


def policy_target(settings: Settings) -> Column:
    return risk_target(F.lit(settings.k_anon), F.lit(settings.epsilon))


def table_scores(catalog: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(table_name, before, after, target): mean column risks, rounded, per table."""
    settings = settings or Settings()
    return risk_reduction(catalog, settings).groupBy("table_name").agg(
        round_half_up(F.avg("risk")).alias("before"),
        round_half_up(F.avg("risk_after")).alias("after"),
        policy_target(settings).alias("target"),
    )


def data_dictionary(catalog: DataFrame) -> DataFrame:
    """Classification, risk bucket, recommended rule and allowed actions per column."""
    return allowed_actions(catalog).withColumn("rule", _default_rule())
