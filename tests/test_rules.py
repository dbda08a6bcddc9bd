"""Row treatments: rules, role switches, helpers, the fixed file rules."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from voilage import Roles, Rule, Settings, apply_rules, fixed_rules, search_columns, treat_rows, with_helpers
from voilage.functions import register_action
from voilage.functions.actions import ACTIONS
from voilage.plans.jobs import without_options

ROLES = Roles(id="id", postal="cp", date1="date", revenue="revenu", sensitive="statut", qids=("date", "cp", "revenu"))
SCHEMA = "id string, courriel string, cp string, date string, revenu string, statut string"
QUIET = Settings(noise_revenue=False)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("1", "client@example.com", "g7h 4b2", "1998-11-02", "73,450$", "a"),
            ("", "", "", "", "", ""),
            (None, None, None, None, None, None),
        ],
        SCHEMA,
    ).repartition(1)


def by_status(df):
    return {r["statut"]: r.asDict() for r in df.collect()}


def test_switches_on_present_empty_and_absent_cells(people):
    rows = by_status(treat_rows(people, ROLES, None, QUIET))
    assert rows["a"] == {
        "id": sha("1"), "courriel": "cl***@example.com", "cp": "G7H***", "date": "1998", "revenu": "73,450$",
        "statut": "a", "_year": "1998", "_fsa": "G7H***", "_revBin": "70–80k",
    }
    assert rows[""] == {
        "id": sha(""), "courriel": "", "cp": "", "date": "", "revenu": "", "statut": "",
        "_year": "", "_fsa": "", "_revBin": "0–10k",
    }
    # the year switch writes into an absent date, nothing else appears
    assert rows[None] == {
        "id": None, "courriel": None, "cp": None, "date": "", "revenu": None, "statut": None,
        "_year": "", "_fsa": "", "_revBin": "",
    }


def test_switches_off(people):
    off = Settings(zip3=False, year_only=False, hash_ids=False, mask_pii=False, noise_revenue=False)
    rows = by_status(treat_rows(people, ROLES, None, off))
    assert rows["a"]["cp"] == "g7h 4b2" and rows["a"]["_fsa"] == "G7H***" and rows["a"]["date"] == "1998-11-02"
    assert rows["a"]["id"] == "1" and rows["a"]["courriel"] == "client@example.com"


def test_bin_follows_the_noised_amount(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("50000").alias("revenu"))
    roles = Roles(id="id", revenue="revenu", qids=("revenu",))
    rows = treat_rows(df, roles, None, Settings(noise_seed="s")).collect()
    assert {r["_revBin"] for r in rows} == {"40–50k", "50–60k"}
    for r in rows:
        low = int(r["revenu"]) // 10000 * 10
        assert r["_revBin"] == f"{low}–{low + 10}k"


def test_noise_is_repeatable_and_keyed(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("50000").alias("revenu"))
    roles = Roles(id="id", revenue="revenu", qids=("revenu",))

    def noised(frame, settings):
        return {r["id"]: r["revenu"] for r in treat_rows(frame, roles, None, settings).collect()}

    fixed = Settings(noise_seed="s", hash_ids=False)
    assert noised(df, fixed) == noised(df.repartition(7), fixed)
    assert noised(df, fixed) != noised(df, Settings(noise_seed="other", hash_ids=False))
    assert noised(df, Settings(hash_ids=False)) != noised(df, Settings(hash_ids=False))
    assert len(set(noised(df, fixed).values())) > 200


def test_every_action(people):
    rules = {
        "id": Rule("pseudonymize"), "courriel": Rule("mask"), "cp": Rule("generalize", {"type": "postal-fsa"}),
        "date": Rule("generalize", {"type": "date-year"}), "revenu": Rule("suppress"), "statut": Rule("unheard-of"),
        "nowhere": Rule("suppress"),
    }
    rows = {r["id"]: list(r)[1:] for r in apply_rules(people, rules).collect()}
    assert rows[sha("1")] == ["cl***@example.com", "G7H", "1998", "", "a"]
    assert rows[sha("")] == ["", "", "", "", ""]
    assert rows[None] == [None] * 5


def test_rule_options_act(people):
    rows = apply_rules(people, {"date": Rule("generalize", {"granularity": "year"}), "id": Rule("pseudonymize", {"salt": "s"})}).collect()
    assert [r["date"] for r in rows] == ["1998", "", None]
    assert rows[0]["id"] == hmac.new(b"s", b"1", "sha256").hexdigest()[:12]
    with pytest.raises(ValueError, match="epsilon"):
        apply_rules(people, {"revenu": Rule("noise", {"epsilon": 0})})
    plain = without_options({"date": Rule("generalize", {"granularity": "year"}), "x": Rule("noise", {"epsilon": 1, "round": 10})})
    assert plain == {"date": Rule("generalize"), "x": Rule("noise")}


def test_generalize_without_known_type_changes_nothing(people):
    for param in (None, {"granularity": "week"}, {"type": "income-bin"}):
        rows = apply_rules(people, {"date": Rule("generalize", param)}).collect()
        assert [r["date"] for r in rows] == ["1998-11-02", "", None]


def test_own_action(people):
    register_action("reverse", lambda c, rule, noise, name: F.reverse(c))
    try:
        assert apply_rules(people, {"statut": Rule("reverse"), "cp": Rule("reverse")}).first()["cp"] == "2b4 h7g"
    finally:
        del ACTIONS["reverse"]


def test_rules_and_switches_compose(people):
    rows = by_status(treat_rows(people, ROLES, {"id": Rule("pseudonymize")}, QUIET))
    assert rows["a"]["id"] == sha(sha("1"))


def test_only_one_date_column_is_reduced(spark):
    df = spark.createDataFrame([("1990-01-01", "2020-02-02")], "d1 string, d2 string")
    both = Roles(date1="d1", date2="d2", qids=("d1", "d2"))
    assert list(treat_rows(df, both, None, QUIET).select("d1", "d2", "_year").first()) == ["1990", "2020-02-02", "1990"]
    second = Roles(date2="d2", qids=("d2",))
    assert list(treat_rows(df, second, None, QUIET).select("d1", "d2", "_year").first()) == ["1990-01-01", "2020", "2020"]


def test_risk_helpers_leave_rows_alone(people):
    rows = by_status(with_helpers(people, ROLES))
    assert rows["a"]["date"] == "1998-11-02" and rows["a"]["_year"] == "1998"
    assert (rows[None]["_year"], rows[None]["_fsa"], rows[None]["_revBin"]) == ("", "", "0–10k")
    assert with_helpers(people, Roles(qids=("cp",))).columns == [*people.columns, "_year"]


def test_fixed_rules(spark):
    df = spark.createDataFrame(
        [("123", "1990-04-12", "G7H4B2", "73450", "x"), ("", "", "", "", ""), (None, None, None, None, None),
         ("456", "1985-10-01", "H2X1A1", "52000", "y")],
        "id_client string, date_naissance string, code_postal string, revenu_annuel string, autre string",
    )
    rows = [list(r) for r in fixed_rules(df, "change-me-salt").collect()]
    assert rows[0] == ["884fa0900172", "1990", "G7H***", "60-80k", "x"]
    assert rows[1] == [""] * 5 and rows[2] == [None] * 5
    assert rows[3] == ["94c1ddcbb8e3", "1985", "H2X***", "40-60k", "y"]
    assert fixed_rules(df.select("autre")).columns == ["autre"]


def test_interface_example(spark):
    df = spark.createDataFrame(
        [("879-22-0194", "client@example.com", "418-555-0199", "G7H4B2", "1998-11-02", "73,450$")],
        "id string, email string, `téléphone` string, code_postal string, date string, revenu string",
    )
    roles = Roles(id="id", postal="code_postal", date1="date", revenue="revenu", qids=("date",))
    row = treat_rows(df, roles, None, QUIET).first()
    assert list(row)[1:6] == ["cl***@example.com", "41****99", "G7H***", "1998", "73,450$"]
    assert row["_revBin"] == "70–80k" and row["id"] == sha("879-22-0194")


def test_roles_are_checked(people):
    with pytest.raises(ValueError):
        Roles().require(people.columns)
    with pytest.raises(ValueError, match="nowhere"):
        Roles(id="nowhere", qids=("cp",)).require(people.columns)


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a@b", "x")], "`e.mail email` string, `b``q` string")
    assert apply_rules(df, {"e.mail email": Rule("mask"), "b`q": Rule("suppress")}).first()[:] == ("a***@b", "")


def test_column_search(spark):
    df = spark.createDataFrame([("Code_Postal",), ("nom",)], "column_name string")
    assert [r[0] for r in search_columns(df, "POST").collect()] == ["Code_Postal"]
