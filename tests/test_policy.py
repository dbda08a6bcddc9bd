"""What is concluded from column names."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from voilage import (
    Roles, Rule, Settings, allowed_actions, choose_rules, classify, data_dictionary, default_rules, fill_rules,
    guess_mapping, guess_roles, policy_target, preset, recommend, recommended_rules, risk_reduction, table_scores,
)
from voilage.operators.policy import catalog_of, risk_target

CLIENT = [
    "id_client", "prenom", "nom", "email", "telephone", "adresse", "ville", "province", "code_postal",
    "date_naissance", "revenu_annuel",
]
ACCOUNT = ["No-Client", "date", "DATE_OPERATION", "date_maj", "Solde", "TYPE_COMPTE", "statut", "ZIP", "courriel", "téléphone"]


@pytest.fixture(scope="module")
def catalog(spark):
    return catalog_of(spark, {"client": CLIENT, "account": ACCOUNT, "nothing": ["x", "y"]})


def by_name(df, *columns):
    return {r["column_name"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_roles(catalog):
    rows = {r["table_name"]: r for r in guess_mapping(catalog).collect()}
    client = rows["client"]
    assert (client["id"], client["postal"], client["date1"], client["date2"], client["revenue"], client["sensitive"]) == (
        "id_client", "code_postal", "date_naissance", None, "revenu_annuel", None,
    )
    assert client["qids"] == ["date_naissance", "code_postal", "revenu_annuel"]
    account = rows["account"]
    # the first column that fits any of the patterns, in table order
    assert account["date1"] == "date" and account["date2"] == "DATE_OPERATION" and account["sensitive"] == "TYPE_COMPTE"
    assert account["id"] == "No-Client" and account["qids"] == ["date", "ZIP", "Solde"]
    assert rows["nothing"]["qids"] == [] and rows["nothing"]["id"] is None


def test_roles_of_one_table_agree_with_the_catalog(catalog):
    for r in guess_mapping(catalog).collect():
        columns = {"client": CLIENT, "account": ACCOUNT, "nothing": ["x", "y"]}[r["table_name"]]
        fields = {k: r[k] for k in ("id", "postal", "date1", "date2", "revenue", "sensitive", "qids")}
        assert guess_roles(columns) == Roles(**fields)


def test_classification(catalog):
    got = by_name(classify(catalog), "type", "cat", "pii", "risk", "bucket")
    personal = "Renseignements personnels"
    assert got["id_client"] == ("Identifiant", personal, True, 92, "Élevé")
    assert got["email"] == ("Identifiant", personal, True, 88, "Élevé")
    assert got["date_naissance"] == ("Date", personal, True, 78, "Élevé")
    assert got["code_postal"] == ("Géoloc", personal, True, 61, "Moyen")
    assert got["ville"] == ("Géoloc", personal, True, 20, "Faible")
    assert got["revenu_annuel"] == ("Numérique", "Finance", False, 69, "Moyen")
    assert got["province"] == ("Texte", personal, False, 20, "Faible")
    assert got["prenom"] == ("Texte", personal, True, 20, "Faible")


def test_actions(catalog):
    got = by_name(allowed_actions(catalog), "actions")
    assert got["email"] == ["none", "pseudonymize", "mask", "suppress"]
    assert got["Solde"] == ["none", "generalize", "noise", "suppress"]
    assert got["date"] == ["none", "generalize", "suppress"]
    assert got["province"] == ["none", "mask", "suppress"]


def test_text_column_about_money_may_be_binned(spark):
    got = allowed_actions(catalog_of(spark, {"t": ["iban", "carte_credit", "date_solde"]}))
    assert by_name(got, "actions") == {
        "iban": ["none", "generalize", "noise", "mask", "suppress"],
        "carte_credit": ["none", "generalize", "noise", "mask", "suppress"],
        "date_solde": ["none", "generalize", "noise", "suppress"],
    }


def test_default_rules(catalog):
    got = by_name(default_rules(catalog).select("column_name", "rule.action", "rule.granularity"), "action", "granularity")
    assert got["id_client"] == ("pseudonymize", None) and got["Solde"] == ("generalize", "bin")
    assert got["date"] == ("generalize", "year") and got["ville"] == ("generalize", "postal_fsa")
    assert got["nom"] == ("none", None)
    for name, rule in fill_rules(CLIENT + ACCOUNT).items():
        assert (rule.action, (rule.param or {}).get("granularity")) == got[name]
    assert fill_rules(["nom"], {"nom": Rule("mask")}) == {"nom": Rule("mask")}


@pytest.mark.parametrize(
    "scores, expected",
    [
        ((70.0, 0.0, 0.0), {"nom": "pseudonymize", "date": "pseudonymize", "Solde": "pseudonymize"}),
        ((69.9, 60.0, 0.0), {"nom": "none", "date": "generalize", "ville": "generalize", "Solde": "generalize"}),
        ((0.0, 0.0, 60.0), {"nom": "none", "date": "generalize", "Solde": "noise", "email": "pseudonymize"}),
        ((None, None, None), {"nom": "none", "date": "generalize", "Solde": "generalize"}),
    ],
)
def test_rules_by_risk(spark, catalog, scores, expected):
    metrics = spark.createDataFrame([scores], "individualization double, correlation double, inference double")
    chosen = choose_rules(catalog, metrics)
    got = by_name(chosen.select("column_name", "rule.action"), "action")
    assert {k: got[k] for k in expected} == expected
    if scores[2] == 60.0:
        rule = chosen.filter("column_name = 'Solde'").first()["rule"]
        assert (rule["epsilon"], rule["round"]) == (2.0, 10)


def test_recommendations(catalog):
    got = by_name(recommend(catalog), "action", "param_type")
    assert got["email"] == ("mask", None) and got["téléphone"] == ("mask", None)
    assert got["date_naissance"] == ("generalize", "date-year") and got["ZIP"] == ("generalize", "postal-fsa")
    assert got["revenu_annuel"] == ("noise", None) and got["Solde"] == ("none", None)
    assert got["prenom"] == ("mask", None) and got["id_client"] == ("none", None)
    for name, rule in recommended_rules(CLIENT + ACCOUNT).items():
        assert rule.action == got[name][0] and (rule.param or {}).get("type") == got[name][1]
    assert recommended_rules(["date"], compat=True)["date"] == Rule("generalize")


def test_risk_reduction(catalog):
    got = by_name(risk_reduction(catalog), "risk", "reduction", "risk_after")
    assert got["id_client"] == (92, 40, 52) and got["date"] == (78, 20, 58)
    assert got["code_postal"] == (61, 15, 46) and got["revenu_annuel"] == (69, 10, 59)
    assert got["courriel"] == (88, 0, 88)
    off = Settings(hash_ids=False, year_only=False, zip3=False, epsilon=6)
    assert set(by_name(risk_reduction(catalog, off), "reduction").values()) == {0}
    assert by_name(risk_reduction(catalog, Settings(epsilon=5)), "reduction")["Solde"] == 5


def test_table_scores(catalog):
    rows = {r["table_name"]: (r["before"], r["after"], r["target"]) for r in table_scores(catalog).collect()}
    assert rows["nothing"] == (20, 20, 35)
    risks = [92, 20, 20, 88, 88, 20, 20, 20, 61, 78, 69]
    cuts = [40, 0, 0, 40, 40, 0, 0, 0, 15, 20, 10]
    mean, after = sum(risks) / 11, sum(r - c for r, c in zip(risks, cuts)) / 11
    assert rows["client"][:2] == (int(mean + 0.5), int(after + 0.5))


def test_target(spark):
    one = spark.range(1)
    assert one.select(policy_target(Settings())).first()[0] == 35
    cases = {(10, 2): 35, (50, 0): 15, (2, 10): 55, (5, 8): 55, (6, 7.5): 53}
    for (k, epsilon), target in cases.items():
        assert one.select(risk_target(F.lit(k), F.lit(epsilon))).first()[0] == target


def test_dictionary_and_preset(catalog):
    row = data_dictionary(catalog).filter("column_name = 'email'").first()
    assert row["rule"]["action"] == "pseudonymize" and row["bucket"] == "Élevé" and "mask" in row["actions"]
    assert preset() == Settings()
    assert (Settings(k_anon=0).k, Settings(k_anon=1).k, Settings(l_div=0).l, Settings(t_close=-1).t) == (2, 2, 1, 0)
    assert Settings(epsilon=None).noise_epsilon == 2
    with pytest.raises(ValueError, match="epsilon"):
        Settings(epsilon=0).noise_epsilon


def test_plain_searches_find_what_the_patterns_find(spark):
    """Every pattern of column names, on names that hold its words, pieces of them, and other ends."""
    import itertools
    import random

    from voilage import fixed_values as fixed
    from voilage.columns import _searches, occurs
    from voilage.workload.settings import WORD_BREAK, WORD_BREAK_LISTED

    rules = (*fixed.TYPE_RULES, *fixed.CATEGORY_RULES, *fixed.RISK_RULES, *fixed.RECOMMENDATION_RULES)
    patterns = sorted({*fixed.ROLE_PATTERNS.values(), *(r[0] for r in rules), fixed.PERSONAL, fixed.DIRECT_PII, fixed.MASKED_CONTACT,
                       fixed.REDUCTION_IDS[0], fixed.REDUCTION_POSTAL[0], fixed.REDUCTION_MONEY, "^id$", "a.c|x+", "b[^a]"})
    draw = random.Random(3)
    pieces = sorted({w for p in patterns for w in re.findall("[a-zé]+", p)}) + ["_", "-", " ", "", "é", "x", "\n", "id", "date"]
    names = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 4))) for _ in range(3000)]
    names += [n[: draw.randint(0, len(n))] for n in names[:1000]] + [None]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(1)
    for some in itertools.batched(patterns, 8):
        wrong = [F.count_if(~occurs(F.col("n"), p).eqNullSafe(F.col("n").rlike(p))) for p in some]
        assert tuple(df.agg(*wrong).first()) == (0,) * len(some)
    assert _searches("code[_-]?postal|postal|zip") == (("postal", "zip"), ()) and _searches("date.*(a|b)")[1] == ((("date",), "date.*(a|b)"),)
    text = "".join(chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11000)))
    broken = spark.createDataFrame([(text,)], "t string").select(F.split("t", WORD_BREAK).alias("a"), F.split("t", WORD_BREAK_LISTED).alias("b")).first()
    assert broken["a"] == broken["b"] and len(broken["a"]) == 6


def test_folded_catalogs_give_what_rows_give(spark):
    """Tables as one list of names: roles and whole definitions; a table in several rows too."""
    from voilage.operators import policy
    from voilage.sinks.files import table_definitions

    parts = [("c", CLIENT), ("a", [*ACCOUNT, "Solde", "email"]), ("e", ["x", "y"]), ("c", ["Date", "id", "nom"]), ("z", None)]
    folded = spark.createDataFrame(parts, "table_name string, columns array<string>")
    rows = folded.select("table_name", F.posexplode("columns").alias("ordinal", "column_name"))
    alone, alone_rows = folded.where("table_name <> 'c'"), rows.where("table_name <> 'c'")

    def sorted_rows(df):
        return sorted(map(str, df.collect()))

    assert sorted_rows(guess_mapping(alone)) == sorted_rows(guess_mapping(alone_rows))
    for some, each in ((alone, alone_rows), (spark.createDataFrame(parts[:1] * 2, folded.schema), catalog_of(spark, {"c": CLIENT}))):
        got = table_definitions(policy.described(policy.whole_tables(some)), Settings(), ";")
        want = table_definitions(guess_mapping(each), Settings(), ";", recommend(each))
        assert got.columns == want.columns and sorted_rows(got) == sorted_rows(want)
