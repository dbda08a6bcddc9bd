"""Scores against straight Python, and the verdicts drawn from them."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from voilage import Roles, compliance, evaluate, profile, risk_metrics, risk_report, row_audit
from voilage.operators.risk import direct_pii_columns

ROLES = Roles(sensitive="s", qids=("a", "b"))


def make_rows(n=800):
    rng = random.Random(3)
    return [
        (rng.choice(["", "  ", " ", "x", None]), rng.choice([None, "", "a1", "a2", f"a{i}"]), str(i % 3),
         rng.choice(["u", "u", "v", "w", None]))
        for i in range(n)
    ]


def expected(rows):
    blank = "\t\n\x0b\x0c\r  ﻿"
    pii = sum(1 for r in rows if r[0] is not None and r[0].strip(blank)) / len(rows)
    groups = defaultdict(Counter)
    for r in rows:
        groups[r[1] or "", r[2]][r[3] or ""] += 1
    alone = sum(1 for g in groups.values() if sum(g.values()) == 1) / len(groups)
    top = sum(max(g.values()) / sum(g.values()) for g in groups.values()) / len(groups)
    overall = Counter(r[3] or "" for r in rows)
    bits = -sum(c / len(rows) * math.log2(c / len(rows)) for c in overall.values())
    return 100 * (0.6 * pii + 0.4 * alone), 100 * alone, 100 * top * (0.6 + 0.4 * (1 - min(1, bits / 4)))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(make_rows(), "client_id string, a string, b string, s string")


def test_metrics(table):
    assert list(risk_metrics(table, ROLES).first()) == pytest.approx(expected(make_rows()))
    bar = risk_metrics(table, ROLES, compat=True).first()
    assert list(bar) == pytest.approx(expected(make_rows()))


def test_scores_that_cannot_be_told(table):
    assert list(risk_metrics(table.limit(0), ROLES).first()) == [None, None, None]
    alone, linked, told = risk_metrics(table, Roles(sensitive="s")).first()
    assert alone > 0 and linked is None and told is None
    assert risk_metrics(table, Roles(qids=("a",))).first()["inference"] is None


def test_direct_identifiers_by_name():
    names = ["ID", "client_no", "Courriel", "Téléphone", "ville", "identite", "video", "nas", "tel", "prenom"]
    assert direct_pii_columns(names) == ["ID", "client_no", "Courriel", "Téléphone", "identite", "nas", "tel"]


def test_verdicts(spark):
    metrics = spark.createDataFrame(
        [("before", 80.0, 30.0, None), ("after", 20.0, 31.5, None)],
        "stage string, individualization double, correlation double, inference double",
    )
    rows = {r["criterion"]: r for r in compliance(metrics).collect()}
    assert rows["individualization"]["verdict"] == "Conforme" and rows["individualization"]["reduction"] == 60
    assert rows["correlation"]["verdict"] == "À améliorer" and rows["correlation"]["reduction"] == 0
    assert rows["inference"]["verdict"] == "N/A" and rows["inference"]["reduction"] is None
    assert [rows[c]["threshold"] for c in ("individualization", "correlation", "inference")] == [20, 30, 35]


def test_report_covers_both_stages(spark):
    df = spark.createDataFrame([(f"199{i % 3}-01-0{i % 9 + 1}", "x") for i in range(30)], "date string, s string")
    roles = Roles(date1="date", sensitive="s", qids=("date",))
    rows = {r["criterion"]: r for r in risk_report(df, roles).collect()}
    assert rows["inference"]["before"] == pytest.approx(100) and rows["correlation"]["after"] == 0


def test_evaluate(spark):
    rows = [("q1", "x")] * 3 + [("q1", "y")] + [("q2", "x")] * 2 + [("q3", None), (None, "z")]
    df = spark.createDataFrame(rows, "q string, s string")
    unique, small, told = evaluate(df, ["q"], "s", 3).first()
    assert unique == pytest.approx(25) and small == pytest.approx(50)
    assert told == pytest.approx((50 * 4 + 100 * 4) / 8)
    assert list(evaluate(df, [], "s").first()) == [0, 0, 0]
    assert list(evaluate(df.limit(0), ["q"], "s").first()) == [0, 0, 0]
    assert evaluate(df, ["q"], None, 3).first()["inference"] == 0


def test_profile(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("b", "x")], "p string, `q.r` string")
    rows = {r["colonne"]: r.asDict() for r in profile(df).collect()}
    assert rows["p"] == {"colonne": "p", "distinct": 2, "vides": 0, "total": 3, "colonnes": 2}
    assert rows["q.r"]["distinct"] == 2 and rows["q.r"]["vides"] == 2
    raw = {r["colonne"]: r["distinct"] for r in profile(df, absent_as_empty=False).collect()}
    assert raw == {"p": 2, "q.r": 2}
    only_null = spark.createDataFrame([(None,), ("x",)], "p string")
    assert profile(only_null, absent_as_empty=False).first()["distinct"] == 1


@pytest.mark.parametrize("by_digest", [True, False])
def test_row_audit(spark, by_digest):
    rows = [("a", "b")] * 3 + [("ab", ""), ("", "ab"), ("a", None), ("a", "")]
    df = spark.createDataFrame(rows, "p string, q string")
    got = row_audit(df, 2, by_digest=by_digest).first().asDict()
    assert got == {"total": 7, "groupes": 4, "nonConformes": 2, "conforme": False}
    assert row_audit(df, 1, by_digest=by_digest).first()["conforme"] is True
    assert row_audit(df.limit(0), 2, by_digest=by_digest).first()["total"] == 0


def test_metrics_plan_has_no_cross_join(table, capsys):
    risk_metrics(table, ROLES).explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Window" not in plan
