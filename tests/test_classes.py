"""Equivalence classes against brute force, with every way through the joins."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from voilage.config import Roles
from voilage.operators import classes


def make_rows(n=3000, seed=5):
    """One class and one value hold a third of all rows each; some values are rare."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{int(rng.paretovariate(0.7)) % 90}"
        value = "common" if rng.random() < 0.34 else f"v{rng.randrange(60)}"
        rows.append((str(i), key, str(i % 2), value))
    return rows


def brute(rows):
    total, overall = len(rows), Counter(r[3] for r in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], r[2]].append(r[3])
    out = {}
    for key, values in groups.items():
        mine = Counter(values)
        gap = sum(abs(mine[v] / len(values) - overall[v] / total) for v in overall)
        out[key] = (len(values), len(mine), gap / 2)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(make_rows(), "id string, a string, b string, s string").cache()


def as_dict(stats):
    return {(r["a"], r["b"]): (r["n"], r["l"], r["tvd"]) for r in stats.collect()}


@pytest.mark.parametrize("heavy", [1, 4, 1000])
@pytest.mark.parametrize("exact_rows", [0, 10**9])
@pytest.mark.parametrize("written", [False, True])
def test_class_stats(table, monkeypatch, heavy, exact_rows, written):
    monkeypatch.setattr(classes, "HEAVY", heavy)
    monkeypatch.setattr(classes, "EXACT_ROWS", exact_rows)
    got = as_dict(classes.class_stats(table, ["a", "b"], "s", write_counts=written))
    want = brute(make_rows())
    assert got.keys() == want.keys()
    for key, (n, l, gap) in want.items():
        assert got[key][:2] == (n, l)
        assert got[key][2] == pytest.approx(gap, abs=1e-12)


def test_class_stats_without_broadcast_joins(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = as_dict(classes.class_stats(table, ["a", "b"], "s"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in brute(make_rows()).items()}


@pytest.mark.parametrize("broadcast_bytes", [0, 10**9])
@pytest.mark.parametrize("heavy", [2, 1000])
def test_suppression(table, monkeypatch, broadcast_bytes, heavy):
    monkeypatch.setattr(classes, "HEAVY", heavy)
    want = {k for k, (n, l, gap) in brute(make_rows()).items() if n >= 12 and l >= 6 and gap <= 0.55}
    assert 0 < len(want) < len(brute(make_rows()))
    verdicts = classes.materialize(classes.class_verdicts(table, ["a", "b"], "s", k=12, l=6, t=0.55))
    kept = classes.keep_rows(table, verdicts, ["a", "b"], broadcast_bytes)
    assert {r["id"] for r in kept.collect()} == {r[0] for r in make_rows() if (r[1], r[2]) in want}
    counts = classes.class_counts(verdicts).first()
    assert counts["total"] == 3000 and counts["kept"] == kept.count()


def test_suppression_keeps_its_promises_and_is_idempotent(table):
    limits = dict(k=12, l=6, suppress_extras=False)
    once = classes.suppress_classes(table, ["a", "b"], "s", **limits)
    for r in classes.class_stats(once, ["a", "b"], "s").collect():
        assert r["n"] >= 12 and r["l"] >= 6
    assert classes.suppress_classes(once, ["a", "b"], "s", **limits).count() == once.count()


def test_limits_apply_as_configured(table):
    by_k = classes.suppress_classes(table, ["a", "b"], None, k=12, l=50, t=0.0)
    want = {k for k, (n, _, _) in brute(make_rows()).items() if n >= 12}
    assert by_k.count() == sum(1 for r in make_rows() if (r[1], r[2]) in want)
    assert classes.suppress_classes(table, ["a", "b"], "s", k=5000).count() == 0
    assert classes.suppress_classes(table, ["a", "b"], "s", k=1).count() == 3000


@pytest.mark.parametrize("heavy", [2, 1000])
def test_class_size_per_row(table, monkeypatch, heavy):
    monkeypatch.setattr(classes, "HEAVY", heavy)
    got = {r["id"]: r["n"] for r in classes.with_class_size(table, ["a", "b"]).collect()}
    sizes = Counter((r[1], r[2]) for r in make_rows())
    assert got == {r[0]: sizes[r[1], r[2]] for r in make_rows()}


def test_empty_table(table):
    nobody = table.limit(0)
    assert classes.class_stats(nobody, ["a", "b"], "s").count() == 0
    assert classes.suppress_classes(nobody, ["a", "b"], "s", k=2).count() == 0


def test_distribution_and_distance(spark):
    p = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "x string")
    q = spark.createDataFrame([("a",), ("c",)], "x string")
    dist = classes.distribution(p, "x")
    assert {r["value"]: (r["c"], r["n"]) for r in dist.collect()} == {"a": (2, 4), "": (2, 4)}
    assert classes.tvd(dist, classes.distribution(q, "x")).first()["tvd"] == pytest.approx(0.5)
    assert classes.tvd(dist, dist).first()["tvd"] == 0


def test_class_key(spark):
    roles = Roles(date1="d1", date2="d2", postal="p", qids=("d2", "p", "x"))
    df = spark.createDataFrame([("1990", "G7H***", "y1", "y2", "p1", None)], "_year string, _fsa string, d1 string, d2 string, p string, x string")
    keys = classes.class_key(roles, df.columns)
    assert list(df.select(*keys.values()).first()) == ["1990", "G7H***", "undefined"]
    bar = classes.class_key(roles, df.columns, compat=True)
    assert df.select(*bar.values()).first()[0] == "1990|G7H***|undefined"


def test_bars_in_values_do_not_merge_classes(spark):
    roles = Roles(qids=("x", "y"))
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    for compat, n in ((False, 2), (True, 1)):
        keyed = df.withColumns(classes.class_key(roles, df.columns, compat=compat))
        assert classes.class_sizes(keyed, [c for c in keyed.columns if c.startswith("_q")]).count() == n


def test_plan_counts_before_it_shuffles(spark, table, capsys):
    """The rows meet a partial aggregate before the first exchange, and no window gathers a class."""
    classes.class_stats(table.select("a", "b", "s"), ["a", "b"], "s").explain()
    plan = capsys.readouterr().out
    assert "partial_count(1)" in plan and "Window" not in plan and "Cartesian" not in plan
    assert "NestedLoop" not in plan
