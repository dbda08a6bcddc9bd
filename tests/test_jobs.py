"""Whole jobs, their outputs on disk, and the stream of files."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import voilage
from voilage import (
    Roles, Rule, Settings, anonymize, auto_anonymize, chosen_rules, fixed_file_job, fixed_rules,
    profile_and_anonymize, read_delimited, synth_clients,
)
from voilage.operators import classes, rules
from voilage.session import scratch_path, shared_folder
from voilage.sinks.files import (
    job_definition, journal_append, journal_read, read_job_definition, run_report, write_csv, write_json,
)
from voilage.streaming.files import start, stream_delimited

ROLES = Roles(
    id="id_client", postal="code_postal", date1="date_naissance", revenue="revenu_annuel", sensitive="ville",
    qids=("decade", "secteur"),
)


@pytest.fixture(scope="module")
def clients(spark):
    made = synth_clients(spark, 4000).withColumns(
        {"decade": F.substring("date_naissance", 1, 3), "secteur": F.substring("code_postal", 1, 1)}
    )
    return classes.materialize(made)


SETTINGS = Settings(k_anon=120, l_div=20, t_close=0.16, noise_seed="s")


def test_anonymize_keeps_exactly_the_good_classes(clients):
    done = anonymize(clients, ROLES, None, SETTINGS)
    treated = rules.treat_rows(clients, ROLES, None, SETTINGS)
    stats = {(r["decade"], r["secteur"]): r for r in classes.class_stats(treated, ["decade", "secteur"], "ville").collect()}
    good = {k for k, r in stats.items() if r["n"] >= 120 and r["l"] >= 20 and r["tvd"] <= 0.16}
    assert 0 < len(good) < len(stats)
    want = {tuple(r) for r in treated.drop("_year", "_fsa", "_revBin").collect() if (r["decade"], r["secteur"]) in good}
    assert done.rows.columns == clients.columns
    assert {tuple(r) for r in done.rows.collect()} == want
    counts = done.counts.first()
    assert (counts["kept"], counts["total"]) == (len(want), 4000)
    metrics = done.metrics.first()
    assert metrics["individualisation"] == 0 and metrics["correlation"] == 0 and 95 <= metrics["inference"] <= 100


def test_extras_flag_switches_closeness_off(clients):
    loose = anonymize(clients, ROLES, None, Settings(k_anon=120, l_div=20, t_close=0.0, suppress_extras=False, noise_seed="s"))
    strict = anonymize(clients, ROLES, None, Settings(k_anon=120, l_div=20, t_close=0.0, noise_seed="s"))
    assert loose.counts.first()["kept"] > 0 and strict.counts.first()["kept"] == 0
    assert strict.rows.count() == 0 and strict.rows.columns == clients.columns


def test_bar_keys_give_the_same_classes_here(clients):
    a = anonymize(clients, ROLES, None, SETTINGS)
    b = anonymize(clients, ROLES, None, SETTINGS, compat=True)
    assert a.counts.first() == b.counts.first()


def test_anonymize_refuses(clients):
    with pytest.raises(ValueError):
        anonymize(clients, Roles())
    with pytest.raises(ValueError):
        auto_anonymize(clients.limit(0))


def test_auto_and_profile(clients, tmp_path):
    journal = str(tmp_path / "journal")
    df = clients.select("id_client", "ville", "code_postal", "date_naissance", "telephone", "secteur")
    done = profile_and_anonymize(df, None, Settings(k_anon=2, t_close=1, noise_seed="s"), journal=journal)
    assert done.rules["telephone"] == Rule("mask") and done.rules["ville"] == Rule("mask")
    assert done.profile.count() == 6
    row = done.result.rows.first()
    assert len(row["date_naissance"]) == 4 and row["code_postal"].endswith("***") and len(row["id_client"]) == 64
    entry = journal_read(df.sparkSession, journal).first()
    assert entry["action"] == "anonymize" and json.loads(entry["data"])["total"] == 4000


def test_recommended_types_may_be_left_unread(spark):
    df = spark.createDataFrame([("19900412", "1990-04-12")] * 3, "date_maj string, date_naissance string")
    roles = Roles(date1="date_naissance", qids=("date_naissance",))
    settings = Settings(k_anon=2)
    assert auto_anonymize(df, roles, settings).rows.first()[:] == ("", "1990")
    assert auto_anonymize(df, roles, settings, compat=True).rows.first()[:] == ("19900412", "1990")


def test_chosen_rules(clients):
    df = clients.select("id_client", "ville", "date_naissance", "revenu_annuel")
    got = chosen_rules(df, Roles(date1="date_naissance", qids=("date_naissance",)))
    assert got["id_client"] == Rule("pseudonymize") and got["date_naissance"] == Rule("generalize", {"granularity": "year"})


def test_fixed_file_job(spark, tmp_path):
    source = tmp_path / "clients.csv"
    source.write_bytes(
        "﻿id_client;date_naissance;code_postal;revenu_annuel\r\n"
        "123;1990-04-12;G7H4B2;73450\r\n456;1985-10-01;H2X1A1;52000\r\n7;;;\r\n8\r\n".encode()
    )
    target = fixed_file_job(spark, str(source), salt="change-me-salt")
    assert target == str(tmp_path / "clients-anon.csv")
    parts = [p.read_bytes() for p in (tmp_path / "clients-anon.csv").glob("part-*")]
    assert parts and all(p.startswith("﻿id_client,".encode()) for p in parts)
    rows = sorted(tuple(r) for r in read_delimited(spark, target).collect())
    assert ("884fa0900172", "1990", "G7H***", "60-80k") in rows and ("94c1ddcbb8e3", "1985", "H2X***", "40-60k") in rows
    assert len(rows) == 4 and rows[0][1:] == rows[1][1:] == ("", "", "")


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "hi"', " padded "), ("", None, "é;\t"), ("line\nend", "x", "")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    path = str(tmp_path / "out")
    write_csv(df, path, ["r", "p", "q"])
    got = read_delimited(spark, path, multiline=True)
    assert got.columns == ["r", "p", "q"]
    assert sorted(tuple(r) for r in got.select("p", "q", "r").collect()) == sorted((p, q or "", r) for p, q, r in rows)
    with pytest.raises(ValueError):
        write_csv(df.limit(0), str(tmp_path / "none"))


def test_definition_round_trip(spark, tmp_path):
    chosen = {"a": Rule("generalize", {"type": "income-bin", "thresholds": [1, 2]}), "b.c": Rule()}
    settings = Settings(epsilon=3, t_close=0.25, zip3=False)
    made = job_definition(spark, ROLES, chosen, settings, ["a", "b.c"], ";", datetime(2024, 1, 2))
    path = str(tmp_path / "definition")
    write_json(made, path)
    roles, back, again, columns = read_job_definition(spark, path)
    assert (roles, back, again, columns) == (ROLES, chosen, settings, ["a", "b.c"])
    raw = json.loads(next(line for p in (tmp_path / "definition").glob("part-*") for line in p.read_text().splitlines()))
    assert raw["meta"] == {"createdAt": "2024-01-02T00:00:00.000Z", "delimiter": ";"}
    assert settings.noise_seed not in json.dumps(raw) and "noise_seed" not in raw["settings"]


def test_report(spark):
    counts = spark.createDataFrame([(3, 5)], "kept bigint, total bigint")
    rows = {(r["section"], r["key"]): r["value"] for r in run_report("<a>&", ",", counts, Roles(id="x"), Settings()).collect()}
    assert rows["dataset", "file"] == "&lt;a&gt;&amp;" and rows["dataset", "rows"] == "5"
    assert rows["mapping", "id"] == "x" and rows["mapping", "postal"] == "—" and rows["parameters", "t"] == "0.3"
    raw = run_report("<a>", ",", counts, Roles(), Settings(), escape=False)
    assert raw.filter("key = 'file'").first()["value"] == "<a>"


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    journal_append(spark, path, "first", at=datetime(2024, 1, 1, 10, 30, 59))
    journal_append(spark, path, "second", {"n": 1}, at=datetime(2024, 1, 2))
    rows = journal_read(spark, path).collect()
    assert [(r["action"], r["data"]) for r in rows] == [("second", '{"n": 1}'), ("first", None)]
    assert (rows[1]["at"].minute, rows[1]["at"].second) == (30, 0)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    columns = ["id_client", "date_naissance", "code_postal", "revenu_annuel"]
    first = "id_client;date_naissance;code_postal;revenu_annuel\n123;1990-04-12;G7H4B2;73450\n1;;H2X\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(first)

    def run():
        stream = stream_delimited(spark, source, columns, ";", max_files=1)
        return start(stream, target, progress, treat=lambda df: fixed_rules(df, "s")).wait()

    assert run().rows_read() == 2
    (tmp_path / "in" / "b.csv").write_text(first.replace("123", "124"))
    assert run().rows_read() == 2 and run().rows_read() == 0
    got = sorted(tuple(r) for r in read_delimited(spark, target, delimiter=",", columns=columns).collect())
    batch = fixed_rules(read_delimited(spark, source), "s").na.fill("")
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) == 4


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == configured if configured else folder.startswith("/tmp/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_public_names():
    assert all(hasattr(voilage, name) for name in voilage.__all__)


def test_intermediate_tables_go_with_their_block(spark, tmp_path):
    from pathlib import Path

    from voilage.session import intermediates, materialize

    with intermediates(spark) as folder:
        kept = materialize(spark.range(5)).count()
        assert Path(folder).exists()
    assert kept == 5 and not Path(folder).exists()
