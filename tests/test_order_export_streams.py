"""Order of first appearance, exports, whole definitions, the journal, streams of any dialect, amounts of any size."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from voilage import Roles, Rule, Settings, anonymize, auto_anonymize, read_delimited
from voilage.functions.noise import noisy_amount, rounded_amount
from voilage.functions.numbers import bin_income, floor_text
from voilage.operators import policy
from voilage.operators.ordering import in_order_of_appearance, numbered
from voilage.operators.rules import apply_rules
from voilage.sinks import files as sinks
from voilage.sources.delimited import sniff_delimiters
from voilage.streaming import files as streams


# order


def test_row_numbers_of_a_whole_table(spark):
    draw = random.Random(1)
    rows = [(draw.randint(0, 50), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {r["position"]: (r["a"], r["b"]) for r in numbered(df, ["a", "b"]).collect()}
    assert [got[i + 1] for i in range(1000)] == sorted(rows)
    down = {r["position"]: (r["a"], r["b"]) for r in numbered(df, ["a", "b"], descending=True).collect()}
    assert [down[i + 1] for i in range(1000)] == sorted(rows, reverse=True)
    assert numbered(df.limit(0), ["a"]).count() == 0


def test_classes_in_the_order_of_their_first_row(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice("aaaaaabcde")) for i in range(500)]  # one class holds half of the rows
    df = spark.createDataFrame(rows, "line int, k string").repartition(5)
    want = sorted(rows, key=lambda r: (next(i for i, k in rows if k == r[1]), r[0]))
    assert [tuple(r) for r in in_order_of_appearance(df, ["k"], ["line"]).collect()] == want
    placed = in_order_of_appearance(df, ["k"], ["line"], "n").collect()
    assert [(r["line"], r["k"]) for r in sorted(placed, key=lambda r: r["n"])] == want


def test_published_rows_keep_the_order_of_the_input(spark):
    rows = [(i, f"{1980 + (i * 7) % 3}-05-01", "G1A1A1", str(1000 * (i % 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "line int, naissance string, cp string, v string").repartition(4)
    roles = Roles(date1="naissance", postal="cp", qids=("naissance", "cp"))
    done = anonymize(df, roles, None, Settings(k_anon=2, noise_seed="s"), appearance=["line"]).rows.collect()
    years, seen = [r["naissance"] for r in done], []
    for y in years:
        if not seen or seen[-1] != y:
            seen.append(y)
    assert seen == ["1980", "1981", "1982"] and len(done) == 60
    for y in seen:
        lines = [r["line"] for r in done if r["naissance"] == y]
        assert lines == sorted(lines)


# exports


def test_one_file_holds_one_header_and_one_mark(spark, tmp_path):
    df = spark.range(1000).repartitionByRange(5, "id").select(F.col("id").cast("string").alias('n"o;'), F.lit("x\ny").alias("t"))
    file = f"{tmp_path}/out.csv"
    sinks.write_one_csv(df, file, delimiter=";")
    raw = (tmp_path / "out.csv").read_bytes()
    assert raw.startswith("\ufeff".encode() + b'"n""o;";t\n') and raw.count("\ufeff".encode()) == 1 and raw.count(b'n""o') == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.csv"]
    read = read_delimited(spark, file)
    assert read.columns == ['n"o;', "t"] and sorted(int(r[0]) for r in read.collect()) == list(range(1000))
    assert [r[1] for r in read.limit(2).collect()] == ["x\ny"] * 2
    assert raw.split(b"\n")[1].startswith(b"0;") and raw.endswith(b'999;"x\ny"\n')
    with pytest.raises(ValueError):
        sinks.write_one_csv(df, file)
    sinks.write_one_csv(df.limit(0), file, bom=False, overwrite=True)
    assert (tmp_path / "out.csv").read_bytes() == b'"n""o;",t\n'


def test_an_empty_table_leaves_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="no row"):
        sinks.write_csv(spark.range(0), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    sinks.write_csv(spark.range(3), f"{tmp_path}/some")
    assert len(read_delimited(spark, f"{tmp_path}/some").collect()) == 3


def test_an_empty_table_is_refused_by_the_job(spark):
    df = spark.createDataFrame([], "id_client string, date_naissance string")
    with pytest.raises(ValueError, match="no row"):
        auto_anonymize(df)


def test_whole_definitions_of_a_catalog(spark, tmp_path):
    columns = policy.catalog_of(spark, {"a": ["note", "email", "note", "date_naissance"], "b": ["x"]})
    made = sinks.table_definitions(policy.guess_mapping(columns), Settings(), ";", policy.recommend(columns))
    sinks.write_json(made, f"{tmp_path}/d")
    told = {r["table_name"]: r for r in spark.read.schema(made.schema).json(f"{tmp_path}/d").collect()}
    assert told["a"]["columns"] == ["note", "email", "date_naissance"] and told["b"]["columns"] == ["x"]
    assert {c: (t["action"], t["param"]["type"]) for c, t in told["a"]["transforms"].items()} == {
        "note": ("mask", None), "email": ("mask", None), "date_naissance": ("generalize", "date-year"),
    }
    assert told["b"]["transforms"] == {} and told["a"]["mapping"]["date1"] == "date_naissance" and told["b"]["mapping"]["date1"] is None


# journal


def test_entries_of_one_minute_come_back_newest_first(spark, tmp_path):
    path, at = f"{tmp_path}/j", datetime(2024, 5, 1, 12, 0, 30, tzinfo=timezone.utc)
    for i in range(5):
        sinks.journal_append(spark, path, f"step {i}", {"i": i}, at)
    want = [f"step {i}" for i in (4, 3, 2, 1, 0)]
    assert [r["action"] for r in sinks.journal_read(spark, path).collect()] == want
    old = "SELECT TIMESTAMP '2024-05-01 12:00:00' AS at, 'before numbers' AS action, CAST(NULL AS STRING) AS data"
    spark.sql(old).write.mode("append").parquet(path)
    assert sinks.journal_compact(spark, path) == 5 and sinks.journal_compact(spark, path) == 1
    assert [r["action"] for r in sinks.journal_read(spark, path).collect()] == [*want, "before numbers"]
    assert len([p for p in (tmp_path / "j").iterdir() if p.name.startswith("part-")]) == 2


def test_an_entry_that_stands_in_two_files_is_read_once(spark, tmp_path):
    path = f"{tmp_path}/j"
    sinks.journal_append(spark, path, "a")
    spark.read.schema(sinks.JOURNAL_SCHEMA).parquet(path).write.parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(path)
    assert sinks.journal_read(spark, path).count() == 1


# streams


def test_files_of_any_dialect_arrive_in_turn(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    masked = {"email": Rule("suppress")}

    def arrive(name: str, data: str) -> list[tuple]:
        (tmp_path / "in" / name).write_bytes(data.encode())
        run = streams.start_mixed(spark, source, target, checkpoint, treat=lambda df: apply_rules(df, masked)).wait()
        rows = run.rows()
        shown = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in ("id", "email", "ville")]
        return sorted(map(tuple, rows.select(*shown).collect()))

    assert arrive("a.csv", "id;email\r\n1;a@b\r\n") == [("1", "", None)]
    assert arrive("b [x].csv", 'ville,id\n"Trois\nRivières",2\n') == [("1", "", None), ("2", None, "Trois\nRivières")]
    assert arrive("c.csv", "id\tville\temail\r3\tLévis\tc@d\r")[2] == ("3", "", "Lévis")
    assert streams.counted_rows(spark, checkpoint).first()["total"] == 3
    kept = spark.read.parquet(f"{checkpoint}/dialects")
    assert {(r["file"][-5:], r["delimiter"]) for r in kept.collect()} == {("a.csv", ";"), ("].csv", ","), ("c.csv", "\t")}


def test_known_dialects_are_not_looked_for_again(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n1;2\n")
    known = sniff_delimiters(spark, str(tmp_path)).withColumn("columns", F.array(F.lit("x"), F.lit("y")))
    assert read_delimited(spark, str(tmp_path), dialects=known).columns == ["x", "y"]


def test_a_resumed_stream_goes_on_counting(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for n, total in ((10, 10), (5, 15), (0, 15)):
        if n:
            spark.range(n).write.mode("append").parquet(source)
        stream = streams.stream_parquet(spark, source, spark.range(1).schema, max_files=1)
        streams.start_counted(stream, target, checkpoint, treat=lambda df: df).awaitTermination()
        assert streams.counted_rows(spark, checkpoint).first()["total"] == total == spark.read.parquet(target).count()


# amounts


def test_no_amount_is_published_as_it_came(evaluate_on):
    values = ["1234567890123456789012345678901234567890", "-" + "9" * 60, "1" * 320, "12,5 $", "abc", "1.2.3", None, "9" * 37]
    got = evaluate_on(lambda c: noisy_amount(c, 2, F.lit(0.25)), values)
    assert got[0] == f"{1.2345678901234568e39:.0f}"[:17] + "0" * 23 and float(got[0]) == float(values[0]) and got[0] != values[0]
    assert float(got[1]) == float(values[1]) and got[1] != values[1] and got[2] == ""
    assert got[3] not in values and got[4].lstrip("-").isdigit() and got[5] == "1.2.3" and got[6] is None
    assert got[7] not in values and float(got[7]) == float(values[7])


def test_every_finite_amount_has_a_bin(evaluate_on):
    values = ["-5", "0", "1" + "0" * 32, "-1" + "0" * 300, "1" * 320, "x", None, "1.2.3"]
    got = evaluate_on(bin_income, values)
    assert got[0] == "-10–0k" and got[1] == "0–10k" and got[4] == "" and got[5] == "0–10k" and got[6] is None and got[7] == ""
    for i in (2, 3):
        low, high = got[i].removesuffix("k").split("–")
        assert low == high and float(low) == pytest.approx(float(values[i]) / 1000)


def test_large_amounts_are_rounded_as_numbers(evaluate_on):
    got = evaluate_on(lambda c: rounded_amount(c, 10), ["14", "15", "-15", "-16", "123456789012345678901234", "1" + "0" * 38, "x"])
    assert got[:4] == ["10", "20", "-10", "-20"] and float(got[4]) == pytest.approx(123456789012345678901234.0, rel=1e-15)
    assert got[5] == "1" + "0" * 38 and got[6] == "0"
    assert evaluate_on(floor_text, [2.5, -2.5, 1e40, None], "double") == ["2", "-3", "1" + "0" * 40, None]


def test_one_exported_file_is_one_file_however_it_is_cut(spark):
    from voilage.workload.queries import QUERIES

    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "16k")
    try:
        got = QUERIES["sink_one_csv"](spark, "/root/testdata/sf0.001").collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("string(doc_id)", "text", "lang", "source", "1")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want.collect()))
