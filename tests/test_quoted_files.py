"""Delimited files cut into many splits, and line ends, quotes and encodings of all kinds."""

from __future__ import annotations

import random

import pytest

from voilage import read_delimited, sniff_delimiters
from voilage.sources import quoted
from voilage.sources.delimited import UnclosedQuote, header_cells, record_end


@pytest.fixture
def small_splits(spark):
    """Splits of 512 bytes, so that records of a few lines lie in several."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "512b")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def written(cell: str, draw: random.Random) -> str:
    if any(x in cell for x in ',"\n\r') or draw.random() < 0.3:
        return '"' + cell.replace('"', '""') + '"'
    return cell


def table_text(draw: random.Random, rows: int, end: str) -> tuple[str, list[list[str]]]:
    cells = [
        ["".join(draw.choice('ab",\n \ré') for _ in range(draw.choice((0, 1, 3, 10, 60, 300)) if draw.random() < 0.3 else 2)) for _ in range(3)]
        for _ in range(rows)
    ]
    if end == "\r":  # the other line end must not stand outside quotes either
        cells = [[c.replace("\n", "x") for c in row] for row in cells]
    lines = [",".join(written(c, draw) for c in row) for row in cells]
    blank = [line if draw.random() < 0.9 else end + line for line in lines]
    return end.join(["id,un,deux,trois", *(f"{i},{line}" if not line.startswith(end) else f"{end}{i},{line[len(end):]}" for i, line in enumerate(blank))]), cells


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("seed", [1, 2])
def test_quoted_cells_over_many_splits(spark, tmp_path, small_splits, end, seed):
    draw, want = random.Random(seed), []
    for name in "abc":
        text, cells = table_text(draw, 60, end)
        (tmp_path / f"{name}.csv").write_bytes((("\ufeff" if name == "b" else "") + text + draw.choice(("", end))).encode())
        want += [(str(i), *row) for i, row in enumerate(cells)]
    df = read_delimited(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sorted(r[0] for r in df.select("deux").collect()) == sorted(r[2] for r in want)


def test_splits_sized_by_the_input_when_records_cross_in_some_files_only(spark, tmp_path):
    """Below the largest split size, Spark cuts files by the bytes it is to read: leaving some out moves the cuts."""
    (tmp_path / "a.csv").write_text("id,nom\n" + "".join(f'{i},"{"x" * 3000}\n{"y" * 3000}"\n' for i in range(10)))
    (tmp_path / "b.csv").write_text("id,nom\n" + "".join(f"{i},{'z' * 600}\n" for i in range(100, 200)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "512b")
    try:
        got = sorted(map(tuple, read_delimited(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    want = [(f"{i}", "x" * 3000 + "\n" + "y" * 3000) for i in range(10)] + [(f"{i}", "z" * 600) for i in range(100, 200)]
    assert got == sorted(want)


def test_splits_smaller_than_the_cost_of_opening_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,nom\n" + "".join(f'{i},"{"x" * 300}\n{"y" * 300}"\n' for i in range(100)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = sorted(map(tuple, read_delimited(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((f"{i}", "x" * 300 + "\n" + "y" * 300) for i in range(100))


def test_a_record_longer_than_many_splits_and_a_long_header(spark, tmp_path, small_splits):
    long = "x,\n" * 1000
    header = '"a\nb' + "c" * 3000 + '"'
    (tmp_path / "a.csv").write_text(f'{header},d\n1,"{long}"\n2,plain\n3,"{long}""{long}"\n4,\n')
    df = read_delimited(spark, str(tmp_path))
    assert df.columns == [header.strip('"'), "d"]
    assert sorted(map(tuple, df.collect())) == [("1", long), ("2", "plain"), ("3", f'{long}"{long}'), ("4", "")]


def test_the_way_of_whole_files_gives_the_same(spark, tmp_path, small_splits, monkeypatch):
    text, cells = table_text(random.Random(5), 40, "\n")
    (tmp_path / "a.csv").write_bytes(text.replace("\r", "y").encode())
    split = sorted(map(tuple, read_delimited(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(quoted, "MOST_SPLITS", 3)
    whole = read_delimited(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == split and whole.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("splits", ["512b", "128m"])
def test_a_quote_that_never_closes_stops_the_job(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text("id,nom\n" + "\n".join(f"{i},n" for i in range(50)) + '\n7,"open\n' + "8,n\n" * 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    spark.conf.set("spark.sql.files.openCostInBytes", splits)
    try:
        with pytest.raises(Exception, match="never closed"):
            read_delimited(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_quote_that_never_closes_in_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"nom\n' + "1,a\n" * 2000)
    with pytest.raises(Exception, match="first record is never closed"):
        read_delimited(spark, str(tmp_path)).collect()


def test_records_beyond_the_bound_stop_the_job(spark, tmp_path, monkeypatch):
    quotes = quoted.Quotes(",")
    split = quoted._Split("f", 0, False, True, quotes, "\n")
    monkeypatch.setattr(quoted, "RECORD_CHARS", 100)
    import pyarrow as pa

    with pytest.raises(ValueError, match="more than 100 characters"):
        split.take(pa.array(["a,b", '1,"x', *["y" * 30] * 5]))


def test_long_lines_are_worked_on_a_few_at_a_time():
    import pyarrow as pa

    n, line = 64, '"' + "x" * 200_000 + '"'
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * n, "start": [0] * n, "value": [line] * n, "inside": [False] * n})
    made = list(quoted._formed(",", "\r", False, False, frozenset())(iter([batch])))
    assert [r for b in made for r in b.column("record").to_pylist()] == [line] * n
    assert max(b.nbytes for b in made) <= 2 * quoted.PIECE_BYTES


def test_carriage_returns_alone_end_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id;nom\r1;a\r2;\"b\nc\"\r")
    (tmp_path / "b.csv").write_bytes(b"id,nom\n3,d\n")
    df = read_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "nom"] and sorted(map(tuple, df.collect())) == [("1", "a"), ("2", "b\nc"), ("3", "d")]
    told = {r["file"][-5:]: (r["delimiter"], r["line_end"]) for r in sniff_delimiters(spark, str(tmp_path)).collect()}
    assert told == {"a.csv": (";", "\r"), "b.csv": (",", "\n")}
    known = read_delimited(spark, f"{tmp_path}/a.csv", delimiter=";", columns=["id", "nom"], line_end="\r")
    assert known.count() == 2


def test_other_encodings(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes("prénom,ville\n".encode("latin-1") + "\n".join(f'Zoé{i},"Montréal\n{i}"' for i in range(30)).encode("latin-1"))
    df = read_delimited(spark, str(tmp_path), encoding="ISO-8859-1")
    assert df.columns == ["prénom", "ville"]
    assert sorted(map(tuple, df.collect())) == sorted((f"Zoé{i}", f"Montréal\n{i}") for i in range(30))
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path), encoding="UTF-16")


def test_automaton_from_both_states():
    quotes, draw = quoted.Quotes(";"), random.Random(4)

    def slow(line: str, inside: bool) -> bool:
        text = ('"' if inside else "") + line
        try:
            record_end(text + "\n", ";") if not text.endswith("\n") else None
        except UnclosedQuote:
            return True
        return False

    for _ in range(5000):
        line = "".join(draw.choice('a";') for _ in range(draw.randint(0, 12)))
        assert quotes.inside_after(line, False) == slow(line, False), line
        # a cell that has begun before: its opening quote and one character of it
        begun = '"x' + line
        try:
            record_end(begun + "\n", ";")
            closed = True
        except UnclosedQuote:
            closed = False
        assert quotes.inside_after(line, True) == (not closed), line


def test_header_cells_with_quotes_and_line_ends():
    assert header_cells('a,"b, ""c""\nd" ,,e"f\rg', ",") == ["a", 'b, "c"\nd ', "", 'e"f\rg'] and header_cells("", ";") == [""]
    assert record_end('a,"b\nc"\r\nx', ",") == 7 and record_end("a\rb", ",") == 1 and record_end("a,b", ",") == -1
