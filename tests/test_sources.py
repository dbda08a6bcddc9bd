"""Delimited files of every shape, and the generator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voilage import Roles, anonymize, preview, read_delimited, sniff_delimiters, synth_clients
from voilage.plans.jobs import fixed_file_job
from voilage.sinks.files import anonymized_name
from voilage.sources import synthetic
from voilage.sources.delimited import count_rows, sample
from voilage.streaming.files import start, stream_delimited

BOM = "﻿".encode()


def write(folder, **files):
    for name, data in files.items():
        (folder / (name + ".csv")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def cells(df):
    return sorted((list(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("method", ["head", "scan"])
def test_sniffing_many_files(spark, tmp_path, method):
    path = write(
        tmp_path,
        a=BOM + "id;date;cp\r\n1;2;3\r\n".encode(),
        **{"b b+%41[x]": "id,date\n1,2\n"},
        c="1\t2\t3\n",
        d="id_client,nom\n",
        e='"a, b";c;d\nx;y;z\n',
        f="1,2\n3,4\n",
        g="x\n1\n",
    )
    got = {
        r["file"].split("/")[-1][:-4]: (r["delimiter"], r["has_header"], r["columns"])
        for r in sniff_delimiters(spark, path, method).collect()
    }
    assert got == {
        "a": (";", True, ["id", "date", "cp"]),
        "b b+%41[x]": (",", True, ["id", "date"]),
        # a single line without any letter is data, so its columns get numbered
        "c": ("\t", False, ["Col 1", "Col 2", "Col 3"]),
        "d": (",", True, ["id_client", "nom"]),
        "e": (";", True, ["a, b", "c", "d"]),
        "f": (",", True, ["1", "2"]),
        "g": (",", True, ["x"]),
    }


@pytest.mark.parametrize("method", ["head", "scan"])
def test_reading_mixed_files(spark, tmp_path, method):
    path = write(
        tmp_path, a=BOM + "id;cp\r\n1;2\r\n\r\n".encode(), **{"b b+%41[x]": "cp,id\n3,4\n"}, c="9,8,7\n", d="id,cp\n"
    )
    df = read_delimited(spark, path, sniff=method)
    assert set(df.columns) == {"id", "cp", "Col 1", "Col 2", "Col 3"}
    assert cells(df.select("id", "cp", "Col 3")) == [["1", "2", None], ["4", "3", None], [None, None, "7"]]


def test_uneven_rows_blank_lines_and_quotes(spark, tmp_path):
    path = write(tmp_path, a='a,b,c\n1,,3\n\n2\n3,"x,""y""",\n4,5,6,7,8\n"q,r",""\n')
    df = read_delimited(spark, path)
    assert cells(df) == [
        ["1", "", "3"], ["2", None, None], ["3", 'x,"y"', ""], ["4", "5", "6"], ["q,r", "", None],
    ]
    # the same when only some columns are asked for
    assert cells(df.select("c")) == [[""], ["3"], ["6"], [None], [None]]
    assert df.count() == 5 and count_rows(df).first()["total"] == 5


def test_everything_is_text(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path, a="a,b\n1,2020-01-01\n"))
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string"]


def test_line_ends_in_quotes(spark, tmp_path):
    path = write(tmp_path, a='a,b\n"x\ny",1\n"z",2\n')
    assert cells(read_delimited(spark, path, multiline=True)) == [["x\ny", "1"], ["z", "2"]]


def test_header_only_and_nothing(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path, a="a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "empty"))


def test_preview_and_sample(spark):
    df = spark.range(300).select(F.col("id"), F.lit(None).cast("string").alias("x"))
    assert preview(df).count() == 200 and list(preview(df, 1).first()) == ["0", ""]
    assert sample(df).count() == 300 and sample(df, 10).count() == 10


FIRST_ROWS = [
    "1,Nora,Lefebvre,nora.lefebvre.1@bnc.example,873-900-4020,8647 Chemin King,Laval,QC,G6T7G4,1956-02-01,72635",
    "2,Antoine,Pelletier,antoine.pelletier.2@bnc.example,418-570-1760,7557 Boulevard Victoria,Repentigny,QC,G1J9J6,1982-07-07,67238",
    "3,Liam,Deschamps,liam.deschamps.3@bnc.example,418-344-2036,710 Rue Frontenac,Terrebonne,QC,H1S3H8,1989-09-05,43403",
]


def test_generator_first_rows(spark):
    assert [",".join(r) for r in synth_clients(spark, 3).orderBy(F.col("id_client").cast("int")).collect()] == FIRST_ROWS


def test_generator_does_not_depend_on_partitions(spark):
    runs = [
        [tuple(r) for r in synth_clients(spark, 2000, partitions=p).orderBy(F.col("id_client").cast("int")).collect()]
        for p in (1, 3, 8)
    ]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2000


def test_generator_states_equal_stepping():
    x, want = np.array([42], dtype=np.uint32), []
    for _ in range(500):
        want.append(int(x[0]))
        for _ in range(synthetic.DRAWS):
            x = synthetic._step(x)
    rows = np.array([1, 500, 77, 2, 256, 257])
    got = synthetic.row_states(rows, 42, synthetic._row_jumps())
    assert [int(v) for v in got] == [want[r - 1] for r in rows]


def test_generator_plausible(spark):
    df = synth_clients(spark, 3000)
    assert df.columns[0] == "id_client" and len(df.columns) == 11
    bad = df.filter(
        ~F.col("code_postal").rlike("^[GHJ][0-9][A-Z][0-9][A-Z][0-9]$")
        | ~F.col("date_naissance").rlike("^(19[4-9][0-9]|200[0-5])-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$")
        | F.try_to_date("date_naissance").isNull()
        | ~F.col("telephone").rlike("^[0-9]{3}-[2-9][0-9]{2}-[0-9]{4}$")
        | ~F.col("revenu_annuel").cast("int").between(22000, 200000)
        | F.col("email").rlike("[^a-z0-9.@]")
    )
    assert bad.count() == 0
    with pytest.raises(ValueError):
        synth_clients(spark, 1, seed=0)


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_header_longer_than_the_first_block(spark, tmp_path):
    names = [f"column_number_{i}" for i in range(8000)]
    path = put(tmp_path / "wide", "a.csv", ",".join(names) + "\n" + ",".join(map(str, range(8000))) + "\n")
    df = read_delimited(spark, path)
    assert df.columns == names and df.select(names[-1]).first()[0] == "7999"


def test_header_with_quotes_line_ends_and_repeated_names(spark, tmp_path):
    path = put(tmp_path / "q", "a.csv", '"Last, First",id,ID,"say ""x""",,"two\nlines"\nA,1,2,3,4,5\n')
    df = read_delimited(spark, path)
    assert df.columns == ["Last, First", "id", "ID_2", 'say "x"', "Col 5", "two\nlines"]
    assert list(df.first()) == ["A", "1", "2", "3", "4", "5"]


def test_identifier_behind_a_quoted_header_is_hashed(spark, tmp_path):
    path = put(tmp_path / "raw", "a.csv", '"Nom, Prenom",id_client\n"Roy, Jo",123\n')
    done = read_delimited(spark, fixed_file_job(spark, path + "/", str(tmp_path / "out"), salt="change-me-salt"))
    assert list(done.first()) == ["Roy, Jo", "884fa0900172"]


def test_line_ends_in_quotes_stay_in_their_cell(spark, tmp_path):
    path = put(tmp_path / "lines", "a.csv", 'id,adresse,revenu_annuel\n1,"12 rue\nKing",50000\n')
    assert list(read_delimited(spark, path).first()) == ["1", "12 rue\nKing", "50000"]
    done = read_delimited(spark, fixed_file_job(spark, path, str(tmp_path / "done")))
    assert list(done.first()) == ["1", "12 rue\nKing", "40-60k"]
    (tmp_path / "in").mkdir()
    stream = stream_delimited(spark, path, ["id", "adresse", "revenu_annuel"])
    start(stream, str(tmp_path / "streamed"), str(tmp_path / "checkpoint"), file_format="parquet").wait()
    assert list(spark.read.parquet(str(tmp_path / "streamed")).first()) == ["1", "12 rue\nKing", "40-60k"]


def test_short_row_with_a_very_long_quoted_cell(spark, tmp_path):
    cell = 'x""y ' * 60000
    path = put(tmp_path / "long", "a.csv", f'id,text,last\n1,"{cell}"\n2,,\n3,"a,b",\n')
    rows = {r[0]: r for r in read_delimited(spark, path).collect()}
    assert rows["1"][1] == cell.replace('""', '"') and rows["1"][2] is None
    assert list(rows["2"]) == ["2", "", ""] and list(rows["3"]) == ["3", "a,b", ""]


def test_more_headers_than_any_limit(spark, tmp_path):
    for i in range(230):
        put(tmp_path / "many", f"{i}.csv", f"id{'|' if i < 0 else ','}c{i % 226}\n{i},v{i}\n")
    df = read_delimited(spark, str(tmp_path / "many"), multiline=False)
    assert len(df.columns) == 227
    rows = {r["id"]: r.asDict() for r in df.collect()}
    assert len(rows) == 230 and rows["7"]["c7"] == "v7" and rows["7"]["c8"] is None and rows["229"]["c3"] == "v229"


def test_files_of_several_delimiters_and_one_without_header(spark, tmp_path):
    put(tmp_path / "mix", "a.csv", "id;nom\n1;x\n2;\n")
    put(tmp_path / "mix", "b.csv", "nom,id,autre\ny,3,z\nw,4\n")
    put(tmp_path / "mix", "c.csv", "7,8,9")
    rows = sorted((r.asDict() for r in read_delimited(spark, str(tmp_path / "mix")).collect()), key=repr)
    told = {(r["id"], r["nom"], r["autre"], r["Col 1"]) for r in rows}
    assert told == {("1", "x", None, None), ("2", "", None, None), ("3", "y", "z", None), ("4", "w", None, None), (None, None, None, "7")}


def test_own_columns_of_reserved_names(spark, tmp_path):
    path = put(tmp_path / "names", "a.csv", "_uneven_row,b\n1,2\n3\n")
    assert [list(r) for r in read_delimited(spark, path).collect()] == [["1", "2"], ["3", None]]
    df = spark.createDataFrame([("1", "a")], "_q0 string, x string")
    with pytest.raises(ValueError, match="rename"):
        anonymize(df, Roles(qids=("x",)))


def test_output_name_of_a_folder():
    assert anonymized_name("s3://landing/clients/") == "s3://landing/clients-anon.csv"
