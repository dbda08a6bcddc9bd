"""Delimited text: sniffing the dialect of many files, then scanning them as text cells."""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voilage.columns import field, text_or_empty
from voilage.functions.delimited import delimiter_of, first_line, header_names, looks_like_header
from voilage.session import materialize
from voilage.sources.quoted import ENCODINGS, FEW_FILES, records

HEAD_BYTES = 64 * 1024  # the delimiter is judged by the first line within these; a header may be longer


# --- the first record of a file ------------------------------------------------------


class UnclosedQuote(ValueError):
    """A quoted cell that does not end."""


def record_end(text: str, delimiter: str, at: int = 0) -> int:
    """Where the record that starts at ``at`` ends: at a line end outside quotes, or -1 if none is there.

    A line end is a line feed, a carriage return, or both. A quote opens a quoted cell only at the
    cell's start; a doubled quote stays inside. Raises ``UnclosedQuote`` if the text ends inside one.
    """
    stop, n = re.compile(rf"[\r\n]|{re.escape(delimiter)}"), len(text)
    while at < n:
        if text[at] == '"':
            at = text.find('"', at + 1)
            while 0 <= at < n - 1 and text[at + 1] == '"':
                at = text.find('"', at + 2)
            if at < 0:
                raise UnclosedQuote
            at += 1
        found = stop.search(text, at)
        if not found:
            return -1
        if found.group() != delimiter:
            return found.start()
        at = found.end()
    return -1


def line_end(text: str, at: int) -> str:
    """The line end that stands at a place: ``\\n`` (a carriage return may stand before it) or ``\\r``."""
    return "\r" if text[at : at + 1] == "\r" and text[at + 1 : at + 2] != "\n" else "\n"


def _delimiter(text: str) -> str:
    """The most frequent of comma, semicolon and tab in the first line; ties go in that order."""
    line = re.split("[\r\n]", text, maxsplit=1)[0]
    return max(",;\t", key=lambda d: (line.count(d), -",;\t".index(d)))


def header_cells(record: str, delimiter: str) -> list[str]:
    """The cells of one record; quotes around a cell are taken off and doubled quotes are one."""
    d = re.escape(delimiter)
    cell, at, cells = re.compile(rf'(?:"((?:[^"]++|"")*+)")?([^{d}]*+)({d}|\Z)'), 0, []
    while True:
        found = cell.match(record, at)
        quoted, plain = found.group(1), found.group(2)
        cells.append(plain if quoted is None else quoted.replace('""', '"') + plain)
        at = found.end()
        if not found.group(3):
            return cells


HEADER_CHARS = 1 << 24  # characters of a longest header; more are taken for a quote that is never closed


def _first_record(stream, file: str, encoding: str = "UTF-8") -> tuple[str, str, bool, str]:
    """(first line, first record, whether something follows it, its line end), reading no further than needed."""
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    head = text = decoder.decode(stream.read(HEAD_BYTES)).removeprefix("\ufeff")
    step, ended, delimiter = HEAD_BYTES, len(text) == 0, _delimiter(head.lstrip("\r\n"))
    while True:
        start = len(text) - len(text.lstrip("\r\n"))
        try:
            end = record_end(text, delimiter, start)
        except UnclosedQuote:
            if ended:
                raise ValueError(f"{file}: a quote in the first record is never closed") from None
            end = -1
        if ended or (end >= 0 and text[end:].strip("\r\n")):
            record = text[start : end if end >= 0 else len(text)]
            line = re.split("[\r\n]", head.lstrip("\r\n"), maxsplit=1)[0]
            more = end >= 0 and bool(text[end:].strip("\r\n"))
            return line, record, more, line_end(text, end) if end >= 0 else "\n"
        if end < 0 and len(text) - start > HEADER_CHARS:
            raise ValueError(f"{file}: the first record has more than {HEADER_CHARS} characters; is a quote never closed?")
        block = stream.read(step)
        ended, step = not block, step * 2
        text += decoder.decode(block, final=ended)


def _open(file: str):
    """One file's bytes, inside a task. Spark gives paths unescaped."""
    from pyarrow import fs

    scheme, _, rest = file.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(scheme + ":" + quote(rest))
    return store.open_input_stream(inner)


def _heads(encoding: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch["file"]:
                with _open(file) as stream:
                    rows.append((file, *_first_record(stream, file, encoding)))
            yield pd.DataFrame(rows, columns=["file", "line", "record", "more", "line_end"])

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells_of(records: pd.Series, delimiters: pd.Series) -> pd.Series:
    return pd.Series([header_cells(r, d) for r, d in zip(records, delimiters)])


def _file_name(path: str = "_metadata.file_path") -> Column:
    """The path of a row's file, as a listing spells it."""
    encoded = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(encoded), "^file:/+", "file:/")


def _records(spark: SparkSession, path: str | list[str], method: str, encoding: str) -> DataFrame:
    """(file, line, record, more, line_end): each file's first line and record, and whether another filled line follows."""
    if method == "head":
        paths = [path] if isinstance(path, str) else list(path)
        files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"))  # a listing, no content
        return files.mapInPandas(_heads(encoding), "file string, line string, record string, more boolean, line_end string")
    if method == "scan":
        lines = spark.read.text(path).select(
            _file_name().alias("file"),
            (F.col("_metadata.file_block_start") == 0).alias("starts"),
            F.monotonically_increasing_id().alias("i"),
            (F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)).alias("line"),
        )
        filled = F.col("line") != ""
        # numbers only are folded; the few first lines are fetched by their number
        first = lines.groupBy("file").agg(
            F.min(F.when(F.col("starts") & filled, F.col("i"))).alias("i"), (F.count_if(filled) > 1).alias("more")
        )
        named = first.join(lines.select(F.col("i").alias("j"), "line"), F.col("i") == F.col("j"), "left")
        line = F.coalesce(first_line(F.col("line")), F.lit(""))
        return named.select("file", line.alias("line"), line.alias("record"), "more", F.lit("\n").alias("line_end"))
    raise ValueError("method is 'head' or 'scan'")


def sniff_delimiters(spark: SparkSession, path: str | list[str], method: str = "head", encoding: str = "UTF-8") -> DataFrame:
    """(file, delimiter, has_header, columns, line_end) for every file below ``path``.

    ``head`` reads each file inside Spark tasks up to the end of its first record, line ends in
    quotes included, and stops with an error where a quote of it is never closed. ``scan`` reads
    the files through Spark's own text source, for stores only that can reach; there a header is
    one line, and lines are taken to end in line feeds. ``encoding`` is one of ``ENCODINGS``.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {', '.join(ENCODINGS)}")
    lines = _records(spark, path, method, encoding).withColumn("delimiter", delimiter_of(F.col("line")))
    cells = lines.withColumn("cells", _cells_of("record", "delimiter"))
    # only a file of one single record may have no header
    named = F.col("more") | looks_like_header(F.col("cells"))
    return cells.select(
        "file",
        "delimiter",
        named.alias("has_header"),
        F.when(named, F.col("cells")).otherwise(header_names(F.col("cells"))).alias("columns"),
        "line_end",
    )


# --- scanning ------------------------------------------------------------------------


def distinct_names(names: Sequence[str]) -> list[str]:
    """Column names that differ even without regard to case: repeated ones are numbered, empty ones named by place."""
    used, out = set(), []
    for i, name in enumerate(names):
        name = name or f"Col {i + 1}"
        unique, n = name, 1
        while unique.lower() in used:
            n += 1
            unique = f"{name}_{n}"
        used.add(unique.lower())
        out.append(unique)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _distinct_names(columns: pd.Series) -> pd.Series:
    return pd.Series([distinct_names(list(c)) for c in columns])


def text_schema(columns: list[str]) -> T.StructType:
    """Every column as text; types are never inferred."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    *,
    delimiter: str | None = None,
    columns: list[str] | None = None,
    multiline: bool = True,
    sniff: str = "head",
    encoding: str = "UTF-8",
    line_end: str = "\n",
    dialects: DataFrame | None = None,
) -> DataFrame:
    """Delimited files as text columns.

    A short row leaves its missing cells NULL, an empty cell is empty text, extra
    cells and blank lines are dropped. Give ``delimiter`` and ``columns`` to skip the
    sniffing, and ``line_end="\\r"`` with them for files that have no line feeds. A
    repeated column name gets a number. Line ends inside quotes are kept: large files are
    split all the same, at the price of reading them twice (see ``sources.quoted``);
    ``multiline=False`` reads once where no cell holds a line end. A quote that is never
    closed stops the job. ``encoding`` is UTF-8, ISO-8859-1 or US-ASCII. ``dialects`` may give
    what ``sniff_delimiters`` told of these files before.

    Files may differ in delimiter and header. There is one scan per delimiter (and per
    having a header or not); files of different headers in it are read as numbered
    cells, and each row's cells are named by its own file's header.
    """
    if delimiter and columns:
        return _scan(spark, path, delimiter, columns, True, multiline, encoding, line_end)
    found = sniff_delimiters(spark, path, sniff, encoding) if dialects is None else dialects
    found = found.withColumn("columns", F.array(*map(F.lit, columns)) if columns else _distinct_names("columns"))
    found = materialize(found.withColumn("delimiter", F.lit(delimiter)) if delimiter else found)
    dialects = found.groupBy("delimiter", "has_header", "line_end").agg(
        F.max(F.size("columns")).alias("width"), F.min("columns").alias("columns"), (F.min("columns") == F.max("columns")).alias("alike")
    )
    dialects = dialects.orderBy("delimiter", "has_header", "line_end").collect()  # at most twelve
    if not dialects:
        raise ValueError("no file to read")
    if len(dialects) == 1 and dialects[0]["alike"]:
        d = dialects[0]
        return _scan(spark, path, d["delimiter"], list(d["columns"]), d["has_header"], multiline, encoding, d["line_end"])
    # the schema: every name once, in the order of files and places
    every = found.select("file", F.posexplode("columns").alias("i", "name"))
    order = every.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("file", "i", "name")).alias("first")).orderBy("first")
    names = [r["first"]["name"] for r in order.collect()]
    places = F.array(*[F.array_position(F.transform("columns", F.lower), F.lit(n.lower())) - 1 for n in names])
    files = found.select(F.col("file").alias("_file"), "delimiter", "has_header", "line_end", places.alias("_places"))
    whole = None
    for d in dialects:
        alike = [F.col(c) == F.lit(d[c]) for c in ("delimiter", "has_header", "line_end")]
        own = files.where(functools.reduce(lambda a, b: a & b, alike))
        cells = [f"c{i}" for i in range(d["width"])]
        some = _named(own, path)
        rows = _scan(spark, some, d["delimiter"], cells, d["has_header"], multiline, encoding, d["line_end"], with_file=True)
        rows = rows.withColumn("_cells", F.array(*cells)).join(own.select("_file", "_places"), "_file")
        part = rows.select(*[F.get("_cells", F.get("_places", F.lit(i)).cast("int")).alias(n) for i, n in enumerate(names)])
        whole = part if whole is None else whole.unionByName(part)
    return whole


def uneven_name(columns: Sequence[str]) -> str:
    """A name for the raw text of uneven rows that no column has."""
    name, used = "_uneven_row", {c.lower() for c in columns}
    while name in used:
        name += "_"
    return name


def dialect(reader, delimiter: str, columns: list[str], header: bool = True, multiline: bool = False):
    """A batch or stream reader set up for text cells, with the raw text of uneven rows kept.

    Column pruning stays off in the parser: with it, an uneven row goes unnoticed.
    """
    uneven = uneven_name(columns)
    return (
        reader.schema(text_schema([*columns, uneven]))
        .option("columnNameOfCorruptRecord", uneven)
        .option("columnPruning", False)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("header", header)
        .option("enforceSchema", True)
        .option("multiLine", multiline)
        .option("maxColumns", max(20480, len(columns) + 2))
        .option("mode", "PERMISSIVE")
        .option("emptyValue", "")
    )


def tell_empty_from_absent(df: DataFrame, delimiter: str, columns: list[str]) -> DataFrame:
    """The reader gives NULL for an empty cell; only cells a short row lacks stay NULL.

    The number of an uneven row's cells is counted once per row. A doubled quote is two quoted
    pieces side by side, so quoted text is passed over without recursion, however long it is.
    """
    uneven = uneven_name(columns)
    bare = F.regexp_replace(field(uneven), '"[^"]*+"', "")
    last = F.length(bare) - F.length(F.translate(bare, delimiter, ""))
    counted = df.withColumn(uneven, F.coalesce(last, F.lit(len(columns))))
    cells = {c: F.when(field(c).isNull() & (field(uneven) >= i), F.lit("")).otherwise(field(c)) for i, c in enumerate(columns)}
    return counted.select(*[cells[c].alias(c) if c in cells else field(c) for c in df.columns if c != uneven])


def _named(files: DataFrame, path: str | list[str]) -> str | list[str]:
    """The files one by one where they are few, else the whole path, whose other files a join drops."""
    names = [r["_file"] for r in files.select("_file").limit(FEW_FILES + 1).collect()]
    return [escaped(n) for n in names] if len(names) <= FEW_FILES else path


def escaped(file: str) -> str:
    """A file's name as a path that is no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def _scan(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str,
    columns: list[str],
    header: bool,
    multiline: bool,
    encoding: str = "UTF-8",
    line_end: str = "\n",
    with_file: bool = False,
) -> DataFrame:
    found = records(spark, path, delimiter, header=header, end=line_end, encoding=encoding) if multiline else None
    if found is None:
        cells = dialect(spark.read, delimiter, columns, header, multiline).option("encoding", encoding).csv(path)
        if with_file:
            cells = cells.select("*", _file_name().alias("_file"))
    else:
        uneven = uneven_name(columns)
        schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in [*columns, uneven])
        options = {
            "sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "columnNameOfCorruptRecord": uneven,
            "maxColumns": str(max(20480, len(columns) + 2)), "multiLine": "true", "lineSep": line_end,
        }
        read = found.select(_file_name("file").alias("_file"), F.from_csv("record", schema, options).alias("row"))
        cells = read.select("row.*", "_file") if with_file else read.select("row.*")
    return tell_empty_from_absent(cells, delimiter, columns)


def preview(df: DataFrame, rows: int | None = 200) -> DataFrame:
    """The first rows, or all, every cell as text, absent cells as empty text."""
    shown = df.select(*[text_or_empty(c).alias(c) for c in df.columns])
    return shown if rows is None else shown.limit(rows)


def sample(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """The rows that profiling and scoring should look at: all, unless told otherwise."""
    return df if sample_rows is None else df.limit(sample_rows)


def count_rows(df: DataFrame) -> DataFrame:
    """One row (total)."""
    return df.agg(F.count(F.lit(1)).alias("total"))
