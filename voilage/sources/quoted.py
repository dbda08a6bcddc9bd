"""Records of delimited text whose quoted cells hold line ends, read in as many tasks as the text has splits.

A split of a file may begin inside a quoted cell, and what its first line means depends on all
splits before it. So the lines are read twice by Spark's own text source:

1. Each split is run through a two-state automaton (outside or inside quotes at the start of a
   line) from both states. A fold over the splits of a file, in order, then tells the true state
   at the start of each: one small row a split.
2. Each split forms its records from its true state. Records that cross into other splits are
   left as fragments, a few a split, and put together by file and order.

The states meet the lines as a broadcast table, whose size is known by then; above ``MOST_SPLITS``
splits, or where Spark would cut the text otherwise the second time, files are read whole by one
task each, or the job stops.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voilage.session import materialize

RECORD_CHARS = 1 << 26  # characters of a longest record; more are taken for a quote that is never closed
MOST_SPLITS = 1_000_000  # rows of 17 bytes in the broadcast table of states
PIECE_BYTES = 1 << 20  # of lines that are worked on at a time
FEW_FILES = 1000  # files named one by one where only some are read again
MARK = "\ufeff"  # of the byte order, before a file's first line
ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII")  # of one byte an ASCII character, so that lines are found before decoding


class Quotes:
    """The automaton for one delimiter: a quote opens a cell only at its start, a doubled one stays inside."""

    def __init__(self, delimiter: str) -> None:
        d = re.escape(delimiter)
        body = r'(?:[^"]++|"")*+"'
        cell = rf'(?:"{body}|(?!"))[^{d}]*+'
        self.closed_from = {
            False: re.compile(rf"{cell}(?:{d}{cell})*+").fullmatch,
            True: re.compile(rf"{body}[^{d}]*+(?:{d}{cell})*+").fullmatch,
        }

    def inside_after(self, line: str, inside: bool) -> bool:
        return self.closed_from[inside](line) is None if '"' in line else inside


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches cut where another split begins, with its file and start, into pieces of some bytes.

    A batch has a number of lines, however long they are; what is made of a piece is several times its size.
    """
    for batch in batches:
        starts, files, at = batch.column("start"), batch.column("file"), 0
        while at < len(batch):
            key = (files[at].as_py(), starts[at].as_py())
            same = pc.and_(pc.equal(files.slice(at), key[0]), pc.equal(starts.slice(at), key[1]))
            other = pc.index(same, False).as_py()
            size = len(batch) - at if other < 0 else other
            part = batch.slice(at, size)
            step = max(1, size * PIECE_BYTES // max(1, part.nbytes))
            for i in range(0, size, step):
                yield key, part.slice(i, step)
            at += size


def _quoted_places(lines: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()


def _transitions(delimiter: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, start, from_outside, from_inside): whether each split ends inside quotes, begun in either state."""

    def told(key: tuple[str, int], ends: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "start": [key[1]], "from_outside": [ends[0]], "from_inside": [ends[1]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, current, ends = Quotes(delimiter), None, [False, True]
        for key, part in _segments(batches):
            begins = key != current
            if begins:
                if current is not None:
                    yield told(current, ends)
                current, ends = key, [False, True]
            lines = part.column("value")
            for i in _quoted_places(lines):
                line = lines[i].as_py()
                if begins and i == 0 and key[1] == 0:
                    line = line.removeprefix(MARK)
                first = quotes.inside_after(line, ends[0])
                ends = [first, first if ends[0] == ends[1] else quotes.inside_after(line, ends[1])]
        if current is not None:
            yield told(current, ends)

    return run


# kinds of rows that come out of a split
WHOLE, HEAD_CLOSED, HEAD_OPEN, TAIL, HEADER_TAIL = range(5)


@dataclass
class _Split:
    """Forms the records of one split."""

    file: str
    start: int
    inside: bool
    header: bool
    quotes: Quotes
    end: str
    open_lines: list[str] = field(default_factory=list)
    size: int = 0
    is_head: bool = False  # the open record began in an earlier split
    fresh: bool = True  # the file's first record was not seen
    begins: bool = True  # no line of the file was seen
    out: list[tuple[int, str]] = field(default_factory=list)  # fragments
    whole: list[pa.Array] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.is_head = self.inside
        self.fresh = self.begins = self.start == 0

    def take(self, lines: pa.Array) -> None:
        at = 0
        for i in [*_quoted_places(lines), len(lines)]:
            self._plain(lines.slice(at, i - at))
            self.begins &= i == 0
            if i < len(lines):
                self._quoted(lines[i].as_py())
                self.begins = False
            at = i + 1

    def _plain(self, lines: pa.Array) -> None:
        """Lines without quotes: records as they are, or more of the open one."""
        if not len(lines):
            return
        if self.inside:
            for line in lines.to_pylist():
                self._add(line)
            return
        if self.fresh:  # at the file's first lines only
            at = 0
            while at < len(lines) and not lines[at].as_py().strip(MARK + "\r"):
                at += 1
            if at < len(lines):
                self._record(lines[at].as_py().removeprefix(MARK))
            lines = lines.slice(min(at + 1, len(lines)))
        self.whole.append(lines)

    def _quoted(self, line: str) -> None:
        if self.begins:
            line = line.removeprefix(MARK)
        after = self.quotes.inside_after(line, self.inside)
        self._add(line)
        if not after:
            text, self.open_lines, self.size = self.end.join(self.open_lines), [], 0
            if self.is_head:
                self.out.append((HEAD_CLOSED, text))
                self.is_head = False
            else:
                self._record(text)
        self.inside = after

    def _add(self, line: str) -> None:
        self.open_lines.append(line)
        self.size += len(line) + 1
        if self.size > RECORD_CHARS:
            raise ValueError(f"{self.file}: a record of more than {RECORD_CHARS} characters; is a quote never closed?")

    def _record(self, text: str) -> None:
        if self.fresh:
            self.fresh = False
            if self.header:
                return
        self.whole.append(pa.array([text], pa.string()))

    def finish(self) -> None:
        if self.inside:
            kind = HEAD_OPEN if self.is_head else HEADER_TAIL if self.fresh and self.header else TAIL
            self.out.append((kind, self.end.join(self.open_lines)))

    def ready(self) -> Iterator[pa.RecordBatch]:
        """The whole records so far."""
        if self.whole:
            texts = pc.utf8_rtrim(pa.concat_arrays([x.cast(pa.string()) for x in self.whole]), "\r")
            self.whole.clear()
            texts = texts.filter(pc.not_equal(texts, ""))
            if len(texts):
                yield self._rows([WHOLE] * len(texts), texts)

    def fragments(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield self._rows([k for k, _ in self.out], pa.array([t for _, t in self.out], pa.string()))

    def _rows(self, kinds: list[int], texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.repeat(self.file, n), pa.repeat(pa.scalar(self.start, pa.int64()), n), pa.array(kinds, pa.int32()), texts]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "record"])


def _formed(
    delimiter: str, end: str, header: bool, fragments: bool, crossing: frozenset[str] | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records of each split, or only its fragments; ``crossing`` names the files whose splits may end inside quotes (None: any)."""

    def ended(split: _Split) -> Iterator[pa.RecordBatch]:
        split.finish()
        if split.inside and crossing is not None and split.file not in crossing:
            raise ValueError(f"{split.file} {UNCLOSED}")
        return split.fragments() if fragments else split.ready()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, split = Quotes(delimiter), None
        for key, part in _segments(batches):
            if split is None or key != (split.file, split.start):
                if split is not None:
                    yield from ended(split)
                inside = part.column("inside")[0].as_py()
                if inside is None:
                    raise ValueError(f"{key[0]} was cut at byte {key[1]} only the second time it was read; run the job again")
                split = _Split(*key, inside, header, quotes, end)
            split.take(part.column("value"))
            if fragments:
                split.whole.clear()
            else:
                yield from split.ready()
        if split is not None:
            yield from ended(split)

    return run


UNCLOSED = "ends inside quotes that are never closed"
_ROW = "file string, start bigint, kind int, record string"


def _text(spark: SparkSession, path: str | list[str], end: str, encoding: str) -> DataFrame:
    lines = spark.read.option("lineSep", end).text(path)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    start = F.col("_metadata.file_block_start")
    return lines.select(F.col("_metadata.file_path").alias("file"), start.alias("start"), value.alias("value"))


def _states(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, start, inside, crosses): the true state at the start of each split, and whether a record crosses one of its ends."""
    ends = lines.mapInArrow(_transitions(delimiter), "file string, start bigint, from_outside boolean, from_inside boolean")
    in_order = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "from_outside", "from_inside"))).alias("splits"))

    def turn(state, split):
        after = F.when(state["inside"], split["from_inside"]).otherwise(split["from_outside"])
        one = F.struct(split["start"].alias("start"), state["inside"].alias("inside"), (state["inside"] | after).alias("crosses"))
        return F.struct(after.alias("inside"), F.array_append(state["seen"], one).alias("seen"))

    begin = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<start:bigint,inside:boolean,crosses:boolean>>").alias("seen"))
    return materialize(in_order.select("file", F.inline(F.aggregate("splits", begin, turn)["seen"])))


def may_be_split(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether any file is large enough for Spark to cut it."""
    conf = spark._jsparkSession.sessionState().conf()
    least = min(int(conf.filesOpenCostInBytes()), int(conf.filesMaxPartitionBytes()))
    files = spark.read.format("binaryFile").load([path] if isinstance(path, str) else list(path))  # a listing, no content
    return not files.where(F.col("length") > least).select("length").isEmpty()


def records(
    spark: SparkSession, path: str | list[str], delimiter: str, *, header: bool, end: str = "\n", encoding: str = "UTF-8"
) -> DataFrame | None:
    """(file, record): every record of the files but their headers and blank lines, in many tasks.

    None where there are more splits than their states may be broadcast for. A file that ends
    inside quotes stops the job, as does a record of more than ``RECORD_CHARS`` characters.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {', '.join(ENCODINGS)}")
    lines = _text(spark, path, end, encoding)
    first = lines.withColumn("inside", F.when(F.col("start") == 0, F.lit(False)))
    if not may_be_split(spark, path):
        return first.mapInArrow(_formed(delimiter, end, header, False, frozenset()), _ROW).select("file", "record")
    states = _states(lines, delimiter)
    size = states.agg(F.count_if(F.col("start") > 0).alias("n"), F.count_if("inside").alias("inside")).first()
    if size["n"] > MOST_SPLITS:
        return None
    crossing: frozenset[str] | None = frozenset()
    if size["n"]:
        first = _met(lines, states.where("start > 0")).withColumn("inside", F.coalesce("inside", F.when(F.col("start") == 0, F.lit(False))))
    if size["inside"]:
        files = [r["file"] for r in states.where("inside").select("file").distinct().limit(FEW_FILES + 1).collect()]
        crossing = frozenset(files) if len(files) <= FEW_FILES else None
    whole = first.mapInArrow(_formed(delimiter, end, header, False, crossing), _ROW).select("file", "record")
    if crossing is not None and not crossing:
        return whole
    # all files are read, and the others' lines dropped behind the join: a filter by file would leave
    # Spark less to read, which it would cut into other splits
    some = _met(lines, states.where("crosses"), "inner")
    return whole.unionByName(_assembled(some.mapInArrow(_formed(delimiter, end, header, True, crossing), _ROW), end))


def _met(lines: DataFrame, states: DataFrame, how: str = "left") -> DataFrame:
    """The lines with the state their split begins in; two hashes stand for file and start, so that a broadcast row is small."""
    a, b = F.xxhash64("file", "start"), F.xxhash64("start", "file")
    told = F.broadcast(states.select(a.alias("_a"), b.alias("_b"), F.col("inside")))
    return lines.join(told, (a == F.col("_a")) & (b == F.col("_b")), how).select("file", "start", "inside", "value")


def _assembled(fragments: DataFrame, end: str) -> DataFrame:
    """Records that lie in more than one split, put together."""
    head = F.col("kind").isin(HEAD_CLOSED, HEAD_OPEN)
    found = materialize(fragments)
    in_file = Window.partitionBy("file").orderBy("start", F.when(head, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    numbered = found.withColumn("number", F.count_if(~head).over(in_file))
    parts = F.array_sort(F.collect_list(F.struct("start", "record")))
    closed, is_header = F.bool_or(F.col("kind") == HEAD_CLOSED), F.bool_or(F.col("kind") == HEADER_TAIL)
    made = numbered.groupBy("file", "number").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), end).alias("record"), closed.alias("closed"), is_header.alias("is_header")
    )
    failed = F.raise_error(F.concat("file", F.lit(f" {UNCLOSED}")))
    checked = made.where(~F.col("is_header")).select("file", F.when(F.col("closed"), F.col("record")).otherwise(failed).alias("record"))
    return checked.select("file", F.regexp_replace("record", "\r$", "").alias("record"))
