"""Row-level rules on a stream of files, of one dialect or of any.

Only stateless treatments: k, l and t are statements about a whole table, and would
hold only inside each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from voilage.operators.rules import fixed_rules
from voilage.sources.delimited import dialect, escaped, read_delimited, sniff_delimiters, tell_empty_from_absent


def stream_delimited(
    spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", max_files: int | None = None,
    *, multiline: bool = True,
) -> DataFrame:
    """New delimited files below ``path`` as they arrive, every cell text.

    Line ends inside quotes are kept at the price of one task per file.
    """
    reader = dialect(spark.readStream, delimiter, columns, multiline=multiline)
    cells = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).csv(path)
    return tell_empty_from_absent(cells, delimiter, columns)


def stream_parquet(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


@dataclass
class StreamRun:
    """A running query and the rows each of its batches has read."""

    query: StreamingQuery
    _by_batch: dict[int, int] = field(default_factory=dict)

    def rows_read(self) -> int:
        """Rows read so far in this run.

        The query keeps only its latest reports, so call this, or wait, while it runs.
        """
        self._by_batch.update({p["batchId"]: p["numInputRows"] for p in self.query.recentProgress})
        return sum(self._by_batch.values())

    def wait(self, every: float = 0.5) -> StreamRun:
        """Wait for the end, taking in the reports as they come."""
        while not self.query.awaitTermination(every):
            self.rows_read()
        self.rows_read()
        return self


def start(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    *,
    treat: Callable[[DataFrame], DataFrame] = fixed_rules,
    file_format: str = "csv",
    available_now: bool = True,
) -> StreamRun:
    """Treat each row and append to files at ``target``, each row exactly once.

    ``checkpoint`` must lie in shared storage; a restarted run goes on from there.
    """
    writer = (
        treat(stream)
        .writeStream.format(file_format)
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )
    if file_format == "csv":
        writer = writer.option("header", True).option("emptyValue", "").option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return StreamRun((writer.trigger(availableNow=True) if available_now else writer).start())


# --- files of any dialect ----------------------------------------------------------------


@dataclass
class MixedRun:
    """A stream of files whose delimiter and header are found file by file."""

    spark: SparkSession
    query: StreamingQuery
    target: str

    def wait(self) -> MixedRun:
        self.query.awaitTermination()
        return self

    def rows(self) -> DataFrame:
        """The rows written so far; columns that a batch did not have are NULL."""
        return self.spark.read.option("mergeSchema", True).parquet(self.target).drop("batch")


def start_mixed(
    spark: SparkSession,
    path: str,
    target: str,
    checkpoint: str,
    *,
    treat: Callable[[DataFrame], DataFrame] = fixed_rules,
    max_files: int = 1000,
    available_now: bool = True,
) -> MixedRun:
    """Delimited files of any delimiter and header below ``path``, treated as they arrive.

    The stream itself carries only the new files' names, ``max_files`` a batch at most; a batch
    sniffs its files, keeps what it found in ``<checkpoint>/dialects``, and reads them as a table.
    Everything a batch leaves is a folder named after it, which a repeated batch replaces: each
    file's rows are written once, and counted once (see ``counted_rows``), also over restarts.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    names = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path)

    def batch(files: DataFrame, number: int) -> None:
        found = [r["path"] for r in files.select("path").collect()]  # at most max_files
        if not found:
            return
        session = files.sparkSession
        dialects = sniff_delimiters(session, [escaped(f) for f in found])
        dialects.write.mode("overwrite").parquet(f"{checkpoint}/dialects/batch={number}")
        kept = session.read.parquet(f"{checkpoint}/dialects/batch={number}")
        rows = treat(read_delimited(session, [escaped(f) for f in found], dialects=kept))
        _write_counted(rows, target, checkpoint, number)

    writer = names.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream")
    return MixedRun(spark, (writer.trigger(availableNow=True) if available_now else writer).start(), target)


# --- counts over restarts ------------------------------------------------------------------


def _write_counted(rows: DataFrame, target: str, checkpoint: str, number: int) -> None:
    """Write a batch, and the number of its rows, under the batch's number."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").parquet(f"{target}/batch={number}")
    one = rows.sparkSession.range(1).select(F.lit(seen.get["rows"]).cast("bigint").alias("rows"))
    one.write.mode("overwrite").parquet(f"{checkpoint}/counts/batch={number}")


def start_counted(
    stream: DataFrame, target: str, checkpoint: str, *, treat: Callable[[DataFrame], DataFrame] = fixed_rules, available_now: bool = True
) -> StreamingQuery:
    """Treat each row and write the batches as folders of ``target``, each row once; ``counted_rows`` tells how many.

    Unlike the numbers of ``StreamRun``, which are those of one run, the counts lie with the
    checkpoint: a stopped and resumed stream goes on counting, and a repeated batch replaces its count.
    """

    def batch(rows: DataFrame, number: int) -> None:
        _write_counted(treat(rows), target, checkpoint, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counted_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row (total): rows of all batches so far, over all runs."""
    counts = spark.read.schema("rows bigint, batch bigint").parquet(f"{checkpoint}/counts")
    return counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
