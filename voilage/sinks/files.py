"""What a run leaves behind: the table, its definition, reports and the journal."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from voilage import fixed_values as fixed
from voilage.columns import field
from voilage.config import ROLE_NAMES, Roles, Rule, Settings
from voilage.functions.text import escape_markup

JOURNAL_SCHEMA = "at timestamp, action string, data string, entry bigint"
_DEFINITION = (
    "meta struct<createdAt:string,delimiter:string>, "
    "settings struct<epsilon:double,kAnon:int,lDiv:int,tClose:double,zip3:boolean,yearOnly:boolean,"
    "hashIds:boolean,maskPII:boolean,suppressExtras:boolean,noiseRevenue:boolean>, "
    "mapping struct<id:string,postal:string,date1:string,date2:string,revenue:string,sensitive:string,"
    "qids:array<string>>, "
    "columns array<string>, "
    "transforms map<string,struct<action:string,param:struct<type:string,granularity:string,thresholds:array<double>,"
    "epsilon:double,round:int>>>"
)
# fixed names of the settings in a definition file, so that files can be exchanged
_SETTING_KEYS = {
    "epsilon": "epsilon", "k_anon": "kAnon", "l_div": "lDiv", "t_close": "tClose", "zip3": "zip3", "year_only": "yearOnly",
    "hash_ids": "hashIds", "mask_pii": "maskPII", "suppress_extras": "suppressExtras", "noise_revenue": "noiseRevenue",
}
_PARAM_KEYS = ("type", "granularity", "thresholds", "epsilon", "round")


def _settings(settings: Settings) -> dict[str, Any]:
    told = settings.exported()
    return {key: float(told[n]) if n in ("epsilon", "t_close") else told[n] for n, key in _SETTING_KEYS.items()}


def _param(param: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """A rule's parameters without its salt, which is a secret."""
    if not param:
        return None
    row = {k: param.get(k) for k in _PARAM_KEYS}
    row["thresholds"] = None if row["thresholds"] is None else [float(t) for t in row["thresholds"]]
    row["epsilon"] = None if row["epsilon"] is None else float(row["epsilon"])
    return row


# --- tables --------------------------------------------------------------------


def write_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    *,
    delimiter: str = ",",
    bom: bool = False,
    mode: str = "errorifexists",
    allow_empty: bool = False,
) -> None:
    """Write text files with a header, in parallel; absent cells become empty.

    ``bom`` puts a byte order mark before each part file's header. An empty table is
    refused unless ``allow_empty``: its rows are counted while they are written, and what
    was written is deleted again.
    """
    out = df.select(*[field(c) for c in (columns or df.columns)])
    counted = None if allow_empty else Observation()
    if counted is not None:
        out = out.observe(counted, F.count(F.lit(1)).alias("rows"))
    if bom:
        out = out.withColumnRenamed(out.columns[0], fixed.BYTE_ORDER_MARK + out.columns[0])
    _csv(out, delimiter, header=True).mode(mode).csv(path)
    if counted is not None and not counted.get["rows"]:
        delete(df.sparkSession, path)
        raise ValueError("there is no row to export")


def _csv(df: DataFrame, delimiter: str, header: bool) -> DataFrameWriter:
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return df.write.options(header=header, sep=delimiter, **options)


def _hadoop_path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, store = _hadoop_path(spark, path)
    store.delete(place, True)


def write_one_csv(
    df: DataFrame, file: str, columns: Sequence[str] | None = None, *, delimiter: str = ",", bom: bool = True, overwrite: bool = False
) -> None:
    """One text file with one header and at most one byte order mark, in the order of the frame's partitions.

    The rows are written as parts in parallel beside the file. The parts are then joined in order:
    by the store itself where it can (HDFS), else copied one after the other through a buffer of
    this process, which holds no row. The file appears under its name when it is whole.
    """
    spark = df.sparkSession
    place, store = _hadoop_path(spark, file)
    if store.exists(place) and not overwrite:
        raise ValueError(f"{file} is there already")
    names = list(columns or df.columns)
    folder = f"{file}.parts-{uuid.uuid4().hex}"
    _csv(df.select(*[field(c) for c in names]), delimiter, header=False).csv(folder)
    head = ((fixed.BYTE_ORDER_MARK if bom else "") + delimiter.join(_written(n, delimiter) for n in names) + "\n").encode()
    whole = _hadoop_path(spark, f"{folder}/whole")[0]
    out = store.create(whole)
    out.write(head)
    out.close()
    parts = sorted(str(f.getPath().toString()) for f in store.listStatus(_hadoop_path(spark, folder)[0]) if f.getPath().getName().startswith("part-"))
    parts = [p for p in parts if store.getFileStatus(_hadoop_path(spark, p)[0]).getLen() > 0]
    _joined(spark, store, whole, parts)
    if store.exists(place):
        store.delete(place, False)
    store.rename(whole, place)
    delete(spark, folder)


def _joined(spark: SparkSession, store, whole, parts: Sequence[str]) -> None:
    places = [_hadoop_path(spark, p)[0] for p in parts]
    if store.getScheme() == "hdfs" and places:
        array = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(places))
        for i, p in enumerate(places):
            array[i] = p
        store.concat(whole, array)
        return
    # stores that cannot append get a new file: header first, then the parts
    again = _hadoop_path(spark, f"{whole.toString()}-joined")[0]
    out = store.create(again)
    for p in (whole, *places):
        stream = store.open(p)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        stream.close()
    out.close()
    store.delete(whole, False)
    store.rename(again, whole)


def _written(cell: str, delimiter: str) -> str:
    quoted = any(x in cell for x in (delimiter, '"', "\n", "\r"))
    return '"' + cell.replace('"', '""') + '"' if quoted else cell


def anonymized_name(path: str) -> str:
    """The default output beside an input file."""
    path = path.rstrip("/")
    return (path[:-4] if path.lower().endswith(".csv") else path) + "-anon.csv"


# --- job definition --------------------------------------------------------------


def job_definition(
    spark: SparkSession,
    roles: Roles,
    rules: Mapping[str, Rule],
    settings: Settings,
    columns: Sequence[str],
    delimiter: str = ",",
    created: datetime | None = None,
) -> DataFrame:
    """One row that holds a job's whole configuration; the noise seed stays out."""
    created = created or datetime.now(timezone.utc)
    row = {
        "meta": {"createdAt": created.strftime("%Y-%m-%dT%H:%M:%S.000Z"), "delimiter": delimiter},
        "settings": _settings(settings),
        "mapping": {**{r: getattr(roles, r) for r in ROLE_NAMES}, "qids": list(roles.qids)},
        "columns": list(columns),
        "transforms": {c: {"action": r.action, "param": _param(r.param)} for c, r in rules.items()},
    }
    return spark.createDataFrame([row], _DEFINITION)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    df.write.mode(mode).json(path, compression=compression)


def read_job_definition(spark: SparkSession, path: str) -> tuple[Roles, dict[str, Rule], Settings, list[str]]:
    """(roles, rules, settings, columns) from a written definition."""
    row = spark.read.schema(_DEFINITION).json(path).first().asDict(recursive=True)
    rules = {
        c: Rule(r["action"], {k: v for k, v in (r["param"] or {}).items() if v is not None} or None)
        for c, r in (row["transforms"] or {}).items()
    }
    told = {n: row["settings"][key] for n, key in _SETTING_KEYS.items() if row["settings"][key] is not None}
    mapping = {k: v for k, v in row["mapping"].items() if v is not None}
    return Roles(**mapping), rules, Settings(**told), row["columns"]


def table_definitions(mappings: DataFrame, settings: Settings, delimiter: str = ",", rules: DataFrame | None = None) -> DataFrame:
    """One definition (table_name, meta, settings, mapping) per table of guessed roles, for a whole catalog.

    With ``rules``, a catalog with an action and a param_type per column, also ``columns`` in table
    order and ``transforms``, the rule of each column that has one. A repeated column name counts
    where it stands first. Mappings that bring ``columns`` and ``rules`` along (``policy.described``)
    have both written without a shuffle.
    """
    shared = _settings(settings)
    def rule_of(rules: str) -> Column:
        param = lambda c: F.struct(c["param_type"].alias("type"))
        rule = lambda c: F.struct(c["action"].alias("action"), param(c).alias("param"))
        return F.map_from_entries(F.transform(rules, lambda c: F.struct(c["column_name"].alias("key"), rule(c).alias("value"))))

    brought = ["columns", rule_of("rules").alias("transforms")] if "rules" in mappings.columns else []
    told = mappings.select(
        "table_name",
        F.struct(F.lit(delimiter).alias("delimiter")).alias("meta"),
        F.struct(*[F.lit(v).alias(k) for k, v in shared.items()]).alias("settings"),
        F.struct(*ROLE_NAMES, "qids").alias("mapping"),
        *brought,
    )
    if rules is None:
        return told
    # one row a column, then one a table: names and rules are gathered once
    once = rules.groupBy("table_name", "column_name", "action", "param_type").agg(F.min("ordinal").alias("ordinal"))
    column = F.struct("ordinal", "column_name", "action", "param_type")
    folded = once.groupBy("table_name").agg(F.array_sort(F.collect_list(column)).alias("found"))
    named = F.transform("found", lambda c: c["column_name"])
    folded = folded.select("table_name", named.alias("columns"), F.filter("found", lambda c: c["action"] != "none").alias("ruled"))
    return told.join(folded.select("table_name", "columns", rule_of("ruled").alias("transforms")), "table_name")


# --- run report --------------------------------------------------------------------


def run_report(
    file: str | None, delimiter: str, counts: DataFrame, roles: Roles, settings: Settings, *, escape: bool = True
) -> DataFrame:
    """(section, key, value): data set, parameters and mapping of one run.

    ``counts`` is a one-row frame with a ``total``; it is read as a subquery.
    """
    spark = counts.sparkSession
    facts = [
        ("dataset", "file", file or "(non importé)"),
        ("dataset", "delimiter", delimiter),
        ("parameters", "k", f"{settings.k_anon}"),
        ("parameters", "l", f"{settings.l_div}"),
        ("parameters", "t", f"{settings.t_close:g}"),
        ("parameters", "epsilon", f"{settings.epsilon:g}"),
        *(("mapping", r, getattr(roles, r) or "—") for r in ROLE_NAMES),
        ("mapping", "QI", ", ".join(roles.qids) or "—"),
    ]
    rows = counts.select(
        F.lit("dataset").alias("section"), F.lit("rows").alias("key"), F.col("total").cast("string").alias("value")
    )
    report = spark.createDataFrame(facts, "section string, key string, value string").unionByName(rows)
    return report.withColumn("value", escape_markup(F.col("value"))) if escape else report


# --- journal ---------------------------------------------------------------------


def entry_number() -> int:
    """A number that grows with time, and differs between writers of one moment but for one chance in 2**11."""
    return (time.time_ns() // 1000 << 11) | (uuid.uuid4().int & ((1 << 11) - 1))


def journal_append(spark: SparkSession, path: str, action: str, data: Any = None, at: datetime | None = None) -> None:
    """Add one entry, at minute resolution; its number keeps the order inside a minute."""
    at = (at or datetime.now(timezone.utc)).replace(second=0, microsecond=0)
    entry = (at, action, None if data is None else json.dumps(data, default=str, sort_keys=True), entry_number())
    spark.createDataFrame([entry], JOURNAL_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def journal_read(spark: SparkSession, path: str) -> DataFrame:
    """All entries, newest first."""
    return newest_first(_entries(spark, path))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """Each entry once, also while a compaction has written its file and not yet deleted the old ones."""
    found = spark.read.schema(JOURNAL_SCHEMA).parquet(path)
    return found.where("entry is null").unionByName(found.where("entry is not null").dropDuplicates())


def journal_compact(spark: SparkSession, path: str) -> int:
    """Write the entries of all present files as one file and delete those; returns how many there were.

    Entries appended meanwhile stay where they are. Files of entries without a number are left alone,
    since two equal ones could not be told from one that was copied.
    """
    found = spark.read.schema(JOURNAL_SCHEMA).parquet(path)
    files = found.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_and(F.col("entry").isNotNull()).alias("numbered"))
    old = [r["file"] for r in files.where("numbered").collect()]  # one small file an entry: what this is there to mend
    if len(old) < 2:
        return len(old)
    spark.read.schema(JOURNAL_SCHEMA).parquet(*old).dropDuplicates().coalesce(1).write.mode("append").parquet(path)
    for file in old:
        delete(spark, file)
    return len(old)


def newest_first(journal: DataFrame) -> DataFrame:
    # a busy minute has many entries: more columns keep them from meeting in one task
    number = [F.desc_nulls_last("entry")] if "entry" in journal.columns else []
    return journal.orderBy(F.desc("at"), *number, "action", "data")
