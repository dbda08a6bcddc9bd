"""Line dedup: lines that other documents have too stay in the first document only.

Lines travel as two 64-bit hashes with document and place. They are dealt out by ranges of the
hashes and sorted, inside each range, by document and place: the first row of a hash names the
document that keeps the line, and the rows behind it are streamed past that. What comes back for a
document is a compressed bitmap of the lines it keeps, as runs, never text.

Hashes that hold more than their share of all lines are found by a sketch of bounded size; their
first documents are few enough to be broadcast, so their lines aren't dealt out at all.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voilage.llm.shared import documents_only, fresh, materialize

LEAST_CHARACTERS = 10
HOT = 1024  # hashes looked at as too frequent for one range; the sketch tells those above rows / (HOT * 4) at least
_WHITE = " \t\n\x0b\x0c\r"
_KEYS = ("_doc", "_text")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    slow = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(bare)).otherwise(slow)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """Lines that may be dropped: two hashes of the key, document, which of its texts, place."""
    texts = docs.select(key.alias("_doc"), F.xxhash64(text).alias("_text"), _lines(text).alias("lines")).where("_doc is not null")
    placed = texts.select("_doc", "_text", F.posexplode("lines").alias("place", "line"))
    keys = placed.select("_doc", "_text", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= LEAST_CHARACTERS)
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "_doc", "_text", "place")


def _dropped(lines: DataFrame) -> DataFrame:
    """The lines whose key a smaller document holds."""
    found = lines.select(F.explode(F.expr(f"approx_top_k(h, {HOT}, {HOT * 16})")).alias("top")).select("top.item", "top.count")
    hot = materialize(found.where("item is not null").select(F.col("item").alias("hot")))  # HOT rows at most
    firsts = materialize(
        lines.join(F.broadcast(hot), F.col("h") == F.col("hot")).groupBy("h", "g").agg(F.min("_doc").alias("first"))
    )
    named = firsts.select(F.col("h").alias("hh"), F.col("g").alias("gg"), "first")
    of_hot = lines.join(F.broadcast(named), (F.col("h") == F.col("hh")) & (F.col("g") == F.col("gg"))).drop("hh", "gg")
    others = lines.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left_anti")
    in_order = Window.partitionBy("h", "g").orderBy("_doc", "place").rowsBetween(Window.unboundedPreceding, 0)
    of_others = others.repartitionByRange("h", "g").withColumn("first", F.first("_doc").over(in_order))
    late = F.col("_doc") > F.col("first")
    return of_hot.where(late).select(*_KEYS, "place").unionByName(of_others.where(late).select(*_KEYS, "place"))


def _runs(places: Column, n: Column) -> Column:
    """Runs (start, length) of the places from 0 to n - 1 that are not among the sorted ones."""
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(n)), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length"))
    )
    return F.filter(gaps, lambda run: run["length"] > 0)


def _bitmaps(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """(_doc, _text, dropped): the places each text loses; texts that lose nothing are not there."""
    lines = materialize(_keyed(docs, key, text))
    return _dropped(lines).groupBy(*_KEYS).agg(F.array_sort(F.collect_set("place")).alias("_dropped"))


def _judged(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text without nulls) with the number of lines and the runs of lines kept."""
    found = _bitmaps(texts, F.col("doc_id"), F.col("text"))
    n = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))) + 1
    own = texts.withColumns({"_own": F.xxhash64("text"), "n_lines": n})
    met = own.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("_own") == F.col("_text")), "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("length")))
    keep = F.when(F.col("_dropped").isNull(), whole).otherwise(_runs(F.col("_dropped"), F.col("n_lines")))
    return met.select("doc_id", "text", "n_lines", F.coalesce(F.size("_dropped"), F.lit(0)).alias("n_dropped"), keep.alias("keep"))


def kept_text(text: Column, keep: Column, n_dropped: Column) -> Column:
    """The lines of the runs, joined; a text that loses none is as it was."""
    parts = F.flatten(F.transform(keep, lambda run: F.slice(_lines(text), run["start"] + 1, run["length"])))
    return F.when(n_dropped == 0, text).otherwise(F.array_join(parts, "\n"))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep: which lines of each row stay, as runs (start, length).

    A line is dropped if its key (see ``line_key``) has at least ten characters and stands in a
    document with a smaller doc_id. A null or empty text is one empty line. Rows of one doc_id are
    one document: none of their lines drops another's, repeated rows have equal results, and rows of
    different texts are each told their own places. Rows without doc_id keep all lines and make no
    other row lose any. Columns besides doc_id and text are not looked at.
    """
    texts = documents_only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return _judged(texts).drop("text")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, the dropped lines taken out of text; a null text becomes empty."""
    row, text = fresh(("row", "text_kept"), docs.columns)
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    packed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.struct(*names).alias(row),
    )
    found = _bitmaps(packed, F.col("doc_id"), F.col("text"))
    own = packed.withColumn("_own", F.xxhash64("text"))
    met = own.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("_own") == F.col("_text")), "left")
    n_lines = F.size(_lines(F.col("text")))
    keep = _runs(F.coalesce("_dropped", F.array().cast("array<int>")), n_lines)
    kept = kept_text(F.col("text"), keep, F.coalesce(F.size("_dropped"), F.lit(0)))
    told = met.select(row, kept.alias(text))
    return told.select(*[F.col(text).alias(c) if c.lower() == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row per row of ``docs``; see ``keep_bitmaps``."""
    texts = documents_only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    found = _judged(texts)
    kept = kept_text(F.col("text"), F.col("keep"), F.col("n_dropped"))
    return found.select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
