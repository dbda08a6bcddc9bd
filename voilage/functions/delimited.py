"""Reading the first line of a delimited file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voilage import fixed_values as fixed


def first_line(text: Column) -> Column:
    """Text up to the first line end, without a byte order mark."""
    line = F.regexp_extract(text, r"\A([^\n]*)", 1)
    return F.regexp_replace(F.regexp_replace(line, r"\r\z", ""), r"\A\x{FEFF}", "")


def delimiter_of(line: Column) -> Column:
    """The most frequent of comma, semicolon and tab; ties go in that order."""
    counts = [F.length(line) - F.length(F.translate(line, d, "")) for d in fixed.DELIMITERS]
    comma, semicolon, tab = counts
    marks = [F.lit(d) for d in fixed.DELIMITERS]
    return (
        F.when((comma >= semicolon) & (comma >= tab), marks[0])
        .when(semicolon >= tab, marks[1])
        .when(tab.isNotNull(), marks[2])
    )


def looks_like_header(cells: Column) -> Column:
    """Whether any cell holds an ASCII letter or an underscore."""
    return F.exists(cells, lambda cell: cell.rlike(fixed.HEADER_CELL))


def header_names(cells: Column) -> Column:
    """The cells as column names, or ``Col 1`` to ``Col n`` when they are data."""
    numbered = F.transform(cells, lambda cell, i: F.concat(F.lit("Col "), (i + 1).cast("string")))
    return F.when(looks_like_header(cells), cells).otherwise(numbered)
