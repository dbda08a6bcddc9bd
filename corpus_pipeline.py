"""A training-corpus pipeline of five stages over the documents table.

Low quality goes, texts of no language go, one document of each near-duplicate group stays,
passages that repeat across documents stay in the first of them only, and what is left is packed
into sequences. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voilage.llm import language, minhash, packing, quality, repeats
from voilage.llm.queries import tokenizer_file
from voilage.llm.shared import materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the scorer trained on these rows accepts.

    Null, empty and blank texts go. Texts of any length are judged whole and by themselves, so repeated
    rows share their fate; columns of any other names stay; an empty table stays empty.
    """
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told with some lead, by a model learned from these rows' text and lang.

    Texts without a letter go, as do those between two languages; without anything to learn from, all others
    stay. Repeated rows share their fate, texts are judged whole, other columns stay, an empty table stays empty.
    """
    return language.keep_identified(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8), that of the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows without doc_id all stay; texts without words link with nothing.
    Sets are taken from whole texts; other columns stay; an empty table stays empty.
    """
    return minhash.keep_one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller doc_id holds too are taken out of the text.

    Rows that lose all their words go. Rows without doc_id keep theirs; rows of one doc_id take nothing from one
    another; n_chars follows the text; other columns stay; an empty table stays empty.
    """
    return repeats.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens: one row a piece, see ``packing.pack``.

    A null or empty text is one piece of its end token; repeated rows and rows without doc_id have pieces of
    their own; long texts are cut; an empty table gives no sequence.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("language identification", known_language),
    ("near duplicates", without_near_duplicates),
    ("repeated passages", without_repeated_passages),
    ("packing", packed),
]
ORACLE_SQL = None  # SQL has no trained scorers and no tokenizer; tests/llm compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
