"""Language identification with error-correcting output codes.

Each language has a codeword; one n-gram classifier per bit predicts that bit. A text goes to the
codeword with the smallest sum of logistic losses, bits weighted by how well they were learned.
A small lead over the second codeword marks a text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voilage.llm import linear
from voilage.llm import words as W
from voilage.llm.shared import documents_only, fresh, materialize, with_columns_schema

SAMPLE = 2400
LEAST = 8  # texts looked for in each language, however many languages there are
AMBIGUOUS = 0.15
REJECT_BELOW = 0.02  # lead below which a text has no language to speak of
UNKNOWN = "und"


def codewords(count: int, seed: int = 5) -> np.ndarray:
    """Distinct codewords of 0 and 1, one row a language.

    Up to five languages get every useful split (the exhaustive code); more get random splits,
    the best of many draws by smallest distance between two rows. Above a thousand languages the
    first draw without repeated rows is taken.
    """
    if count <= 5:
        splits = np.arange(1, 1 << max(count - 1, 0))
        return ((splits[None, :] >> np.arange(count)[:, None]) & 1).astype(np.int8)
    draw, best, apart = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(count)))
    for _ in range(50):
        code = draw.integers(0, 2, (count, length), np.int8)
        if count > 1000:
            if len(np.unique(code, axis=0)) == count:
                return code
            continue
        signs = 2 * code.astype(int) - 1
        far = (length - signs @ signs.T) // 2 + length * np.eye(count, dtype=int)
        if far.min() > apart and (code.min(0) < code.max(0)).all():
            best, apart = code, far.min()
    return best if best is not None else np.random.default_rng(seed).integers(0, 2, (count, length), np.int8)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    signs: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    offset: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding, summing to 1

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of belief, and the lead over the second in loss."""
        margins = features @ self.weights + self.offset
        ones, zeros = np.logaddexp(0, -margins) * self.trust, np.logaddexp(0, margins) * self.trust
        losses = ones @ (self.signs > 0).T + zeros @ (self.signs <= 0).T
        order = np.sort(losses, 1)
        belief = np.exp(-(losses - order[:, :1]) * self.signs.shape[1])
        lead = order[:, 1] - order[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
        return losses.argmin(1), belief.max(1) / belief.sum(1), lead


def train(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Model | None:
    """Fit on about ``sample`` texts, the same number of each language where there are enough.

    ``docs`` has doc_id, text, lang; rows without a language or text are left out. Where there are
    so many languages that fewer than ``least`` texts would fall to each, it is ``least`` for each.
    Languages of whose texts none falls into the sample are not learned. None if there is nothing
    to learn.
    """
    known = documents_only(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = materialize(known.groupBy("lang").count().withColumnRenamed("lang", "name"))
    languages = counts.count()
    if not languages:
        return None
    each = max(sample / languages, least)
    # below ``least`` texts every one is taken
    known = known.join(counts, F.col("lang") == F.col("name"))
    chosen = known.where(linear.in_sample(F.col("doc_id"), F.least(F.lit(1.0), F.lit(each) / F.col("count"))))
    told = chosen.select("text", "lang").mapInArrow(_features, "lang string, features binary")
    rows = linear.collected(told, int(2 * each * languages))
    if not len(rows):
        return None
    spoken = rows.column("lang").combine_chunks().dictionary_encode()
    names, of_row = np.unique(np.array(spoken.dictionary.to_pylist())[spoken.indices.to_numpy()], return_inverse=True)
    names = names.tolist()
    x = linear.dense(rows.column("features"), linear.WIDTH)
    del rows, spoken
    code = codewords(len(names))
    if code.shape[1] == 0:
        return Model(tuple(names), np.zeros((1, 0)), np.zeros((linear.WIDTH, 0)), np.zeros(0), np.zeros(0))
    y = code[of_row].astype(np.float32)
    weights, offset, margins = linear.fit(x, y)
    right = ((margins > 0) == (y > 0.5)).mean(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(tuple(names), 2.0 * code - 1, weights, offset, trust / trust.sum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        rows = [linear.sparse(x) for x in linear.shares(batch.column("text"), W.lower())]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "features"])


TOLD = ("guess", "belief", "lead")


def _predictions(model: Model, told: Sequence[str] = TOLD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text", rows=256):
            best, belief, lead = model.decode(np.stack(list(linear.shares(part.column("text"), W.lower()))))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in part.schema.names),
                    pa.array([model.languages[i] for i in best], pa.string()),
                    pa.array(belief.astype(float)),
                    pa.array(lead.astype(float)),
                ],
                names=[*part.schema.names, *told],
            )

    return run


def held_out(doc_id: Column) -> Column:
    """The rows kept for testing: every fifth by the CRC-32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep_text: bool = False, least_lead: float = AMBIGUOUS) -> DataFrame:
    """One row per row: doc_id, lang_pred, score (0 to 1), ambiguous (and text).

    A null text, or one without a letter of any script, is ``und`` with score 0 and not
    ambiguous; so is every text if no model could be learned. Texts of any length are judged as a
    whole and by nothing but themselves: repeated rows get equal answers, and of languages that tie
    the one first by name is taken. An empty table gives an empty one.
    """
    texts = documents_only(docs, "doc_id", "text").withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kept = ["doc_id", *(["text"] if keep_text else [])]
    if model is None:
        return texts.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    told = texts.mapInArrow(
        _predictions(model), "doc_id bigint, text string, letters boolean, guess string, belief double, lead double"
    )
    letters = F.col("letters")
    return told.select(
        *kept,
        F.when(letters, F.col("guess")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.col("belief")).otherwise(0.0).alias("score"),
        (letters & (F.col("lead") < least_lead)).alias("ambiguous"),
    )


def keep_identified(docs: DataFrame, least_lead: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` whose language is told with some lead, with all their columns.

    Learns from the rows' own text and lang. Rejects texts without a letter and those that lie
    between two languages; keeps the rest, everything with a letter if there is nothing to learn.
    """
    model = train(docs)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.where(letters)
    told = fresh(TOLD, docs.columns)
    schema = with_columns_schema(docs, dict(zip(told, ("string", "double", "double"))))
    scored = docs.mapInArrow(_predictions(model, told), schema)
    return scored.where(letters & (F.col(told[2]) >= least_lead)).select(*[F.col(f"`{c}`") for c in docs.columns])
