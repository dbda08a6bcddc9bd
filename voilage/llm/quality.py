"""Text quality from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation
maximisation over the counts of all vote patterns (there are at most 3**labellers of them)
estimates how each labeller votes on good and on bad texts, which gives each pattern a posterior.
The posteriors of a bounded sample then train a linear scorer over hashed byte n-grams and hashed
word shapes, and the scorer judges every document. Its verdict counts less on short texts, which
show little: it is drawn towards the share of good texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voilage.llm import linear
from voilage.llm import words as W
from voilage.llm.shared import documents_only, fresh, with_columns_schema

SAMPLE = 4000
KEEP_FROM = 0.4
LEAST_WORDS = 5
SHAPES = 64
HALF_TRUST = 6  # words at which scorer and prior count alike
#: labellers in voting order: (name, value from which a text is bad, value up to which it is good)
LABELLERS = (
    ("symbols", 0.03, 0.015),  # bytes that are #$%&*!|<>{}~^ to all bytes
    ("same word again", 0.15, 0.05),  # words equal to the word before
    ("upper case", 0.30, 0.15),  # A-Z among ASCII letters
    ("bare marks", 0.12, 0.04),  # words without a letter or digit
    ("marked ends", 0.15, 0.05),  # words that end in a symbol
    ("repeated triples", 0.30, 0.15),  # word triples seen before in the text
    ("no sentences", 0.985, 0.97),  # words that do not end in . ? or !
)
_SYMBOLS, _STOPS = b"#$%&*!|<>{}~^", b".?!"
N = len(LABELLERS)
NO_VOTES = 3**N - 1


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_IS_SYMBOL, _IS_STOP = _table(_SYMBOLS), _table(_STOPS)
_IS_UPPER = _table(bytes(range(65, 91)))
_IS_ASCII_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_IS_ALNUM = _table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def measures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word counts, and the value each labeller looks at (rows x labellers)."""
    data, offsets = W.buffer_of(column)
    found = W.split(data, offsets, W.outside(W.WHITE), places=True)
    n = len(offsets) - 1
    out, counts = np.zeros((n, N)), np.diff(found.bounds)
    for i in range(n):
        if counts[i] < LEAST_WORDS:
            continue
        own = slice(found.bounds[i], found.bounds[i + 1])
        h, s, e = found.hashes[own], found.starts[own], found.ends[own]
        text = data[offsets[i] : offsets[i + 1]]
        letters = _IS_ASCII_LETTER[text].sum()
        marks = np.concatenate([[0], np.cumsum(_IS_ALNUM[text])])
        last = data[e - 1]
        triples = W.grams(h, 3)
        out[i] = (
            _IS_SYMBOL[text].mean(),
            (h[1:] == h[:-1]).mean(),
            _IS_UPPER[text].sum() / max(1, letters),
            (marks[e - offsets[i]] == marks[s - offsets[i]]).mean(),
            _IS_SYMBOL[last].mean(),
            1 - len(np.unique(triples)) / len(triples),
            1 - _IS_STOP[last].mean(),
        )
    return counts, out


def shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word counts, and the share of each word shape: what it repeats, holds and ends in."""
    data, offsets = W.buffer_of(column)
    found = W.split(data, offsets, W.outside(W.WHITE), places=True)
    n = len(offsets) - 1
    counts, h = np.diff(found.bounds), found.hashes
    code = np.zeros(len(h), np.int64)
    code[1:] += h[1:] == h[:-1]
    code[2:] += 2 * (h[2:] == h[:-2])
    last, first = data[found.ends - 1], data[found.starts]
    code += 4 * _IS_SYMBOL[last] + 8 * _IS_STOP[last] + 16 * _IS_UPPER[first] + 32 * _IS_ALNUM[first]
    row = np.repeat(np.arange(n), counts)
    table = np.bincount(row * SHAPES + code, minlength=n * SHAPES).reshape(n, SHAPES)
    return counts, table / np.maximum(counts, 1)[:, None]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word counts, and rows of n-gram and shape shares."""
    counts, by_shape = shapes(column)
    grams = np.array(list(linear.shares(column)), np.float32).reshape(len(column), linear.WIDTH)
    return counts, np.concatenate([grams, by_shape.astype(np.float32)], 1)


def votes(column: pa.Array) -> np.ndarray:
    """Rows x labellers: 1 good, 0 bad, 2 no vote. Texts of few words get no votes."""
    counts, values = measures(column)
    bad, good = np.array([b for _, b, _ in LABELLERS]), np.array([g for _, _, g in LABELLERS])
    vote = np.where(values >= bad, 0, np.where(values <= good, 1, 2))
    # a short text need not have a full stop to be fine
    vote[:, N - 1] = np.where((counts < 60) & (vote[:, N - 1] == 0), 2, vote[:, N - 1])
    vote[counts < LEAST_WORDS] = 2
    return vote


def pattern(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(N))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return (np.asarray(patterns)[:, None] // 3 ** np.arange(N)) % 3


@dataclass(frozen=True)
class Belief:
    prior: float
    tables: np.ndarray  # class (bad, good) x labeller x vote (bad, good, none)

    def good(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior probability that texts with these vote patterns are good."""
        vote = unpacked(patterns)
        logs = np.log(self.tables[:, np.arange(N), :])
        said = vote != 2  # a labeller that says nothing tells nothing
        by_class = np.stack([(np.take_along_axis(logs[c], vote.T, 1).T * said).sum(1) for c in (0, 1)])
        by_class += np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(by_class[0] - by_class[1], -500, 500)))


def agree(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> Belief:
    """Expectation maximisation from the majority vote; a bad vote weighs more, as flaws are local."""
    vote, counts = unpacked(patterns), np.asarray(counts, float)
    ups, downs = (vote == 1).sum(1), (vote == 0).sum(1)
    good = np.where(downs > 0, ups / np.maximum(ups + 4.0 * downs, 1), np.where(ups > 0, 0.95, 0.7))
    belief = Belief(0.5, np.full((2, N, 3), 1 / 3))
    for _ in range(steps):
        weights = np.stack([counts * (1 - good), counts * good])
        tables = np.stack([(weights @ (vote == v)) + 0.5 for v in range(3)], 2)
        belief = Belief(
            float(np.clip(weights[1].sum() / max(counts.sum(), 1e-9), 0.01, 0.99)), tables / tables.sum(2, keepdims=True)
        )
        good = belief.good(patterns)
    return belief


@dataclass(frozen=True)
class Scorer:
    belief: Belief
    weights: np.ndarray
    offset: np.ndarray


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        found, n = np.unique(pattern(votes(batch.column("text"))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, "text", rows=256):
        texts = part.column("text")
        codes = pattern(votes(texts)).astype(np.int64)
        rows = [linear.sparse(x) for x in features(texts)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(rows, pa.binary())], names=["pattern", "features"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Labeller accuracies from all documents, scorer weights from about ``sample`` of them.

    Documents of too few words for any vote count in neither.
    """
    texts = documents_only(docs, "doc_id", "text").where("text is not null")
    seen = texts.select("text").mapInArrow(_patterns, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    total, seen = sum(r["n"] for r in seen), [r for r in seen if r["pattern"] != NO_VOTES]
    if not seen:
        return None
    belief = agree(np.array([r["pattern"] for r in seen]), np.array([r["n"] for r in seen]))
    chosen = texts.where(linear.in_sample(F.col("doc_id"), F.lit(min(1.0, sample / total))))
    examples = chosen.select("text").mapInArrow(_examples, "pattern bigint, features binary").where(F.col("pattern") != NO_VOTES)
    rows = linear.collected(examples, 2 * sample)
    if not len(rows):
        return Scorer(belief, np.zeros((linear.WIDTH + SHAPES, 1)), np.zeros(1))
    y = belief.good(rows.column("pattern").to_numpy())[:, None].astype(np.float32)
    x = linear.dense(rows.column("features"), linear.WIDTH + SHAPES)
    del rows
    weights, offset, _ = linear.fit(x, y)
    return Scorer(belief, weights, offset)


TOLD = ("n_votes", "posterior", "score")


def _scores(scorer: Scorer, told: Sequence[str] = TOLD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text", rows=256):
            vote = votes(part.column("text"))
            counts, x = features(part.column("text"))
            prior = np.log(scorer.belief.prior / (1 - scorer.belief.prior))
            own = (x @ scorer.weights + scorer.offset)[:, 0].astype(float)
            trust = counts / (counts + HALF_TRUST)
            score = 1 / (1 + np.exp(-np.clip(trust * own + (1 - trust) * prior, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in part.schema.names),
                    pa.array((vote != 2).sum(1).astype(np.int32)),
                    pa.array(scorer.belief.good(pattern(vote)).astype(float)),
                    pa.array(score),
                ],
                names=[*part.schema.names, *told],
            )

    return run


def judge(docs: DataFrame, scorer: Scorer | None, keep_from: float = KEEP_FROM, keep_text: bool = False) -> DataFrame:
    """One row per row: doc_id, n_votes, posterior, score, keep (and text).

    A null, empty or blank text scores 0 and is not kept. A text of fewer than five words gets no
    votes; the scorer alone judges it. Without a scorer (nothing to learn from) nothing else is
    rejected: the score is 0.5. Texts of any length are measured as a whole. A verdict depends on
    the text alone, so repeated rows get equal ones; of a tie at the threshold the text is kept.
    """
    texts = documents_only(docs, "doc_id", "text")
    kept = ["doc_id", *(["text"] if keep_text else [])]
    if scorer is None:
        told = texts.withColumns({"n_votes": F.lit(0), "posterior": F.lit(0.5), "score": F.lit(0.5)})
    else:
        told = texts.mapInArrow(_scores(scorer), "doc_id bigint, text string, n_votes int, posterior double, score double")
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    score = F.when(blank, 0.0).otherwise(F.col("score"))
    return told.select(*kept, "n_votes", "posterior", score.alias("score"), (~blank & (score >= keep_from)).alias("keep"))


def keep_good(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the scorer trained on them keeps, with all their columns.

    Rejects what ``judge`` does not keep, with equal verdicts on equal texts of any length. Columns
    may have any names besides doc_id and text. An empty table stays empty.
    """
    scorer = train(docs)
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    if scorer is None:
        return docs.where(~blank)
    told = fresh(TOLD, docs.columns)
    schema = with_columns_schema(docs, dict(zip(told, ("int", "double", "double"))))
    scored = docs.mapInArrow(_scores(scorer, told), schema)
    return scored.where(~blank & (F.col(told[2]) >= keep_from)).select(*[F.col(f"`{c}`") for c in docs.columns])
