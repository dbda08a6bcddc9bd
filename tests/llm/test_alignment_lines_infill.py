"""Token alignment, line dedup and infilling against brute force, on messy rows and small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voilage.llm import alignment, infill, lines
from voilage.llm import words as W
from voilage.llm.queries import QUERIES, tokenizer_file

SMALL = "/root/testdata/sf0.001"
BYTE, PIECE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")
#: columns whose names the operators use inside
SCHEMA = (
    "doc_id bigint, text string, block bigint, pair bigint, n bigint, h bigint, g bigint, place int, keep string, _doc bigint, _text bigint,"
    " form string, output string, row int, doc_id_ string"
)
LINE = "a line of some length that other documents have too"


def messy_rows() -> list[tuple]:
    draw = random.Random(1)
    words = "the of and naïve Straße 中文 x1 <s> </s> <|endoftext|> don't 12,5   É".split(" ")
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [
        (None, f"{LINE}\nown words here"), (1, None), (2, ""), (3, " \n\t \n"), (4, "word"), (5, f"  {LINE.upper()} \r\nshort\nshort"),
        (6, f"{LINE}\n{LINE}\nshort\nthird line of six"), (6, f"{LINE}\n{LINE}\nshort\nthird line of six"), (6, f"other text\n\n{LINE}"),
        (7, f"{LINE}\x0b"), (8, prose(20000)), (9, "x" * 150000), (10, "a▁b  c ▁"), (11, "\n".join(prose(9) for _ in range(3000))),
        (12, "ends in <P> marker"), (13, "  two  blanks  "), (14, "é" * 9 + "\n" + "é" * 10), (15, "é" * 9 + "\n" + "é" * 10 + "\n\n"), (16, LINE),
    ]
    return [(i, t, 1, 2, 3, 4, 5, 6, "k", 7, 8, "f", "o", 9, "d") for i, t in texts]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same_rows(got, want) -> None:
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# 11: alignment


def brute_alignment(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text, by the libraries and loops."""
    a_side = Tokenizer.from_file(BYTE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own_sign = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own_sign} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own_sign)}

    def spelled_b(i: int) -> bytes:
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(tokens: list[bytes]) -> list[int]:
        return np.cumsum([len(t) for t in tokens]).tolist()

    told, linked = [], []
    for text in texts:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text, num_threads=1) if text else []
        a_bytes = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [spelled_b(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            told.append((0, 0, 0, 0, ""))
            linked.append([])
            continue
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        both = set(a_ends) & set(b_ends)
        groups, own, at = [], [], [0, 0]
        for cut in sorted(both):
            part = []
            for side, (ids, stops) in enumerate(((a, a_ends), (b, b_ends))):
                start = at[side]
                while at[side] < len(ids) and stops[at[side]] <= cut:
                    at[side] += 1
                part.append(ids[start : at[side]])
            own.append((part[0][-1], part[1][-1]))
            groups.append("|".join(",".join(map(str, ids)) for ids in part))
        linked.append(own)
        told.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts, highest = Counter(pair for own in linked for pair in own), defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (*t[:4], sum(counts[p] == highest[p[1]] for p in own), sum(counts[p] for p in own), t[4]) for t, own in zip(told, linked)
    ]


def as_alignment(row) -> tuple:
    return tuple(row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


@tables
def test_link_counts_of_the_small_table(spark):
    texts = texts_of(spark.read.parquet(f"{SMALL}/documents.parquet"))
    want = [(i, *t) for (i, _), t in zip(texts, brute_alignment([t for _, t in texts]))]
    same_rows([as_alignment(r) for r in QUERIES["op11_token_alignment"](spark, SMALL).collect()], want)


@pytest.mark.parametrize("block", [1, 100_000, 1 << 30])
def test_link_counts_of_messy_rows_in_blocks_of_any_size(messy, block):
    texts = texts_of(messy)
    want = [(i, *t) for (i, _), t in zip(texts, brute_alignment([t for _, t in texts]))]
    same_rows([as_alignment(r) for r in alignment.link_counts(messy, BYTE, PIECE, block).collect()], want)


def test_alignment_of_an_empty_table(empty):
    assert alignment.link_counts(empty, BYTE, PIECE).collect() == []
    assert alignment.align(empty, BYTE, PIECE).collect() == []


def test_aligned_tokens_spell_the_same_in_every_group(spark):
    df = spark.createDataFrame([(1, "naïve Straße 中文 don't"), (2, None), (3, "a▁b")], "doc_id bigint, text string")
    told = {r["doc_id"]: r for r in alignment.align(df, BYTE, PIECE).collect()}
    assert told[2]["a_ids"] == told[3]["a_ids"] == told[3]["b_group"] == []
    both, row, groups = alignment.aligner(BYTE, PIECE), told[1], defaultdict(lambda: [b"", b""])
    for side, spelling, ids, group in ((0, both.a_spelling, "a_ids", "a_group"), (1, both.b_spelling, "b_ids", "b_group")):
        for i, g in zip(row[ids], row[group]):
            groups[g][side] += spelling.joined(np.array([i])).tobytes()
    assert all(a == b for a, b in groups.values()) and sorted(groups) == list(range(len(groups)))
    assert b"".join(groups[g][0] for g in range(len(groups))).decode() == " naïve Straße 中文 don't"


def test_pointer_jumping_finds_common_cuts():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randint(1, 60)
        a, b = (sorted({*draw.sample(range(1, n + 1), draw.randint(0, n)), n}) for _ in range(2))
        a_group, b_group = alignment.groups_of(np.array(a), np.array(b))
        cuts = sorted(set(a) & set(b))
        for ends, group in ((a, a_group), (b, b_group)):
            assert group.tolist() == [next(k for k, c in enumerate(cuts) if c >= e) for e in ends]
    # a long chain without a common cut but the last
    a_group, b_group = alignment.groups_of(np.arange(2, 200_001, 2), np.array([*range(1, 200_000, 2), 200_000]))
    assert not a_group.any() and not b_group.any()


# 12: line dedup


def brute_lines(texts: list[tuple]) -> list[tuple]:
    def key(line: str) -> str:
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\t\n\x0b\x0c\r"))

    first: dict[str, int] = {}
    for i, text in texts:
        for line in (text or "").split("\n") if i is not None else []:
            first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, text in texts:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def as_lines(df) -> list[tuple]:
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()]


def test_line_dedup_of_messy_rows(messy):
    same_rows(as_lines(lines.dropped_lines(messy)), brute_lines(texts_of(messy)))


def test_line_dedup_of_an_empty_table(empty):
    assert as_lines(lines.dropped_lines(empty)) == [] and lines.without_repeated_lines(empty).collect() == []


@pytest.mark.parametrize("hot", [1, 2, 1024])
def test_lines_of_a_third_of_all_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    draw = random.Random(7)
    texts = [
        (i, "\n".join(f"line number {draw.choice((1, 1, 2, 3, draw.randint(4, 400)))}" for _ in range(draw.randint(0, 30)))) for i in range(400)
    ]
    draw.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    same_rows(as_lines(lines.dropped_lines(df)), brute_lines(texts))


def test_keep_bitmaps_are_runs_and_apply(messy):
    for row in lines.keep_bitmaps(messy).collect():
        spans = [(r["start"], r["length"]) for r in row["keep"]]
        assert sum(n for _, n in spans) == row["n_lines"] - row["n_dropped"]
        assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:]))
    done = lines.without_repeated_lines(messy)
    assert done.columns == messy.columns and {r["_doc"] for r in done.collect()} == {7}
    digests = [(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in done.collect()]
    same_rows(digests, [(i, sha) for i, _, _, sha in brute_lines(texts_of(messy))])


def test_line_dedup_plan_is_native_and_takes_the_ranges_as_they_are(spark, messy):
    plan = lines.dropped_lines(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)
    window = plan[plan.index("Window") :]
    assert re.match(r"(?s)Window.{0,600}?Sort.{0,300}?Exchange rangepartitioning", window)


# 13: fill in middle


def brute_infill(doc_id, text) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, drawn = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    counts = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, n, form, *counts, *(hashlib.sha256(x.encode()).hexdigest() for x in (out, text)))


def test_infilling_of_messy_rows(messy):
    same_rows(infill.digests(messy).collect(), [brute_infill(*t) for t in texts_of(messy)])


def test_infilling_of_many_short_texts(spark):
    draw = random.Random(5)
    texts = [(i, "".join(draw.choice("aBz <>PSM\n中é𝒳") for _ in range(draw.randint(0, 40)))) for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = infill.digests(df).collect()
    same_rows(got, [brute_infill(*t) for t in texts])
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infilling_of_an_empty_table(empty):
    assert infill.digests(empty).collect() == []


def test_markers_that_could_meet_in_a_text_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("<P>", "#S", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            infill.Markers(*marks)


def test_boundary_sets_select_every_member():
    draw = np.random.default_rng(2)
    parts = [
        np.arange(70_000), 200_000 + np.sort(draw.choice(65_000, 30_000, replace=False)), np.array([400_000, 400_009, 999_999]),
        np.arange(5 << 20, (5 << 20) + 60_000, 2),
    ]
    places = np.concatenate(parts)
    found = infill.Boundaries(places)
    assert {type(c) for c in found.containers} == {infill.Listed, infill.Bitmap, infill.Runs}
    assert len(found) == len(places) and len(infill.Boundaries(places[:0])) == 0
    for k in [0, 1, 65_535, 65_536, len(places) - 1, *draw.integers(0, len(places), 3000).tolist()]:
        assert found.select(k) == places[k]


def test_units_end_inside_no_character():
    texts = ["ab1 é中x", "", "𝒳𝒳", "end"]
    data, offsets = W.buffer_of(pa.array(texts))
    ends = infill.unit_ends(data, offsets)
    for i, text in enumerate(texts):
        want = np.cumsum([len(u.encode()) for u in re.findall("[A-Za-z]+|[^A-Za-z]", text)])
        assert ends[(ends > offsets[i]) & (ends <= offsets[i + 1])].tolist() == (want + offsets[i]).tolist()
