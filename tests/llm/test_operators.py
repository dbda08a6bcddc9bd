"""Operators against brute force, on messy rows and small tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voilage.llm import fingerprint, grammar, language, licences, minhash, neighbours, packing, quality, repeats, sentencepieces
from voilage.llm import words as W
from voilage.llm.queries import QUERIES, tokenizer_file
from voilage.llm.shared import components
from voilage.llm.tokens import Pieces

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD, BYTE, PIECE = (tokenizer_file(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, root string, node int, guess string, digest string, band int, _kept int, range int"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def messy_rows() -> list[tuple]:
    a = prose(1, 200)
    near = a.split()
    near[7] = "changed"
    texts = [
        (None, a), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, a), (6, a), (6, a), (7, " ".join(near)),
        (8, prose(2, 30000)), (9, "é中   x   y\x85 𝒳 ▁ <|endoftext|>\r\n"), (10, "x" * 200000), (11, prose(3, 60) + " " + " ".join(near[50:120])),
    ]
    return [(i, t, "en" if i != 9 else None, "s", 0, 1.5, "r", 1, "g", "d", 2, 3, 4) for i, t in texts]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows(df) -> list:
    return sorted(df.collect(), key=repr)


# words


def test_words_are_those_of_the_pattern_in_any_block():
    draw = random.Random(4)
    texts = ["".join(draw.choice("aB \n\té") for _ in range(draw.randint(0, 50))) for _ in range(2000)]
    texts += [None, "", "X" * 300000, "y Z " * 60000]
    data, offsets = W.buffer_of(pa.array(texts))
    for separators, fold, pattern in ((W.WHITE, None, rb"[^\x20\x09-\x0D]+"), (W.NOT_ALNUM, W.lower(), rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = W.split(data, offsets, W.outside(separators), fold, places=True)
        by_hash = {}
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            want = re.findall(pattern, raw if fold is None else raw.lower())
            own = slice(found.bounds[i], found.bounds[i + 1])
            assert len(want) == found.bounds[i + 1] - found.bounds[i]
            for word, h in zip(want, found.hashes[own].tolist()):
                assert by_hash.setdefault(h, word) == word
        assert len(set(by_hash.values())) == len(by_hash)


def test_sliding_minimum_takes_the_last_of_equals():
    x = np.random.default_rng(1).integers(0, 9, 300)
    for w in (1, 2, 3, 26):
        for i, m in enumerate(W.sliding_min(x, w)):
            part = x[i : i + w]
            assert m == i + w - 1 - np.argmin(part[::-1])


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 150)} == {100} and got[201] == 200


# 1: near duplicates


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_components(texts, size):
    ids = [i for i in texts if i is not None]
    sets, root = {i: shingles(texts[i], size) for i in ids}, {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@tables
@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_of_the_small_table(spark, size):
    docs = docs_of(spark, SMALL)
    want = brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, size)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, size).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_large_group_of_copies_that_only_partly_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 800)
    draw, base = random.Random(9), prose(5, 100).split()
    texts = {}
    for i in range(60):
        own = list(base)
        for k in draw.sample(range(100), draw.choice([1, 3, 6, 12, 14])):
            own[k] = f"w{i}x{k}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 2).collect()}
    assert got == brute_components(texts, 2)


def test_near_duplicates_of_messy_rows(messy, empty):
    got = rows(minhash.near_duplicates(messy, 2))
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(messy_rows())
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[4] == (1, 4, True)
    assert by[5][1:] == (5, True) and by[6][1:] == (5, False) and by[7][1:] == (5, False)
    assert by[None][1:] == (None, True)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 8, 9, 10, 11]


# 2: quality


def test_labeller_accuracies_are_recovered():
    draw = np.random.default_rng(3)
    truth = draw.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.7])
    votes = np.where(draw.random((20000, quality.N)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[draw.random(votes.shape) < 0.2] = 2
    codes, counts = np.unique(quality.pattern(votes), return_counts=True)
    belief = quality.agree(codes, counts)
    assert abs(belief.prior - 0.8) < 0.03
    told = belief.tables[1, :, 1] / belief.tables[1, :, :2].sum(1)
    assert np.abs(told - right).max() < 0.05
    assert ((belief.good(quality.pattern(votes)) > 0.5) == truth).mean() > 0.95


@tables
def test_quality_agrees_with_labels_it_never_saw(spark):
    docs = docs_of(spark, LARGER)
    told = quality.judge(docs, quality.train(docs)).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    good = [r["keep"] for r in told if r["quality"] == 1]
    bad = [r["keep"] for r in told if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.12


def test_quality_of_messy_rows(messy, empty):
    scorer = quality.train(messy)
    by = {r["doc_id"]: r for r in quality.judge(messy, scorer).collect()}
    assert not any(by[i]["keep"] for i in (1, 2, 3)) and by[1]["score"] == 0.0
    assert by[4]["n_votes"] == 0 and all(0 <= r["score"] <= 1 for r in by.values())
    assert quality.train(empty) is None and quality.judge(empty, None).count() == 0
    assert quality.keep_good(messy).columns == messy.columns and quality.keep_good(empty).count() == 0


# 3: packing


def whole_ids(path, texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [np.array(e.ids + [end], np.uint32) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(texts_by_id, got, capacity):
    ids = dict(zip(texts_by_id, whole_ids(WORD, texts_by_id.values(), 0)))
    seen, places = {}, {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == capacity * r["piece"] and len(own) == r["length"] <= capacity
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return ids, seen, places


@tables
def test_packing_of_the_small_table_needs_the_fewest_sequences(spark):
    docs = docs_of(spark, SMALL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, seen, places = check_packing(texts, packing.pack(docs, WORD).collect(), packing.CAPACITY)
    total = sum(map(len, ids.values()))
    assert seen == {i: len(x) for i, x in ids.items()}
    assert len(places) <= -(-total // packing.CAPACITY) + 1


def test_packing_of_messy_rows(messy, empty):
    got = packing.pack(messy, WORD).collect()
    texts = {i: t for i, t, *_ in messy_rows()}
    ids, seen, _ = check_packing(texts, got, packing.CAPACITY)
    assert seen == {i: len(x) * (2 if i == 6 else 1) for i, x in ids.items()}
    assert packing.pack(empty, WORD).count() == 0


def test_plan_holds_every_piece_once():
    draw = np.random.default_rng(8)
    for _ in range(5):
        histogram = np.bincount(draw.integers(1, 65, 3000), minlength=65)
        plan = packing.make_plan(histogram)
        used, room = np.zeros(65, int), np.zeros(plan.sequences, int)
        slots = sorted(zip(plan.length, plan.first, plan.each, plan.sequence, plan.offset))
        for i, (length, first, each, sequence, _) in enumerate(slots):
            end = slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == length else histogram[length]
            assert first == used[length] and (end - first) % each == 0
            used[length] = end
            room[sequence : sequence + (end - first) // each] += length * each
        assert (used == histogram * (np.arange(65) > 0)).all() and room.max() <= 64
        least = max(-(-int((histogram * np.arange(65)).sum()) // 64), int(histogram[33:].sum()))
        assert plan.sequences <= least * 1.02 + 2


# 4: token files


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50000])
def test_blocks_decode_whole_and_in_part(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    block = grammar.Block(grammar.compress(ids))
    assert (block.ids() == ids).all()
    for a, b in np.sort(np.random.default_rng(1).integers(0, n + 1, (40, 2)), 1):
        assert (block.ids(a, b) == ids[a:b]).all()


def test_repetitive_ids_shrink():
    ids = np.tile(np.arange(50, dtype=np.uint32), 2000)
    assert len(grammar.compress(ids)) < len(ids) * 4 / 50
    left = grammar.Block(grammar.compress(np.random.default_rng(3).integers(0, 40, 60_000).astype(np.uint32))).symbols
    assert np.unique((left[:-1].astype(np.uint64) << np.uint64(32)) | left[1:], return_counts=True)[1].max() < grammar.LEAST_COUNT


def test_token_files_of_messy_rows(messy, empty):
    told = [(r[0], r[1]) for r in messy_rows()]
    want = [(i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(told, whole_ids(BYTE, [t for _, t in told], 2))]
    got = grammar.round_trip(messy, BYTE).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], key=repr) == sorted(want, key=repr)
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert grammar.round_trip(empty, BYTE).count() == 0


@pytest.mark.parametrize("path, blank_ends", [(WORD, False), (BYTE, True)])
def test_cut_texts_give_the_ids_of_whole_texts(path, blank_ends):
    draw = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "é", "é", "́", ".", "!!", "'s", "it's", "中", "12", "\x1c", "\x85", "\xa0", "　",
             " ", "<|endoftext|>", "\r", "𝒳", "‍", "~", "a~b"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(2500)] + ["", " ", "\n"]
    pieces = Pieces(path, blank_ends, cache=500)
    for at, ids, bounds in pieces.batches(pa.array(texts)):
        for i, want in enumerate(whole_ids(path, texts[at : at + len(bounds) - 1], 0)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want[:-1].tolist(), texts[at + i]


# 5: licences


@tables
def test_licence_bases_by_plain_search(spark):
    docs = docs_of(spark, LARGER)
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for r in docs.collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").encode().lower())
        places, labels = [], set()
        for phrase, label in licences.BASE:
            want = [w.encode() for w in phrase.split()]
            hits = [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
            places += hits
            labels |= {label} if hits else set()
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
        assert (g["first_word"], g["last_word"]) == (min(places, default=None), max(places, default=None))
        assert labels <= set(g["labels"].split(",")) | {""} and 0 <= g["score"] <= 1
        assert ("cc-by-nc" in g["labels"]) == ("CC BY-NC" in (r["text"] or ""))


def test_licence_templates_in_messy_rows(spark, messy, empty):
    notice = "x y Permission is hereby granted, free of charge, to any person obtaining a copy of this software ... without restriction."
    df = spark.createDataFrame([(1, notice), (2, "the MIT, license"), (3, "mit\nLICENSE mit license"), (4, None)], "doc_id bigint, text string")
    by = {r["doc_id"]: r for r in licences.scan(df.unionByName(df.limit(0))).collect()}
    assert by[2]["base_labels"] == "mit" and (by[3]["n_base"], by[3]["first_word"], by[3]["last_word"]) == (2, 0, 2)
    assert by[4]["labels"] == "" and by[4]["n_words"] == 0 and by[1]["base_labels"] == ""
    assert licences.scan(messy).count() == len(messy_rows()) and licences.scan(empty).count() == 0


def test_no_licence_notice_crowds_out_another(spark):
    filler = " ".join(draw for draw in random.Random(4).choices(prose(9, 300).split() + list(licences.VOCABULARY), k=20000))
    every = " zz ".join(text for _, text, _ in licences.TEMPLATES)
    told = [(0, every)] + [(1 + t, f"{filler} zz {text} zz {filler}") for t, (_, text, _) in enumerate(licences.TEMPLATES)]
    by = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(told, "doc_id bigint, text string")).collect()}
    assert set(by[0]["labels"].split(",")) == {label for label, *_ in licences.TEMPLATES} and by[0]["score"] == 1.0
    for t, (label, *_) in enumerate(licences.TEMPLATES):
        assert label in by[1 + t]["labels"].split(",") and by[1 + t]["score"] == 1.0


def brute_licences(text: str | None) -> tuple[str, float]:
    """Labels and score of one text, by trying every template at every word."""
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]

    def stands(place: int, want: list[str]) -> bool:
        return place >= 0 and words[place : place + len(want)] == want

    labels, score = set(), 0.0
    for name, label in (*licences.BASE, *licences.NAMES):
        if any(stands(i, name.split()) for i in range(len(words))):
            labels, score = labels | {label}, max(score, licences.MENTION)
    for label, whole, phrases in licences.TEMPLATES:
        want = whole.split()
        offsets = [f" {whole} ".split(f" {p} ")[0].count(" ") for p in phrases]
        for start in range(-len(want), len(words)):
            if not stands(start + offsets[0], phrases[0].split()):
                continue
            if not all(any(stands(start + o + d, p.split()) for d in range(-licences.SLACK, licences.SLACK + 1)) for o, p in zip(offsets, phrases)):
                continue
            before = range(offsets[0] - licences.REACH, offsets[0])
            if any(0 <= start + i < len(words) and words[start + i] in licences.NEGATIONS and (i < 0 or want[i] != words[start + i]) for i in before):
                continue
            share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(want)) / len(want)
            labels, score = labels | {label}, max(score, licences.NOTICE + (1 - licences.NOTICE) * share)
    return ",".join(sorted(labels)), score


def test_licence_labels_by_brute_force(spark):
    draw = random.Random(8)
    texts = [
        "distributed under GPL v3", "SPDX-License-Identifier: MIT", "Eclipse Public License", "we never use the mit license here",
        "mozilla public license mozilla public license mozilla public license", "This is NOT released under the MIT License.", None, "",
    ]
    for _ in range(400):
        parts = []
        for _ in range(draw.randint(1, 3)):
            words = draw.choice(licences.TEMPLATES)[1].split()
            for _ in range(draw.choice((0, 0, 1, 3, 12))):  # words changed, dropped or put in
                i = draw.randrange(len(words))
                words[i : i + draw.randint(0, 1)] = draw.choices([*licences.VOCABULARY, "zz", "not"], k=draw.randint(0, 2))
                words = words or ["zz"]
            parts += draw.choices(["zz", "not", "never", "the"], k=draw.randint(0, 4)) + words[draw.choice((0, 0, 0, 5)) :]
        texts.append(draw.choice((" ", ". ", "\n")).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(df).collect()}
    for i, text in enumerate(texts):
        labels, score = brute_licences(text)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, (text, got[i], labels, score)
    assert [got[i] for i in range(8)] == [
        ("gpl", 0.5 + 0.5 * 3 / 4), ("mit", 1.0), ("epl", 0.2), ("mit", 0.2), ("mpl", 0.2), ("mit", 0.2), ("", 0.0), ("", 0.0)
    ]


# 6: language


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 30):
        code = language.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n


@tables
def test_languages_of_held_out_documents(spark):
    docs = docs_of(spark, LARGER)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    told = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) / len(told) > 0.97
    for i in (0, 5, 123, 999):
        assert docs.where(f"doc_id = {i}").select(language.held_out(F.col("doc_id"))).first()[0] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_no_language_is_left_out_however_many_there_are(spark):
    draw = random.Random(2)
    names = [f"l{i:03}" for i in range(600)]
    letters = {n: draw.sample("abcdefghijklmnopqrstuvwxyz", 7) for n in names}
    words = {n: ["".join(draw.choices(letters[n], k=5)) for _ in range(30)] for n in names}
    rows = [(i, " ".join(draw.choices(words[n], k=60)), n) for i, n in enumerate(n for n in names for _ in range(8))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df, sample=100)
    assert list(model.languages) == names and len({tuple(s) for s in model.signs.tolist()}) == 600
    told = language.identify(df, model).join(df, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) / len(told) > 0.5


def test_languages_of_messy_rows(messy, empty):
    by = {r["doc_id"]: r for r in language.identify(messy, language.train(messy)).collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (1, 2, 3))
    assert all(by[i]["lang_pred"] == "en" for i in (4, 5, 8, 9, None))
    assert language.train(empty) is None and language.keep_identified(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(messy, None).collect()} == {"und"}
    assert language.keep_identified(messy).columns == messy.columns


# 7: fingerprints


def test_edits_across_ranges_and_at_the_ends_of_the_ids(spark):
    draw = random.Random(3)
    ids = sorted({-(1 << 63), (1 << 63) - 1, *(draw.randint(-(1 << 40), 1 << 40) for _ in range(300))})
    texts = {i: prose(n, draw.randint(0, 12)) for n, i in enumerate(ids)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(11)
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edits(df).collect()}
    assert len(got) == len(ids)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        t, n = texts[i], texts[after]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprints_of_messy_rows(messy, empty):
    got = fingerprint.compare_with_edits(messy).collect()
    assert len(got) == len(messy_rows()) and fingerprint.compare_with_edits(empty).count() == 0
    texts = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in messy_rows()), key=lambda x: x[0])
    edits = {}
    for i, (key, text) in enumerate(texts):
        half, after = len(text) // 2, texts[(i + 1) % len(texts)][1]
        edits.setdefault(key, set()).add(hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    own = {}
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["edited_sha256"] in edits[key] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        own.setdefault(dict(texts)[key], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in own.values())
    assert len({f for v in own.values() for f in v}) == len(own)


def test_paragraphs_come_and_go_in_any_order():
    def of(text):
        return fingerprint.packed(*fingerprint.fingerprints(pa.array([text])))[0]

    assert of("a b c\nd e\nf") == of("f\na b c\nd e")
    assert fingerprint.inserted(of("d e"), ["a b c"]) == of("a b c\nd e")
    assert fingerprint.deleted(of("a b c\nd e"), ["d e"]) == of("a b c") != of("a b\nc")


def test_likeness_of_texts_that_repeat_a_pair_very_often():
    for times in (40000, 100000):
        text = "a b " * times
        edited = text[: len(text) // 2] + prose(7, 100000)[: len(text) // 2]
        own, new = (fingerprint.fingerprints(pa.array([t])) for t in (text, edited))
        assert fingerprint.likeness(own, new)[0] > 0.9
        assert fingerprint.unpacked(fingerprint.packed(*own)[0])[1].tolist() == own[1][0].tolist()


# 8: repeated passages


def brute_removal(texts, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    starts = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            starts[key] = min(starts.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_removed_words_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    draw, pool = random.Random(2), [prose(k, 40).split() for k in range(8)]
    texts = []
    for i in range(80):
        words = []
        for _ in range(draw.randint(0, 5)):
            part = draw.choice(pool)
            a, b = sorted((draw.randint(0, 40), draw.randint(0, 40)))
            words += part[a:b] + prose(draw.random(), draw.randint(0, 9)).split()
        texts.append((i, " ".join(words)))
    texts += [(80, texts[3][1]), (81, "a " * 300), (82, "a " * 90), (83, None)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.removed_repeats(df, 10).collect()}
    assert got == brute_removal(texts, 10)


@pytest.mark.parametrize("letters", ["a", "ab", "abc"])
def test_passages_of_few_words_by_brute_force(letters):
    draw = random.Random(6)
    texts = [(i, " ".join(draw.choices(letters, k=draw.choice((5, 12, 60))))) for i in range(40)]
    want = brute_removal(texts, 7)
    machine = repeats.Automaton([(i, t.encode()) for i, t in texts], 7)
    for i, text in texts:
        words = text.encode().split()
        assert (len(words), int(machine.covered(i, words).sum())) == want[i][:2]


def test_one_word_over_and_over_takes_time_in_proportion():
    words = [b"a"] * 200_000
    start = time.monotonic()
    machine = repeats.Automaton([(1, b" ".join(words)), (2, b" ".join(words[:1000]))], 50)
    assert machine.covered(3, words).all() and not machine.covered(1, words).any() and machine.covered(2, words[:70]).all()
    assert time.monotonic() - start < 20


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(repeats.Automaton, "_hashed", lambda self, words: np.zeros(max(0, len(words) - self.window + 1), np.uint64))
    texts = [(i, prose(i % 5, 30)) for i in range(12)]
    machine = repeats.Automaton([(i, t.encode()) for i, t in texts], 7)
    for i, text in texts:
        assert machine.covered(i, text.encode().split()).sum() == (30 if i >= 5 else 0)


def test_removal_in_messy_rows(messy, empty):
    got = rows(repeats.removed_repeats(messy))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(messy_rows())
    assert by[6]["n_removed"] == 200 and by[5]["n_removed"] == 0 and by[None]["n_removed"] == 0
    assert by[11]["n_removed"] == 70 and by[1]["n_words"] == 0
    assert repeats.removed_repeats(empty).count() == 0
    left = repeats.without_repeats(messy)
    assert left.columns == messy.columns and 6 not in {r["doc_id"] for r in left.collect()}
    row = left.where("doc_id = 11").first()
    assert row["text"] == prose(3, 60) and row["n_chars"] == len(row["text"])


# 9: SentencePiece


def test_best_paths_by_brute_force_and_exact_round_trips():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECE)
    score = {model.id_to_piece(i): model.get_score(i) for i in range(259, model.get_piece_size())}
    pieces, draw = sentencepieces.PieceModel(PIECE, cache=200), random.Random(3)
    parts = ["a", "b", " ", "  ", "the", "\n", "é", "中", "𝒳", ".", "ing", " th", "\t", "▁", "12"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(600)] + ["", " ", None]
    for at, ids, bounds in pieces.batches(pa.array(texts)):
        for i in range(len(bounds) - 1):
            text, own = texts[at + i] or "", ids[bounds[i] : bounds[i + 1]]
            assert pieces.decode(own).decode() == text
            if any(c not in score for c in text.replace(" ", "▁")) or "▁" in text:
                continue
            part = (" " + text if text else "").replace(" ", "▁")
            best = [0.0]
            for end in range(1, len(part) + 1):
                best.append(max(best[k] + score[part[k:end]] for k in range(max(0, end - 20), end) if part[k:end] in score))
            assert sum(model.get_score(int(k)) for k in own) == best[-1]


def test_pieces_of_messy_rows(messy, empty):
    got = sentencepieces.encode_and_decode(messy, PIECE).collect()
    texts = {i: t or "" for i, t, *_ in messy_rows()}
    assert len(got) == len(messy_rows()) and all(r["same"] for r in got)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
    assert sentencepieces.encode_and_decode(empty, PIECE).count() == 0
    assert sentencepieces.encoded(messy, PIECE).where("doc_id = 4").first()["ids"]


# 10: vectors


def brute_links(vectors, threshold=0.95):
    fit = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in fit.items()}
    near = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= threshold} for i in unit}
    root = {i: i for i, _ in vectors}
    for _ in vectors:
        for i, others in near.items():
            root[i] = min([root[i], *(root[j] for j in others)])
    return {i: (len(near.get(i, ())), root[i]) for i, _ in vectors}


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    draw = np.random.default_rng(5)
    base = draw.standard_normal((6, 16))
    vectors = [base[k] + s * draw.standard_normal(16) for k, (n, s) in enumerate([(70, 0.02), (30, 0.1), (9, 0.2), (2, 0.05), (1, 0), (1, 0)]) for _ in range(n)]
    vectors += list(draw.standard_normal((120, 16))) + [vectors[0]] * 5
    told = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    told += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0])]
    df = spark.createDataFrame(told, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1)).withColumn("root", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_vectors(df).collect()}
    want = brute_links(told)
    found = sum(min(got[i][0], n) for i, (n, _) in want.items())
    assert found >= 0.99 * sum(n for n, _ in want.values()) and all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(got[i][1] == r for i, (_, r) in want.items()) >= 0.99 * len(want)
    assert neighbours.near_vectors(df.limit(0)).count() == 0
    copies = df.where("vec_id < 3").unionByName(df.where("vec_id < 3")).unionByName(df.where("vec_id = 1").withColumn("vec_id", F.lit(None)))
    assert neighbours.near_vectors(copies).count() == 7


def families(sizes, inner, cross):
    """Unit vectors at cosine ``inner`` within a family and ``cross`` between two of them."""
    n = sum(sizes)
    family, near = np.repeat(np.arange(len(sizes)), sizes), np.zeros((n, n))
    near[:] = np.where(family[:, None] == family[None, :], inner, cross)
    np.fill_diagonal(near, 1)
    return np.linalg.cholesky(near)


def test_vectors_link_across_families_that_fill_each_others_places(spark):
    vectors = families([40, 40], 0.99, 0.96)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_vectors(df).collect()}
    assert got == {i: (79, 0) for i in range(80)}


def test_vectors_are_compared_as_a_whole_where_the_search_stays_short(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "AUDIT", 5)  # most likely without one of the three linked vectors
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1)
    monkeypatch.setattr(neighbours, "_start", lambda nodes, *_: nodes.sparkSession.createDataFrame([], neighbours.PAIR))
    vectors = np.concatenate([np.eye(120), families([3], 0.96, 0) @ np.eye(3, 120) + 1e-3 * np.eye(3, 120, 60)])[3:]
    told = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(told, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_vectors(df).collect()}
    assert got == brute_links(told) and got[119] == (2, 117)


def test_asked_vectors_meet_every_link_in_any_tile_and_chunk(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 7)
    monkeypatch.setattr(neighbours, "LEADERS", 3)
    monkeypatch.setattr(neighbours, "CHUNK", 16 * 50)
    draw = np.random.default_rng(6)
    base = draw.standard_normal((8, 16))
    told = [(i, [float(x) for x in base[i % 8] + 0.2 * (i % 3) * draw.standard_normal(16)], 1 + i % 2, i % 8) for i in range(200)]
    nodes = spark.createDataFrame(told, "node bigint, v array<double>, weight bigint, root bigint")
    asked = neighbours._asked(nodes, nodes, 16)
    x = np.array([v for _, v, *_ in told])
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(200, dtype=bool)
    want = {i: int(n) for i, n in enumerate(near @ np.array([w for *_, w, _ in told])) if n}
    for side in ("asked", "not asked"):
        assert {r["node"]: r["n"] for r in asked.where(side).groupBy("node").agg(F.sum("n").alias("n")).collect()} == want
    roots = {r["node"]: r["root"] for r in components(asked.select(F.col("node").alias("a"), F.col("other").alias("b"))).collect()}
    brute = brute_links([(i, v) for i, v, *_ in told])
    assert {i: roots.get(i, i) for i in brute} == {i: root for i, (_, root) in brute.items()}


# pipeline


@tables
def test_each_stage_of_the_pipeline(spark):
    from voilage.llm.shared import materialize, table

    docs, seen = table(spark, SMALL, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SMALL))
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["near duplicates"]
    want = brute_components({i: r["text"] for i, r in before.items()}, 5)
    assert {r["doc_id"] for r in after} == {i for i, (_, root) in want.items() if root == i}
    before, after = seen["repeated passages"]
    want = brute_removal([(i, r["text"]) for i, r in sorted(before.items())], 50)
    left = {r["doc_id"]: r["text"] for r in after}
    for i, (n, gone, sha) in want.items():
        if gone == 0:
            assert left[i] == before[i]["text"]
        elif gone < n:
            assert hashlib.sha256(left[i].encode()).hexdigest() == sha
        else:
            assert i not in left
    before, after = seen["packing"]
    check_packing({i: r["text"] for i, r in before.items()}, after, packing.CAPACITY)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality classifier"][1]}
    good = [i in kept for i, q in labels.items() if q == 1]
    assert sum(good) / len(good) > 0.95


def test_the_pipeline_runs_on_messy_and_on_empty_tables(spark, messy, empty, tmp_path):
    for name, rows_in in (("messy", messy), ("empty", empty)):
        rows_in.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in pieces} <= {r[0] for r in messy_rows()} and (name == "messy") == bool(pieces)


def test_every_operator_has_its_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5
