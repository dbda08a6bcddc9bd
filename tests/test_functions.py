"""Single-value treatments against their written-down results."""

from __future__ import annotations

import hashlib
import hmac
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voilage import functions as V
from voilage.functions.noise import laplace


def check(evaluate_on, fn, cases):
    got = evaluate_on(fn, list(cases))
    assert dict(zip(cases, got)) == cases


def test_mask(evaluate_on):
    check(evaluate_on, V.mask_simple, {
        "client@example.com": "cl***@example.com", "@x": "***@x", "a@b@c": "a***@b", "a@": "a***@",
        "418-555-0199": "41****99", "Montréal": "******al", "ab": "ab", "a": "a", "": "",
        "12345678": "12****78", "1234567": "*****67", None: None,
        "abc\ndefg": "*bc\n**fg", "abc\r\nde": "*bc\r\nde", "ab\ncd": "ab\ncd", "a bcd": "a *cd",
    })


def test_income_bins(evaluate_on):
    check(evaluate_on, V.bin_income, {
        "73,450$": "70–80k", "52000,50": "5200–5210k", "-5": "-10–0k", "": "0–10k", "abc": "0–10k",
        "1-2": "", "1.2.3": "", "--5": "", "1.": "0–10k", "1e5": "0–10k", ".5": "0–10k", "-": "", ".": "",
        "9" * 400: "", None: None, "1" + "0" * 18: "1000000000000000–1000000000000010k",
    })


def test_income_bin_width(evaluate_on):
    assert evaluate_on(lambda c: V.bin_income(c, 25000), ["73450"]) == ["50–75k"]
    with pytest.raises(ValueError):
        V.bin_income(F.lit("1"), 1500)


def test_income_below(evaluate_on):
    cases = {"10": "<20000", "20000": "<50000.5", "50000.5": "<80000", "45000": "<50000.5", "90000": "≥80000",
             "": "<20000", "1-2": "", None: None}
    # 40000 comes after a larger threshold, so it is never the first one exceeded
    check(evaluate_on, lambda c: V.income_below(c, [20000, 50000.5, 40000, 80000]), cases)
    with pytest.raises(ValueError):
        V.income_below(F.lit("1"), [])


def test_income_bands(evaluate_on):
    check(evaluate_on, V.income_band, {
        "39999": "<40k", "40000": "40-60k", "59999.9": "40-60k", "60000": "60-80k", "80000": ">=80k",
        "-90000": ">=80k", "abc": "<40k", "1.2.3": "1.2.3", "9" * 400: ">=80k", None: None,
    })


def test_years(evaluate_on):
    check(evaluate_on, V.only_year, {
        "1990-04-12": "1990", "12/04/1985": "1985", "19900412": "1990", "abc": "abc", "2101-01-01": "2101",
        "é2001": "2001", "_2001": "_200", "": "", None: None, "en 1850 et 1950": "1950",
    })
    check(evaluate_on, V.year_or_empty, {
        "1990-04-12": "1990", "19900412": "", "abc": "", "_2001": "", "é2001": "2001", "": "", None: None,
    })
    check(evaluate_on, V.leading_year, {"1990-04-12": "1990", "12": "12", None: None})


def test_postal_areas(evaluate_on):
    check(evaluate_on, V.to_fsa, {
        "g7h 4b2": "G7H***", "g7h 4b2": "G7H***", "﻿g 7h4b2": "G7H***", "": "", " ": "",
        "G7H***": "G7H***", "g": "G***", None: None,
    })
    check(evaluate_on, V.fsa, {"g7h 4b2": "G7H", "": "", None: None})
    check(evaluate_on, V.short_fsa, {"g7h 4b2": "g7h***", "g 7h": "g 7***", None: None})


def test_hmac(evaluate_on):
    def expected(value, salt):
        return hmac.new(salt.encode(), value.encode(), hashlib.sha256).hexdigest()[:12]

    values = ["123", "é😀", "", "x" * 500]
    for salt in ("change-me-salt", "s" * 64, "t" * 65):
        assert evaluate_on(lambda c: V.hmac12(c, salt), values) == [expected(v, salt) for v in values]
    assert evaluate_on(lambda c: V.hmac12(c, "change-me-salt"), ["123", "456", "é😀", None]) == [
        "884fa0900172", "94c1ddcbb8e3", "270b711e02de", None,
    ]


def test_salt_from_environment(evaluate_on, monkeypatch):
    monkeypatch.setenv("HASH_SALT", "other")
    expected = hmac.new(b"other", b"123", hashlib.sha256).hexdigest()[:12]
    assert evaluate_on(V.hmac12, ["123"]) == [expected]


def test_sha256(evaluate_on):
    assert evaluate_on(V.sha256_hex, ["é", "", None]) == [
        hashlib.sha256("é".encode()).hexdigest(), hashlib.sha256(b"").hexdigest(), None,
    ]


def test_escape_and_unaccent(evaluate_on):
    assert evaluate_on(V.escape_markup, ["<a & b>&lt;"]) == ["&lt;a &amp; b&gt;&amp;lt;"]
    assert evaluate_on(V.unaccent, ["Élise.Côté", "Raphaël Bélanger"]) == ["elise.cote", "raphael belanger"]


def test_first_lines(evaluate_on):
    check(evaluate_on, V.first_line, {"a;b\r\nc": "a;b", "﻿a\nb": "a", "a\rb": "a\rb", "": "", None: None})
    check(evaluate_on, V.delimiter_of, {
        "a;b;c,d": ";", "a,b;c": ",", "a\tb\tc;d": "\t", "abc": ",", "a;b\tc": ";", "": ",", None: None,
    })


@pytest.mark.parametrize("epsilon", [0.5, 2.0])
def test_laplace_moments(spark, epsilon):
    draws = spark.range(200_000).select(V.uniform_draw("seed", F.col("id")).alias("u"))
    x = laplace(F.lit(1000.0), epsilon, F.col("u"), 500.0)
    b = 500.0 / epsilon
    mean, spread = draws.select(x.alias("x")).agg(F.avg("x"), F.avg(F.abs(F.col("x") - 1000))).first()
    assert abs(mean - 1000) < 0.02 * b
    assert abs(spread - b) < 0.02 * b
    low, high, middle = draws.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < low < 0.001 and 0.999 < high < 1 and abs(middle - 0.5) < 0.005


def test_laplace_without_budget(evaluate_on):
    assert evaluate_on(lambda c: laplace(c, 0, F.lit(0.9), 500.0), [5.0], "double") == [5.0]
    assert evaluate_on(lambda c: laplace(c, -1, F.lit(0.9), 500.0), [5.0], "double") == [5.0]


def test_noise_rounds_halves_up(evaluate_on):
    from voilage.functions.numbers import floor_text

    assert evaluate_on(lambda c: floor_text(c + 0.5), [-2.5, 2.5, -0.4, 1e20], "double") == [
        "-2", "3", "0", "100000000000000000000",
    ]


def test_whole_digits_up_to_1e37(evaluate_on):
    from voilage.functions.numbers import exact_floor_text

    values = [s * x for s in (1, -1) for x in (1.15e36, 1.1529215046068470e36, 1.16e36, 9.2e36, 9.99999999999999e36)]
    assert evaluate_on(exact_floor_text, values, "double") == [str(int(v)) for v in values]
    assert evaluate_on(exact_floor_text, [1e37], "double") == [None]


def test_noise_leaves_text_that_is_no_number(evaluate_on):
    got = evaluate_on(lambda c: V.noisy_amount(c, 2, F.lit(0.5)), ["73,450$", "1-2", "", None])
    assert got == ["73450", "1-2", "0", None]


def mask_by_hand(s: str) -> str:
    """The rule again, character by character."""
    if "@" in s:
        parts = s.split("@")
        return parts[0][:2] + "***@" + parts[1]
    if sum(c in "0123456789" for c in s) >= 8:
        return s[:2] + "****" + s[-2:]
    ends = "\n\r  "
    return "".join(
        "*" if c not in ends and len(s) > i + 2 and s[i + 1] not in ends and s[i + 2] not in ends else c
        for i, c in enumerate(s)
    )


def test_mask_long_lines(evaluate_on):
    lines = ["".join("ab*é "[(i * k) % 5] for i in range(n)) for k, n in ((1, 400), (2, 33), (3, 34), (4, 35), (7, 10), (9, 11))]
    values = ["\n".join(lines), "\r\n".join(lines), "\n" + lines[0], lines[1] + "\n", lines[0]]
    assert evaluate_on(V.mask_simple, values) == [mask_by_hand(v) for v in values]


def test_treatments_stay_in_generated_code(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a",)], "v string").write.parquet(path)
    c = F.col("v")
    spark.read.parquet(path).select(
        V.mask_simple(c), V.only_year(c), V.to_fsa(c), V.bin_income(c), V.income_band(c), V.hmac12(c, "s"),
        V.noisy_amount(c, 2, V.uniform_draw("s", c)),
    ).explain()
    assert re.search(r"\*\(\d+\) Project", capsys.readouterr().out)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab@01234567é\n\r  "), max_size=14), min_size=50, max_size=80))
def test_mask_any_text(evaluate_on, values):
    assert evaluate_on(V.mask_simple, values) == [mask_by_hand(v) for v in values]
