"""Column expressions for single values. All of them run inside the JVM."""

from voilage.functions.actions import ACTIONS, Noise, generalize, register_action
from voilage.functions.delimited import delimiter_of, first_line, header_names, looks_like_header
from voilage.functions.numbers import (
    bin_income, floor_text, income_band, income_below, parse_amount, parse_unsigned,
)
from voilage.functions.noise import laplace, noisy_amount, uniform_draw
from voilage.functions.text import (
    escape_markup, fsa, hmac12, leading_year, mask_simple, only_year, sha256_hex,
    short_fsa, strip_blanks, to_fsa, unaccent, year_or_empty,
)

__all__ = [
    "ACTIONS", "Noise", "bin_income", "delimiter_of", "escape_markup", "first_line",
    "floor_text", "fsa", "generalize", "header_names", "hmac12", "income_band", "income_below",
    "laplace", "leading_year", "looks_like_header", "mask_simple", "noisy_amount", "only_year",
    "parse_amount", "parse_unsigned", "register_action", "sha256_hex", "short_fsa", "strip_blanks",
    "to_fsa", "unaccent", "uniform_draw", "year_or_empty",
]
