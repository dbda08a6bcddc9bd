"""Small column helpers shared by every module."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(name: str) -> Column:
    """A top-level column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    """The column as text, with absent cells read as empty text."""
    return F.coalesce(field(name).cast("string"), F.lit(""))


# --- patterns as searches for plain text ---------------------------------------

_PIECE = re.compile(r"\[([^\]\\^-]+-?)\](\??)|([^\\^$.|?*+()\[\]{}])")  # a set of characters, perhaps absent, or one character


def _branches(pattern: str) -> list[str]:
    """A pattern's alternatives outside all brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _spellings(branch: str) -> list[str] | None:
    """All texts a branch stands for, if it is made of characters and sets of them."""
    found = list(_PIECE.finditer(branch))
    if not branch or "".join(m.group() for m in found) != branch:
        return None
    return ["".join(p) for p in itertools.product(*[[m[3]] if m[3] else [*m[1], *([""] if m[2] else [])] for m in found])]


def _shortest(texts: Sequence[str]) -> list[str]:
    """Those that hold no other one: where any of all occurs, one of these does."""
    return [t for i, t in enumerate(texts) if t not in texts[:i] and not any(u != t and u in t for u in texts)]


def _needed(branch: str) -> list[str]:
    """Texts of which a name must hold one for the branch to occur in it; none if that is not seen at once."""
    head = re.sub(r"\(\^\|_\)|\(\$\|_\)|^\^|\$$", "", branch).split(".*")[0]
    inner = head[1:-1] if re.fullmatch(r"\([^()]*\)", head) else head
    spelled = [_spellings(b) for b in _branches(inner)]
    return [] if None in spelled else _shortest(list(itertools.chain(*spelled)))


@functools.cache
def _searches(pattern: str) -> tuple[tuple[str, ...], tuple[tuple[tuple[str, ...], str], ...]]:
    """(texts, (needed texts, branch) pairs): a pattern occurs where one of the texts or of the branches does."""
    spelled = {b: _spellings(b) for b in _branches(pattern)}
    texts = _shortest([t for all_of in spelled.values() for t in all_of or ()])
    return tuple(texts), tuple((tuple(_needed(b)), b) for b, all_of in spelled.items() if all_of is None)


def occurs(name: Column, pattern: str) -> Column:
    """``name.rlike(pattern)``, which costs much less where the pattern is mostly plain words."""

    def any_of(tests: Sequence[Column]) -> Column:
        return functools.reduce(lambda a, b: a | b, tests)

    texts, branches = _searches(pattern)
    tests = [name.contains(F.lit(t)) for t in texts]
    for needed, branch in branches:
        found = name.rlike(branch)
        tests.append(any_of([name.contains(F.lit(t)) for t in needed]) & found if needed else found)
    return any_of(tests)


def first_match(name: Column, rules: Sequence[tuple[str, Any]], default: Any) -> Column:
    """The value of the first rule whose pattern occurs in ``name``."""
    chosen = None
    for pattern, value in rules:
        hit = occurs(name, pattern)
        chosen = F.when(hit, F.lit(value)) if chosen is None else chosen.when(hit, F.lit(value))
    return F.lit(default) if chosen is None else chosen.otherwise(F.lit(default))


def matching(names: Sequence[str], pattern: str) -> list[str]:
    """The names a pattern occurs in, compared in lower case."""
    return [n for n in names if re.search(pattern, n.lower())]


def round_half_up(x: Column) -> Column:
    """Round to a whole number with halves going towards positive infinity."""
    return F.floor(x + F.lit(0.5))
