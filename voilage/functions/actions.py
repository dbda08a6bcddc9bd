"""The six per-column actions, and the registry that users may extend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column

from pyspark.sql import functions as F

from voilage.config import Rule, Settings
from voilage.columns import field
from voilage.functions.noise import noisy_amount, rounded_amount, uniform_draw
from voilage.functions.numbers import bin_income, income_below
from voilage.functions.text import fsa, hmac12, mask_simple, sha256_hex, year_or_empty


@dataclass(frozen=True)
class Noise:
    """Where noise comes from: the budget, the secret seed, the columns naming a record."""

    epsilon: float
    seed: str
    record: tuple[str, ...]

    @classmethod
    def of(cls, settings: Settings, record: tuple[str, ...]) -> Noise:
        return cls(settings.noise_epsilon, settings.noise_seed, record)

    def on(self, c: Column, purpose: str) -> Column:
        """Noise ``c``; the draw depends on the record, the purpose and the value."""
        parts = [F.lit(purpose), *(field(r) for r in self.record), c]
        return noisy_amount(c, self.epsilon, uniform_draw(self.seed, *parts))

    def by_rule(self, c: Column, rule: Rule, name: str) -> Column:
        """Noise with the rule's own ``epsilon`` and ``round``, where it has them."""
        param = rule.param or {}
        epsilon = float(param["epsilon"]) if param.get("epsilon") is not None else self.epsilon
        if epsilon <= 0:
            raise ValueError("epsilon must be above 0")
        noised = replace(self, epsilon=epsilon).on(c, f"rule:{name}")
        return rounded_amount(noised, param["round"]) if param.get("round") else noised


Builder = Callable[[Column, Rule, Noise, str], Column]


def generalize(c: Column, param: dict[str, Any] | None) -> Column:
    """Coarsen by ``param['type']`` (date-year, postal-fsa, income-bin) or ``param['granularity']`` (year, postal_fsa, bin).

    Both spellings act. Any other value, or an income-bin without thresholds, leaves the cell
    alone; the granularity ``bin`` without thresholds takes the fixed bins.
    """
    param = param or {}
    kind = param.get("type") or {"year": "date-year", "postal_fsa": "postal-fsa"}.get(param.get("granularity"))
    if kind is None and param.get("granularity") == "bin":
        return bin_income(c) if param.get("thresholds") is None else income_below(c, param["thresholds"])
    if kind == "date-year":
        return year_or_empty(c)
    if kind == "postal-fsa":
        return fsa(c)
    if kind == "income-bin" and param.get("thresholds") is not None:
        return income_below(c, param["thresholds"])
    return c


def pseudonym(c: Column, param: dict[str, Any] | None) -> Column:
    """The digest of a value, keyed by ``param['salt']`` if there is one."""
    salt = (param or {}).get("salt")
    return hmac12(c, salt) if salt else sha256_hex(c)


ACTIONS: dict[str, Builder] = {
    "none": lambda c, rule, noise, name: c,
    "suppress": lambda c, rule, noise, name: F.when(c.isNotNull(), F.lit("")),
    "pseudonymize": lambda c, rule, noise, name: pseudonym(c, rule.param),
    "mask": lambda c, rule, noise, name: mask_simple(c),
    "generalize": lambda c, rule, noise, name: generalize(c, rule.param),
    "noise": lambda c, rule, noise, name: noise.by_rule(c, rule, name),
}


def register_action(action: str, builder: Builder) -> None:
    """Add an action. ``builder(column, rule, noise, name)`` returns a Column.

    It may be any Column, also one made by a ``pandas_udf``.
    """
    ACTIONS[action] = builder


def build(action: str) -> Builder:
    """An unknown action leaves the value alone."""
    return ACTIONS.get(action, ACTIONS["none"])
