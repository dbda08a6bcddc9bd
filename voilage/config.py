"""Job configuration: which column plays which role, what to do with it, how strictly."""

from __future__ import annotations

import secrets
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from typing import Any

ROLE_NAMES = ("id", "postal", "date1", "date2", "revenue", "sensitive")


@dataclass(frozen=True)
class Roles:
    """The role of each column; ``qids`` are the quasi-identifiers, in key order."""

    id: str | None = None
    postal: str | None = None
    date1: str | None = None
    date2: str | None = None
    revenue: str | None = None
    sensitive: str | None = None
    qids: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "qids", tuple(self.qids or ()))

    @property
    def date(self) -> str | None:
        """The one date column that gets reduced to a year."""
        return self.date1 or self.date2

    def require(self, columns: Iterable[str], *, with_qids: bool = True) -> None:
        """Refuse roles that name unknown columns, or no quasi-identifier at all."""
        if with_qids and not self.qids:
            raise ValueError("choose at least one quasi-identifier")
        known = set(columns)
        named = [getattr(self, r) for r in ROLE_NAMES] + list(self.qids)
        missing = sorted({c for c in named if c and c not in known})
        if missing:
            raise ValueError(f"roles name columns the table does not have: {missing}")


@dataclass(frozen=True)
class Rule:
    """One action for one column: none, generalize, mask, pseudonymize, noise or suppress."""

    action: str = "none"
    param: dict[str, Any] | None = None


@dataclass(frozen=True)
class Settings:
    """Switches and thresholds. The defaults are the recommended preset.

    ``noise_seed`` keys the noise: the same settings always add the same noise to
    the same record, so a lost executor or a second pass sees the same table. It
    is secret, random per object unless given, and never exported.
    """

    epsilon: float = 2
    k_anon: int = 10
    l_div: int = 3
    t_close: float = 0.3
    suppress_extras: bool = True
    zip3: bool = True
    year_only: bool = True
    hash_ids: bool = True
    mask_pii: bool = True
    noise_revenue: bool = True
    noise_seed: str = field(default_factory=lambda: secrets.token_hex(16), repr=False, compare=False)

    @property
    def k(self) -> int:
        return max(2, self.k_anon or 2)

    @property
    def l(self) -> int:  # noqa: E743
        return max(1, self.l_div or 1)

    @property
    def t(self) -> float:
        return max(0.0, float(self.t_close or 0))

    @property
    def noise_epsilon(self) -> float:
        """The noise's budget. 0 would mean no protection at all, and is refused."""
        epsilon = 2.0 if self.epsilon is None else float(self.epsilon)
        if epsilon <= 0:
            raise ValueError("epsilon must be above 0; switch the noise off to publish amounts as they are")
        return epsilon

    def exported(self) -> dict[str, Any]:
        """Everything that may leave the job, so all but the noise seed."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "noise_seed"}


def preset() -> Settings:
    """The automatic preset: every protection on, default thresholds."""
    return Settings()
