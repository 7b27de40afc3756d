"""What a run is told about a table: which columns play which part, and the rules that hold for them."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class RuleKind(str, Enum):
    LESS_EQUAL = "less_than_or_equal"
    LESS = "less_than"
    GREATER_EQUAL = "greater_than_or_equal"
    GREATER = "greater_than"
    EQUALITY = "equality"
    DATE_ORDER = "date_order"
    MIN_MAX = "min_max"
    CALCULATED = "calculated_field"
    NULLABLE_IF = "nullable_if"
    REQUIRED_IF = "required_if"
    CUSTOM = "custom"
    RARE_CATEGORY = "rare_category"
    EXTREME_VALUE = "extreme_value"
    #: Audited only: no repair is defined for these.
    REQUIRED = "required"
    DATE_RANGE = "date_range"
    ALLOWED_VALUES = "allowed_values"


@dataclass(frozen=True)
class Rule:
    """Columns are taken by position; params name limits and values."""

    name: str
    kind: RuleKind
    columns: tuple[str, ...]
    params: dict[str, Any] = field(default_factory=dict)
    confidence: float = 1.0
    support: float = 1.0


@dataclass(frozen=True)
class ColumnPlan:
    """The part each column plays in metrics."""

    categorical: tuple[str, ...] = ()
    numerical: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    pii: dict[str, str] = field(default_factory=dict)  # column: drop, mask, hash or token
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Relationship:
    parent_table: str
    child_table: str
    parent_key: str
    child_key: str


@dataclass(frozen=True)
class RunConfig:
    """Limits and verdict thresholds; checked when made."""

    seed: int = 42
    rows: int | None = None
    k: int = 5
    l: int = 2  # noqa: E741
    t: float = 0.2
    bins: int = 20
    max_attempts: int = 20
    duplicate_policy: str = "balanced"  # strict, balanced or off

    def __post_init__(self) -> None:
        if self.rows is not None and self.rows < 1:
            raise ValueError("rows must be positive")
        if self.k < 1 or self.l < 1 or not 0 <= self.t <= 1 or self.bins < 1 or self.max_attempts < 1:
            raise ValueError("a limit is out of range")
        if self.duplicate_policy not in ("strict", "balanced", "off"):
            raise ValueError(f"unknown duplicate policy {self.duplicate_policy}")


def resolve_column(columns: list[str], name: str, synonyms: dict[str, str] | None = None) -> str | None:
    """The column meant by a name: itself, the same without case and punctuation, by synonym, or the only one that contains it."""
    if name in columns:
        return name
    plain = lambda s: "".join(ch for ch in s.casefold() if ch.isalnum())
    by = {plain(c): c for c in reversed(columns)}
    want = plain(name)
    if want in by:
        return by[want]
    for a, b in (synonyms or {}).items():
        if plain(a) == want and plain(b) in by:
            return by[plain(b)]
        if plain(b) == want and plain(a) in by:
            return by[plain(a)]
    near = [c for p, c in by.items() if want and (want in p or p in want)]
    return near[0] if len(near) == 1 else None
