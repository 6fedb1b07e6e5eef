"""Declarations that operators take: features and rules. All are plain data, applied as literal expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

KINDS = ("continuous", "ordinal", "binary", "categorical")


@dataclass(frozen=True)
class FeatureSpec:
    """A column of a raw text table: its kind, the smallest valid value, and whether it identifies a row."""

    name: str
    kind: str = "categorical"
    min_valid: float | None = None
    identifier: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r} of {self.name}")


def with_open_columns(specs: list[FeatureSpec], columns: list[str]) -> tuple[list[FeatureSpec], list[str]]:
    """The specs of the columns there are, unknown ones as categorical, and the names of declared ones that lack."""
    known = {s.name: s for s in specs}
    return [known.get(c, FeatureSpec(c)) for c in columns], [s.name for s in specs if s.name not in columns]


@dataclass(frozen=True)
class Rule:
    """IF feature meets threshold THEN outcome. threshold is None until calibrated."""

    rule_id: str
    feature: str
    kind: str
    weight: int = 1
    threshold: float | str | bool | None = None
    precision: float = 0.0
    support: int = 0
    outcome: str = "success"
    mechanisms: tuple[str, ...] = field(default=())
