"""Configuration rules the collectors share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageledger.functions.records import make_score
from usageledger.schema import COMPONENT_DDL, SCORES_DDL


@dataclass(frozen=True)
class OnlyIf:
    """A rule applies where the text of ``key`` matches the pattern anywhere."""

    key: str
    matches: str


@dataclass(frozen=True)
class SiteRule:
    name: str
    only_if: OnlyIf | None = None


@dataclass(frozen=True)
class ScoreRule:
    name: str
    value: float
    only_if: OnlyIf | None = None


@dataclass(frozen=True)
class ComponentRule:
    name: str
    key: str
    key_type: str = "Integer"
    default_value: int | None = None
    scores: tuple[ScoreRule, ...] = field(default_factory=tuple)
    only_if: OnlyIf | None = None
    allow_empty: bool = False


@dataclass(frozen=True)
class MetaRule:
    name: str
    key: str
    key_type: str = "Integer"
    allow_empty: bool = False
    only_if: OnlyIf | None = None


def guard(only_if: OnlyIf | None, text_of) -> Column:
    """Does the rule apply?  ``text_of`` gives the raw text column of a key."""
    if only_if is None:
        return F.lit(True)
    return F.coalesce(text_of(only_if.key).rlike(only_if.matches), F.lit(False))


def first_site(rules: tuple[SiteRule, ...], text_of) -> Column:
    """Name of the first site rule that applies; null if none does."""
    return F.coalesce(
        *[F.when(guard(rule.only_if, text_of), F.lit(rule.name)) for rule in rules]
    )


def scores_of(rules: tuple[ScoreRule, ...], text_of) -> Column:
    if not rules:
        return F.array().cast(SCORES_DDL)
    return F.array_compact(
        F.array(
            *[
                F.when(guard(rule.only_if, text_of), make_score(rule.name, F.lit(rule.value)))
                for rule in rules
            ]
        )
    ).cast(SCORES_DDL)


def components_of(
    rules: tuple[ComponentRule, ...], amount_of, text_of
) -> tuple[Column, Column]:
    """(component list, is complete): incomplete if a rule that applies finds
    neither its key nor a default."""
    if not rules:
        return F.array().cast(f"array<{COMPONENT_DDL}>"), F.lit(True)
    entries, complete = [], F.lit(True)
    for rule in rules:
        applies = guard(rule.only_if, text_of)
        amount = F.coalesce(amount_of(rule), F.lit(rule.default_value).cast("bigint"))
        entries.append(
            F.when(
                applies,
                F.struct(
                    F.lit(rule.name).alias("name"),
                    amount.alias("amount"),
                    scores_of(rule.scores, text_of).alias("scores"),
                ),
            )
        )
        complete &= ~applies | amount.isNotNull()
    return F.array_compact(F.array(*entries)).cast(f"array<{COMPONENT_DDL}>"), complete
