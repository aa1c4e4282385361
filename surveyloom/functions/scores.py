"""Scalar scoring, recoding and labelling as Column expressions.

All of them keep NULL as NULL unless filling it is their purpose.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Sequence

from pyspark.sql import Column, functions as F

from surveyloom.model import LIKERT, LIKERT_TOP


def likert_score(answer: Column, labels: Sequence[tuple[str, int]] = LIKERT) -> Column:
    """Label to number; labels outside the table become NULL."""
    table = F.create_map(*[F.lit(x) for pair in labels for x in pair])
    return F.try_element_at(table, answer)


def key_score(answer: Column, key: Column) -> Column:
    """1 right, 0 wrong, NULL unanswered."""
    return (answer == key).cast("int")


def reverse_score(item: Column, score: Column, reversed_items: Sequence[str], top: int = LIKERT_TOP) -> Column:
    return F.when(item.isin(list(reversed_items)), F.lit(top + 1) - score).otherwise(score)


def signed_score(score: Column, loading: Column, top: int = LIKERT_TOP) -> Column:
    """Reverse where the loading is not positive; NULL loading gives NULL."""
    return F.when(loading > 0, score).when(loading <= 0, F.lit(top + 1) - score)


def yes_no(condition: Column) -> Column:
    """Yes, No, or NULL for an unknown condition."""
    return F.when(condition, "Yes").when(~condition, "No")


def option_flag(answer: Column, value: str) -> Column:
    return yes_no(answer == F.lit(value))


def recode(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order to any matching part of the text."""
    return reduce(lambda done, pair: F.regexp_replace(done, pair[0], pair[1]), replacements, text)


def collapse(value: Column, members: Sequence[str], into: str, rest: str | None = None) -> Column:
    """Merge ``members`` into one level; others stay, or all become ``rest``."""
    other = value if rest is None else F.lit(rest)
    return F.when(value.isin(list(members)), F.lit(into)).otherwise(other)


def override_role(role: Column, prior: Column, include_prior: bool, focus: str) -> Column:
    """Move respondents with a prior membership into the focus group on request."""
    return F.when(F.lit(include_prior) & (F.coalesce(prior, F.lit("No")) == "Yes"), F.lit(focus)).otherwise(role)


def fill_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def duration_min(started: Column, completed: Column) -> Column:
    """Minutes to two decimals, 0 for an unfinished questionnaire."""
    micros = F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.coalesce(F.round(micros / F.lit(6e7), 2), F.lit(0.0))


def day(moment: Column) -> Column:
    return F.to_date(moment)


def signed_share(level: Column, share: Column, low_levels: Sequence[str]) -> Column:
    """Shares of the low levels negated, one decimal, for a diverging bar."""
    return F.when(level.isin(list(low_levels)), F.round(-share, 1)).otherwise(F.round(share, 1)) + F.lit(0.0)


def encode_yes_no(value: Column) -> Column:
    return (value == "Yes").cast("int")


def encode_levels(value: Column, codes: dict[str, int]) -> Column:
    """Ordinal code; an unlisted level is 0 and NULL stays NULL."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, value), F.lit(0)))


def row_total(columns: Sequence[str]) -> Column:
    """Sum across columns, NULL if any of them is NULL."""
    return reduce(add, [F.col(c) for c in columns])


def letter_grade(share: Column) -> Column:
    return (
        F.when(share > 0.8, "A")
        .when(share > 0.6, "B")
        .when(share > 0.4, "C")
        .when(share > 0.2, "D")
        .when(share.isNotNull(), "F")
    )


def p_label(p: Column, cuts: Sequence[float] = (0.05, 0.1), rest: str = "no_sig") -> Column:
    """Label a p-value by the first cut it falls below."""
    label = F.when(p < cuts[0], f"p<{cuts[0]}")
    for cut in cuts[1:]:
        label = label.when(p < cut, f"p<{cut}")
    return label.when(p.isNotNull(), rest)


def sign_label(loading: Column) -> Column:
    return F.when(loading > 0, "positive").when(loading <= 0, "negative")


def within_limit(value: Column, limit: float) -> Column:
    return F.when(value <= limit, "Y").when(value > limit, "N")


def level_order(value: Column, levels: Sequence[str]) -> Column:
    """1-based position among ordered levels, NULL for an unknown level."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), value), F.lit(0).cast("long"))


def label_part(text: Column, kind: str = "first") -> Column:
    """Code inside a header: first word, or the text in parentheses."""
    if kind == "first":
        return F.split_part(text, F.lit(" "), F.lit(1))
    return F.nullif(F.regexp_extract(text, r"\(([^)]*)\)", 1), F.lit(""))
