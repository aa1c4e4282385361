"""Small numeric Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tidy(value: Column, digits: int = 6) -> Column:
    """Round for comparison or display; adding zero removes a negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or NULL (ANSI division would raise)."""
    return F.when(b != 0, a / b)
