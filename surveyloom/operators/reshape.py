"""Long and wide shapes, named columns, level order, row numbers, joins by key."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions.scores import level_order
from surveyloom.operators.selection import number_rows
from surveyloom.session import attach


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str = "item", value: str = "answer") -> DataFrame:
    """Gather columns into key/value rows, NULL values kept."""
    return df.unpivot(list(ids), list(cols), key, value)


def to_long_twice(
    df: DataFrame,
    ids: Sequence[str],
    first: Sequence[str],
    second: Sequence[str],
    names: tuple[str, str, str, str] = ("category", "response", "facet", "level"),
) -> DataFrame:
    """Category x facet: gather one block of columns, then another."""
    key1, value1, key2, value2 = names
    once = df.unpivot([*ids, *second], list(first), key1, value1)
    return once.unpivot([*ids, key1, value1], list(second), key2, value2)


def to_wide(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str, names: Sequence, how: str = "first") -> DataFrame:
    """One column per declared name.  Declaring the names spares a pass over the data."""
    agg = {"first": F.first, "sum": F.sum, "max": F.max}[how]
    return df.groupBy(*keys).pivot(names_from, list(names)).agg(agg(values_from))


def rename_cols(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def select_items(responses: DataFrame, key: DataFrame, item: str = "item") -> DataFrame:
    """Answers to the items of a key.  The key is a declared dictionary, so it is broadcast."""
    return responses.join(F.broadcast(key.select(item).distinct()), item, "left_semi")


def with_level_order(df: DataFrame, col: str, levels: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, level_order(F.col(col), levels))


def with_row_id(df: DataFrame, order: Sequence[str], out: str = "row_id") -> DataFrame:
    """1, 2, 3, ... in the given order; the order must be unique per row."""
    return number_rows(df, order, out)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def complete_cases(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_not_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """A NULL is not one of the values, so its row stays."""
    return df.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def left_on(df: DataFrame, other: DataFrame, on: Sequence[str], rows: int | None = None) -> DataFrame:
    """Left join with named keys; ``rows`` bounds a dictionary side."""
    return attach(df, other, list(on), rows)


def keep_dictionary(loadings: DataFrame, items: DataFrame, on: str) -> DataFrame:
    """Right join: every dictionary item stays, matched or not."""
    return loadings.join(items, on, "right")


def attach_cluster(df: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(labels, id_col, "left")


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def complement(df: DataFrame, taken: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not among ``taken``."""
    return df.join(taken.select(*on), list(on), "left_anti")


def norms_joined(scores: DataFrame, norms: DataFrame, on: str) -> DataFrame:
    """Published norms (a declared table) beside group scores."""
    return scores.join(F.broadcast(norms), on, "left")


def sort_by(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.orderBy(*order)
