"""Ranks, top-k and standardising.

Ranking windows run on grouped frames (items, scales, factors).  Where raw
rows are ranked, the rank goes through value counts instead.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.functions.numeric import safe_divide
from surveyloom.operators.selection import value_counts
from surveyloom.session import attach, attach_measured, with_values


def unique_rank(grouped: DataFrame, order: Sequence[Column], out: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """1, 2, 3, ... on a grouped frame; the order must end in a unique column."""
    window = Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)
    return grouped.withColumn(out, F.row_number().over(window))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """Rank of the value within its keys, ties sharing their mean rank.

    Works from counts per distinct value, so a group or a tie of any size is
    never sorted in one task.  Rows with a NULL value are dropped.
    """
    ranked = value_counts(df, keys, value)
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    if descending:
        rank = F.col("n_total") + 1 - rank
    ranked = ranked.select(*keys, value, rank.alias(out))
    return df.join(ranked, [*keys, value])


def average_rank_grouped(grouped: DataFrame, keys: Sequence[str], score: Column, out: str = "rank") -> DataFrame:
    """Mean rank by descending score on a frame whose groups are dictionary-sized."""
    # A tie shares one rank() value, so its size is a count over that value.
    first = F.rank().over(Window.partitionBy(*keys).orderBy(score.desc()))
    with_first = grouped.where(score.isNotNull()).withColumn("_first", first)
    ties = Window.partitionBy(*keys, "_first")
    return with_first.withColumn(out, F.col("_first") + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)).drop("_first")


def top_k_per_group(df: DataFrame, keys: Sequence[str], score: Column, k: int, out: str = "rank") -> DataFrame:
    """Rows whose mean rank by descending score is within ``k``.

    A mean rank within k needs a minimum rank within k, and Spark applies that
    cheaper limit inside each task before shuffling.
    """
    window = Window.partitionBy(*keys).orderBy(score.desc())
    near = df.where(score.isNotNull()).withColumn("_first", F.rank().over(window)).where(F.col("_first") <= k)
    ties = Window.partitionBy(*keys, "_first")
    rank = F.col("_first") + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return near.withColumn(out, rank).where(F.col(out) <= k).drop("_first")


def best_per_group(df: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """The single best row; an exact tie for first keeps none, as its mean rank is 1.5."""
    return top_k_per_group(df, keys, score, 1).drop("rank")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def order_by_group_stat(df: DataFrame, group: str, value: str, out: str = "position") -> DataFrame:
    """Group means with their chart position, lowest first."""
    means = df.groupBy(group).agg(F.avg(value).alias("mean"))
    return unique_rank(means, [F.col("mean").asc_nulls_last(), F.col(group)], out)


def zscore(df: DataFrame, keys: Sequence[str], value: str, out: str = "z", rows: int | None = None) -> DataFrame:
    """Standardise within keys by the sample sd; NULL where the sd is zero."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    if not keys:
        joined = with_values(df, stats)
    else:
        joined = attach(df, stats, list(keys), rows) if rows else attach_measured(df, stats, list(keys))
    return joined.withColumn(out, safe_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")
