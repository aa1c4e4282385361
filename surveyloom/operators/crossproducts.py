"""Pairwise item statistics without pairing rows.

A self-join on the respondent would emit every pair of items for everyone.
Here each task multiplies its own respondents' answer block by itself and only
the items-by-items sums leave the task.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from surveyloom.operators.reshape import to_wide
from surveyloom.session import attach

_SCHEMA = "item_a string, item_b string, n long, sum_a double, sum_b double, sum_aa double, sum_bb double, sum_ab double"
_SUMS = ("n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")


def _blocks(batches: Iterator[pd.DataFrame], items: list[str]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch[items].to_numpy(dtype=float, na_value=np.nan)


def pair_sums(responses: DataFrame, items: Sequence[str], value: str = "score", ident: str = "id", complete: bool = False) -> DataFrame:
    """Sums over respondents who answered both items, for every a < b.

    Values are centred on the item mean first, which changes no covariance and
    keeps the sums small.  ``complete`` keeps respondents with every item.
    """
    items = sorted(items)
    means = responses.where(F.col("item").isin(items)).groupBy("item").agg(F.avg(value).alias("_mean"))
    centred = attach(responses, means, ["item"], len(items), "inner").withColumn("_c", F.col(value) - F.col("_mean"))
    wide = to_wide(centred, [ident], "item", "_c", items)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(items)
        n, sa, saa, sab = (np.zeros((p, p)) for _ in range(4))
        for block in _blocks(batches, items):
            seen = ~np.isnan(block)
            if complete:
                block, seen = block[seen.all(axis=1)], seen[seen.all(axis=1)]
            x, m = np.where(seen, block, 0.0), seen.astype(float)
            n += m.T @ m
            sa += x.T @ m
            saa += (x * x).T @ m
            sab += x.T @ x
        a, b = np.triu_indices(p, 1)
        names = np.array(items, dtype=object)
        frame = pd.DataFrame({"item_a": names[a], "item_b": names[b], "n": n[a, b].astype("int64")})
        frame["sum_a"], frame["sum_b"] = sa[a, b], sa.T[a, b]
        frame["sum_aa"], frame["sum_bb"] = saa[a, b], saa.T[a, b]
        frame["sum_ab"] = sab[a, b]
        yield frame[frame["n"] > 0]

    parts = wide.select(*items).mapInPandas(products, _SCHEMA)
    return parts.groupBy("item_a", "item_b").agg(*[F.sum(c).alias(c) for c in _SUMS])


def correlations(sums: DataFrame) -> DataFrame:
    """Correlation per pair; NULL for a constant item."""
    n = F.col("n")
    cov = F.col("sum_ab") - F.col("sum_a") * F.col("sum_b") / n
    var_a = F.col("sum_aa") - F.col("sum_a") * F.col("sum_a") / n
    var_b = F.col("sum_bb") - F.col("sum_b") * F.col("sum_b") / n
    spread = (var_a > 1e-12) & (var_b > 1e-12)
    return sums.select("item_a", "item_b", "n", F.when(spread, cov / F.sqrt(var_a * var_b)).alias("r"))


def cor_pairwise(responses: DataFrame, items: Sequence[str], value: str = "score", ident: str = "id") -> DataFrame:
    """Pair-complete correlations (item_a < item_b) with the pair's n."""
    return correlations(pair_sums(responses, items, value, ident))


def cor_complete(responses: DataFrame, items: Sequence[str], value: str = "score", ident: str = "id") -> DataFrame:
    """Correlation matrix over respondents with every item, one wide row per item."""
    half = correlations(pair_sums(responses, items, value, ident, complete=True))
    both = half.select("item_a", "item_b", "r").union(half.select("item_b", "item_a", "r"))
    names = sorted(items)
    cells = [F.when(F.col("item") == c, 1.0).otherwise(F.max(F.when(F.col("item_b") == c, F.col("r")))).alias(c) for c in names]
    return both.groupBy(F.col("item_a").alias("item")).agg(*cells)


def variable_distance(responses: DataFrame, items: Sequence[str], value: str = "score", ident: str = "id") -> DataFrame:
    """Euclidean distance between variables over complete respondents."""
    sums = pair_sums(responses, items, value, ident, complete=True)
    means = responses.where(F.col("item").isin(list(items))).groupBy("item").agg(F.avg(value).alias("m"))
    named = lambda side: F.broadcast(means.select(F.col("item").alias(f"item_{side}"), F.col("m").alias(f"m_{side}")))
    both = sums.join(named("a"), "item_a").join(named("b"), "item_b")
    # Undo the centring: (x - y) = (cx - cy) + (mean x - mean y).
    shift = F.col("m_a") - F.col("m_b")
    square = (
        F.col("sum_aa") + F.col("sum_bb") - 2 * F.col("sum_ab")
        + 2 * shift * (F.col("sum_a") - F.col("sum_b")) + F.col("n") * shift * shift
    )
    return both.select("item_a", "item_b", F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def win_counts(responses: DataFrame, items: Sequence[str], value: str = "score", ident: str = "id") -> DataFrame:
    """For ordered pairs, respondents with item_a right and item_b wrong."""
    items = sorted(items)
    wide = to_wide(responses, [ident], "item", value, items)

    def wins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(items)
        total = np.zeros((p, p))
        for block in _blocks(batches, items):
            total += (block == 1).astype(float).T @ (block == 0).astype(float)
        a, b = np.nonzero(total)
        names = np.array(items, dtype=object)
        yield pd.DataFrame({"item_a": names[a], "item_b": names[b], "n": total[a, b].astype("int64")})

    parts = wide.select(*items).mapInPandas(wins, "item_a string, item_b string, n long")
    return parts.groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))
