"""Ranks, quantiles and exact draws that no single task has to hold.

Two ideas carry everything here.  A hash is uniform, so rows can be cut into
even buckets by its value without looking at the data; and ranks of ordinary
values follow from counts per distinct value, where a value held by a third of
all rows is still one row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.session import attach, cut_lineage


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Row numbers over a total order, by range partitions and their offsets.

    The ranged rows are checkpointed, so positions cannot shift between the
    pass that counts partitions and the pass that numbers rows.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33))
        .withColumn("_pos", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_seq")
    )
    ranged = cut_lineage(ranged)
    # One row per partition: the ordered window sees partitions, not rows.
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def hash_index(df: DataFrame, keys: Sequence[str], unit: Column, ident: str, out: str, buckets: int = 4096) -> DataFrame:
    """0-based position of each row by ascending hash within its keys.

    Buckets of the uniform hash spread any key over ``buckets`` groups; the
    answer does not depend on their number.
    """
    keys = list(keys)
    marked = df.withColumn("_u", unit).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = marked.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``buckets`` rows per key reach these windows.
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_u", ident)
    return (
        marked.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_b"])
        .withColumn(out, F.col("_offset") + F.col("_r"))
        .withColumnRenamed("_total", f"{out}_of")
        .drop("_u", "_b", "_r", "_offset")
    )


def cut_bin(bins: int = 16) -> Column:
    """Bin of the hash ``_u``: fine around the ``_take`` / ``_of`` quantile, coarse elsewhere.

    The cut of n uniforms lies within a few standard errors of take/n, so the
    bin that holds it has about sqrt(n) rows.
    """
    p = F.col("_take") / F.col("_of")
    half = F.lit(8.0) * F.sqrt(p * (F.lit(1.0) - p) / F.col("_of")) + F.lit(1e-9)
    fine = F.floor((F.col("_u") - (p - half)) / (half * 2 / bins))
    return F.least(F.greatest(fine, F.lit(-1)), F.lit(bins)).cast("int")


def hash_cutoffs(rows: DataFrame, keys: Sequence[str], ident: str, key_rows: int | None = None) -> DataFrame:
    """The (hash, id) pair that closes the ``_take`` smallest of each key.

    ``rows`` carries keys, ``ident``, the hash ``_u``, and per key the wanted
    ``_take`` and the size ``_of``.  Only the one bin holding the cut is sorted.
    Should the cut fall outside the fine bins, its coarse bin is sorted
    instead: slower, same answer.
    """
    keys = list(keys)
    binned = rows.withColumn("_b", cut_bin())
    sizes = binned.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.first("_take").alias("_want"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = whole.orderBy("_b")
    closing = (
        sizes.withColumn("_upto", F.sum("_n").over(upto))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(*keys, F.col("_b"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_nth"))
    )
    edge = attach(binned, closing, [*keys, "_b"], key_rows, "inner")
    order = whole.orderBy("_u", ident)
    return (
        edge.select(*keys, "_u", ident, "_nth")
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") == F.col("_nth"))
        .select(*keys, F.col("_u").alias("_cut_u"), F.col(ident).alias("_cut_id"))
    )


def is_taken(ident: str) -> Column:
    """Whether a row lies at or before its cut; without a cut nothing is taken."""
    below = (F.col("_u") < F.col("_cut_u")) | (
        (F.col("_u") == F.col("_cut_u")) & (F.col(ident) <= F.col("_cut_id"))
    )
    return F.coalesce(below, F.lit(False))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 128, **sums: Column) -> DataFrame:
    """Distinct values with their counts and the counts before them.

    Columns: keys, value, ``n``, ``n_before``, ``n_total`` and each named sum.
    NULL values are left out.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(col).alias(name) for name, col in sums.items()])
    )
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, points, F.lit(10 * buckets)).alias("_cuts"))
    if keys:
        placed = attach(counts, cuts, keys)
    else:
        placed = counts.withColumn("_cuts", cuts.scalar())
    placed = placed.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = placed.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("n_total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_b"])
        .withColumn("n_before", F.col("_offset") + F.col("_inside"))
        .drop("_b", "_inside", "_offset")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles (the type-7 rule), one column per name."""
    keys = list(keys)
    ranked = value_counts(df, keys, value)
    aggs = []
    for name, prob in probs.items():
        spot = (F.col("n_total") - 1) * F.lit(prob)
        for side, place in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            holds = (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col(value))).cast("double").alias(f"_{name}_{side}"))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"_{name}_w"))
    found = ranked.groupBy(*keys).agg(*aggs)
    between = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in probs
    ]
    return found.select(*keys, *between)
