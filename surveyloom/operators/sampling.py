"""Reproducible splits, resampling of classes, and synthetic rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from surveyloom.functions.draws import normal_pair, uniform
from surveyloom.operators.neighbors import nearest
from surveyloom.operators.selection import hash_cutoffs, hash_index, is_taken
from surveyloom.session import attach, attach_measured, cut_lineage, with_values


def split_random(df: DataFrame, ident: str, share: float, seed: int, by: Sequence[str] = (), out: str = "train") -> DataFrame:
    """Mark exactly floor(share * n) rows per stratum, the smallest by hash."""
    keys = list(by)
    rows = df.withColumn("_u", uniform(seed, ident))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_of"))
    sizes = sizes.withColumn("_take", F.floor(F.col("_of") * F.lit(share)))
    join = attach_measured if keys else with_values
    cuts = hash_cutoffs(join(rows.select(*keys, ident, "_u"), sizes, keys), keys, ident)
    return join(rows, cuts, keys).withColumn(out, is_taken(ident)).drop("_u", "_cut_u", "_cut_id")


def split_stratified(df: DataFrame, ident: str, label: str, share: float, seed: int) -> DataFrame:
    return split_random(df, ident, share, seed, [label])


def _drawn(pool: DataFrame, draws: DataFrame, ident: str, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``pool`` hit by ``draws`` (keys, draw), with replacement."""
    keys = list(keys)
    placed = hash_index(pool, keys, uniform(seed, F.lit("pool"), ident), ident, "_idx")
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sized = attach(draws, sizes, keys) if keys else draws.withColumn("_size", sizes.scalar())
    hit = sized.withColumn("_idx", F.floor(uniform(seed, F.lit("draw"), "draw") * F.col("_size")))
    return hit.drop("_size").join(placed.drop("_idx_of"), [*keys, "_idx"]).drop("_idx")


def smote(rows: DataFrame, label: str, minority, dims: int, seed: int, k: int = 5, over: int = 100, under: int = 200, ident: str = "id", vector: str = "v") -> DataFrame:
    """(kind, id, draw, label, v): minority rows, synthetic ones, and drawn majority rows.

    Each minority row yields over/100 synthetic rows on the way to one of its
    ``k`` nearest minority rows; the majority is drawn with replacement to
    under/100 times the synthetic rows.  Distances are scaled by the
    minority's ranges.
    """
    if over < 100:
        raise ValueError("over must be at least 100: every minority row yields a synthetic one")
    each = over // 100
    rows = cut_lineage(rows.select(ident, F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v")))
    minor = rows.where(F.col("label") == minority)
    coord = lambda i: F.col("v")[i]
    ranges = minor.agg(F.array(*[F.max(coord(i)) - F.min(coord(i)) for i in range(dims)]))
    scaled = minor.withColumn("_w", ranges.scalar()).select(
        ident, "v", F.zip_with("v", "_w", lambda x, w: F.when(w > 0, x / w).otherwise(F.lit(0.0))).alias("_s")
    )
    near = nearest(scaled, scaled, k, dims, ident, "_s", keep_self=False, carry=["v"])
    known = near.groupBy(ident).agg(F.count(F.lit(1)).alias("_k"))
    seeds = known.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(each).cast("long"))))
    seeds = seeds.withColumn("rank", (F.floor(uniform(seed, F.lit("near"), "draw", ident) * F.col("_k")) + 1).cast("int"))
    gap = uniform(seed, F.lit("gap"), "draw", ident)
    made = (
        seeds.join(near, [ident, "rank"])
        .join(minor.select(ident, "v"), ident)
        .withColumn("_gap", gap)
        .select(
            F.lit("synthetic").alias("kind"),
            ident,
            "draw",
            F.lit(minority).alias("label"),
            F.zip_with("v", "donor_v", lambda x, y: x + F.col("_gap") * (y - x)).alias("v"),
        )
    )
    # One draw list entry per wanted majority row, generated from the minority rows.
    times = each * under // 100
    numbered = hash_index(minor.select(ident), [], uniform(seed, F.lit("order"), ident), ident, "_n")
    draws = numbered.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(
        (F.col("_n") * times + F.col("_t") + 1).cast("long").alias("draw")
    )
    major = _drawn(rows.where(F.col("label") != minority), draws, ident, seed)
    plain = lambda frame, kind, draw: frame.select(F.lit(kind).alias("kind"), ident, draw.cast("long").alias("draw"), "label", "v")
    return plain(minor, "minority", F.lit(0)).unionByName(made).unionByName(plain(major, "majority", F.col("draw")))


def rose(rows: DataFrame, label: str, classes: Sequence, dims: int, seed: int, ident: str = "id", vector: str = "v") -> DataFrame:
    """(draw, id, label, v): as many rows as given, classes balanced, smoothed.

    Every output row picks a class by a fair draw, a row of that class with
    replacement, and adds Gaussian noise of width h times the class's sd, where
    h = (4 / ((d + 2) n))^(1 / (d + 4)).
    """
    rows = cut_lineage(rows.select(ident, F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v")))
    coord = lambda i: F.col("v")[i]
    spread = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.coalesce(F.stddev_samp(coord(i)), F.lit(0.0)) for i in range(dims)]).alias("_sd")
    )
    width = F.pow(F.lit(4.0) / (F.lit(dims + 2.0) * F.col("_n")), F.lit(1.0 / (dims + 4)))
    spread = spread.select("label", F.transform("_sd", lambda s: s * width).alias("_h"))
    numbered = hash_index(rows.select(ident), [], uniform(seed, F.lit("order"), ident), ident, "_d")
    names = F.array(*[F.lit(c) for c in classes])
    draws = numbered.select((F.col("_d") + 1).alias("draw"))
    chosen = F.element_at(names, (F.floor(uniform(seed, F.lit("class"), "draw") * len(classes)) + 1).cast("int"))
    drawn = _drawn(rows, draws.withColumn("label", chosen), ident, seed, ["label"])
    noisy = attach(drawn, spread, ["label"], len(classes)).withColumn(
        "v", F.transform("v", lambda x, i: x + F.col("_h")[i] * normal_pair(seed, F.col("draw"), i))
    )
    return noisy.select("draw", ident, "label", "v")
