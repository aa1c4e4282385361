"""Scale reliability from pairwise item sums."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from surveyloom.functions.numeric import safe_divide
from surveyloom.operators import crossproducts
from surveyloom.operators.selection import quantiles
from surveyloom.session import attach

KeyRows = Sequence[tuple[str, str, int]]


def _key(df: DataFrame, rows: KeyRows) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), "scale string, item string, sign int")


def signed_responses(responses: DataFrame, rows: KeyRows, value: str = "score", top: int = 5) -> DataFrame:
    """(id, scale, item, score) with reversed items turned, for the declared key."""
    joined = attach(responses, _key(responses, rows), ["item"], len(rows), "inner")
    turned = F.when(F.col("sign") < 0, F.lit(top + 1) - F.col(value)).otherwise(F.col(value))
    return joined.select("id", "scale", "item", turned.cast("double").alias("score"))


def score_items(respondents: DataFrame, responses: DataFrame, rows: KeyRows, value: str = "score", top: int = 5) -> DataFrame:
    """Scale means after filling each unanswered item with the item's median.

    A mean over filled items is the answered sum plus the medians that were
    not replaced by an answer, so no grid of respondents by items is built.
    """
    signed = signed_responses(responses, rows, value, top)
    mids = quantiles(signed, ["scale", "item"], "score", {"mid": 0.5})
    totals = mids.groupBy("scale").agg(F.sum("mid").alias("_mids"))
    joined = attach(signed, mids, ["scale", "item"], len(rows))
    scales = sorted({scale for scale, _, _ in rows})
    gain = F.col("score") - F.col("mid")
    per_person = joined.groupBy("id").agg(
        *[F.coalesce(F.sum(F.when(F.col("scale") == s, gain)), F.lit(0.0)).alias(s) for s in scales]
    )
    everyone = respondents.select("id").join(per_person, "id", "left").fillna(0.0, subset=scales)
    sizes = {s: sum(1 for scale, _, _ in rows if scale == s) for s in scales}
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("scale"))
    long = everyone.unpivot(["id"], scales, "scale", "_gain")
    return attach(long, totals, ["scale"], len(scales)).select(
        "id", "scale", ((F.col("_mids") + F.col("_gain")) / size).alias("score")
    )


def cronbach_alpha(responses: DataFrame, rows: KeyRows, value: str = "score", top: int = 5) -> DataFrame:
    """Raw and standardised alpha with the mean inter-item correlation, from pair-complete moments."""
    signed = signed_responses(responses, rows, value, top)
    items = [item for _, item, _ in rows]
    scale_of = F.broadcast(_key(responses, rows).select("scale", "item"))
    sums = crossproducts.pair_sums(signed, items)
    n = F.col("n")
    pairs = (
        sums.withColumn("_cov", (F.col("sum_ab") - F.col("sum_a") * F.col("sum_b") / n) / (n - 1))
        .join(crossproducts.correlations(sums).select("item_a", "item_b", "r"), ["item_a", "item_b"])
        .join(scale_of.toDF("scale", "item_a"), "item_a")
        .join(scale_of.toDF("scale", "item_b"), ["scale", "item_b"])
        .groupBy("scale")
        .agg(F.sum("_cov").alias("_cov"), F.avg("r").alias("mean_r"))
    )
    variances = signed.groupBy("scale", "item").agg(F.var_samp("score").alias("_v"))
    variances = variances.groupBy("scale").agg(F.sum("_v").alias("_var"), F.count(F.lit(1)).alias("k"))
    k = F.col("k")
    raw = k / (k - 1) * (1 - safe_divide(F.col("_var"), F.col("_var") + 2 * F.col("_cov")))
    std = safe_divide(k * F.col("mean_r"), 1 + (k - 1) * F.col("mean_r"))
    return variances.join(pairs, "scale").select("scale", "k", raw.alias("raw_alpha"), std.alias("std_alpha"), "mean_r")


def guarded_corr(x: str, y: str):
    """Correlation aggregate that is NULL, not an error, for a constant side."""
    return safe_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def item_total_correlation(responses: DataFrame, rows: KeyRows, value: str = "score", top: int = 5) -> DataFrame:
    """Item against the rest of its scale, over respondents who answered the whole scale.

    A respondent's answers to one scale, a declared handful, are kept together.
    """
    sizes: dict[str, int] = {}
    for scale, _, _ in rows:
        sizes[scale] = sizes.get(scale, 0) + 1
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("scale"))
    signed = signed_responses(responses, rows, value, top).where(F.col("score").isNotNull())
    whole = (
        signed.groupBy("id", "scale")
        .agg(F.sum("score").alias("_total"), F.collect_list(F.struct("item", "score")).alias("_cells"))
        .where(F.size("_cells") == size)
        .select("scale", "_total", F.inline("_cells"))
        .withColumn("_rest", F.col("_total") - F.col("score"))
    )
    return whole.groupBy("scale", "item").agg(guarded_corr("score", "_rest").alias("r_drop"), F.count(F.lit(1)).alias("n"))


def scale_intercorrelation(responses: DataFrame, rows: KeyRows, value: str = "score", top: int = 5) -> DataFrame:
    """Correlations of scale means, raw and corrected for attenuation by raw alpha."""
    signed = signed_responses(responses, rows, value, top)
    scales = sorted({scale for scale, _, _ in rows})
    scores = signed.groupBy("id", F.col("scale").alias("item")).agg(F.avg("score").alias("score"))
    raw = crossproducts.cor_pairwise(scores, scales)
    alpha = cronbach_alpha(responses, rows, value, top)
    named = lambda side: F.broadcast(alpha.select(F.col("scale").alias(f"item_{side}"), F.col("raw_alpha").alias(f"_{side}")))
    product = F.col("_a") * F.col("_b")
    corrected = F.when(product > 0, F.col("r") / F.sqrt(product))
    return (
        raw.join(named("a"), "item_a").join(named("b"), "item_b")
        .select(F.col("item_a").alias("scale_a"), F.col("item_b").alias("scale_b"), "n", "r", corrected.alias("r_corrected"))
    )
