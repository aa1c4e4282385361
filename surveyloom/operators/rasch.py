"""Rasch measurement with gaps in the answers.

Item difficulties use the pairwise estimator: for two items the log ratio of
"only this one right" counts estimates their distance.  Conditional maximum
likelihood agrees with it only in large samples.  Abilities are maximum
likelihood; all-right and all-wrong respondents have none and stay NULL.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from surveyloom.operators import crossproducts
from surveyloom.operators.groups import summary_se
from surveyloom.operators.ranking import zscore
from surveyloom.session import attach

NEWTON_STEPS = 30


def _patterns(responses: DataFrame, value: str) -> DataFrame:
    """(id, answered items, raw score); a person answers at most the declared items."""
    seen = responses.where(F.col(value).isNotNull())
    return seen.groupBy("id").agg(
        F.array_sort(F.collect_list("item")).alias("answered"), F.sum(value).cast("long").alias("raw")
    )


def raw_score_counts(responses: DataFrame, value: str = "score") -> DataFrame:
    """How many respondents share a missing pattern and raw score."""
    persons = _patterns(responses, value).select(F.array_join("answered", ",").alias("pattern"), "raw")
    return persons.groupBy("pattern", "raw").agg(F.count(F.lit(1)).alias("n"))


def item_totals(responses: DataFrame, value: str = "score") -> DataFrame:
    return responses.groupBy("item").agg(F.count(value).alias("n"), F.sum(value).cast("long").alias("right"))


def item_difficulty(responses: DataFrame, items: Sequence[str], value: str = "score") -> DataFrame:
    """Pairwise difficulties centred on zero; pairs with an empty count are left out."""
    wins = crossproducts.win_counts(responses, items, value)
    back = wins.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), F.col("n").alias("n_back"))
    gaps = wins.join(back, ["item_a", "item_b"]).groupBy(F.col("item_a").alias("item")).agg(
        F.sum(F.log(F.col("n_back") / F.col("n"))).alias("_sum"), F.count(F.lit(1)).alias("partners")
    )
    # The item is its own partner at distance zero.
    gaps = gaps.withColumn("_d", F.col("_sum") / (F.col("partners") + 1))
    centre = gaps.agg(F.avg("_d")).scalar()
    return gaps.withColumn("_centre", centre).select("item", (F.col("_d") - F.col("_centre")).alias("difficulty"), "partners")


def person_theta(responses: DataFrame, difficulty: DataFrame, value: str = "score") -> DataFrame:
    """(id, raw, theta, se, proficiency): solved once per pattern and raw score."""
    persons = _patterns(responses, value)
    # One map with an entry per item.
    table = difficulty.agg(F.map_from_entries(F.collect_list(F.struct("item", "difficulty"))))
    chance = lambda theta, beta: F.lit(1.0) / (F.lit(1.0) + F.exp(beta - theta))
    expected = lambda betas, theta: F.aggregate(betas, F.lit(0.0), lambda s, b: s + chance(theta, b))
    info = lambda betas, theta: F.aggregate(
        betas, F.lit(0.0), lambda s, b: s + chance(theta, b) * (F.lit(1.0) - chance(theta, b))
    )
    betas, raw = F.col("_betas"), F.col("raw").cast("double")
    step = lambda theta: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (raw - expected(betas, theta)) / info(betas, theta)))
    steps = F.sequence(F.lit(1), F.lit(NEWTON_STEPS))
    solved = (
        persons.select("answered", "raw")
        .distinct()
        .withColumn("_table", table.scalar())
        .withColumn("_betas", F.transform("answered", lambda item: F.col("_table")[item]))
        .withColumn("_inner", (F.col("raw") > 0) & (F.col("raw") < F.size("answered")))
        .withColumn("theta", F.when(F.col("_inner"), F.aggregate(steps, F.lit(0.0), lambda theta, _: theta + step(theta))))
        .withColumn("se", F.lit(1.0) / F.sqrt(info(betas, F.col("theta"))))
        .select("answered", "raw", "theta", "se")
    )
    return persons.join(solved, ["answered", "raw"]).select(
        "id", "raw", "theta", "se", F.round("theta", 2).alias("proficiency")
    )


def residuals(responses: DataFrame, difficulty: DataFrame, theta: DataFrame, n_items: int, value: str = "score") -> DataFrame:
    """(id, item, p, w, c, residual) for respondents with an ability."""
    known = theta.where(F.col("theta").isNotNull()).select("id", "theta")
    joined = attach(responses.where(F.col(value).isNotNull()), difficulty.select("item", "difficulty"), ["item"], n_items, "inner")
    joined = joined.join(known, "id").withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("difficulty") - F.col("theta"))))
    p, q = F.col("p"), F.lit(1.0) - F.col("p")
    return joined.select(
        "id", "item", "p", (p * q).alias("w"), (p * q * (p * p * p + q * q * q)).alias("c"), (F.col(value) - p).alias("residual")
    )


def item_fit(parts: DataFrame) -> DataFrame:
    """Information-weighted and plain mean-square residuals per item."""
    r2 = F.col("residual") * F.col("residual")
    return parts.groupBy("item").agg(
        (F.sum(r2) / F.sum("w")).alias("infit"), F.avg(r2 / F.col("w")).alias("outfit"), F.count(F.lit(1)).alias("n")
    )


def person_fit(parts: DataFrame, cut: float = 1.96) -> DataFrame:
    """Infit per respondent, standardised by the cube-root rule, and a misfit flag."""
    r2 = F.col("residual") * F.col("residual")
    sums = parts.groupBy("id").agg(
        (F.sum(r2) / F.sum("w")).alias("infit"),
        (F.sqrt(F.sum(F.col("c") - F.col("w") * F.col("w"))) / F.sum("w")).alias("_q"),
    )
    z = F.when(F.col("_q") > 0, (F.cbrt("infit") - 1) * 3 / F.col("_q") + F.col("_q") / 3)
    return sums.withColumn("infit_z", z).withColumn("misfit", F.col("infit_z") > cut).drop("_q")


def misfit_share(fit: DataFrame) -> DataFrame:
    return fit.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("misfit").cast("int")).alias("misfit_share"))


def separation_reliability(theta: DataFrame) -> DataFrame:
    """(variance of abilities - mean squared error) / variance of abilities."""
    stats = theta.agg(F.var_samp("theta").alias("variance"), F.avg(F.col("se") * F.col("se")).alias("mse"))
    return stats.withColumn("reliability", F.when(F.col("variance") > 0, (F.col("variance") - F.col("mse")) / F.col("variance")))


def item_curves(difficulty: DataFrame, low: float = -4.0, high: float = 4.0, points: int = 81) -> DataFrame:
    """Probability of a right answer along an even ability grid, per item."""
    step = (high - low) / (points - 1)
    grid = difficulty.select("item", "difficulty", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    grid = grid.withColumn("theta", F.lit(low) + F.col("point") * F.lit(step))
    return grid.select("item", "point", "theta", (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("difficulty") - F.col("theta")))).alias("p"))


def theta_by_group(theta: DataFrame, respondents: DataFrame, group: str) -> DataFrame:
    """Ability summary per group beside the mean z-score of the raw total."""
    joined = theta.join(respondents.select("id", group), "id").where(F.col("theta").isNotNull())
    both = zscore(joined, [], "raw", "raw_z")
    raw = both.groupBy(group).agg(F.avg("raw_z").alias("mean_raw_z"))
    return summary_se(both, [group], "theta").join(raw, group)
