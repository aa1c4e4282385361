"""Missingness, careless answering and the screening filters built on them."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from surveyloom.functions.scores import within_limit, yes_no
from surveyloom.model import DONT_KNOW, ScreeningRules
from surveyloom.session import attach


def missing_rate(respondents: DataFrame, responses: DataFrame, n_items: int, out: str, answer: str = "answer", id_col: str = "id") -> DataFrame:
    """Share of the ``n_items`` a respondent left unanswered.

    An absent cell and a NULL answer both count as missing, so counting the
    answered cells is enough; no grid of respondents by items is built.
    """
    answered = responses.groupBy(id_col).agg(F.count(answer).alias("_answered"))
    share = F.lit(1.0) - F.coalesce(F.col("_answered"), F.lit(0)) / F.lit(float(n_items))
    return respondents.select(id_col).join(answered, id_col, "left").select(id_col, share.alias(out))


def missing_rates(respondents: DataFrame, cells: DataFrame, sizes: dict[str, int], id_col: str = "id") -> DataFrame:
    """``miss_<kind>`` for each questionnaire in ``sizes`` (kind: number of items), in one pass over all cells.

    ``cells`` is (id, kind, item, answer) with a row per cell.
    """
    counts = [F.count_if((F.col("kind") == kind) & F.col("answer").isNotNull()).alias(f"_{kind}") for kind in sizes]
    answered = cells.groupBy(id_col).agg(*counts)
    share = [(F.lit(1.0) - F.coalesce(F.col(f"_{k}"), F.lit(0)) / F.lit(float(n))).alias(f"miss_{k}") for k, n in sizes.items()]
    return respondents.select(id_col).join(answered, id_col, "left").select(id_col, *share)


def missing_by_respondent(respondents: DataFrame, responses: DataFrame, items: Sequence[str], answer: str = "answer", id_col: str = "id") -> DataFrame:
    """(id, n_missing, missing): which of the declared items a respondent left out, in their order."""
    answered = responses.where(F.col(answer).isNotNull()).groupBy(id_col).agg(F.collect_set("item").alias("_has"))
    left_out = F.filter(F.array(*[F.lit(i) for i in items]), lambda i: ~F.coalesce(F.array_contains("_has", i), F.lit(False)))
    joined = respondents.select(id_col).join(answered, id_col, "left").withColumn("_out", left_out)
    return joined.select(id_col, F.size("_out").cast("long").alias("n_missing"), F.array_join("_out", " ").alias("missing"))


def complete_case_sizes(scores: DataFrame, scales: Sequence[str], role: str = "role", id_col: str = "id") -> DataFrame:
    """(role, n): respondents with a score on every scale."""
    whole = scores.where(F.col("score").isNotNull()).groupBy(id_col, role).agg(F.count_distinct("scale").alias("_n"))
    return whole.where(F.col("_n") == len(scales)).groupBy(role).agg(F.count(F.lit(1)).alias("n"))


def insincere_count(responses: DataFrame, label: str = DONT_KNOW, answer: str = "answer", id_col: str = "id", of: int | None = None) -> DataFrame:
    """How often a respondent chose the give-up option, as a count or as a share of ``of``."""
    hits = F.count_if(F.col(answer) == label)
    return responses.groupBy(id_col).agg((hits if of is None else hits / F.lit(float(of))).alias("sincere"))


def missing_by_item(responses: DataFrame, n_respondents: DataFrame, items: Sequence[str], answer: str = "answer") -> DataFrame:
    """Missing cells of each declared item.  ``n_respondents`` is a one-value frame."""
    spark = responses.sparkSession
    named = spark.createDataFrame([(x,) for x in items], "item string")
    answered = responses.groupBy("item").agg(F.count(answer).alias("_answered"))
    return (
        named.join(answered, "item", "left")
        .withColumn("_all", n_respondents.scalar())
        .select("item", (F.col("_all") - F.coalesce("_answered", F.lit(0))).alias("n_missing"))
    )


def item_stats(responses: DataFrame, value: str = "score") -> DataFrame:
    """Mean and sd per item to one decimal, with a difficulty rank.

    The item name decides ties.  Only the grouped items are ranked.
    """
    from surveyloom.operators.ranking import unique_rank

    stats = responses.groupBy("item").agg(
        F.round(F.avg(value), 1).alias("mean"), F.round(F.stddev_samp(value), 1).alias("sd")
    )
    return unique_rank(stats, [F.col("mean").desc_nulls_last(), F.col("item")], "rank")


def easy_mean(stats: DataFrame, k: int = 10) -> DataFrame:
    """Mean of the rounded means of the ``k`` easiest items, as a one-value frame."""
    return stats.where(F.col("rank") <= k).agg(F.avg("mean").alias("easy_mean"))


def infrequency(responses: DataFrame, stats: DataFrame, k: int = 10, value: str = "score", id_col: str = "id") -> DataFrame:
    """Distance of a respondent's mean on the easiest items from everyone's."""
    easiest = F.broadcast(stats.where(F.col("rank") <= k).select("item"))
    own = responses.join(easiest, "item", "left_semi").groupBy(id_col).agg(F.avg(value).alias("_own"))
    return own.withColumn("_easy", easy_mean(stats, k).scalar()).select(
        id_col, F.abs(F.col("_easy") - F.col("_own")).alias("infreq")
    )


def screening_stats(respondents: DataFrame, likert: DataFrame, items: Sequence[str], keyed: DataFrame | None = None, keyed_items: Sequence[str] = (), id_col: str = "id", k: int = 10) -> DataFrame:
    """Respondents with miss_p and infreq, and with miss_c and sincere where
    keyed answers are given.

    ``likert`` holds numeric ``answer`` values (reversed items turned),
    ``keyed`` raw options.  Each source is grouped by respondent once.
    """
    scores = likert.withColumnRenamed("answer", "score")
    stats = item_stats(scores)
    # At most k of the declared items.
    easiest = F.broadcast(stats.where(F.col("rank") <= k).select("item", F.lit(True).alias("_easy")))
    own = (
        scores.join(easiest, "item", "left")
        .groupBy(id_col)
        .agg(F.count("score").alias("_p"), F.avg(F.when(F.col("_easy"), F.col("score"))).alias("_own"))
    )
    share = lambda n, of: F.lit(1.0) - F.coalesce(F.col(n), F.lit(0)) / F.lit(float(of))
    out = (
        respondents.join(own, id_col, "left")
        .withColumn("miss_p", share("_p", len(items)))
        .withColumn("infreq", F.abs(easy_mean(stats, k).scalar() - F.col("_own")))
        .drop("_p", "_own")
    )
    if keyed is None:
        return out
    gave_up = F.count_if(F.col("answer") == DONT_KNOW)
    other = keyed.groupBy(id_col).agg(F.count("answer").alias("_c"), gave_up.alias("sincere"))
    return (
        out.join(other, id_col, "left")
        .withColumn("miss_c", share("_c", len(keyed_items)))
        .withColumn("sincere", F.coalesce("sincere", F.lit(0)))
        .drop("_c")
    )


def screen(df: DataFrame, rules: ScreeningRules) -> DataFrame:
    """Rows that pass every limit; an unknown measure does not pass."""
    return df.where(rules.condition())


def completion_flag(df: DataFrame, rules: ScreeningRules, out: str = "completed_flag") -> DataFrame:
    """Yes, No, or NULL where the limits cannot be decided."""
    return df.withColumn(out, yes_no(rules.condition()))


def flag_within(df: DataFrame, col: str, limit: float, out: str = "filter_in") -> DataFrame:
    return df.withColumn(out, within_limit(F.col(col), limit))


def quality_profile(stats: DataFrame, rules: ScreeningRules, measures: Sequence[str], id_col: str = "id") -> DataFrame:
    """Screened measures gathered long, with the larger of them as order key."""
    top = F.greatest(*measures) if len(measures) > 1 else F.col(measures[0])
    kept = screen(stats, rules).withColumn("order_key", top)
    return kept.unpivot([id_col, "order_key"], list(measures), "measure", "score")


def sample_sizes(df: DataFrame, rules: ScreeningRules, role: str, roles: Sequence[str]) -> DataFrame:
    """Usable respondents per role, one wide row."""
    wanted = [F.count_if(F.col(role) == name).alias(name) for name in roles]
    return screen(df, rules).agg(*wanted)


def scale_scores(responses: DataFrame, key: DataFrame, n_items: int, by: Sequence[str] = ("id",), value: str = "score", top: int = 5, signed: bool = True) -> DataFrame:
    """Mean of the answered items of each scale.

    ``key`` is a declared dictionary of ``n_items`` rows (scale, item, sign).
    """
    joined = attach(responses, key, ["item"], n_items, "inner")
    turned = F.when(F.col("sign") < 0, F.lit(top + 1) - F.col(value)).otherwise(F.col(value)) if signed else F.col(value)
    return joined.groupBy(*by, "scale").agg(F.avg(turned).alias("score"))


def total_scores(responses: DataFrame, by: Sequence[str] = ("id",), value: str = "score", name: str = "Cog_tot") -> DataFrame:
    """Mean over all answered items, shaped like one more scale."""
    return responses.groupBy(*by).agg(F.avg(value).alias("score")).select(*by, F.lit(name).alias("scale"), "score")
