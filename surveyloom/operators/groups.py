"""Counts, shares, contrasts and chart data by group."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.functions.numeric import safe_divide
from surveyloom.functions.tdist import t_quantile
from surveyloom.operators.reshape import to_long_twice
from surveyloom.operators.selection import quantiles
from surveyloom.session import attach_measured, spread


def group_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def group_sum(df: DataFrame, keys: Sequence[str], value: str, out: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(out))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def group_share(df: DataFrame, num_keys: Sequence[str], den_keys: Sequence[str], value: Column | None = None) -> DataFrame:
    """Count (or sum of ``value``) over the count of the coarser group.

    The rows are reduced once; denominators are sums over the reduced rows.
    """
    top = F.count(F.lit(1)) if value is None else F.sum(value)
    counts = df.groupBy(*num_keys).agg(top.alias("n"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*den_keys) if den_keys else Window.partitionBy(F.lit(0))
    return counts.withColumn("n_tot", F.sum("_rows").over(whole)).withColumn("share", F.col("n") / F.col("n_tot")).drop("_rows")


def option_share(df: DataFrame, group: str, options: Sequence[str], yes: str = "Yes") -> DataFrame:
    """Share of a group ticking each option, over the group's head count."""
    ticked = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_tot"), *[F.count_if(F.col(o) == yes).alias(o) for o in options]
    )
    return ticked.unpivot([group, "n_tot"], list(options), "option", "n").withColumn("share", F.col("n") / F.col("n_tot"))


def count_table_with_total(df: DataFrame, row: str, col: str, cols: Sequence[str], done: Column, total: str = "Total") -> DataFrame:
    """Row x column counts, completions, and a grand-total row, in one aggregation."""
    cells = [F.count_if(F.col(col) == name).alias(name) for name in cols]
    wide = df.rollup(row).agg(*cells, F.count_if(done).alias("completed"), F.grouping(row).alias("_total"))
    label = F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(row))
    return wide.select(label.alias(row), *cols, "completed")


def summary_se(df: DataFrame, keys: Sequence[str], measure: str, ci: float | None = None) -> DataFrame:
    """N, mean, sd, se and, on request, the half-width of a t interval."""
    out = df.groupBy(*keys).agg(
        F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd")
    )
    out = out.withColumn("se", safe_divide(F.col("sd"), F.sqrt("n")))
    if ci is not None:
        critical = t_quantile(F.lit(0.5 + ci / 2.0), (F.col("n") - 1).cast("double"))
        out = out.withColumn("ci", F.col("se") * critical)
    return out


def category_by_facet(people: DataFrame, ids: Sequence[str], categories: Sequence[str], facets: Sequence[str]) -> DataFrame:
    """Shares of each answer within every level of every facet: gather twice, then count."""
    long = to_long_twice(people, ids, categories, facets)
    return group_share(long, ["facet", "level", "category", "response"], ["facet", "level", "category"])


def group_contrast(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Mean of two groups side by side with signed and absolute difference."""
    side = lambda name: F.avg(F.when(F.col(group) == name, F.col(value)))
    means = df.groupBy(*keys).agg(side(a).alias("mean_a"), side(b).alias("mean_b"))
    gap = F.col("mean_a") - F.col("mean_b")
    return means.withColumn("difference", gap).withColumn("difference_abs", F.abs(gap))


def mean_contrast(contrasts: DataFrame) -> DataFrame:
    return contrasts.agg(F.avg("difference_abs").alias("mean_difference"))


def value_range(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(value).alias("lowest"), F.max(value).alias("highest"), (F.max(value) - F.min(value)).alias("range")
    )


def grade_by_range(df: DataFrame, value: str, out: str = "grade") -> DataFrame:
    """Shift by the absolute minimum, divide by the range, cut into letters."""
    from surveyloom.functions.scores import letter_grade

    ends = value_range(df, value)
    low, width = ends.select("lowest").scalar(), ends.select("range").scalar()
    share = safe_divide(F.col(value) + F.abs(F.col("_low")), F.col("_width"))
    return (
        df.withColumn("_low", low)
        .withColumn("_width", width)
        .withColumn("share", share)
        .withColumn(out, letter_grade(F.col("share")))
        .drop("_low", "_width")
    )


def completion_summary(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """Finished, partial and total respondents per group."""
    out = df.groupBy(group).agg(F.count_if(flag).alias("complete"), F.count_if(~flag).alias("partial"))
    return out.withColumn("total", F.col("complete") + F.col("partial"))


def daily_counts(df: DataFrame, moments: Sequence[str], id_col: str = "id") -> DataFrame:
    """Rows per day for each kind of moment; days of unfinished rows are NULL."""
    long = df.select(id_col, *[F.to_date(m).alias(m) for m in moments]).unpivot([id_col], list(moments), "category", "date")
    return long.groupBy("date", "category").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin between the lowest and highest value."""
    ends = value_range(df, value)
    placed = (
        df.where(F.col(value).isNotNull())
        .withColumn("_low", ends.select("lowest").scalar())
        .withColumn("_width", ends.select("range").scalar() / F.lit(float(bins)))
    )
    spot = F.floor(safe_divide(F.col(value) - F.col("_low"), F.col("_width")))
    # No width, one bin; least() alone would pass over the NULL.
    last = F.when(spot.isNull(), 0).when(spot >= bins, bins - 1).otherwise(spot)
    placed = placed.withColumn("bin", last.cast("int"))
    return placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def five_number(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outlier count per group."""
    hinge = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fence = hinge.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    )
    inside = (F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))
    return (
        attach_measured(df.where(F.col(value).isNotNull()).select(*keys, value), fence, list(keys), "inner")
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def outlier_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows beyond the whiskers."""
    hinge = quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    joined = attach_measured(df, hinge, list(keys), "inner")
    return joined.where((F.col(value) < F.col("_q1") - reach) | (F.col(value) > F.col("_q3") + reach)).drop("_q1", "_q3")


def density(df: DataFrame, value: str, by: str, points: int = 32) -> DataFrame:
    """Gaussian kernel density of each group on an even grid over all values.

    The bandwidth is the usual rule of thumb, 0.9 min(sd, IQR/1.34) n^(-1/5),
    with the sd, a value, or 1 standing in for a zero spread.
    One aggregate holds a sum per grid point; rows are not copied.
    """
    hinges = quantiles(df, [by], value, {"_q1": 0.25, "_q3": 0.75})
    moments = df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count(value).alias("_n"), F.avg(value).alias("group_mean"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_any")
    )
    zero = F.lit(0.0)
    scale = F.coalesce(
        F.nullif(F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.34), zero),
        F.nullif(F.col("_sd"), zero),
        F.nullif(F.abs("_any").cast("double"), zero),
        F.lit(1.0),
    )
    width = F.lit(0.9) * scale * F.pow("_n", F.lit(-0.2))
    bands = moments.join(hinges, by).select(by, "_n", "group_mean", width.alias("_h"))
    ends = value_range(df, value)
    rows = (
        attach_measured(spread(df.where(F.col(value).isNotNull()).select(by, value)), bands, [by], "inner")
        .withColumn("_low", ends.select("lowest").scalar())
        .withColumn("_step", ends.select("range").scalar() / F.lit(float(points - 1)))
    )

    def kernel(i: int):
        z = (F.col("_low") + F.lit(float(i)) * F.col("_step") - F.col(value)) / F.col("_h")
        return F.exp(-z * z / 2.0) / (F.col("_h") * F.lit(2.5066282746310002))

    wide = rows.groupBy(by, "group_mean", "_low", "_step").agg(F.array(*[F.avg(kernel(i)) for i in range(points)]).alias("_curve"))
    curve = wide.select(by, "group_mean", "_low", "_step", F.posexplode("_curve").alias("grid", "density"))
    return curve.select(by, "grid", "group_mean", (F.col("_low") + F.col("grid") * F.col("_step")).alias("x"), "density")


def impute_median(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Fill gaps with the exact median of the column within the group.

    All columns are done together: one long pass of value counts.
    """
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([group], list(cols), "_col", "_value")
    mids = quantiles(long, [group, "_col"], "_value", {"_mid": 0.5})
    wide = mids.groupBy(group).agg(*[F.max(F.when(F.col("_col") == c, F.col("_mid"))).alias(f"_mid_{c}") for c in cols])
    joined = attach_measured(df, wide, [group])
    filled = joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_mid_{c}")) for c in cols})
    return filled.drop(*[f"_mid_{c}" for c in cols])
