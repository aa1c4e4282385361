"""Counts, shares, contrasts and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom import model
from surveyloom.functions import scores as sc
from surveyloom.functions.numeric import tidy
from surveyloom.operators import groups, screening
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.session import cut_lineage
from surveyloom.sources.readers import read_table


def role_scale_scores(spark, d):
    """(id, role, scale, score) over screened respondents.

    The cleaned cells are written once; screening and scoring both read them.
    """
    cells = cut_lineage(t.responses(spark, d))
    kept = screening.screen(t.profile_stats(spark, d, cells), model.PROFILE_SAMPLE).select("id", "role")
    scores = screening.scale_scores(cells, t.key_frame(spark), 24)
    return scores.join(kept, "id")


def settled_scores(spark, d):
    """The same rows written once, for queries that read them several times."""
    return cut_lineage(role_scale_scores(spark, d))


ROLE_SCALE = (
    t.SCREEN + ", " + t.SCALE_SCORES + ", rs AS (SELECT id, role, scale, score FROM scale_scores JOIN screened USING (id) WHERE miss_p < 0.33 AND infreq < 1)"
)


@query("agg4_group_count", f"WITH {t.RESPONDENTS} SELECT role, rank, count(*) AS n FROM respondents GROUP BY ALL")
def group_count(spark, d):
    return groups.group_count(t.respondents(spark, d), ["role", "rank"])


@query(
    "agg5_group_share",
    f"""WITH {t.RESPONDENTS} SELECT role, rank, degree, count(*) AS n, sum(count(*)) OVER (PARTITION BY role, rank)::BIGINT AS n_tot,
        round(count(*) / sum(count(*)) OVER (PARTITION BY role, rank)::DOUBLE, 6) AS share FROM respondents GROUP BY role, rank, degree""",
)
def group_share(spark, d):
    out = groups.group_share(t.respondents(spark, d), ["role", "rank", "degree"], ["role", "rank"])
    return out.withColumn("share", tidy(F.col("share")))


@query(
    "agg5_option_share",
    f"""WITH {t.RESPONDENTS}, g AS (SELECT role, count(*) AS n_tot, count(*) FILTER (WHERE gaming = 'Yes') AS gaming,
        count(*) FILTER (WHERE scripts = 'Yes') AS scripts FROM respondents GROUP BY role)
        SELECT role, n_tot, unnest(['gaming', 'scripts']) AS option, unnest([gaming, scripts]) AS n,
               round(unnest([gaming, scripts]) / n_tot::DOUBLE, 6) AS share FROM g""",
)
def option_share(spark, d):
    out = groups.option_share(t.respondents(spark, d), "role", ["gaming", "scripts"])
    return out.withColumn("share", tidy(F.col("share")))


@query(
    "agg5_category_by_facet",
    f"""WITH {t.RESPONDENTS}, a AS (SELECT id, unnest(['experience', 'degree']) AS category, unnest([experience, degree]) AS response, role, rank FROM respondents),
        l AS (SELECT category, response, unnest(['role', 'rank']) AS facet, unnest([role, rank]) AS level FROM a)
        SELECT facet, level, category, response, count(*) AS n, sum(count(*)) OVER (PARTITION BY facet, level, category)::BIGINT AS n_tot,
               round(count(*) / sum(count(*)) OVER (PARTITION BY facet, level, category)::DOUBLE, 6) AS share FROM l GROUP BY facet, level, category, response""",
)
def category_by_facet(spark, d):
    people = t.respondents(spark, d).select("id", "experience", "degree", "role", "rank")
    out = groups.category_by_facet(people, ["id"], ["experience", "degree"], ["role", "rank"])
    return out.withColumn("share", tidy(F.col("share")))


@query(
    "agg6_count_table_with_total",
    f"""WITH {t.RESPONDENTS} SELECT coalesce(role, 'Total') AS role, {", ".join(f"count(*) FILTER (WHERE rank = '{r}') AS {r}" for r in ("Enlisted", "Officer", "Warrant"))},
        count(*) FILTER (WHERE completed IS NOT NULL) AS completed FROM respondents GROUP BY ROLLUP (role)""",
)
def count_table_with_total(spark, d):
    return groups.count_table_with_total(
        t.respondents(spark, d, times=True), "role", "rank", ["Enlisted", "Officer", "Warrant"], F.col("completed").isNotNull()
    )


@query("agg7_group_sum", f"WITH {t.COGNITIVE} SELECT item, sum(score)::BIGINT AS total FROM cognitive GROUP BY item")
def group_sum(spark, d):
    return groups.group_sum(t.cognitive(spark, d), ["item"], "score")


@query(
    "agg8_summary_se",
    f"""WITH {ROLE_SCALE} SELECT role, scale, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd,
        round(stddev_samp(score) / sqrt(count(score)), 6) AS se FROM rs GROUP BY role, scale""",
)
def summary_se(spark, d):
    out = groups.summary_se(role_scale_scores(spark, d), ["role", "scale"], "score")
    return out.select("role", "scale", "n", *[tidy(F.col(c)).alias(c) for c in ("mean", "sd", "se")])


# Quantile .975 of the t distribution with f degrees: bisection over Simpson's rule, 2000 panels.
_T_QUANTILE = """list_reduce(list_transform(range(61), lambda i: {'lo': 0.0::DOUBLE, 'hi': 2000.0::DOUBLE}), lambda b, x: CASE WHEN (b.lo + b.hi) / 12000
    * list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()) * pow(1 + pow((b.lo + b.hi) / 2 * i / 2000.0::DOUBLE, 2) / f, -(f + 1) / 2))) < .475
    THEN {'lo': (b.lo + b.hi) / 2, 'hi': b.hi} ELSE {'lo': b.lo, 'hi': (b.lo + b.hi) / 2} END).lo"""


@query(
    "agg8_summary_ci",
    f"""WITH {ROLE_SCALE}, g AS (SELECT role, scale, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd FROM rs GROUP BY role, scale),
        q AS (SELECT n, {_T_QUANTILE} AS t FROM (SELECT DISTINCT n, (n - 1)::DOUBLE AS f FROM g WHERE n > 1))
        SELECT role, scale, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, round(t * sd / sqrt(n), 5) AS ci FROM g LEFT JOIN q USING (n)""",
)
def summary_ci(spark, d):
    out = groups.summary_se(role_scale_scores(spark, d), ["role", "scale"], "score", ci=0.95)
    return out.select("role", "scale", "n", *[tidy(F.col(c)).alias(c) for c in ("mean", "sd", "se")], F.round("ci", 5).alias("ci"))


@query(
    "agg11_factor_scale_scores",
    f"""WITH {t.RESPONSES}, {t.RESPONDENTS}, l AS (SELECT 'I' || lpad(i::VARCHAR, 2, '0') AS item, 'F' || i % 4 AS scale,
        (i * 7 % 11 - 5) / 10.0::DOUBLE AS loading FROM range(24) r(i) WHERE i % 6 <> 5)
        SELECT id, role, scale, round(avg(CASE WHEN loading > 0 THEN score ELSE 6 - score END), 6) AS score
        FROM responses JOIN l USING (item) JOIN respondents USING (id) GROUP BY ALL""",
)
def factor_scale_scores(spark, d):
    from surveyloom.operators.factors import factor_scale_scores

    rows = [(f"I{i:02d}", f"F{i % 4}", (i * 7 % 11 - 5) / 10.0) for i in range(24) if i % 6 != 5]
    loadings = spark.createDataFrame(rows, "item string, scale string, loading double")
    out = factor_scale_scores(t.responses(spark, d), t.respondents(spark, d), loadings, len(rows))
    return out.select("id", "role", "scale", tidy(F.col("score")).alias("score"))


@query(
    "agg15_median_of",
    f"""WITH {t.RESPONDENTS}, f AS (SELECT coalesce(round((epoch_us(completed) - epoch_us(started)) / 6e7::DOUBLE, 2), 0) AS m FROM respondents)
        SELECT round(median(m), 6) AS median FROM f WHERE m > 0""",
)
def median_of(spark, d):
    from surveyloom.operators.selection import quantiles

    minutes = t.respondents(spark, d, times=True).select(sc.duration_min(F.col("started"), F.col("completed")).alias("m"))
    return quantiles(minutes.where("m > 0"), [], "m", {"median": 0.5}).select(tidy(F.col("median")).alias("median"))


_CONTRAST = f"""WITH {ROLE_SCALE}, c AS (SELECT scale, avg(score) FILTER (WHERE role = 'BUILDING') AS mean_a,
    avg(score) FILTER (WHERE role = 'MACHINERY') AS mean_b FROM rs GROUP BY scale)"""


def _contrast(spark, d):
    return groups.group_contrast(role_scale_scores(spark, d), ["scale"], "role", "BUILDING", "MACHINERY", "score")


@query(
    "agg16_group_contrast",
    _CONTRAST + """ SELECT scale, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_a - mean_b, 6) AS difference,
    round(abs(mean_a - mean_b), 6) AS difference_abs FROM c""",
)
def group_contrast(spark, d):
    out = _contrast(spark, d)
    return out.select("scale", *[tidy(F.col(c)).alias(c) for c in ("mean_a", "mean_b", "difference", "difference_abs")])


@query("agg17_mean_contrast", _CONTRAST + " SELECT round(avg(abs(mean_a - mean_b)), 6) AS mean_difference FROM c")
def mean_contrast(spark, d):
    return groups.mean_contrast(_contrast(spark, d)).select(tidy(F.col("mean_difference")).alias("mean_difference"))


@query("agg18_group_mean", f"WITH {t.RESPONDENTS} SELECT role, round(avg(balance), 6) AS mean FROM respondents GROUP BY role")
def group_mean(spark, d):
    return groups.group_mean(t.respondents(spark, d), ["role"], "balance").select("role", tidy(F.col("mean")).alias("mean"))


@query(
    "agg19_value_range",
    """SELECT l_returnflag, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest,
       round(max(l_extendedprice) - min(l_extendedprice), 6) AS range FROM lineitem GROUP BY 1""",
)
def value_range(spark, d):
    out = groups.value_range(read_table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.withColumn("range", tidy(F.col("range")))


@query(
    "agg20_completion_summary",
    f"""WITH {t.RESPONDENTS} SELECT role, count(*) FILTER (WHERE completed > started) AS complete,
        count(*) FILTER (WHERE completed IS NULL OR completed <= started) AS partial, count(*) AS total FROM respondents GROUP BY role""",
)
def completion_summary(spark, d):
    timed = t.respondents(spark, d, times=True).withColumn("duration", sc.duration_min(F.col("started"), F.col("completed")))
    return groups.completion_summary(timed, "role", F.col("duration") > 0)


@query(
    "agg21_daily_counts",
    f"""WITH {t.RESPONDENTS}, u AS (SELECT unnest(['started', 'completed']) AS category, unnest([started, completed])::DATE AS date FROM respondents)
        SELECT date, category, count(*) AS n FROM u GROUP BY ALL""",
)
def daily_counts(spark, d):
    return groups.daily_counts(t.respondents(spark, d, times=True), ["started", "completed"])


@query(
    "agg22_histogram",
    f"""WITH {t.SCREEN}, e AS (SELECT min(miss_p) AS lo, (max(miss_p) - min(miss_p)) / 30.0::DOUBLE AS w FROM screened)
        SELECT least(floor((miss_p - lo) / w), 29)::INT AS bin, CASE WHEN miss_p <= 0.2 THEN 'Y' ELSE 'N' END AS filter_in, count(*) AS n
        FROM screened, e GROUP BY ALL""",
)
def histogram(spark, d):
    flagged = screening.flag_within(t.screening_stats(spark, d), "miss_p", 0.2)
    return groups.histogram(flagged, "miss_p", 30, ["filter_in"])


@query(
    "agg23_five_number",
    f"""WITH {ROLE_SCALE}, q AS (SELECT scale, quantile_cont(score, .25) AS q1, quantile_cont(score, .5) AS med, quantile_cont(score, .75) AS q3
        FROM rs GROUP BY scale), j AS (SELECT rs.scale, q1, med, q3, score, score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
        FROM rs JOIN q ON rs.scale = q.scale)
        SELECT scale, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(min(score) FILTER (WHERE inside), 6) AS whisker_low,
               round(max(score) FILTER (WHERE inside), 6) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers FROM j GROUP BY ALL""",
)
def five_number(spark, d):
    out = groups.five_number(settled_scores(spark, d), ["scale"], "score")
    numbers = ("q1", "median", "q3", "whisker_low", "whisker_high")
    return out.select("scale", *[tidy(F.col(c)).alias(c) for c in numbers], "outliers")


@query(
    "agg23_outlier_rows",
    """SELECT event_type, event_id, value FROM events JOIN (SELECT event_type, quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3
       FROM events GROUP BY 1) USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def outlier_rows(spark, d):
    return groups.outlier_rows(read_table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value")


@query(
    "agg24_density",
    """WITH b AS (SELECT event_type, avg(value) AS group_mean,
          0.9 * least(stddev_samp(value), (quantile_cont(value, .75) - quantile_cont(value, .25)) / 1.34) * pow(count(*), -0.2) AS h
          FROM events GROUP BY 1), e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 31.0 AS step FROM events),
       g AS (SELECT i AS grid, lo + i * step AS x FROM range(32) r(i), e)
       SELECT event_type, grid::INT AS grid, round(group_mean, 6) AS group_mean, round(x, 6) AS x,
              round(avg(exp(-pow((x - value) / h, 2) / 2) / (h * sqrt(2 * pi()))), 6) AS density
       FROM events JOIN b USING (event_type), g GROUP BY event_type, grid, group_mean, x""",
)
def density(spark, d):
    out = groups.density(read_table(spark, d, "events"), "value", "event_type", 32)
    return out.select("event_type", "grid", *[tidy(F.col(c)).alias(c) for c in ("group_mean", "x", "density")])


@query(
    "agg25_response_share",
    """SELECT o_orderstatus AS cluster, o_orderpriority AS response, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus)::DOUBLE, 6) AS share FROM orders GROUP BY 1, 2""",
)
def response_share(spark, d):
    orders = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("cluster"), F.col("o_orderpriority").alias("response"))
    out = groups.group_share(orders, ["cluster", "response"], ["cluster"])
    return out.select("cluster", "response", "n", tidy(F.col("share")).alias("share"))
