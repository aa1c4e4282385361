"""Group tests, resampling and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions.draws import POISSON_CDF
from surveyloom.functions.numeric import tidy
from surveyloom.functions.tdist import t_two_sided
from surveyloom.operators import crossproducts, inference, reshape, screening
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.plans.summaries import ROLE_SCALE, role_scale_scores, settled_scores
from surveyloom.session import cut_lineage, with_values

REPS = 1000


def _rounded(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


# Two-sided p by Simpson's rule over the t density, 2000 panels.
def _p_sql(tt: str, df: str) -> str:
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + x * x / {df}, -({df} + 1) / 2)"
    return f"""(SELECT 1 - 2 * abs({tt}) / 6000.0::DOUBLE * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density}))
        FROM (SELECT i, abs({tt}) * i / 2000.0::DOUBLE AS x FROM range(2001) r(i)))"""


_WELCH = """(mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
    pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df"""
_SIDES = ", ".join(
    f"{fn} FILTER (WHERE grp = '{name}') AS {stat}_{tag}"
    for tag, name in (("a", "good"), ("b", "poor"))
    for stat, fn in (("n", "count(value)"), ("mean", "avg(value)"), ("var", "var_samp(value)"))
)


@query(
    "inf1_welch_t",
    f"""WITH {t.TWO_GROUPS}, s AS (SELECT {_SIDES} FROM two), w AS (SELECT *, {_WELCH} FROM s)
        SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(t, 6) AS t, round(df, 6) AS df,
               round({_p_sql("w.t", "w.df")}, 6) AS p FROM w""",
)
def welch_t(spark, d):
    out = inference.welch_t(t.two_groups(spark, d), "grp", "value", "good", "poor")
    return _rounded(out.drop("var_a", "var_b"), "mean_a", "mean_b", "t", "df", "p")


_PAIRS = f"""WITH {ROLE_SCALE}, m AS (SELECT scale, role, count(score) AS n, avg(score) AS mean, var_samp(score) AS var FROM rs GROUP BY ALL),
    s AS (SELECT a.scale, a.role AS group_a, b.role AS group_b, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b, a.var AS var_a, b.var AS var_b
          FROM m a JOIN m b ON a.scale = b.scale AND a.role < b.role WHERE a.n > 1 AND b.n > 1),
    w AS (SELECT *, {_WELCH} FROM s), p AS (SELECT w.*, {_p_sql("w.t", "w.df")} AS p FROM w),
    h AS (SELECT *, least(1, p * (count(*) OVER (PARTITION BY scale) - row_number() OVER o + 1)) AS step FROM p
          WINDOW o AS (PARTITION BY scale ORDER BY p, group_a, group_b))"""


@query(
    "inf2_welch_t_by",
    _PAIRS + """ SELECT scale, group_a, group_b, n_a, n_b, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p,
    round(max(step) OVER (PARTITION BY scale ORDER BY p, group_a, group_b), 6) AS p_holm FROM h""",
)
def welch_t_by(spark, d):
    out = inference.welch_t_by(settled_scores(spark, d), ["scale"], "role", "score")
    out = out.select("scale", "group_a", "group_b", "n_a", "n_b", "t", "df", "p", "p_holm")
    return _rounded(out, "t", "df", "p", "p_holm")


@query(
    "inf3_significant_scales",
    _PAIRS + """ SELECT scale, group_a, group_b, round(p, 6) AS p, CASE WHEN p < .2 THEN 'Yes' ELSE 'No' END AS significant,
    count(*) FILTER (WHERE p < .2) OVER () AS n_significant FROM p""",
)
def significant_scales(spark, d):
    tests = inference.welch_t_by(settled_scores(spark, d), ["scale"], "role", "score")
    out = inference.significant_scales(tests, 0.2)
    return _rounded(out.select("scale", "group_a", "group_b", "p", "significant", "n_significant"), "p")


@query(
    "inf4_observed_diff",
    f"""WITH {ROLE_SCALE} SELECT scale, round(avg(score) FILTER (WHERE role = 'BUILDING') - avg(score) FILTER (WHERE role = 'MACHINERY'), 6) AS diff
        FROM rs GROUP BY scale""",
)
def observed_diff(spark, d):
    out = inference.observed_diff(role_scale_scores(spark, d), "role", "score", "BUILDING", "MACHINERY", ["scale"])
    return _rounded(out, "diff")


def _boot_sql(stat: str, where: str = "true") -> str:
    return f"""WITH {t.TWO_GROUPS}, i AS (SELECT *, row_number() OVER (ORDER BY {t.uniform_sql(42, "'row'", "id")}, id) - 1 AS idx,
        count(*) OVER () AS n FROM two WHERE {where}),
        draws AS (SELECT rep, floor({t.uniform_sql(42, "rep", "idx")} * n)::BIGINT AS hit FROM i, range(1, {REPS + 1}) r(rep))
        SELECT rep::INT AS rep, round({stat}, 6) AS stat FROM draws JOIN i ON hit = idx GROUP BY rep"""


_DIFF = "avg(value) FILTER (WHERE grp = 'good') - avg(value) FILTER (WHERE grp = 'poor')"


@query("inf5_bootstrap_mean", _boot_sql("avg(value)", "grp = 'good'"))
def bootstrap_mean(spark, d):
    good = t.two_groups(spark, d).where("grp = 'good'")
    return _rounded(inference.bootstrap_mean(good, "id", "value", REPS, 42), "stat")


@query("inf6_bootstrap_diff", _boot_sql(_DIFF))
def bootstrap_diff(spark, d):
    out = inference.bootstrap_diff(t.two_groups(spark, d), "id", "grp", "value", "good", "poor", REPS, 42)
    return _rounded(out, "stat")


# Draws by numpy generators are beyond SQL; it checks that every replicate has n draws, and that their mean is the
# table's within six standard errors.
@query(
    "inf5_bootstrap_buckets",
    f"""WITH {t.TWO_GROUPS}, s AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM two WHERE grp = 'good')
        SELECT rep::INT AS rep, n AS n_draws, round(m, 6) AS centre, true AS near FROM s, range(1, {REPS + 1}) r(rep)""",
)
def bootstrap_buckets(spark, d):
    good = cut_lineage(t.two_groups(spark, d).where("grp = 'good'"))
    stats = inference.bootstrap_mean(good, "id", "value", REPS, 42, method="buckets")
    truth = good.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))
    near = F.abs(F.col("stat") - F.col("m")) <= 6 * F.col("sd") / F.sqrt("n")
    return _rounded(with_values(stats, truth).select("rep", "n_draws", F.col("m").alias("centre"), near.alias("near")), "centre")


@query(
    "inf6_bootstrap_diff_buckets",
    f"""WITH {ROLE_SCALE}, s AS (SELECT scale, role, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM rs WHERE role IN ('BUILDING', 'MACHINERY') GROUP BY ALL)
        SELECT a.scale, (a.n + b.n)::BIGINT AS least_draws, (a.n + b.n)::BIGINT AS most_draws, {REPS}::BIGINT AS n_reps, round(a.m - b.m, 6) AS diff, true AS covered
        FROM s a JOIN s b USING (scale) WHERE a.role = 'BUILDING' AND b.role = 'MACHINERY'""",
)
def bootstrap_diff_buckets(spark, d):
    scores = settled_scores(spark, d)
    stats = inference.bootstrap_diff(scores, "id", "role", "score", "BUILDING", "MACHINERY", REPS, 42, ["scale"], method="buckets")
    spans = stats.groupBy("scale").agg(F.min("n_draws").alias("least_draws"), F.max("n_draws").alias("most_draws"), F.count("stat").alias("n_reps"), F.min("stat").alias("lo"), F.max("stat").alias("hi"))
    seen = inference.observed_diff(scores, "role", "score", "BUILDING", "MACHINERY", ["scale"])
    out = spans.join(seen, "scale").withColumn("covered", F.col("diff").between(F.col("lo"), F.col("hi")))
    return _rounded(out.select("scale", "least_draws", "most_draws", "n_reps", "diff", "covered"), "diff")


_POISSON = " + ".join(f"(u >= {bound!r})::INT" for bound in POISSON_CDF)


def _poisson_sql(frame: str, keys: str, group: str, value: str, a: str, b: str, source: str) -> str:
    side = lambda name: f"sum(w * {value}) FILTER (WHERE {group} = '{name}') / sum(w) FILTER (WHERE {group} = '{name}')::DOUBLE"
    return f"""{frame}, x AS (SELECT s.*, rep, {t.uniform_sql(42, "rep", "s.id")} AS u FROM {source} s, range(1, {REPS + 1}) r(rep)),
        k AS (SELECT *, {_POISSON} AS w FROM x), stats AS (SELECT {keys} rep::INT AS rep, {side(a)} - {side(b)} AS stat FROM k
        WHERE {group} IN ('{a}', '{b}') GROUP BY {keys} rep)"""


@query(
    "inf6_bootstrap_diff_poisson",
    _poisson_sql(f"WITH {t.TWO_GROUPS}", "", "grp", "value", "good", "poor", "two") + " SELECT rep, round(stat, 6) AS stat FROM stats",
)
def bootstrap_diff_poisson(spark, d):
    out = inference.bootstrap_diff(t.two_groups(spark, d), "id", "grp", "value", "good", "poor", REPS, 42, method="poisson")
    return _rounded(out, "stat")


@query(
    "inf7_percentile_ci",
    _poisson_sql(f"WITH {t.TWO_GROUPS}", "", "grp", "value", "good", "poor", "two")
    + " SELECT round(quantile_cont(stat, .025), 6) AS lower_ci, round(quantile_cont(stat, .975), 6) AS upper_ci FROM stats",
)
def percentile_ci(spark, d):
    stats = inference.bootstrap_diff(t.two_groups(spark, d), "id", "grp", "value", "good", "poor", REPS, 42, method="poisson")
    return _rounded(inference.percentile_ci(stats, 0.95), "lower_ci", "upper_ci")


@query(
    "inf7_resampling_chart",
    _poisson_sql(f"WITH {t.TWO_GROUPS}", "", "grp", "value", "good", "poor", "two")
    + """, e AS (SELECT min(stat) AS lo, (max(stat) - min(stat)) / 30.0::DOUBLE AS w, quantile_cont(stat, .025) AS a, quantile_cont(stat, .975) AS b FROM stats),
        h AS (SELECT least(floor((stat - lo) / w), 29)::INT AS bin, count(*) AS n FROM stats, e GROUP BY 1)
        SELECT bin, round(lo + (bin + 0.5) * w, 6) AS x, n, round(a, 6) AS lower_ci, round(b, 6) AS upper_ci FROM h, e""",
)
def resampling_chart(spark, d):
    stats = inference.bootstrap_diff(t.two_groups(spark, d), "id", "grp", "value", "good", "poor", REPS, 42, method="poisson")
    return _rounded(inference.resampling_chart(stats, 0.95), "x", "lower_ci", "upper_ci")


@query(
    "inf8_permute_null",
    f"""WITH {t.TWO_GROUPS}, x AS (SELECT two.*, rep, row_number() OVER (PARTITION BY rep ORDER BY {t.uniform_sql(7, "rep", "id")}, id) AS r,
        count(*) FILTER (WHERE grp = 'good') OVER (PARTITION BY rep) AS n_a FROM two, range(1, {REPS + 1}) q(rep))
        SELECT rep::INT AS rep, round(avg(value) FILTER (WHERE r <= n_a) - avg(value) FILTER (WHERE r > n_a), 6) AS stat FROM x GROUP BY rep""",
)
def permute_null(spark, d):
    return _rounded(inference.permute_null(t.two_groups(spark, d), "id", "grp", "value", "good", "poor", REPS, 7), "stat")


@query(
    "inf9_p_value",
    f"""WITH {ROLE_SCALE}, b AS (SELECT * FROM rs WHERE role IN ('BUILDING', 'MACHINERY')),
        o AS (SELECT scale, avg(score) FILTER (WHERE role = 'BUILDING') - avg(score) FILTER (WHERE role = 'MACHINERY') AS diff FROM b GROUP BY scale),
        x AS (SELECT b.*, rep, row_number() OVER (PARTITION BY scale, rep ORDER BY {t.uniform_sql(7, "rep", "id")}, id) AS r,
              count(*) FILTER (WHERE role = 'BUILDING') OVER (PARTITION BY scale, rep) AS n_a FROM b, range(1, {REPS + 1}) q(rep)),
        n AS (SELECT scale, rep, avg(score) FILTER (WHERE r <= n_a) - avg(score) FILTER (WHERE r > n_a) AS stat FROM x GROUP BY ALL)
        SELECT scale, round(diff, 6) AS diff, CASE WHEN diff > 0 THEN 'right' ELSE 'left' END AS side,
               round(avg(CASE WHEN diff > 0 THEN (round(stat, 9) >= round(diff, 9))::INT ELSE (round(stat, 9) <= round(diff, 9))::INT END), 6) AS p_value
        FROM n JOIN o USING (scale) GROUP BY scale, diff""",
)
def p_value(spark, d):
    scores = role_scale_scores(spark, d)
    out = inference.p_value(scores, "id", "role", "score", "BUILDING", "MACHINERY", REPS, 7, ["scale"], len(t.SCALES))
    return _rounded(out, "diff", "p_value")


# Labels drawn by numpy generators are beyond SQL; it checks how many each replicate gives, the spread that
# shuffling must have, and, for p-values, the observed difference and the normal tail within six standard errors.
@query(
    "inf8_permute_buckets",
    f"""WITH {t.TWO_GROUPS}, s AS (SELECT count(*) FILTER (WHERE grp = 'good') AS a, count(*) FILTER (WHERE grp = 'poor') AS b, stddev_samp(value) AS sd FROM two WHERE value IS NOT NULL AND grp IN ('good', 'poor'))
        SELECT rep::INT AS rep, a AS n_labels, round(sd * sqrt(1.0::DOUBLE / a + 1.0::DOUBLE / b), 6) AS se, true AS near FROM s, range(1, {REPS + 1}) r(rep)""",
)
def permute_buckets(spark, d):
    two = cut_lineage(t.two_groups(spark, d))
    null = inference.permute_null(two, "id", "grp", "value", "good", "poor", REPS, 7, method="buckets")
    out = with_values(null, two.agg(_shuffled_se("grp", "value", "good", "poor").alias("se")))
    return _rounded(out.select("rep", "n_labels", "se", (F.abs("stat") <= 6 * F.col("se")).alias("near")), "se")


def _shuffled_se(group: str, value: str, a: str, b: str):
    """Standard error of a difference in means over shuffled labels."""
    size = lambda name: F.count(F.when(F.col(group) == name, F.col(value)))
    return F.stddev_samp(F.when(F.col(group).isin(a, b), F.col(value))) * F.sqrt(F.lit(1.0) / size(a) + F.lit(1.0) / size(b))


@query(
    "inf9_p_value_buckets",
    f"""WITH {ROLE_SCALE}, o AS (SELECT scale, avg(score) FILTER (WHERE role = 'BUILDING') - avg(score) FILTER (WHERE role = 'MACHINERY') AS diff FROM rs GROUP BY scale)
        SELECT scale, round(diff, 6) AS diff, CASE WHEN diff > 0 THEN 'right' ELSE 'left' END AS side, true AS agrees FROM o WHERE diff IS NOT NULL""",
)
def p_value_buckets(spark, d):
    scores = settled_scores(spark, d)
    got = inference.p_value(scores, "id", "role", "score", "BUILDING", "MACHINERY", REPS, 7, ["scale"], method="buckets")
    se = scores.groupBy("scale").agg(_shuffled_se("role", "score", "BUILDING", "MACHINERY").alias("se"))
    tail = got.join(se, "scale").withColumn("tail", t_two_sided(F.abs("diff") / F.col("se"), F.lit(1e7)) / 2)
    room = 6 * F.sqrt(F.col("tail") * (1 - F.col("tail")) / REPS) + 0.02
    return _rounded(tail.select("scale", "diff", "side", (F.abs(F.col("p_value") - F.col("tail")) <= room).alias("agrees")), "diff")


@query(
    "inf10_confidence_interval",
    _poisson_sql(f"WITH {ROLE_SCALE}", "scale,", "role", "score", "BUILDING", "MACHINERY", "rs")
    + " SELECT scale, round(quantile_cont(stat, .025), 6) AS lower_ci, round(quantile_cont(stat, .975), 6) AS upper_ci FROM stats GROUP BY scale",
)
def confidence_interval(spark, d):
    out = inference.confidence_interval(
        settled_scores(spark, d), "id", "role", "score", "BUILDING", "MACHINERY", REPS, 42, 0.95, ["scale"], "poisson"
    )
    return _rounded(out, "lower_ci", "upper_ci")


_COR = "round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) + 0.0::DOUBLE"
_ALL_PAIRS = """p AS (SELECT a.id, a.item AS item_a, b.item AS item_b, a.score AS x, b.score AS y
    FROM {src} a JOIN {src} b ON a.id = b.id AND a.item < b.item)"""
_FULL = "full_ids AS (SELECT id FROM long GROUP BY id HAVING count(score) = 6)"
_SCALE_LONG = f"WITH {t.SCORED}, {t.SCALE_SCORES}, long AS (SELECT id, scale AS item, score FROM scale_scores), {_FULL}, whole AS (SELECT * FROM long WHERE id IN (SELECT id FROM full_ids))"


def _scale_long(spark, d):
    return screening.scale_scores(t.responses(spark, d), t.key_frame(spark), 24).withColumnRenamed("scale", "item")


@query(
    "inf11_cor_complete",
    f"""{_SCALE_LONG}, {_ALL_PAIRS.format(src="whole")}, r AS (SELECT item_a, item_b, {_COR} AS r FROM p GROUP BY 1, 2),
        b AS (SELECT item_a AS item, item_b, r FROM r UNION ALL SELECT item_b, item_a, r FROM r UNION ALL SELECT item, item, 1.0 FROM (SELECT DISTINCT item FROM long))
        SELECT item, {", ".join(f"max(r) FILTER (WHERE item_b = '{s}') AS {s}" for s in t.SCALES)} FROM b GROUP BY item""",
)
def cor_complete(spark, d):
    return _rounded(crossproducts.cor_complete(_scale_long(spark, d), t.SCALES), *t.SCALES)


@query(
    "inf12_cor_pairwise",
    f"""WITH {t.SCORED}, {_ALL_PAIRS.format(src="scored")} SELECT item_a, item_b, count(*) AS n, {_COR} AS r FROM p GROUP BY 1, 2""",
)
def cor_pairwise(spark, d):
    return _rounded(crossproducts.cor_pairwise(t.scored(spark, d), t.ITEM_NAMES), "r")


@query(
    "inf13_variable_distance",
    f"""{_SCALE_LONG}, {_ALL_PAIRS.format(src="whole")} SELECT item_a, item_b, round(sqrt(sum((x - y) * (x - y))), 6) AS distance FROM p GROUP BY 1, 2""",
)
def variable_distance(spark, d):
    return _rounded(crossproducts.variable_distance(_scale_long(spark, d), t.SCALES), "distance")
