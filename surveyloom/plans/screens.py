"""Screening measures, filters and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom import model
from surveyloom.functions.numeric import tidy
from surveyloom.operators import reshape, screening
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.sources.readers import read_table

# Limits that split the test respondents into both outcomes.
RULES = model.ScreeningRules(
    (model.Limit("miss_c", 0.25), model.Limit("miss_p", 0.3), model.Limit("sincere", 8), model.Limit("infreq", 0.75))
)
RULES_SQL = "miss_c < 0.25 AND miss_p < 0.3 AND sincere < 8 AND infreq < 0.75"


@query(
    "fil1_screen",
    f"""WITH {t.SCREEN} SELECT id, role, round(miss_p, 6) AS miss_p, round(miss_c, 6) AS miss_c, sincere, round(infreq, 6) AS infreq
        FROM screened WHERE {RULES_SQL}""",
)
def screen(spark, d):
    kept = screening.screen(t.screening_stats(spark, d), RULES)
    return kept.select("id", "role", *[tidy(F.col(c)).alias(c) for c in ("miss_p", "miss_c")], "sincere", tidy(F.col("infreq")).alias("infreq"))


@query(
    "fil2_completion_flag",
    f"WITH {t.SCREEN} SELECT id, CASE WHEN {RULES_SQL} THEN 'Yes' WHEN NOT ({RULES_SQL}) THEN 'No' END AS completed_flag FROM screened",
)
def completion_flag(spark, d):
    return screening.completion_flag(t.screening_stats(spark, d), RULES).select("id", "completed_flag")


@query(
    "fil3_within_limit",
    f"WITH {t.SCREEN} SELECT id, CASE WHEN miss_p <= 0.2 THEN 'Y' ELSE 'N' END AS filter_in FROM screened",
)
def within_limit(spark, d):
    return screening.flag_within(t.screening_stats(spark, d), "miss_p", 0.2).select("id", "filter_in")


@query("fil4_drop_missing", f"WITH {t.RESPONDENTS} SELECT id, role, experience FROM respondents WHERE experience IS NOT NULL")
def drop_missing(spark, d):
    return reshape.drop_missing(t.respondents(spark, d).select("id", "role", "experience"), ["experience"])


@query(
    "fil5_complete_cases",
    f"""WITH {t.RESPONSES}, w AS (SELECT id, {", ".join(f"max(score) FILTER (WHERE item = '{i}') AS {i}" for i in t.ITEM_NAMES)}
        FROM responses GROUP BY id) SELECT * FROM w WHERE {" AND ".join(f"{i} IS NOT NULL" for i in t.ITEM_NAMES)}""",
)
def complete_cases(spark, d):
    return reshape.complete_cases(reshape.to_wide(t.responses(spark, d), ["id"], "item", "score", t.ITEM_NAMES))


@query(
    "fil6_filter_not_in",
    f"""WITH {t.RESPONDENTS} SELECT id, role, prior FROM respondents
        WHERE role IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND coalesce(prior NOT IN ('Yes'), true)""",
)
def filter_not_in(spark, d):
    people = t.respondents(spark, d).select("id", "role", "prior")
    return reshape.filter_not_in(reshape.filter_in(people, "role", ["BUILDING", "MACHINERY", "FURNITURE"]), "prior", ["Yes"])


@query(
    "agg1_missing_rate",
    f"""WITH {t.SCREEN} SELECT id, round(miss_p, 6) AS miss_p, round(miss_c, 6) AS miss_c FROM screened""",
)
def missing_rate(spark, d):
    rates = screening.missing_rates(t.respondents(spark, d), t.cells(spark, d), {"p": 24, "c": 25})
    return rates.select("id", tidy(F.col("miss_p")).alias("miss_p"), tidy(F.col("miss_c")).alias("miss_c"))


@query(
    "agg2_insincere_count",
    f"""WITH {t.ANSWERS} SELECT id, count(*) FILTER (WHERE option = 'I don''t know') AS sincere,
        round(count(*) FILTER (WHERE option = 'I don''t know') / 25.0::DOUBLE, 6) AS sincere_share FROM answers GROUP BY id""",
)
def insincere_count(spark, d):
    answers = t.answers(spark, d)
    counts = screening.insincere_count(answers, answer="option")
    return counts.withColumn("sincere_share", tidy(F.col("sincere") / 25.0))


@query(
    "agg3_missing_map",
    f"""WITH {t.RESPONSES} SELECT item, (SELECT count(*) FROM customer) - count(score) AS n_missing FROM responses GROUP BY item""",
)
def missing_map(spark, d):
    people = read_table(spark, d, "customer").agg(F.count(F.lit(1)))
    return screening.missing_by_item(t.responses(spark, d), people, t.ITEM_NAMES, "score")


@query(
    "agg3_missing_map_by_id",
    f"""WITH {t.RESPONSES}, a AS (SELECT c_custkey AS id, list(item) FILTER (WHERE score IS NOT NULL) AS has FROM customer LEFT JOIN responses ON id = c_custkey GROUP BY 1),
        m AS (SELECT id, list_filter([{", ".join(f"'{i}'" for i in t.ITEM_NAMES)}], lambda i: NOT list_contains(coalesce(has, []), i)) AS gone FROM a)
        SELECT id, len(gone)::BIGINT AS n_missing, coalesce(array_to_string(gone, ' '), '') AS missing FROM m""",
)
def missing_map_by_id(spark, d):
    return screening.missing_by_respondent(t.respondents(spark, d), t.responses(spark, d), t.ITEM_NAMES, "score")


@query(
    "agg9_scale_scores",
    f"""WITH {t.SCORED}, {t.COGNITIVE} SELECT id, scale, round(avg(score), 6) AS score FROM scored GROUP BY id, scale
        UNION ALL SELECT id, 'T' || substr(item, 2)::INT % 5, round(avg(score), 6) FROM cognitive GROUP BY 1, 2
        UNION ALL SELECT id, 'Cog_tot', round(avg(score), 6) FROM cognitive GROUP BY id""",
)
def scale_scores(spark, d):
    likert = screening.scale_scores(t.responses(spark, d), t.key_frame(spark), 24)
    types = spark.createDataFrame([(f"T{i % 5}", name, 1) for i, name in enumerate(t.COG_NAMES)], "scale string, item string, sign int")
    cognitive = t.cognitive(spark, d)
    keyed = screening.scale_scores(cognitive, types, 25)
    both = likert.unionByName(keyed).unionByName(screening.total_scores(cognitive))
    return both.withColumn("score", tidy(F.col("score")))


@query(
    "agg10_revised_scale_scores",
    f"""WITH {t.RESPONSES} SELECT id, 'N' || substr(item, 2)::INT % 3 AS scale,
        round(avg(CASE WHEN item IN ('I02', 'I05', 'I12') THEN 6 - score ELSE score END), 6) AS score FROM responses GROUP BY 1, 2""",
)
def revised_scale_scores(spark, d):
    rows = [(f"N{i % 3}", name, -1 if name in ("I02", "I05", "I12") else 1) for i, name in enumerate(t.ITEM_NAMES)]
    key = spark.createDataFrame(rows, "scale string, item string, sign int")
    out = screening.scale_scores(t.responses(spark, d), key, len(rows))
    return out.withColumn("score", tidy(F.col("score")))


@query(
    "agg12_item_stats",
    f"WITH {t.ITEM_STATS} SELECT item, mean, sd, rank FROM item_stats",
)
def item_stats(spark, d):
    return screening.item_stats(t.scored(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("agg13_easy_mean", f"WITH {t.ITEM_STATS} SELECT round(avg(mean), 6) AS easy_mean FROM item_stats WHERE rank <= 10")
def easy_mean(spark, d):
    return screening.easy_mean(screening.item_stats(t.scored(spark, d))).select(tidy(F.col("easy_mean")).alias("easy_mean"))


@query("agg14_infrequency", f"WITH {t.SCREEN} SELECT id, round(infreq, 6) AS infreq FROM screened WHERE infreq IS NOT NULL")
def infrequency(spark, d):
    scored = t.scored(spark, d)
    return screening.infrequency(scored, screening.item_stats(scored)).select("id", tidy(F.col("infreq")).alias("infreq"))


@query(
    "agg26_quality_profile",
    f"""WITH {t.SCREEN}, s AS (SELECT id, miss_c, sincere / 25.0::DOUBLE AS sincere FROM screened WHERE miss_c < 0.2),
        k AS (SELECT *, greatest(miss_c, sincere) AS order_key FROM s)
        SELECT id, round(order_key, 6) AS order_key, unnest(['miss_c', 'sincere']) AS measure,
               round(unnest([miss_c, sincere]), 6) AS score FROM k""",
)
def quality_profile(spark, d):
    stats = t.screening_stats(spark, d).withColumn("sincere", F.col("sincere") / 25.0)
    rules = model.ScreeningRules((model.Limit("miss_c", 0.2),))
    out = screening.quality_profile(stats, rules, ["miss_c", "sincere"])
    return out.select("id", "measure", tidy(F.col("order_key")).alias("order_key"), tidy(F.col("score")).alias("score"))


@query(
    "agg27_sample_sizes",
    f"""WITH {t.SCREEN} SELECT {", ".join(f"count(*) FILTER (WHERE role = '{r}') AS {r}" for r in t.ROLES)} FROM screened
        WHERE {RULES_SQL}""",
)
def sample_sizes(spark, d):
    return screening.sample_sizes(t.screening_stats(spark, d), RULES, "role", t.ROLES)


@query(
    "agg27_complete_case_sizes",
    f"""WITH {t.SCREEN}, {t.SCALE_SCORES}, w AS (SELECT id, role FROM scale_scores JOIN screened USING (id) WHERE {RULES_SQL}
        GROUP BY id, role HAVING count(DISTINCT scale) = {len(t.SCALES)}) SELECT role, count(*) AS n FROM w GROUP BY role""",
)
def complete_case_sizes(spark, d):
    """Respondents that pass screening and have a score on every scale."""
    kept = screening.screen(t.screening_stats(spark, d), RULES).select("id", "role")
    scores = screening.scale_scores(t.responses(spark, d), t.key_frame(spark), 24)
    return screening.complete_case_sizes(scores.join(kept, "id"), t.SCALES)
