"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import scores as sc
from surveyloom.functions.numeric import tidy
from surveyloom.operators import groups
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.sources.readers import read_table

_ACCURATE = ["Very Inaccurate", "Moderately Inaccurate", "Neither Accurate nor Inaccurate", "Moderately Accurate", "Very Accurate"]
_AGREE = ["Strongly Disagree", "Moderately Disagree", "Neither Agree nor Disagree", "Moderately Agree", "Strongly Agree"]


@query(
    "sca1_likert_score",
    f"WITH {t.RESPONSES} SELECT id, item, CASE WHEN item = 'I23' THEN NULL ELSE score END AS score FROM responses",
)
def likert_score(spark, d):
    pick = lambda labels: F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("score"))
    even = F.substring("item", 2, 2).cast("int") % 2 == 0
    label = F.when(F.col("item") == "I23", F.lit("no such label")).when(even, pick(_ACCURATE)).otherwise(pick(_AGREE))
    return t.responses(spark, d).select("id", "item", sc.likert_score(label).alias("score"))


@query("sca2_key_score", f"WITH {t.COGNITIVE} SELECT id, item, score FROM cognitive")
def key_score(spark, d):
    return t.cognitive(spark, d)


@query("sca3_reverse_score", f"WITH {t.SCORED} SELECT id, item, score FROM scored")
def reverse_score(spark, d):
    turned = sc.reverse_score(F.col("item"), F.col("score"), t.REVERSED)
    return t.responses(spark, d).select("id", "item", turned.alias("score"))


@query(
    "sca4_signed_score",
    f"""WITH {t.RESPONSES} SELECT id, item, CASE WHEN (substr(item, 2)::INT % 5) - 2 > 0 THEN score ELSE 6 - score END AS score
        FROM responses""",
)
def signed_score(spark, d):
    loading = F.substring("item", 2, 2).cast("int") % 5 - 2
    return t.responses(spark, d).select("id", "item", sc.signed_score(F.col("score"), loading).alias("score"))


@query(
    "sca5_option_flag",
    f"WITH {t.RESPONDENTS} SELECT id, CASE WHEN experience = '>5Years' THEN 'Yes' WHEN experience IS NOT NULL THEN 'No' END AS senior FROM respondents",
)
def option_flag(spark, d):
    return t.respondents(spark, d).select("id", sc.option_flag(F.col("experience"), ">5Years").alias("senior"))


@query(
    "sca6_recode",
    """SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(o_orderpriority, '1-URGENT|2-HIGH', 'Tier_1'),
         '3-MEDIUM', 'Tier_2'), '4-NOT SPECIFIED|5-LOW', 'Tier_Other') AS priority FROM orders""",
)
def recode(spark, d):
    table = [("1-URGENT|2-HIGH", "Tier_1"), ("3-MEDIUM", "Tier_2"), ("4-NOT SPECIFIED|5-LOW", "Tier_Other")]
    return read_table(spark, d, "orders").select("o_orderkey", sc.recode(F.col("o_orderpriority"), table).alias("priority"))


@query(
    "sca7_collapse_role",
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'Focus' ELSE 'Other' END AS two_way,
         CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'Focus' ELSE c_mktsegment END AS merged FROM customer""",
)
def collapse_role(spark, d):
    focus = ["HOUSEHOLD", "MACHINERY"]
    role = F.col("c_mktsegment")
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        sc.collapse(role, focus, "Focus", "Other").alias("two_way"),
        sc.collapse(role, focus, "Focus").alias("merged"),
    )


@query(
    "sca8_override_role",
    f"""WITH {t.RESPONDENTS} SELECT id, CASE WHEN prior = 'Yes' THEN 'MACHINERY' ELSE role END AS with_prior, role AS without_prior
        FROM respondents""",
)
def override_role(spark, d):
    role, prior = F.col("role"), F.col("prior")
    return t.respondents(spark, d).select(
        "id",
        sc.override_role(role, prior, True, "MACHINERY").alias("with_prior"),
        sc.override_role(role, prior, False, "MACHINERY").alias("without_prior"),
    )


@query(
    "sca9_collapse_level",
    f"WITH {t.RESPONDENTS} SELECT id, CASE WHEN degree IN ('Associates', 'Some College') THEN 'Some College' ELSE degree END AS degree FROM respondents",
)
def collapse_level(spark, d):
    return t.respondents(spark, d).select(
        "id", sc.collapse(F.col("degree"), ["Associates", "Some College"], "Some College").alias("degree")
    )


@query(
    "sca10_fill_default",
    f"WITH {t.RESPONDENTS} SELECT id, coalesce(prior, 'No') AS prior, coalesce(experience, 'unknown') AS experience FROM respondents",
)
def fill_default(spark, d):
    return t.respondents(spark, d).select(
        "id",
        sc.fill_default(F.col("prior"), "No").alias("prior"),
        sc.fill_default(F.col("experience"), "unknown").alias("experience"),
    )


@query(
    "sca11_duration_min",
    f"""WITH {t.RESPONDENTS} SELECT id, coalesce(round((epoch_us(completed) - epoch_us(started)) / 6e7::DOUBLE, 2), 0.0::DOUBLE) AS duration_min
        FROM respondents""",
)
def duration_min(spark, d):
    return t.respondents(spark, d, times=True).select("id", sc.duration_min(F.col("started"), F.col("completed")).alias("duration_min"))


@query("sca12_day", "SELECT event_id, ts::DATE AS day FROM events")
def day(spark, d):
    return read_table(spark, d, "events").select("event_id", sc.day(F.col("ts")).alias("day"))


@query(
    "sca13_signed_share",
    f"""WITH {t.RESPONDENTS}, g AS (SELECT role, experience, count(*) AS n FROM respondents WHERE experience IS NOT NULL GROUP BY ALL)
        SELECT role, experience, CASE WHEN experience = '<=5Years' THEN round(-n / sum(n) OVER (PARTITION BY role)::DOUBLE, 1)
               ELSE round(n / sum(n) OVER (PARTITION BY role)::DOUBLE, 1) END AS share FROM g""",
)
def signed_share(spark, d):
    known = t.respondents(spark, d).where(F.col("experience").isNotNull())
    shares = groups.group_share(known, ["role", "experience"], ["role"])
    return shares.select(
        "role", "experience", sc.signed_share(F.col("experience"), F.col("share"), ["<=5Years"]).alias("share")
    )


@query(
    "sca14_encode",
    f"""WITH {t.RESPONDENTS} SELECT id, CASE WHEN gaming = 'Yes' THEN 1 WHEN gaming IS NOT NULL THEN 0 END AS gaming,
        CASE WHEN degree = 'Masters' THEN 3 WHEN degree = 'Bachelors' THEN 2 WHEN degree IN ('Associates', 'Some College') THEN 1
             ELSE 0 END AS degree FROM respondents""",
)
def encode(spark, d):
    codes = {"High School": 0, "Associates": 1, "Some College": 1, "Bachelors": 2, "Masters": 3}
    return t.respondents(spark, d).select(
        "id",
        sc.encode_yes_no(F.col("gaming")).alias("gaming"),
        sc.encode_levels(F.col("degree"), codes).alias("degree"),
    )


@query(
    "sca15_row_total",
    f"""WITH {t.RESPONDENTS} SELECT id, (prior = 'Yes')::INT + (gaming = 'Yes')::INT + (scripts = 'Yes')::INT AS total FROM respondents""",
)
def row_total(spark, d):
    flags = ["prior", "gaming", "scripts"]
    coded = t.respondents(spark, d).withColumns({c: sc.encode_yes_no(F.col(c)) for c in flags})
    return coded.select("id", sc.row_total(flags).alias("total"))


@query(
    "sca16_grade",
    """WITH g AS (SELECT p_brand, avg(p_retailprice) - 1500 AS value FROM part GROUP BY p_brand),
            s AS (SELECT p_brand, (value + abs(min(value) OVER ())) / (max(value) OVER () - min(value) OVER ()) AS share FROM g)
       SELECT p_brand, CASE WHEN share > .8 THEN 'A' WHEN share > .6 THEN 'B' WHEN share > .4 THEN 'C' WHEN share > .2 THEN 'D'
              ELSE 'F' END AS grade, round(share, 6) AS share FROM s""",
)
def grade(spark, d):
    means = read_table(spark, d, "part").groupBy("p_brand").agg((F.avg("p_retailprice") - 1500).alias("value"))
    graded = groups.grade_by_range(means, "value")
    return graded.select("p_brand", "grade", tidy(F.col("share")).alias("share"))


@query(
    "sca17_p_label",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount < 0.05 THEN 'p<0.05' WHEN l_discount < 0.1 THEN 'p<0.1'
              ELSE 'no_sig' END AS label, CASE WHEN l_tax < 0.05 THEN 'Yes' ELSE 'No' END AS flag FROM lineitem""",
)
def p_label(spark, d):
    return read_table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        sc.p_label(F.col("l_discount")).alias("label"),
        sc.yes_no(F.col("l_tax") < 0.05).alias("flag"),
    )


@query(
    "sca18_sign_label",
    """SELECT vec_id, i, CASE WHEN v > 0 THEN 'positive' ELSE 'negative' END AS sign
       FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings)""",
)
def sign_label(spark, d):
    long = read_table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return long.select("vec_id", F.col("i").cast("long").alias("i"), sc.sign_label(F.col("v")).alias("sign"))
