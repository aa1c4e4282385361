"""Ranks, top-k, standardising and median filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions.numeric import tidy
from surveyloom.operators import groups, ranking, reshape, screening
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.session import cut_lineage
from surveyloom.sources.readers import read_table


@query(
    "rnk1_unique_rank",
    f"WITH {t.ITEM_STATS} SELECT item, round(raw_mean, 6) AS mean, row_number() OVER (ORDER BY raw_mean DESC, item) AS rank FROM item_stats",
)
def unique_rank(spark, d):
    means = groups.group_mean(t.scored(spark, d), ["item"], "score")
    out = ranking.unique_rank(means, [F.col("mean").desc(), F.col("item")])
    return out.select("item", tidy(F.col("mean")).alias("mean"), F.col("rank").cast("long").alias("rank"))


@query(
    "rnk2_average_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
       rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank
       FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""",
)
def average_rank(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return ranking.average_rank(rows, ["l_returnflag"], "l_quantity")


_LOADINGS = """l AS (SELECT vec_id AS item, generate_subscripts(embedding, 1) - 1 AS factor, unnest(embedding)::DOUBLE AS loading FROM embeddings)"""


def _loadings(spark, d):
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.posexplode("embedding").alias("factor", "loading"))
    return rows.select("item", F.col("factor").cast("long").alias("factor"), F.col("loading").cast("double").alias("loading"))


@query(
    "rnk3_top_k_per_group",
    f"""WITH {_LOADINGS}, r AS (SELECT *, rank() OVER (PARTITION BY item ORDER BY abs(loading) DESC)
          + (count(*) OVER (PARTITION BY item, abs(loading)) - 1) / 2.0::DOUBLE AS rank FROM l)
        SELECT item, factor, round(loading, 6) AS loading, rank FROM r WHERE rank <= 2""",
)
def top_k_per_group(spark, d):
    out = ranking.top_k_per_group(_loadings(spark, d), ["item"], F.abs("loading"), 2)
    return out.select("item", "factor", tidy(F.col("loading")).alias("loading"), "rank")


@query(
    "rnk4_best_per_group",
    f"""WITH {_LOADINGS}, r AS (SELECT *, rank() OVER (PARTITION BY item ORDER BY abs(loading) DESC)
          + (count(*) OVER (PARTITION BY item, abs(loading)) - 1) / 2.0::DOUBLE AS rank FROM l)
        SELECT item, factor, round(loading, 6) AS loading FROM r WHERE rank = 1""",
)
def best_per_group(spark, d):
    out = ranking.best_per_group(_loadings(spark, d), ["item"], F.abs("loading"))
    return out.select("item", "factor", tidy(F.col("loading")).alias("loading"))


@query("rnk5_top_k", f"WITH {t.ITEM_STATS} SELECT item, mean FROM item_stats ORDER BY mean DESC, item LIMIT 10")
def top_k(spark, d):
    stats = screening.item_stats(t.scored(spark, d))
    return ranking.top_k(stats, [F.col("mean").desc(), F.col("item")], 10).select("item", "mean")


@query("rnk6_sort_by", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def sort_by(spark, d):
    people = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return reshape.sort_by(people, "c_mktsegment", F.col("c_acctbal").desc(), "c_custkey")


@query(
    "rnk7_order_by_group_stat",
    f"""WITH {t.SCORED}, {t.SCALE_SCORES} SELECT scale, round(avg(score), 6) AS mean,
        row_number() OVER (ORDER BY avg(score), scale) AS position FROM scale_scores GROUP BY scale""",
)
def order_by_group_stat(spark, d):
    scores = screening.scale_scores(t.responses(spark, d), t.key_frame(spark), 24)
    out = ranking.order_by_group_stat(scores, "scale", "score")
    return out.select("scale", tidy(F.col("mean")).alias("mean"), F.col("position").cast("long").alias("position"))


@query(
    "rnk8_zscore",
    f"""WITH {t.SCORED}, {t.SCALE_SCORES} SELECT id, scale,
        round((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), 6) + 0.0::DOUBLE AS z
        FROM scale_scores WINDOW w AS (PARTITION BY scale)""",
)
def zscore(spark, d):
    scores = screening.scale_scores(t.responses(spark, d), t.key_frame(spark), 24)
    return ranking.zscore(scores, ["scale"], "score", rows=24).select("id", "scale", tidy(F.col("z")).alias("z"))


_WIDE = ", ".join(f"max(score) FILTER (WHERE item = '{i}') AS {i}" for i in t.ITEM_NAMES)


@query(
    "rnk9_impute_median",
    f"""WITH {t.RESPONSES}, {t.RESPONDENTS}, w AS (SELECT r.id, any_value(role) AS role, {_WIDE} FROM respondents r LEFT JOIN responses s ON r.id = s.id GROUP BY r.id)
        SELECT id, role, {", ".join(f"coalesce({i}, median({i}) OVER (PARTITION BY role))::DOUBLE AS {i}" for i in t.ITEM_NAMES)} FROM w""",
)
def impute_median(spark, d):
    wide = reshape.to_wide(t.responses(spark, d), ["id"], "item", "score", t.ITEM_NAMES)
    people = cut_lineage(t.respondents(spark, d).select("id", "role").join(wide, "id", "left"))
    return groups.impute_median(people, "role", t.ITEM_NAMES).select("id", "role", *t.ITEM_NAMES)
