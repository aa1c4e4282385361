"""Survey-shaped inputs derived from the test tables, in Spark and in SQL.

Both sides are written independently: the SQL text is what the check runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.functions.scores import key_score
from surveyloom.operators import screening
from surveyloom.sources.readers import read_table

ITEM_NAMES = [f"I{i:02d}" for i in range(24)]
COG_NAMES = [f"C{i:02d}" for i in range(25)]
SCALE_ROWS = [(f"S{i // 4}", f"I{i:02d}", -1 if i % 2 else 1) for i in range(24)]
REVERSED = [item for _, item, sign in SCALE_ROWS if sign < 0]
SCALES = [f"S{i}" for i in range(6)]
ROLES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
COG_KEY_ROWS = [(name, "A" if i % 2 == 0 else "N") for i, name in enumerate(COG_NAMES)]


def _label(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 2, "0"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their respondent, before cells are made unique."""
    line = read_table(spark, folder, "lineitem")
    order = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))


# A cell keeps the value of its first order line, by order, line, part and supplier.  They and the
# value are packed into one decimal, whose least is found by hash aggregation: 12 digits for the
# order, 2 for the line, 11 and 10 for the keys, 3 for the value.
_WIDE = "decimal(38,0)"


def _packed(code):
    line = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("decimal(14,0)") * F.lit(str(10**24)).cast("decimal(25,0)")
    rest = F.col("l_partkey").cast("decimal(11,0)") * F.lit(10**13).cast("decimal(14,0)")
    return (line + rest + (F.col("l_suppkey") * 1000 + code).cast("decimal(14,0)")).cast(_WIDE)


def _code(packed):
    return F.pmod(packed, F.lit(1000).cast(_WIDE)).cast("int")


def _option(code):
    letter = F.char(code)
    return F.when(letter == "R", "I don't know").otherwise(letter)


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """(id, item, score 1..5): one cell per respondent and item."""
    score = F.ceil(F.col("l_quantity") / 10).cast("int")
    return (
        lines(spark, folder)
        .groupBy(F.col("o_custkey").alias("id"), _label("I", F.col("l_partkey") % 24).alias("item"))
        .agg(F.min(_packed(score)).alias("first"))
        .select("id", "item", _code(F.col("first")).alias("score"))
    )


def turned(cells: DataFrame) -> DataFrame:
    """Responses with reversed items turned round."""
    score = F.when(F.col("item").isin(REVERSED), 6 - F.col("score")).otherwise(F.col("score"))
    return cells.withColumn("score", score)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return turned(responses(spark, folder))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(id, item, option): keyed answers, where R stands for "I don't know"."""
    return (
        lines(spark, folder)
        .groupBy(F.col("o_custkey").alias("id"), _label("C", F.col("l_suppkey") % 25).alias("item"))
        .agg(F.min(_packed(F.ascii("l_returnflag"))).alias("first"))
        .select("id", "item", _option(_code(F.col("first"))).alias("option"))
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, item, answer) of both questionnaires, from one reading of the lines; kind is p or c."""
    both = F.array(
        F.struct(F.lit("p").alias("kind"), _label("I", F.col("l_partkey") % 24).alias("item"), _packed(F.ceil(F.col("l_quantity") / 10).cast("int")).alias("first")),
        F.struct(F.lit("c").alias("kind"), _label("C", F.col("l_suppkey") % 25).alias("item"), _packed(F.ascii("l_returnflag")).alias("first")),
    )
    least = lines(spark, folder).select(F.col("o_custkey").alias("id"), F.inline(both)).groupBy("id", "kind", "item").agg(F.min("first").alias("first"))
    code = _code(F.col("first"))
    return least.select("id", "kind", "item", F.when(F.col("kind") == "p", code.cast("string")).otherwise(_option(code)).alias("answer"))


def keyed_scores(cells: DataFrame) -> DataFrame:
    """(id, item, score 0/1) by the answer key."""
    key = cells.sparkSession.createDataFrame(COG_KEY_ROWS, "item string, right_option string")
    joined = cells.join(F.broadcast(key), "item")
    return joined.select("id", "item", key_score(F.col("option"), F.col("right_option")).alias("score"))


def cognitive(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_scores(answers(spark, folder))


def respondents(spark: SparkSession, folder: str, times: bool = False) -> DataFrame:
    """One row per respondent with demographics and, where wanted, start/finish times."""
    nation = F.col("c_nationkey")
    people = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("role"),
        F.when(nation % 3 == 0, "Enlisted").when(nation % 3 == 1, "Officer").otherwise("Warrant").alias("rank"),
        F.when(nation % 7 == 0, None).when(F.col("c_acctbal") > 5000, ">5Years").otherwise("<=5Years").alias("experience"),
        F.when(nation % 5 == 0, "High School")
        .when(nation % 5 == 1, "Associates")
        .when(nation % 5 == 2, "Some College")
        .when(nation % 5 == 3, "Bachelors")
        .otherwise("Masters")
        .alias("degree"),
        F.when(nation % 4 == 0, "Yes").when(nation % 4 == 1, "No").alias("prior"),
        F.when(F.col("c_custkey") % 3 == 0, "Yes").when(F.col("c_custkey") % 3 == 1, "No").alias("gaming"),
        F.when(F.col("c_custkey") % 5 == 0, "Yes").when(F.col("c_custkey") % 5 < 4, "No").alias("scripts"),
        F.col("c_acctbal").alias("balance"),
    )
    if not times:
        return people
    spans = (
        read_table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.min("ts").alias("started"), F.max("ts").alias("completed"))
    )
    return people.join(spans, "id", "left")


def screening_stats(spark: SparkSession, folder: str, keyed: DataFrame | None = None) -> DataFrame:
    """respondents + miss_p, miss_c, sincere, infreq; ``keyed`` may bring settled answers."""
    keyed = answers(spark, folder) if keyed is None else keyed
    return screening.screening_stats(
        respondents(spark, folder),
        scored(spark, folder).withColumnRenamed("score", "answer"),
        ITEM_NAMES,
        keyed.withColumnRenamed("option", "answer"),
        COG_NAMES,
    )


def profile_stats(spark: SparkSession, folder: str, cells: DataFrame) -> DataFrame:
    """respondents + miss_p and infreq: what screening Likert scales needs."""
    likert = turned(cells).withColumnRenamed("score", "answer")
    return screening.screening_stats(respondents(spark, folder), likert, ITEM_NAMES)


def key_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCALE_ROWS, "scale string, item string, sign int")


def two_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(id, grp good/poor, value): document length by quality label."""
    label = read_table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("value"))
    return label.join(docs, "id").select("id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("grp"), "value")


# ------------------------------------------------------------------ SQL side

RESPONSES = """responses AS (
  SELECT id, item, score FROM (
    SELECT o_custkey AS id, 'I' || lpad((l_partkey % 24)::VARCHAR, 2, '0') AS item,
           CAST(ceil(l_quantity / 10) AS INTEGER) AS score,
           row_number() OVER (PARTITION BY o_custkey, l_partkey % 24
                              ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)"""

SCORED = RESPONSES + """, scored AS (
  SELECT id, item, 'S' || (substr(item, 2)::INT // 4) AS scale,
         CASE WHEN substr(item, 2)::INT % 2 = 1 THEN 6 - score ELSE score END AS score FROM responses)"""

ANSWERS = """answers AS (
  SELECT id, item, option FROM (
    SELECT o_custkey AS id, 'C' || lpad((l_suppkey % 25)::VARCHAR, 2, '0') AS item,
           CASE WHEN l_returnflag = 'R' THEN 'I don''t know' ELSE l_returnflag END AS option,
           row_number() OVER (PARTITION BY o_custkey, l_suppkey % 25
                              ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)"""

COGNITIVE = ANSWERS + """, cognitive AS (
  SELECT id, item, CASE WHEN option = CASE WHEN substr(item, 2)::INT % 2 = 0 THEN 'A' ELSE 'N' END
                        THEN 1 ELSE 0 END AS score FROM answers)"""

RESPONDENTS = """respondents AS (
  SELECT c_custkey AS id, c_mktsegment AS role,
         CASE c_nationkey % 3 WHEN 0 THEN 'Enlisted' WHEN 1 THEN 'Officer' ELSE 'Warrant' END AS rank,
         CASE WHEN c_nationkey % 7 = 0 THEN NULL WHEN c_acctbal > 5000 THEN '>5Years' ELSE '<=5Years' END AS experience,
         CASE c_nationkey % 5 WHEN 0 THEN 'High School' WHEN 1 THEN 'Associates' WHEN 2 THEN 'Some College'
                              WHEN 3 THEN 'Bachelors' ELSE 'Masters' END AS degree,
         CASE c_nationkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS prior,
         CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS gaming,
         CASE WHEN c_custkey % 5 = 0 THEN 'Yes' WHEN c_custkey % 5 < 4 THEN 'No' END AS scripts,
         c_acctbal AS balance, started, completed
  FROM customer LEFT JOIN (SELECT user_id, min(ts) AS started, max(ts) AS completed FROM events GROUP BY 1)
       ON user_id = c_custkey)"""

# item statistics, the mean of the ten easiest, and the screening measures
ITEM_STATS = SCORED + """, item_stats AS (
  SELECT *, row_number() OVER (ORDER BY mean DESC, item) AS rank FROM (
    SELECT item, round(avg(score), 1) AS mean, round(stddev_samp(score), 1) AS sd, avg(score) AS raw_mean
    FROM scored GROUP BY item))"""

SCREEN = (
    RESPONDENTS
    + ", "
    + ITEM_STATS
    + ", "
    + ANSWERS
    + """, easy AS (SELECT avg(mean) AS easy_mean FROM item_stats WHERE rank <= 10)
, screened AS (
  SELECT r.*, 1 - coalesce(np, 0) / 24.0::DOUBLE AS miss_p, 1 - coalesce(nc, 0) / 25.0::DOUBLE AS miss_c,
         coalesce(sincere, 0) AS sincere, infreq
  FROM respondents r
  LEFT JOIN (SELECT id, count(score) AS np FROM scored GROUP BY id) USING (id)
  LEFT JOIN (SELECT id, count(option) AS nc, count(*) FILTER (WHERE option = 'I don''t know') AS sincere
             FROM answers GROUP BY id) USING (id)
  LEFT JOIN (SELECT id, abs((SELECT easy_mean FROM easy) - avg(score)) AS infreq
             FROM scored JOIN item_stats USING (item) WHERE rank <= 10 GROUP BY id) USING (id))"""
)

SCALE_SCORES = """scale_scores AS (SELECT id, scale, avg(score) AS score FROM scored GROUP BY id, scale)"""

TWO_GROUPS = """two AS (
  SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS grp, n_chars::DOUBLE AS value
  FROM labels JOIN documents USING (doc_id))"""


def uniform_sql(seed, *labels: str) -> str:
    """SQL text of the hashed uniform."""
    parts = ", ".join([f"'{seed}'", *[f"({label})::VARCHAR" for label in labels]])
    return f"(('0x' || substr(md5(concat_ws('-', {parts})), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE)"
