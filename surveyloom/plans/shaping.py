"""Sources, sinks, reshaping and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from surveyloom.functions import scores as sc
from surveyloom.functions.draws import uniform
from surveyloom.functions.numeric import tidy
from surveyloom.operators import reshape, sampling, screening
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.session import remove_at_end, shared_dir
from surveyloom.sources import readers, writers


@query("src1_read_responses", "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def read_responses(spark, d):
    schema = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_partkey", T.LongType()),
            T.StructField("l_quantity", T.DoubleType()),
            T.StructField("l_returnflag", T.StringType()),
        ]
    )
    return readers.read_responses(spark, f"{d}/lineitem.parquet", schema)


@query(
    "src2_read_items",
    "SELECT p_partkey::VARCHAR AS item, p_type AS trait, p_name AS content FROM part",
)
def read_items(spark, d):
    schema = T.StructType(
        [
            T.StructField("p_partkey", T.LongType()),
            T.StructField("p_type", T.StringType()),
            T.StructField("p_name", T.StringType()),
        ]
    )
    items = readers.read_items(spark, f"{d}/part.parquet", schema, index="p_partkey")
    return items.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("trait"), F.col("p_name").alias("content"))


_TYPES = ["ThreeD", "Pattern", "Matrix", "Verbal", "Analogies"]


@query(
    "src3_norms",
    f"""WITH {t.COGNITIVE}, n(dimension, norm) AS (VALUES ('ThreeD', 0.23), ('Pattern', 0.46), ('Matrix', 0.44),
        ('Verbal', 0.57), ('Analogies', 0.37)), g AS (
        SELECT ['ThreeD', 'Pattern', 'Matrix', 'Verbal', 'Analogies'][substr(item, 2)::INT % 5 + 1] AS dimension,
               round(avg(score), 6) AS mean FROM cognitive GROUP BY 1)
        SELECT dimension, mean, norm::DOUBLE AS norm FROM g LEFT JOIN n USING (dimension)""",
)
def norms(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), F.substring("item", 2, 2).cast("int") % 5 + 1)
    means = t.cognitive(spark, d).groupBy(kind.alias("dimension")).agg(tidy(F.avg("score")).alias("mean"))
    return reshape.norms_joined(means, readers.norms(spark), "dimension")


@query(
    "snk1_write_table_csv",
    f"""WITH {t.ITEM_STATS} SELECT item, mean, sd FROM item_stats""",
)
def write_table_csv(spark, d):
    path = f"{shared_dir(spark)}/question-table-{uuid.uuid4().hex}"
    stats = screening.item_stats(t.scored(spark, d))
    remove_at_end(spark, path)
    writers.write_table_csv(stats, path, ["item", "mean", "sd"], [F.col("mean").desc(), "item"])
    return spark.read.schema("item string, mean double, sd double").option("header", True).csv(path)


@query(
    "prj1_to_long",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, value FROM (
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem)
       UNPIVOT INCLUDE NULLS (value FOR measure IN (l_quantity, l_discount, l_tax))""",
)
def to_long(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return reshape.to_long(readers.read_table(spark, d, "lineitem"), keys, ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@query(
    "prj2_to_wide",
    f"""WITH {t.RESPONSES} SELECT id, {", ".join(f"max(score) FILTER (WHERE item = '{i}') AS {i}" for i in t.ITEM_NAMES)}
        FROM responses GROUP BY id""",
)
def to_wide(spark, d):
    return reshape.to_wide(t.responses(spark, d), ["id"], "item", "score", t.ITEM_NAMES)


@query(
    "prj3_to_long_twice",
    f"""WITH {t.RESPONDENTS}, a AS (SELECT id, unnest(['experience', 'degree']) AS category,
        unnest([experience, degree]) AS response, role, rank FROM respondents)
        SELECT id, category, response, unnest(['role', 'rank']) AS facet, unnest([role, rank]) AS level FROM a""",
)
def to_long_twice(spark, d):
    return reshape.to_long_twice(
        t.respondents(spark, d).select("id", "experience", "degree", "role", "rank"),
        ["id"],
        ["experience", "degree"],
        ["role", "rank"],
    )


@query(
    "prj4_split_label",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word,
              nullif(regexp_extract(p_type || ' (' || p_brand || ')', '\\(([^)]*)\\)', 1), '') AS code FROM part""",
)
def split_label(spark, d):
    part = readers.read_table(spark, d, "part")
    header = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return part.select(
        "p_partkey",
        sc.label_part(F.col("p_name")).alias("first_word"),
        sc.label_part(header, "parentheses").alias("code"),
    )


@query("prj5_rename_cols", "SELECT c_custkey AS id, c_mktsegment AS work_role, c_acctbal AS balance FROM customer")
def rename_cols(spark, d):
    people = readers.read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return reshape.rename_cols(people, {"c_custkey": "id", "c_mktsegment": "work_role", "c_acctbal": "balance"})


@query(
    "prj6_select_items",
    f"WITH {t.SCORED} SELECT id, item, score FROM responses WHERE item IN (SELECT item FROM scored WHERE scale <> 'S5')",
)
def select_items(spark, d):
    key = t.key_frame(spark).where(F.col("scale") != "S5")
    return reshape.select_items(t.responses(spark, d), key).select("id", "item", "score")


@query(
    "prj7_with_level_order",
    f"""WITH {t.RESPONDENTS} SELECT id, degree, CASE degree WHEN 'High School' THEN 1 WHEN 'Associates' THEN 2
        WHEN 'Some College' THEN 3 WHEN 'Bachelors' THEN 4 END AS ordinal FROM respondents""",
)
def with_level_order(spark, d):
    levels = ["High School", "Associates", "Some College", "Bachelors"]
    return reshape.with_level_order(t.respondents(spark, d).select("id", "degree"), "degree", levels, "ordinal")


@query(
    "prj8_with_row_id",
    f"""WITH {t.RESPONDENTS} SELECT id, role, row_number() OVER (ORDER BY role, id) AS row_id FROM respondents""",
)
def with_row_id(spark, d):
    return reshape.with_row_id(t.respondents(spark, d).select("id", "role"), ["role", "id"])


@query(
    "jon1_left_on_id",
    f"""WITH {t.RESPONDENTS}, {t.RESPONSES} SELECT id, role, n_answered FROM respondents
        LEFT JOIN (SELECT id, count(*) AS n_answered FROM responses GROUP BY id) USING (id)""",
)
def left_on_id(spark, d):
    counts = t.responses(spark, d).groupBy("id").agg(F.count("score").alias("n_answered"))
    return reshape.left_on(t.respondents(spark, d).select("id", "role"), counts, ["id"])


@query(
    "jon2_left_on_item",
    f"WITH {t.ITEM_STATS} SELECT id, item, score, mean, rank FROM scored LEFT JOIN item_stats USING (item)",
)
def left_on_item(spark, d):
    scored = t.scored(spark, d)
    stats = screening.item_stats(scored).select("item", "mean", "rank")
    joined = reshape.left_on(scored, stats, ["item"], rows=len(t.ITEM_NAMES))
    return joined.select("id", "item", "score", "mean", F.col("rank").cast("long").alias("rank"))


@query(
    "jon3_keep_dictionary",
    """SELECT p_partkey, p_name, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
       RIGHT JOIN (SELECT p_partkey, p_name FROM part UNION ALL SELECT -p_partkey, p_name FROM part) ON l_partkey = p_partkey""",
)
def keep_dictionary(spark, d):
    """The dictionary also lists items nobody was given: the same parts under negative keys."""
    lines = readers.read_table(spark, d, "lineitem")
    used = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    part = readers.read_table(spark, d, "part")
    items = part.select("p_partkey", "p_name").union(part.select(-F.col("p_partkey"), "p_name"))
    return reshape.keep_dictionary(used, items, "p_partkey").select("p_partkey", "p_name", "n")


@query(
    "jon4_attach_cluster",
    f"""WITH {t.SCORED}, {t.RESPONDENTS}, c AS (SELECT id, CASE WHEN avg(score) >= 3 THEN 1 ELSE 2 END AS cluster
        FROM scored GROUP BY id) SELECT id, role, cluster FROM respondents LEFT JOIN c USING (id)""",
)
def attach_cluster(spark, d):
    labels = t.scored(spark, d).groupBy("id").agg(F.when(F.avg("score") >= 3, 1).otherwise(2).alias("cluster"))
    return reshape.attach_cluster(t.respondents(spark, d).select("id", "role"), labels)


@query(
    "jon5_union_rows",
    """SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier""",
)
def union_rows(spark, d):
    buyers = readers.read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance")
    )
    sellers = readers.read_table(spark, d, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")
    )
    return reshape.union_rows(buyers, sellers)


@query(
    "jon6_complement",
    f"""WITH u AS (SELECT vec_id, label, row_number() OVER (ORDER BY {t.uniform_sql(11, "vec_id")}, vec_id) AS r,
        count(*) OVER () AS n FROM embeddings) SELECT vec_id, label FROM u WHERE r > floor(0.7 * n)""",
)
def complement(spark, d):
    rows = readers.read_table(spark, d, "embeddings").select("vec_id", "label")
    train = sampling.split_random(rows, "vec_id", 0.7, seed=11).where("train")
    return reshape.complement(rows, train, ["vec_id"])
