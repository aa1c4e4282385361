"""Imputation, components, factors, scale building and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from surveyloom.functions import scores as sc
from surveyloom.functions.numeric import tidy
from surveyloom.operators import clusters, crossproducts, factors, inference, neighbors, reliability, reshape, screening
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.plans.summaries import ROLE_SCALE, role_scale_scores
from surveyloom.plans.tests import _p_sql
from surveyloom.session import cut_lineage
from surveyloom.sources.readers import read_table

DIMS = 64


def _rounded(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def vectors(spark, d):
    """(id, label, v): the embeddings as numeric features."""
    rows = read_table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def wide_responses(spark, d):
    return reshape.to_wide(t.responses(spark, d), ["id"], "item", "score", t.ITEM_NAMES)


@query(
    "mul1_knn_impute",
    f"""WITH {t.RESPONSES}, z AS (SELECT id, item, (score - avg(score) OVER w) / stddev_samp(score) OVER w AS z FROM responses WINDOW w AS (PARTITION BY item)),
        whole AS (SELECT id FROM z GROUP BY id HAVING count(*) = 24),
        q AS (SELECT * FROM z WHERE id NOT IN (SELECT id FROM whole)), d AS (SELECT id AS donor, item, z AS dz FROM z WHERE id IN (SELECT id FROM whole)),
        dist AS (SELECT q.id, donor, round(sum((z - dz) * (z - dz)), 8) AS d2 FROM q JOIN d USING (item) GROUP BY ALL),
        r AS (SELECT id, donor, row_number() OVER (PARTITION BY id ORDER BY d2, donor) AS rk FROM dist),
        fill AS (SELECT r.id, item, avg(dz) AS f FROM r JOIN d USING (donor) WHERE rk <= 5 GROUP BY ALL),
        done AS (SELECT coalesce(z.id, fill.id) AS id, item, coalesce(z, f) AS z FROM z FULL JOIN fill USING (id, item))
        SELECT id, {", ".join(f"round(max(z) FILTER (WHERE item = '{i}'), 6) + 0.0::DOUBLE AS {i}" for i in t.ITEM_NAMES)} FROM done GROUP BY id""",
)
def knn_impute(spark, d):
    return _rounded(neighbors.knn_impute(wide_responses(spark, d), t.ITEM_NAMES), *t.ITEM_NAMES)


def _pca(spark, d, k):
    rows = cut_lineage(neighbors.standardise(vectors(spark, d), DIMS))
    return rows, factors.fit_pca(rows, k)


@query("mul2_pca_variance")
def pca_variance(spark, d):
    return factors.pca_variance(*_pca(spark, d, 20))


@query("mul2_pca_loadings")
def pca_loadings(spark, d):
    return factors.pca_loadings(*_pca(spark, d, 10), [f"v{i:02d}" for i in range(DIMS)])


@query("mul2_pca_gram", "SELECT a::INT AS component_a, b::INT AS component_b, (a = b)::INT + 0.0::DOUBLE AS dot FROM range(1, 11) x(a), range(1, 11) y(b) WHERE a <= b")
def pca_gram(spark, d):
    """Loadings are orthonormal: products of every two components."""
    rows = factors.pca_loadings(*_pca(spark, d, 10), [f"v{i:02d}" for i in range(DIMS)])
    a, b = (rows.select("item", F.col("component").alias(f"component_{s}"), F.col("loading").alias(s)) for s in "ab")
    pairs = a.join(b, "item").where("component_a <= component_b").groupBy("component_a", "component_b")
    return _rounded(pairs.agg(F.sum(F.col("a") * F.col("b")).alias("dot")), "dot")


@query("mul2_pca_total", "SELECT i::INT AS component, NULL::DOUBLE AS share FROM range(0) r(i) UNION ALL SELECT 64, 1.0")
def pca_total(spark, d):
    """The shares of all components add up to the whole variance."""
    out = factors.pca_variance(*_pca(spark, d, DIMS))
    return _rounded(out.agg(F.max("component").alias("component"), F.sum("share").alias("share")), "share")


@query("mul3_contribution_totals", "SELECT i::INT AS component, 100.0::DOUBLE AS total FROM range(1, 11) r(i)")
def contribution_totals(spark, d):
    return _rounded(pca_contribution(spark, d).groupBy("component").agg(F.sum("contribution").alias("total")), "total")


@query("mul3_pca_contribution")
def pca_contribution(spark, d):
    return factors.pca_contribution(factors.pca_loadings(*_pca(spark, d, 10), [f"v{i:02d}" for i in range(DIMS)]))


@query("mul4_pca_project")
def pca_project(spark, d):
    rows, model = _pca(spark, d, 2)
    return factors.pca_project(rows, model).join(clusters.kmeans(rows), "id")


@query("mul5_factor_loadings")
def factor_loadings(spark, d):
    return factors.factor_loadings(cut_lineage(t.scored(spark, d)), t.ITEM_NAMES, 6)


@query("mul6_parallel_analysis")
def parallel_analysis(spark, d):
    return factors.parallel_analysis(wide_responses(spark, d), t.ITEM_NAMES, reps=20, seed=3)


# Loadings for the scale-building queries: correlation of each item with each scale mean.
_LOADINGS = f"""loadings AS (SELECT item, s.scale, covar_samp(a.score, s.score) / nullif(stddev_samp(a.score) * stddev_samp(s.score), 0) AS loading
    FROM scored a JOIN scale_scores s USING (id) GROUP BY ALL),
  items AS (SELECT 'I' || lpad((p_partkey % 25)::VARCHAR, 2, '0') AS item, arg_min(p_type, p_partkey) AS trait, arg_min(p_name, p_partkey) AS content
    FROM part GROUP BY 1),
  m AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY item ORDER BY abs(loading) DESC) + (count(*) OVER (PARTITION BY item, abs(loading)) - 1) / 2.0 AS rk
    FROM loadings) WHERE rk <= 2),
  built AS (SELECT item, scale, loading, trait, content FROM (SELECT *, rank() OVER (PARTITION BY scale ORDER BY abs(loading) DESC)
    + (count(*) OVER (PARTITION BY scale, abs(loading)) - 1) / 2.0 AS lr FROM m) JOIN items USING (item) WHERE lr <= 6
    UNION ALL SELECT item, NULL, NULL, trait, content FROM items WHERE item NOT IN (SELECT item FROM loadings))"""


def _items(spark, d):
    part = read_table(spark, d, "part")
    name = F.concat(F.lit("I"), F.lpad((F.col("p_partkey") % 25).cast("string"), 2, "0"))  # I24 was never asked
    return part.groupBy(name.alias("item")).agg(
        F.min_by("p_type", "p_partkey").alias("trait"), F.min_by("p_name", "p_partkey").alias("content")
    )


def _built(spark, d, scored):
    scores = screening.scale_scores(scored, t.key_frame(spark), 24, signed=False).withColumnRenamed("score", "total")
    pairs = scored.join(scores, "id")
    loadings = pairs.groupBy("item", "scale").agg(reliability.guarded_corr("score", "total").alias("loading"))
    return factors.build_scales(loadings, _items(spark, d), 2, 6)


@query(
    "mul7_build_scales",
    f"WITH {t.SCORED}, {t.SCALE_SCORES}, {_LOADINGS} SELECT item, scale, round(loading, 6) AS loading, trait, content FROM built",
)
def build_scales(spark, d):
    return _rounded(_built(spark, d, t.scored(spark, d)), "loading")


_TESTS = f"""tw AS (SELECT scale, CASE WHEN role = 'BUILDING' THEN 'a' ELSE 'b' END AS side, score FROM rs),
  mo AS (SELECT scale, count(*) FILTER (WHERE side = 'a') AS n_a, count(*) FILTER (WHERE side = 'b') AS n_b,
    avg(score) FILTER (WHERE side = 'a') - avg(score) FILTER (WHERE side = 'b') AS gap,
    var_samp(score) FILTER (WHERE side = 'a') / count(*) FILTER (WHERE side = 'a') AS va,
    var_samp(score) FILTER (WHERE side = 'b') / count(*) FILTER (WHERE side = 'b') AS vb FROM tw GROUP BY scale),
  td AS (SELECT scale, gap / sqrt(va + vb) AS t, pow(va + vb, 2) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS df FROM mo),
  tests AS (SELECT scale, {_p_sql("td.t", "td.df")} AS p FROM td)"""


def _tests(spark, d):
    collapsed = role_scale_scores(spark, d).withColumn("side", sc.collapse(F.col("role"), ["BUILDING"], "a", "b"))
    tests = inference.welch_t(collapsed, "side", "score", "a", "b", ["scale"])
    return tests.withColumn("significant", sc.yes_no(F.col("p") < 0.5))


@query(
    "mul8_scale_composition",
    f"""WITH {ROLE_SCALE}, {_LOADINGS}, {_TESTS} SELECT b.scale, trait, CASE WHEN p < 0.5 THEN 'Yes' WHEN p IS NOT NULL THEN 'No' END AS significant,
        CASE WHEN loading > 0 THEN 'positive' WHEN loading <= 0 THEN 'negative' END AS sign, count(*) AS n
        FROM built b LEFT JOIN tests t ON b.scale = t.scale GROUP BY ALL""",
)
def scale_composition(spark, d):
    return factors.scale_composition(_built(spark, d, t.scored(spark, d)), _tests(spark, d))


@query(
    "mul9_questionnaire_table",
    f"""WITH {ROLE_SCALE}, {_LOADINGS}, {_TESTS} SELECT b.scale, trait, b.item, round(loading, 2) AS loading, mean, sd, content
        FROM built b LEFT JOIN tests t ON b.scale = t.scale LEFT JOIN item_stats s ON b.item = s.item""",
)
def questionnaire_table(spark, d):
    scored = cut_lineage(t.scored(spark, d))
    table = factors.questionnaire_table(_built(spark, d, scored), _tests(spark, d), screening.item_stats(scored))
    return table.withColumn("loading", F.col("loading") + F.lit(0.0))


@query("clu1_kmeans")
def kmeans(spark, d):
    rows = cut_lineage(neighbors.standardise(vectors(spark, d), DIMS))
    labels = clusters.kmeans(rows, 2)
    return rows.select("id", "label").join(labels, "id").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


@query("clu2_bisecting_kmeans")
def bisecting_kmeans(spark, d):
    rows = cut_lineage(neighbors.standardise(vectors(spark, d), DIMS))
    return clusters.bisecting_kmeans(rows, range(2, 7)).groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("clu3_kmedoids_sampled")
def kmedoids_sampled(spark, d):
    rows = neighbors.standardise(vectors(spark, d), DIMS)
    out = clusters.kmedoids_sampled(rows, range(2, 7))
    return out.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))


@query("clu4_cluster_validity")
def cluster_validity(spark, d):
    rows = cut_lineage(neighbors.standardise(vectors(spark, d), DIMS))
    labels = [clusters.labels_of(rows, range(2, 7), m).withColumn("method", F.lit(m)) for m in clusters.METHODS]
    return clusters.cluster_validity(rows, reduce(DataFrame.unionByName, labels), DIMS, keys=["method", "k"])


@query("clu5_cluster_stability")
def cluster_stability(spark, d):
    scores = screening.scale_scores(t.responses(spark, d), t.key_frame(spark), 24)
    wide = reshape.to_wide(scores, ["id"], "scale", "score", t.SCALES)
    filled = neighbors.knn_impute(wide, t.SCALES)
    rows = cut_lineage(filled.select("id", F.array(*t.SCALES).alias("v")))
    parts = [clusters.cluster_stability(rows, range(2, 7), len(t.SCALES), method=m).withColumn("method", F.lit(m)) for m in clusters.METHODS]
    return reduce(DataFrame.unionByName, parts)


_CLUSTER = "cl AS (SELECT id, CASE WHEN avg(score) >= 3 THEN 1 ELSE 2 END AS cluster FROM scored GROUP BY id)"


def _labels(spark, d):
    return t.scored(spark, d).groupBy("id").agg(F.when(F.avg("score") >= 3, 1).otherwise(2).alias("cluster"))


@query(
    "clu6_cluster_profile",
    f"""WITH {t.SCORED}, {t.SCALE_SCORES}, {_CLUSTER}, g AS (SELECT cluster, scale, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd
        FROM scale_scores JOIN cl USING (id) GROUP BY ALL)
        SELECT cluster, scale, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se,
               round(abs(max(mean) FILTER (WHERE cluster = 1) OVER (PARTITION BY scale) - max(mean) FILTER (WHERE cluster = 2) OVER (PARTITION BY scale)), 6) AS delta FROM g""",
)
def cluster_profile(spark, d):
    scores = screening.scale_scores(t.responses(spark, d), t.key_frame(spark), 24)
    return _rounded(clusters.cluster_profile(scores, _labels(spark, d)), "mean", "sd", "se", "delta")


@query(
    "clu7_cluster_mix",
    f"""WITH {t.SCORED}, {t.RESPONDENTS}, {_CLUSTER}, u AS (SELECT cluster, unnest(['rank', 'degree', 'experience']) AS category,
        unnest([rank, degree, experience]) AS response FROM respondents JOIN cl USING (id))
        SELECT cluster, category, response, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster, category)::BIGINT AS n_tot,
               round(count(*) / sum(count(*)) OVER (PARTITION BY cluster, category)::DOUBLE, 6) AS share FROM u GROUP BY cluster, category, response""",
)
def cluster_mix(spark, d):
    out = clusters.cluster_mix(t.respondents(spark, d), _labels(spark, d), ["rank", "degree", "experience"])
    return _rounded(out, "share")
