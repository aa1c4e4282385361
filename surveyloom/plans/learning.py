"""Splits, class balancing and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions.draws import POISSON_CDF
from surveyloom.functions.numeric import tidy
from surveyloom.operators import models, neighbors, sampling
from surveyloom.plans import tables as t
from surveyloom.plans.multivariate import DIMS, vectors
from surveyloom.plans.registry import query
from surveyloom.session import cut_lineage

KS = list(range(5, 44, 2))


def _rounded(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def _binary(spark, d):
    """Label 0 against the rest: an unbalanced two-class set."""
    return vectors(spark, d).withColumn("label", (F.col("label") != 0).cast("int"))


_EMB = """emb AS (SELECT vec_id AS id, label, embedding FROM embeddings),
  long AS (SELECT id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM emb)"""
_SPLIT = f"""{_EMB}, u AS (SELECT id, label, row_number() OVER (ORDER BY {t.uniform_sql(11, "id")}, id) <= floor(0.7 * count(*) OVER ()) AS train FROM emb)"""


@query("smp1_split_random", f"WITH {_SPLIT} SELECT id, label, train FROM u")
def split_random(spark, d):
    return sampling.split_random(vectors(spark, d).select("id", "label"), "id", 0.7, 11)


@query(
    "smp2_split_stratified",
    f"""WITH {_EMB} SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {t.uniform_sql(12, "id")}, id)
        <= floor(0.6 * count(*) OVER (PARTITION BY label)) AS train FROM emb""",
)
def split_stratified(spark, d):
    return sampling.split_stratified(vectors(spark, d).select("id", "label"), "id", "label", 0.6, 12)


@query(
    "smp3_smote",
    f"""WITH {_EMB}, mi AS (SELECT id, embedding FROM emb WHERE label = 0), rg AS (SELECT i, max(v) - min(v) AS w FROM long WHERE label = 0 GROUP BY i),
        s AS (SELECT id, list(CASE WHEN w > 0 THEN v / w ELSE 0 END ORDER BY i) AS s FROM long JOIN rg USING (i) WHERE label = 0 GROUP BY id),
        nn AS (SELECT a.id, b.id AS donor, row_number() OVER (PARTITION BY a.id ORDER BY round(pow(list_distance(a.s, b.s), 2), 8), b.id) AS rk
               FROM s a JOIN s b ON a.id <> b.id),
        pick AS (SELECT id, donor FROM nn WHERE rk = floor({t.uniform_sql(5, "'near'", "1", "id")} * (SELECT least(5, count(*) - 1) FROM mi)) + 1),
        syn AS (SELECT p.id, x.i, x.v + {t.uniform_sql(5, "'gap'", "1", "p.id")} * (y.v - x.v) AS v FROM pick p JOIN long x ON x.id = p.id JOIN long y ON y.id = p.donor AND y.i = x.i),
        pool AS (SELECT id, row_number() OVER (ORDER BY {t.uniform_sql(5, "'pool'", "id")}, id) - 1 AS idx FROM emb WHERE label <> 0),
        draws AS (SELECT draw, floor({t.uniform_sql(5, "'draw'", "draw")} * (SELECT count(*) FROM pool))::BIGINT AS idx
                  FROM (SELECT unnest(range(1, 2 * (SELECT count(*) FROM mi) + 1)) AS draw))
        SELECT 'minority' AS kind, id, 0::BIGINT AS draw, 0 AS label, i, round(v, 6) + 0.0::DOUBLE AS value FROM long WHERE label = 0
        UNION ALL SELECT 'synthetic', id, 1, 0, i, round(v, 6) + 0.0::DOUBLE FROM syn
        UNION ALL SELECT 'majority', id, draw, 1, i, round(v, 6) + 0.0::DOUBLE FROM draws JOIN pool USING (idx) JOIN long USING (id)""",
)
def smote(spark, d):
    out = sampling.smote(_binary(spark, d), "label", 0, DIMS, seed=5)
    out = out.select("kind", "id", "draw", "label", F.posexplode("v").alias("i", "value"))
    return _rounded(out, "value")


@query(
    "smp4_rose",
    f"""WITH {_EMB}, b AS (SELECT id, i, (label <> 0)::INT AS label, v FROM long), sp AS (SELECT label, i, stddev_samp(v)
          * pow(4.0::DOUBLE / (66 * count(*)), 1 / 68.0::DOUBLE) AS h FROM b GROUP BY ALL),
        pool AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {t.uniform_sql(123, "'pool'", "id")}, id) - 1 AS idx,
          count(*) OVER (PARTITION BY label) AS size FROM (SELECT DISTINCT id, label FROM b)),
        draws AS (SELECT draw, floor({t.uniform_sql(123, "'class'", "draw")} * 2)::INT AS label, {t.uniform_sql(123, "'draw'", "draw")} AS w
          FROM (SELECT unnest(range(1, (SELECT count(*) FROM emb) + 1)) AS draw)),
        hit AS (SELECT draw, id, d.label FROM draws d JOIN pool p ON d.label = p.label AND floor(w * size)::BIGINT = idx)
        SELECT draw, hit.id, hit.label, b.i, round(v + h * sqrt(-2 * ln(1 - {t.uniform_sql(123, "'a'", "draw", "b.i")}))
          * cos(6.283185307179586::DOUBLE * {t.uniform_sql(123, "'b'", "draw", "b.i")}), 6) + 0.0::DOUBLE AS value
        FROM hit JOIN b ON b.id = hit.id JOIN sp ON sp.label = hit.label AND sp.i = b.i""",
)
def rose(spark, d):
    out = sampling.rose(_binary(spark, d), "label", [0, 1], DIMS, seed=123)
    out = out.select("draw", "id", "label", F.posexplode("v").alias("i", "value"))
    return _rounded(out, "value")


@query(
    "mlc1_model_frame",
    f"""WITH {t.RESPONDENTS}, c AS (SELECT id, role, CASE WHEN prior = 'Yes' THEN 1 WHEN prior IS NOT NULL THEN 0 END AS prior,
        CASE WHEN gaming = 'Yes' THEN 1 WHEN gaming IS NOT NULL THEN 0 END AS gaming, CASE WHEN scripts = 'Yes' THEN 1 WHEN scripts IS NOT NULL THEN 0 END AS scripts,
        CASE WHEN degree = 'Masters' THEN 3 WHEN degree = 'Bachelors' THEN 2 WHEN degree IN ('Associates', 'Some College') THEN 1 ELSE 0 END AS degree
        FROM respondents WHERE role IN ('BUILDING', 'MACHINERY')), x AS (SELECT *, gaming + scripts AS total FROM c)
        SELECT id, role, {", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY role))::DOUBLE AS {c}" for c in ("prior", "gaming", "scripts", "degree", "total"))} FROM x""",
)
def model_frame(spark, d):
    codes = {"High School": 0, "Associates": 1, "Some College": 1, "Bachelors": 2, "Masters": 3}
    return models.model_frame(
        t.respondents(spark, d), "role", ["BUILDING", "MACHINERY"], ["prior", "gaming", "scripts"], {"degree": codes}, ["gaming", "scripts"], "total"
    )


def _forest(spark, d):
    rows = cut_lineage(sampling.split_stratified(_binary(spark, d), "id", "label", 0.7, 11))
    train, test = rows.where("train"), rows.where("NOT train")
    balanced = cut_lineage(sampling.smote(train, "label", 0, DIMS, seed=5))
    return balanced, test, models.random_forest(balanced, trees=500, mtry=12, seed=102)


@query("mlc2_random_forest")
def random_forest(spark, d):
    _, test, model = _forest(spark, d)
    return models.predict(model, test).select("id", "label", "predicted")


@query("mlc3_confusion")
def confusion(spark, d):
    balanced, test, model = _forest(spark, d)
    part = lambda rows, name: models.confusion(models.predict(model, rows)).withColumn("part", F.lit(name))
    return part(balanced, "train").unionByName(part(test, "test"))


@query(
    "mlc3_confusion_totals",
    f"""WITH {_EMB}, s AS (SELECT (label <> 0)::INT AS label, id FROM emb), u AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {t.uniform_sql(11, "id")}, id)
        <= floor(0.7 * count(*) OVER (PARTITION BY label)) AS train FROM s), m AS (SELECT count(*) AS n FROM u WHERE train AND label = 0)
        SELECT 'test' AS part, label, count(*)::BIGINT AS n FROM u WHERE NOT train GROUP BY label UNION ALL SELECT 'train', 0, 2 * n FROM m UNION ALL SELECT 'train', 1, 2 * n FROM m""",
)
def confusion_totals(spark, d):
    """Rows per true label in the confusion tables: the held-out ones, and the balanced ones trained on."""
    return confusion(spark, d).groupBy("part", "label").agg(F.sum("n").alias("n"))


@query("mlc3_accuracy")
def accuracy(spark, d):
    balanced, test, model = _forest(spark, d)
    part = lambda rows, name: models.accuracy(models.predict(model, rows)).withColumn("part", F.lit(name))
    return part(balanced, "train").unionByName(part(test, "test"))


@query("mlc4_permutation_importance")
def permutation_importance(spark, d):
    _, test, model = _forest(spark, d)
    return models.permutation_importance(model, test, [f"v{i:02d}" for i in range(DIMS)], seed=9)


OOB_TREES = 24


def _oob_forest(spark, d):
    rows = cut_lineage(_binary(spark, d))
    return rows, models.bagged_forest(rows, OOB_TREES, mtry=12, seed=102, depth=12)


# Bags are hashed Poisson counts, so SQL knows which trees did not see a row.
_BAGS = f"""WITH {_EMB}, s AS (SELECT (label <> 0)::INT AS label, id FROM emb), b AS (SELECT id, label, tree,
        {t.uniform_sql(102, "'bag'", "tree", "id")} < {POISSON_CDF[0]!r}::DOUBLE AS unseen FROM s, range({OOB_TREES}) r(tree))"""


@query("mlc2_oob_votes", f"{_BAGS} SELECT id, label, count(*) FILTER (WHERE unseen)::INT AS n_votes, count(*) FILTER (WHERE unseen) > 0 AS called FROM b GROUP BY id, label")
def oob_votes(spark, d):
    rows, forest = _oob_forest(spark, d)
    return models.oob_votes(forest, rows, 2).select("id", "label", "n_votes", F.col("predicted").isNotNull().alias("called"))


@query("mlc3_oob_error")
def oob_error(spark, d):
    rows, forest = _oob_forest(spark, d)
    called = models.oob_votes(forest, rows, 2).where("predicted IS NOT NULL")
    return models.kappa(cut_lineage(called)).withColumn("error", 1 - F.col("accuracy"))


@query("mlc4_oob_importance")
def oob_importance(spark, d):
    rows, forest = _oob_forest(spark, d)
    return models.oob_importance(forest, rows, [f"v{i:02d}" for i in range(DIMS)], seed=9)


@query(
    "mlc5_knn_classify",
    f"""WITH {_SPLIT}, mom AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM long JOIN u USING (id) WHERE train GROUP BY i),
        z AS (SELECT id, list((v - m) / s ORDER BY i) AS z FROM long JOIN mom USING (i) GROUP BY id), zz AS (SELECT id, label, train, z FROM z JOIN u USING (id)),
        nn AS (SELECT a.id, a.label, b.label AS vote, row_number() OVER (PARTITION BY a.id ORDER BY round(pow(list_distance(a.z, b.z), 2), 8), b.id) AS rk
               FROM zz a, zz b WHERE NOT a.train AND b.train),
        v AS (SELECT id, label, vote, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, vote) AS place FROM nn WHERE rk <= 5 GROUP BY id, label, vote)
        SELECT id, label, vote AS predicted FROM v WHERE place = 1""",
)
def knn_classify(spark, d):
    rows = cut_lineage(sampling.split_random(vectors(spark, d), "id", 0.7, 11))
    return neighbors.knn_classify(rows.where("train").drop("train"), rows.where("NOT train").drop("train"), 5, DIMS)


_TUNED = f"""{_SPLIT}, mom AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM long JOIN u USING (id) WHERE train GROUP BY i),
        z AS (SELECT id, list((v - m) / s ORDER BY i) AS z FROM long JOIN mom USING (i) GROUP BY id), zz AS (SELECT id, label, train, z FROM z JOIN u USING (id)),
        f AS (SELECT id, label, repeat, floor({t.uniform_sql(400, "repeat", "id")} * 10)::INT AS own FROM u, range(1, 4) r(repeat) WHERE train),
        cm AS (SELECT repeat, fold, i, avg(v) AS m, stddev_samp(v) AS s FROM f JOIN long USING (id), range(10) g(fold) WHERE own <> fold GROUP BY ALL),
        cz AS (SELECT f.id, f.label, f.repeat, fold, own, list((v - m) / s ORDER BY i) AS z FROM f JOIN long USING (id) JOIN cm USING (repeat, i) GROUP BY ALL),
        cn AS (SELECT a.repeat, a.id, a.label, b.label AS vote, row_number() OVER (PARTITION BY a.repeat, a.id ORDER BY round(pow(list_distance(a.z, b.z), 2), 8), b.id) AS rk
               FROM cz a JOIN cz b ON a.repeat = b.repeat AND a.fold = b.fold AND a.own = a.fold AND b.own <> b.fold),
        cv AS (SELECT k, repeat, id, label, vote, row_number() OVER (PARTITION BY k, repeat, id ORDER BY count(*) DESC, vote) AS place
              FROM cn, range(5, 44, 2) q(k) WHERE rk <= k GROUP BY k, repeat, id, label, vote),
        best AS (SELECT k FROM (SELECT k, avg((vote = label)::INT) AS accuracy FROM cv WHERE place = 1 GROUP BY k) ORDER BY round(accuracy, 9) DESC, k DESC LIMIT 1),
        nn AS (SELECT a.id, a.label, b.label AS vote, row_number() OVER (PARTITION BY a.id ORDER BY round(pow(list_distance(a.z, b.z), 2), 8), b.id) AS rk
               FROM zz a, zz b WHERE NOT a.train AND b.train),
        v AS (SELECT id, label, vote, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, vote) AS place FROM nn, best WHERE rk <= k GROUP BY id, label, vote),
        t AS (SELECT id, label, vote AS predicted FROM v WHERE place = 1)"""


def _tuned(spark, d):
    rows = cut_lineage(sampling.split_random(vectors(spark, d), "id", 0.7, 11))
    train, test = rows.where("train").drop("train"), rows.where("NOT train").drop("train")
    return neighbors.tuned_knn(train, test, DIMS, KS, folds=10, repeats=3, seed=400)


@query("mlc5_tuned_knn", f"WITH {_TUNED} SELECT id, label, predicted, (SELECT k FROM best)::INT AS k FROM t")
def tuned_knn(spark, d):
    k, out = _tuned(spark, d)
    return out.withColumn("k", F.lit(k))


@query("mlc5_tuned_confusion", f"WITH {_TUNED} SELECT predicted, label, count(*) AS n FROM t GROUP BY ALL")
def tuned_confusion(spark, d):
    return models.confusion(_tuned(spark, d)[1])


@query("mlc5_tuned_accuracy", f"WITH {_TUNED} SELECT round(avg((predicted = label)::INT), 6) AS accuracy, count(*) AS n FROM t")
def tuned_accuracy(spark, d):
    return _rounded(models.accuracy(_tuned(spark, d)[1]), "accuracy")


@query(
    "mlc5_tuned_kappa",
    f"""WITH {_TUNED}, c AS (SELECT label AS c, count(*) AS n FROM t GROUP BY 1), p AS (SELECT predicted AS c, count(*) AS n FROM t GROUP BY 1),
        o AS (SELECT avg((predicted = label)::INT) AS seen, count(*) AS n FROM t), e AS (SELECT coalesce(sum(c.n * p.n), 0)::DOUBLE AS chance FROM c JOIN p USING (c))
        SELECT round((seen - chance / n / n) / (1 - chance / n / n), 6) AS kappa, round(seen, 6) AS accuracy, n FROM o, e""",
)
def tuned_kappa(spark, d):
    return _rounded(models.kappa(cut_lineage(_tuned(spark, d)[1])), "kappa", "accuracy")


@query(
    "mlc6_repeated_cv",
    f"""WITH {_EMB}, f AS (SELECT id, label, repeat, floor({t.uniform_sql(400, "repeat", "id")} * 10)::INT AS own FROM emb, range(1, 4) r(repeat)),
        mom AS (SELECT repeat, fold, i, avg(v) AS m, stddev_samp(v) AS s FROM f JOIN long USING (id), range(10) g(fold) WHERE own <> fold GROUP BY ALL),
        z AS (SELECT f.id, f.label, f.repeat, fold, own, list((v - m) / s ORDER BY i) AS z FROM f JOIN long USING (id) JOIN mom USING (repeat, i) GROUP BY ALL),
        nn AS (SELECT a.repeat, a.id, a.label, b.label AS vote, row_number() OVER (PARTITION BY a.repeat, a.id ORDER BY round(pow(list_distance(a.z, b.z), 2), 8), b.id) AS rk
               FROM z a JOIN z b ON a.repeat = b.repeat AND a.fold = b.fold AND a.own = a.fold AND b.own <> b.fold),
        v AS (SELECT k, repeat, id, label, vote, row_number() OVER (PARTITION BY k, repeat, id ORDER BY count(*) DESC, vote) AS place
              FROM nn, range(5, 44, 2) q(k) WHERE rk <= k GROUP BY k, repeat, id, label, vote)
        SELECT k::INT AS k, round(avg((vote = label)::INT), 6) AS accuracy, count(*) AS n FROM v WHERE place = 1 GROUP BY k""",
)
def repeated_cv(spark, d):
    return _rounded(neighbors.repeated_cv(vectors(spark, d), DIMS, KS, folds=10, repeats=3, seed=400), "accuracy")


@query(
    "mlc7_auc_importance",
    f"""WITH {_EMB}, r AS (SELECT i, (label = 0)::INT AS pos, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0::DOUBLE AS rk FROM long),
        s AS (SELECT i AS feature, sum(pos)::BIGINT AS n1, (count(*) - sum(pos))::BIGINT AS n0, sum(rk) FILTER (WHERE pos = 1) AS ranks FROM r GROUP BY i),
        a AS (SELECT feature, n1, n0, (ranks - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS auc FROM s)
        SELECT feature, n1, n0, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS importance FROM a""",
)
def auc_importance(spark, d):
    long = vectors(spark, d).select((F.col("label") == 0).cast("int").alias("pos"), F.posexplode("v").alias("feature", "value"))
    return _rounded(models.auc_importance(long, "feature", "value", "pos"), "auc", "importance")
