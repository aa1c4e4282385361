"""Components, factors, clusters, class balancing and forests by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import clusters, factors, models, neighbors, sampling


def blobs(spark, n=240, d=5, seed=7):
    rng = np.random.default_rng(seed)
    label = (np.arange(n) % 3 == 0).astype(int)
    x = rng.normal(size=(n, d)) + label[:, None] * np.array([6.0, 6.0, 0, 0, 0])[:d]
    return spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(n)], "id long, label int, v array<double>"), x, label


def test_pca_matches_the_covariance(spark):
    frame, x, _ = blobs(spark)
    model = factors.fit_pca(frame, 5)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    share = factors.pca_variance(frame, model).orderBy("component").toPandas()
    assert np.allclose(share["share"], values[::-1] / values.sum()) and share["cumulative"].iloc[-1] == pytest.approx(1.0)
    loadings = factors.pca_loadings(frame, model, list("abcde"))
    first = loadings.where("component = 1").orderBy("item").toPandas()["loading"].to_numpy()
    assert np.allclose(np.abs(first), np.abs(vectors[:, -1])) and first[np.abs(first).argmax()] > 0
    total = factors.pca_contribution(loadings).groupBy("component").agg(F.sum("contribution").alias("s")).toPandas()["s"]
    assert np.allclose(total, 100.0)
    plane = factors.pca_project(frame, model).toPandas()
    assert plane["pc1"].var() == pytest.approx(values[-1], rel=1e-6)


def survey(spark, n=500, seed=8):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=(n, 2))
    x = np.hstack([f[:, [0]] + 0.5 * rng.normal(size=(n, 3)), f[:, [1]] + 0.5 * rng.normal(size=(n, 3))])
    cells = [(i, f"q{j}", float(x[i, j])) for i in range(n) for j in range(6)]
    return spark.createDataFrame(cells, "id long, item string, score double"), x


def test_factors_recover_two_blocks(spark):
    cells, x = survey(spark)
    names = [f"q{j}" for j in range(6)]
    table = factors.factor_loadings(cells, names, 2).toPandas().pivot(index="item", columns="scale", values="loading").abs()
    home = table.idxmax(axis=1)
    assert len(set(home[:3])) == 1 and len(set(home[3:])) == 1 and home.iloc[0] != home.iloc[3]
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert (table**2).to_numpy().sum() == pytest.approx(values[:2].sum())


def test_parallel_analysis_finds_two_components(spark):
    _, x = survey(spark)
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"q{j} double" for j in range(6)))
    out = factors.parallel_analysis(wide, [f"q{j}" for j in range(6)], 10, 1).orderBy("component").toPandas()
    assert np.allclose(out["observed"], np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1])
    assert (out["observed"] > out["resampled"]).sum() == 2
    assert out["resampled"].sum() == pytest.approx(6.0)


def test_build_scales_keeps_unmatched_and_handles_ties(spark):
    loadings = spark.createDataFrame(
        [("a", "F1", 0.9), ("a", "F2", 0.1), ("b", "F1", 0.5), ("b", "F2", -0.5), ("c", "F1", 0.3), ("c", "F2", 0.2)],
        "item string, scale string, loading double",
    )
    items = spark.createDataFrame([(i, "t", i) for i in "abcd"], "item string, trait string, content string")
    best = {(r["item"], r["scale"]) for r in factors.build_scales(loadings, items, 1, 10).collect()}
    assert best == {("a", "F1"), ("c", "F1"), ("d", None)}
    capped = {(r["item"], r["scale"]) for r in factors.build_scales(loadings, items, 1, 1).collect()}
    assert capped == {("a", "F1"), ("d", None)}


def test_clusters_split_the_blobs(spark):
    frame, x, label = blobs(spark)
    for labels in (
        clusters.kmeans(frame, 2),
        clusters.bisecting_kmeans(frame, [2]).select("id", "cluster"),
        clusters.kmedoids_sampled(frame, [2]).select("id", "cluster"),
    ):
        got = frame.join(labels, "id").groupBy("label").agg(F.countDistinct("cluster").alias("n")).toPandas()
        assert (got["n"] == 1).all()
    validity = clusters.cluster_validity(frame, clusters.bisecting_kmeans(frame, [2, 3]), 5).toPandas().set_index("k")
    assert validity.loc[2, "silhouette"] > validity.loc[3, "silhouette"] > 0
    assert validity.loc[2, "connectivity"] == 0.0 and (validity["dunn"] > 0).all()
    stable = clusters.cluster_stability(frame, [2], 5).first()
    assert stable["apn"] == pytest.approx(0.0) and stable["adm"] == pytest.approx(0.0) and stable["fom"] > 0


def test_one_cluster_has_no_silhouette(spark):
    frame, _, _ = blobs(spark, 60)
    labels = frame.select(F.lit(1).alias("k"), "id", F.lit(1).alias("cluster"))
    got = clusters.cluster_validity(frame, labels, 5).first()
    assert got["silhouette"] is None and got["dunn"] is None and got["connectivity"] == 0.0


def test_smote_counts_and_segments(spark):
    frame, x, label = blobs(spark)
    out = sampling.smote(frame, "label", 1, 5, seed=2).toPandas()
    m = int(label.sum())
    assert out["kind"].value_counts().to_dict() == {"minority": m, "synthetic": m, "majority": 2 * m}
    assert set(out[out["kind"] == "majority"]["label"]) == {0}
    low, high = x[label == 1].min(axis=0), x[label == 1].max(axis=0)
    made = np.array(out[out["kind"] == "synthetic"]["v"].tolist())
    assert ((made >= low - 1e-9) & (made <= high + 1e-9)).all()


def test_rose_is_balanced_and_whole(spark):
    frame, x, label = blobs(spark, 600)
    out = sampling.rose(frame, "label", [0, 1], 5, seed=2).toPandas()
    assert len(out) == 600 and abs((out["label"] == 1).mean() - 0.5) < 0.08
    assert np.allclose(np.array(out[out["label"] == 1]["v"].tolist()).mean(axis=0), x[label == 1].mean(axis=0), atol=0.4)


def test_forest_and_importance(spark):
    frame, _, _ = blobs(spark)
    split = sampling.split_stratified(frame, "id", "label", 0.6, 1)
    model = models.random_forest(split.where("train"), 20, 2, 1)
    test = split.where("NOT train")
    assert models.accuracy(models.predict(model, test)).first()["accuracy"] > 0.95
    table = models.permutation_importance(model, test, list("abcde"), 3).toPandas().set_index("name")
    assert len(table) == 5 and table["gini"].sum() == pytest.approx(1.0)
    assert table.loc[["a", "b"], "importance"].max() == table["importance"].max()


def test_auc_by_hand(spark):
    rows = [("f", 1.0, 0), ("f", 2.0, 1), ("f", 2.0, 0), ("f", 3.0, 1)]
    got = models.auc_importance(spark.createDataFrame(rows, "feature string, value double, pos int"), "feature", "value", "pos").first()
    assert got["auc"] == pytest.approx(0.875)


def test_cv_counts_every_row_once_per_repeat(spark):
    frame, _, _ = blobs(spark, 90)
    out = neighbors.repeated_cv(frame, 5, [1, 3, 5], 5, 2, 1).toPandas()
    assert sorted(out["k"]) == [1, 3, 5] and (out["n"] == 180).all() and (out["accuracy"] > 0.9).all()
