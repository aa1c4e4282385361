"""Tests, resampling and correlations against NumPy and printed tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.functions import tdist
from surveyloom.operators import crossproducts, inference


def test_t_distribution_against_tables():
    t = np.array([2.228, 1.96, 12.706, 0.0, 2.576])
    df = np.array([10.0, 1e7, 1.0, 5.0, 1e7])
    assert np.allclose(tdist.two_sided(t, df), [0.05, 0.05, 0.05, 1.0, 0.01], atol=2e-4)
    q = tdist.quantile(np.full(4, 0.975), np.array([1.0, 2.0, 10.0, 30.0]))
    assert np.allclose(q, [12.7062, 4.30265, 2.22814, 2.04227], atol=1e-4)
    assert np.isnan(tdist.two_sided(np.array([np.nan]), np.array([3.0])))[0]


def groups_frame(spark, n=400):
    rng = np.random.default_rng(4)
    rows = [(i, "a" if i % 5 else "b", float(rng.normal(0.3 if i % 5 else 0.0))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, x double"), rows


def test_welch_by_hand(spark):
    frame, rows = groups_frame(spark)
    a, b = (np.array([x for _, g, x in rows if g == s]) for s in "ab")
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    got = inference.welch_t(frame, "g", "x", "a", "b").first()
    assert got["t"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb))
    assert got["df"] == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))


def test_tiny_groups_are_not_tested(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0)], "g string, x double")
    assert inference.welch_t(frame, "g", "x", "a", "b").count() == 0


def test_holm_is_monotone_and_capped(spark):
    frame = spark.createDataFrame([("k", "a", 0.01), ("k", "b", 0.04), ("k", "c", 0.03), ("k", "d", 0.9)], "k string, n string, p double")
    got = {r["n"]: r["p_holm"] for r in inference.holm(frame, ["k"], "p", ["n"]).collect()}
    assert got == {"a": pytest.approx(0.04), "c": pytest.approx(0.09), "b": pytest.approx(0.09), "d": pytest.approx(0.9)}


@pytest.mark.parametrize("method", ["rows", "poisson", "buckets"])
def test_bootstrap_centres_on_the_observed_difference(spark, method):
    frame, rows = groups_frame(spark)
    a, b = (np.array([x for _, g, x in rows if g == s]) for s in "ab")
    stats = inference.bootstrap_diff(frame, "id", "g", "x", "a", "b", 400, 1, method=method).toPandas()["stat"]
    se = np.sqrt(a.var() / len(a) + b.var() / len(b))
    assert len(stats) == 400
    assert stats.mean() == pytest.approx(a.mean() - b.mean(), abs=4 * se / np.sqrt(400))
    assert stats.std() == pytest.approx(se, rel=0.15)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_permutation_matches_full_ranking(spark, partitions, parts):
    partitions(parts)
    frame, rows = groups_frame(spark, 150)
    got = inference.permute_null(frame, "id", "g", "x", "a", "b", 40, 9).toPandas().set_index("rep")["stat"]
    import hashlib

    u = lambda rep, i: int(hashlib.md5(f"9-{rep}-{i}".encode()).hexdigest()[:13], 16)
    n_a = sum(g == "a" for _, g, _ in rows)
    for rep in (1, 17, 40):
        order = sorted(rows, key=lambda r: (u(rep, r[0]), r[0]))
        x = np.array([r[2] for r in order])
        assert got[rep] == pytest.approx(x[:n_a].mean() - x[n_a:].mean())
    assert abs(got.mean()) < 0.1


def test_p_value_of_a_clear_difference(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 2)) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, g string, x double")
    got = inference.p_value(frame, "id", "g", "x", "a", "b", 50, 1).first()
    assert got["diff"] == 1.0 and got["p_value"] == 0.0 and got["side"] == "right"


def test_pairwise_correlation_with_gaps_and_constant(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 6, (300, 4)).astype(float)
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 3.0)
    cells = [(i, f"v{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(300) for j in range(4)]
    got = {(r["item_a"], r["item_b"]): r for r in crossproducts.cor_pairwise(spark.createDataFrame(cells, "id long, item string, score double"), ["v0", "v1", "v2", "v3"]).collect()}
    both = ~np.isnan(x[:, 0]) & ~np.isnan(x[:, 1])
    assert got["v0", "v1"]["n"] == both.sum()
    assert got["v0", "v1"]["r"] == pytest.approx(np.corrcoef(x[both, 0], x[both, 1])[0, 1])
    assert got["v0", "v3"]["r"] is None


def test_bucket_draws_are_n_and_of_the_right_shape():
    sizes = np.array([5, 1, 700, 30, 264])
    counts = np.array([[inference.bucket_draws(sizes, b, rep, "x") for b in range(5)] for rep in range(400)])
    assert (counts.sum(axis=1) == 1000).all()
    assert counts.mean(axis=0) == pytest.approx(sizes, abs=4)
    assert counts.var(axis=0) == pytest.approx(sizes * (1 - sizes / 1000), rel=0.3)
    assert inference.bucket_draws(np.array([7]), 0, 1) == 7


def test_bootstrap_in_buckets_does_not_depend_on_partitions(spark, partitions, monkeypatch):
    monkeypatch.setattr(inference, "BUCKET_ROWS", 30)
    frame, rows = groups_frame(spark)
    frame = frame.withColumn("trait", F.lit("t")).union(frame.withColumn("trait", F.lit("u")).where("id < 100"))
    found = []
    for parts in (2, 16):
        partitions(parts)
        stats = inference.bootstrap_diff(frame.repartition(parts), "id", "g", "x", "a", "b", 50, 1, ["trait"], method="buckets").toPandas()
        assert len(stats) == 100 and set(zip(stats["trait"], stats["n_draws"])) == {("t", 400), ("u", 100)}
        found.append(stats.sort_values(["trait", "rep"])["stat"].to_numpy())
    assert found[0] == pytest.approx(found[1])
    assert len(np.unique(found[0].round(12))) == 100
    empty = inference.bootstrap_mean(frame.where("id < 0"), "id", "x", 5, 1, method="buckets")
    assert empty.count() == 0


def test_label_draws_are_all_labels_and_hypergeometric():
    sizes = np.array([5, 1, 700, 30, 264])
    counts = np.array([[inference.bucket_draws(sizes, b, rep, "y", draws=300) for b in range(5)] for rep in range(400)])
    assert (counts.sum(axis=1) == 300).all() and (counts <= sizes).all()
    assert counts.mean(axis=0) == pytest.approx(sizes * 0.3, abs=2)
    assert counts.var(axis=0) == pytest.approx(sizes * (1 - sizes / 1000) * 0.21 * 1000 / 999, rel=0.35)


def test_permutation_in_buckets(spark, partitions, monkeypatch):
    """As many labels as there were, in the spread that shuffling has, whatever the partitions."""
    monkeypatch.setattr(inference, "BUCKET_ROWS", 30)
    frame, rows = groups_frame(spark)
    frame = frame.withColumn("trait", F.lit("t")).union(frame.withColumn("trait", F.lit("u")).where("id < 100"))
    found = []
    for parts in (2, 16):
        partitions(parts)
        null = inference.permute_null(frame.repartition(parts), "id", "g", "x", "a", "b", 300, 9, ["trait"], method="buckets").toPandas()
        assert len(null) == 600 and set(zip(null["trait"], null["n_labels"])) == {("t", 320), ("u", 80)}
        found.append(null.sort_values(["trait", "rep"])["stat"].to_numpy())
    assert found[0] == pytest.approx(found[1])
    for own, n in ((found[0][:300], 400), (found[0][300:], 100)):
        x = np.array([r[2] for r in rows[:n]])
        se = x.std(ddof=1) * np.sqrt(1 / (0.8 * n) + 1 / (0.2 * n))
        assert own.mean() == pytest.approx(0, abs=4 * se / np.sqrt(300)) and own.std() == pytest.approx(se, rel=0.15)
    p = {m: {r["trait"]: (r["diff"], r["side"], r["p_value"]) for r in inference.p_value(frame, "id", "g", "x", "a", "b", 300, 9, ["trait"], 2, method=m).collect()} for m in ("bins", "buckets")}
    for trait in "tu":
        assert p["buckets"][trait][:2] == p["bins"][trait][:2]
        assert p["buckets"][trait][2] == pytest.approx(p["bins"][trait][2], abs=0.12)


def test_permutation_in_buckets_of_few_rows(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 2)) for i in range(4)] + [(9, None, 1.0), (10, "a", None)]
    frame = spark.createDataFrame(rows, "id long, g string, x double")
    stats = inference.permute_null(frame, "id", "g", "x", "a", "b", 60, 1, method="buckets").toPandas()
    assert set(stats["stat"].round(9)) <= {-1.0, 0.0, 1.0} and set(stats["n_labels"]) == {2}
    assert inference.permute_null(frame.where("g = 'a'"), "id", "g", "x", "a", "b", 3, 1, method="buckets").where("stat IS NOT NULL").count() == 0
    assert inference.permute_null(frame.where("id < 0"), "id", "g", "x", "a", "b", 3, 1, method="buckets").count() == 0
