"""Ranks, quantiles, row numbers and hashed draws against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.functions.draws import POISSON_CDF, poisson_one, uniform
from surveyloom.operators import groups, ranking, reshape, sampling, selection


def test_known_uniform(spark):
    value = spark.range(1).select(uniform(42, F.lit(1), F.lit(7))).first()[0]
    assert value == int(hashlib.md5(b"42-1-7").hexdigest()[:13], 16) / (1 << 52)


def test_poisson_inversion(spark):
    rows = spark.createDataFrame([(0.0,), (POISSON_CDF[0],), (POISSON_CDF[1] - 1e-9,), (POISSON_CDF[2],)], "u double")
    assert [r[0] for r in rows.select(poisson_one(F.col("u"))).collect()] == [0, 1, 1, 3]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_ranks_and_quantiles_do_not_depend_on_partitions(spark, partitions, parts):
    partitions(parts)
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(700, 3.0), rng.integers(0, 40, 900).astype(float), rng.normal(size=500)])
    frame = spark.createDataFrame([(i, "hot" if i % 3 else "cold", float(v)) for i, v in enumerate(x)], "id long, g string, x double")
    ranked = ranking.average_rank(frame, ["g"], "x").toPandas()
    want = ranked.groupby("g")["x"].rank(method="average")
    assert np.allclose(ranked["rank"], want)
    got = selection.quantiles(frame, ["g"], "x", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).toPandas().set_index("g")
    for g, part in frame.toPandas().groupby("g"):
        assert np.allclose(got.loc[g, ["q1", "q2", "q9"]].astype(float), np.quantile(part["x"], [0.25, 0.5, 0.9]))


def test_row_numbers_follow_order_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i:04d}", i) for i in range(3000)]
    numbered = reshape.with_row_id(spark.createDataFrame(rows, "k string, id long").repartition(7), ["k", "id"]).toPandas()
    want = numbered.sort_values(["k", "id"])
    assert want["row_id"].tolist() == list(range(1, 3001))


def test_tied_best_drops_both_and_top_two_keeps_both(spark):
    frame = spark.createDataFrame([("i", "f1", 0.5), ("i", "f2", -0.5), ("j", "f1", 0.9), ("j", "f2", 0.1)], "item string, f string, x double")
    assert [(r["item"], r["f"]) for r in ranking.best_per_group(frame, ["item"], F.abs("x")).collect()] == [("j", "f1")]
    assert ranking.top_k_per_group(frame, ["item"], F.abs("x"), 2).count() == 4


def test_constant_column_has_no_zscore(spark):
    frame = spark.createDataFrame([("c", 2.0), ("c", 2.0), ("v", 1.0), ("v", 3.0)], "g string, x double")
    got = sorted((r["g"], r["z"]) for r in ranking.zscore(frame, ["g"], "x").collect() if r["g"] == "v")
    assert got == [("v", pytest.approx(-0.7071, abs=1e-4)), ("v", pytest.approx(0.7071, abs=1e-4))]
    assert all(r["z"] is None for r in ranking.zscore(frame, ["g"], "x").collect() if r["g"] == "c")


def test_median_fill_by_group(spark):
    frame = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "a", 4), (4, "b", None)], "id long, g string, x int")
    got = {r["id"]: r["x"] for r in groups.impute_median(frame, "g", ["x"]).collect()}
    assert got == {1: 1.0, 2: 2.5, 3: 4.0, 4: None}


@pytest.mark.parametrize("parts", [1, 16])
def test_exact_split_sizes(spark, partitions, parts):
    partitions(parts)
    frame = spark.createDataFrame([(i, "hot" if i % 10 else "cold") for i in range(997)], "id long, g string")
    whole = sampling.split_random(frame, "id", 0.7, 3)
    assert whole.where("train").count() == 697 and whole.count() == 997
    by = {r["g"]: r["n"] for r in sampling.split_stratified(frame, "id", "g", 0.6, 3).where("train").groupBy("g").agg(F.count("id").alias("n")).collect()}
    assert by == {"hot": int(897 * 0.6), "cold": 60}


def test_histogram_of_a_constant(spark):
    frame = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [(r["bin"], r["n"]) for r in groups.histogram(frame, "x").collect()] == [(0, 2)]


def test_density_of_a_constant_group(spark):
    frame = spark.createDataFrame([("c", 2.0), ("c", 2.0), ("v", 0.0), ("v", 4.0), ("v", 1.0)], "g string, x double")
    out = groups.density(frame, "x", "g", 9)
    assert out.count() == 18 and out.where("density IS NULL").count() == 0
