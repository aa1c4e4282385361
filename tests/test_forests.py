"""Forests with known bags, and kappa, against plain counts."""

import hashlib
from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3))
    rows = [(i, [float(v) for v in x[i]], int(x[i, 0] + 0.2 * x[i, 1] > 0)) for i in range(240)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3).cache(), rows


@pytest.fixture(scope="module")
def forest(points):
    return models.bagged_forest(points[0], 9, 2, 5, depth=6)


def unseen(tree, ident):
    return int(hashlib.md5(f"5-bag-{tree}-{ident}".encode()).hexdigest()[:13], 16) / (1 << 52) < exp(-1)


def test_only_trees_that_did_not_see_a_row_vote(spark, points, forest):
    frame, rows = points
    from pyspark.ml.linalg import Vectors

    got = {r["id"]: r for r in models.oob_votes(forest, frame, 2).collect()}
    assert len(got) == 240
    for ident, v, label in rows[:40]:
        calls = [int(t.predict(Vectors.dense(v))) for k, t in enumerate(forest.trees) if unseen(k, ident)]
        assert got[ident]["n_votes"] == len(calls) and got[ident]["label"] == label
        assert got[ident]["predicted"] == (None if not calls else int(2 * sum(calls) > len(calls)))
    right = np.mean([r["predicted"] == r["label"] for r in got.values() if r["predicted"] is not None])
    assert right > 0.85


def test_bags_are_weights_of_the_trees(points, forest):
    """A tree's root holds as many rows, with repeats, as its bag has."""
    frame, rows = points
    bags = frame.select(models.bag_weights(9, 5, "id").alias("b")).agg(*[F.sum(F.col("b")[k]).alias(str(k)) for k in range(9)]).first()
    for k, tree in enumerate(forest.trees):
        root = tree.trees[0]._call_java("rootNode").impurityStats()
        assert root.count() == bags[k] and 180 < bags[k] < 300


def test_importance_of_the_deciding_feature(points, forest):
    got = models.oob_importance(forest, points[0], ["a", "b", "c"], 3).collect()
    by = {r["name"]: r for r in got}
    assert set(by) == set("abc") and by["a"]["relative"] == 1.0
    assert by["a"]["importance"] > 0.25 and abs(by["c"]["importance"]) < 0.1 and all(r["se"] >= 0 for r in got)


def test_folding_of_calls_changes_nothing(points, forest):
    rows = models._with_bags(forest, points[0], "v", "label")
    few, many = ({r["id"]: [tuple(c) for c in r["calls"]] for r in models._tree_hits(forest, rows, at_once=n).collect()} for n in (2, 25))
    assert few == many


def test_kappa_by_hand(spark):
    pairs = [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15
    frame = spark.createDataFrame([*pairs, (None, 1), (1, None)], "predicted int, label int")
    got = models.kappa(frame).first()
    assert (got["kappa"], got["accuracy"], got["n"]) == (pytest.approx(0.4), pytest.approx(0.7), 50)
    assert models.kappa(frame.where("predicted = 0 AND label = 0")).first()["kappa"] is None
    assert models.kappa(frame.where("false")).count() == 0
    other = spark.createDataFrame([(2, 1), (3, 1)], "predicted int, label int")
    assert models.kappa(other).first()["kappa"] == 0.0
