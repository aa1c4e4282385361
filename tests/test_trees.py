"""Forests whose trees are grown and kept away from the driver, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from surveyloom.operators import models, trees


def gini(y, w):
    share = np.bincount(y, w, minlength=3) / w.sum()
    return 1 - (share**2).sum()


def plain_tree(codes, y, w, depth):
    """Votes per row of a tree that tries every split, and its gain per feature."""
    worth = np.zeros(codes.shape[1])

    def node(rows, left):
        n, own = w[rows].sum(), gini(y[rows], w[rows])
        best = (1e-12, None)
        for f in range(codes.shape[1]) if left else ():
            for c in range(codes[:, f].max()):
                low = codes[rows, f] <= c
                if low.any() and not low.all():
                    a, b = rows[low], rows[~low]
                    gain = own - w[a].sum() / n * gini(y[a], w[a]) - w[b].sum() / n * gini(y[b], w[b])
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, c, a, b))
        counts = np.bincount(y[rows], w[rows], minlength=3)
        if best[1] is None:
            return counts.argmax(), counts / n, {}
        f, c, a, b = best[1]
        l, r = node(a, left - 1), node(b, left - 1)
        if not l[2] and not r[2] and l[0] == r[0]:
            return counts.argmax(), counts / n, {}
        worth[f] += best[0] * n
        return None, None, {"f": f, "c": c, "l": l, "r": r}

    return node(np.flatnonzero(w), depth), worth


def plain_votes(found, row):
    while found[2]:
        found = found[2]["l" if row[found[2]["f"]] <= found[2]["c"] else "r"]
    return found[1]


@pytest.mark.parametrize("depth", [2, 30])
@pytest.mark.parametrize("cells", [2_000_000, 300])
def test_a_tree_is_the_one_of_largest_gains(monkeypatch, depth, cells):
    monkeypatch.setattr(trees, "_CELLS", cells)
    monkeypatch.setattr(trees, "_PART_ROWS", 17)
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 9, (150, 3)).astype(np.uint8)
    y = np.where(rng.random(150) < 0.3, rng.integers(0, 3, 150), codes[:, 1] // 3).astype(np.int32)
    w = rng.poisson(1.0, 150)
    feature, code, left, stats, worth = trees.grow(codes, y, w, 3, 3, depth, rng)
    want, gains = plain_tree(codes, y, w.astype(float), depth)
    leaf = trees._leaves((feature, code, left), codes, np.zeros(150, int))
    got = stats[leaf] / stats[leaf].sum(axis=1, keepdims=True)
    assert np.allclose(got, [plain_votes(want, r) for r in codes])
    assert np.allclose(np.bincount(np.maximum(feature, 0), worth, minlength=3), gains)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)).round(2)
    y = np.where(rng.random(300) < 0.2, 1, (x[:, 0] + x[:, 2] > 0)).astype(int)
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id long, v array<double>, label int"), x, y


def test_trees_stay_in_a_table_and_do_not_depend_on_the_layout(points):
    """Spark's own forest puts every node into the driver, and depends on partitions."""
    frame = points[0]
    found = []
    for parts in (1, 7):
        model = models.random_forest(frame.repartition(parts, "v"), 20, 2, 5)
        assert isinstance(model.trees, DataFrame) and model.trees.count() == 20
        found.append({r["tree"]: bytes(r["feature"] + r["code"] + r["left"] + r["votes"]) for r in model.trees.collect()})
    assert found[0] == found[1] and len(set(found[0].values())) == 20
    assert models.random_forest(frame, 3, 2, 5, depth=1).trees.select(F.max(F.length("left"))).first()[0] == 3 * 4


@pytest.mark.parametrize("block", [16_384, 20])
def test_importance_is_that_of_scored_copies(points, monkeypatch, block):
    """Paths followed once per row give what every shuffled copy scored by itself gives; ids may repeat."""
    monkeypatch.setattr(trees, "BLOCK_ROWS", block)
    frame, x, y = points
    model = models.random_forest(frame.where("id < 180"), 15, 2, 5)
    rest = frame.where("id >= 180").unionByName(frame.where("id >= 296"))
    got = {r["name"]: r for r in models.permutation_importance(model, rest, list("abcd"), 3).collect()}
    copies = models._shuffled_copies(rest, 3, "id")
    by = {r["feature"]: r["accuracy"] for r in models.accuracy(models.predict(model, copies), keys=["feature"]).collect()}
    for i, name in enumerate("abcd"):
        assert got[name]["importance"] == pytest.approx(by[-1] - by[i])
    assert max(got.values(), key=lambda r: r["importance"])["name"] in "ac" and sum(r["gini"] for r in got.values()) == pytest.approx(1.0)


def test_predicted_rows_are_whole(points):
    frame, x, y = points
    model = models.random_forest(frame, 25, 2, 5)
    out = models.predict(model, frame.withColumn("kept", F.struct("id", "label")).withColumn("id", F.when(F.col("id") > 3, F.col("id"))))
    rows = out.collect()
    assert out.columns == ["id", "v", "label", "kept", "predicted"] and len(rows) == 300
    assert sorted(r["kept"]["id"] for r in rows) == list(range(300)) and sum(r["id"] is None for r in rows) == 4
    assert np.mean([r["predicted"] == r["label"] for r in rows]) > 0.97
    assert models.predict(model, frame.where("false")).count() == 0


def test_cuts_lie_between_values(spark):
    values = [*range(500), *[900] * 500]
    frame = spark.createDataFrame([([float(a), float(a % 3), 5.0], a % 2) for a in values], "v array<double>, label int").repartition(3)
    wide, few, none = models.random_forest(frame, 1, 2, 5).cuts
    assert few.tolist() == [0.5, 1.5] and none.size == 0
    assert 14 <= wide.size <= 31 and 699.5 in wide and all(a == int(a) + 0.5 for a in wide)


def test_no_rows_or_labels_are_refused(spark):
    frame = spark.createDataFrame([([1.0], 1)], "v array<double>, label int")
    for bad in (frame.where("false"), frame.withColumn("label", F.lit(None).cast("int")), frame.withColumn("label", F.lit(-1))):
        with pytest.raises(ValueError):
            models.random_forest(bad, 2, 1, 5)
