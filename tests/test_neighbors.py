"""Exact neighbours against brute force, with many small groups and a hot place."""

import numpy as np
import pytest

from surveyloom.operators import neighbors as nb


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("GROUP_ROWS", 150), ("QUERY_ROWS", 40), ("PIVOT_ROWS", 60)):
        monkeypatch.setattr(nb, name, value)


@pytest.mark.parametrize("by, d", [([], 4), (["g"], 4), ([], 64)])
def test_nearest_is_exact(spark, small_blocks, by, d):
    rng = np.random.default_rng(1)
    n, k = 900, 6
    x = rng.normal(size=(n, d)).round(1)
    x[: n // 3] = x[0]
    q = rng.normal(size=(120, d)).round(1)
    q[:40] = x[0]
    q[rng.random(q.shape) < 0.2] = np.nan
    donors = spark.createDataFrame([(i, x[i].tolist(), i % 2) for i in range(n)], "id long, v array<double>, g int")
    ask = spark.createDataFrame([(i, [None if np.isnan(a) else float(a) for a in q[i]], i % 2) for i in range(120)], "id long, v array<double>, g int")
    got = nb.nearest(ask, donors, k, d, by=by).toPandas()
    assert len(got) == 120 * k
    for i in range(120):
        d2 = np.round(np.nansum((x - q[i]) ** 2, axis=1), 8)
        ids = np.arange(n)
        if by:
            d2, ids = d2[ids % 2 == i % 2], ids[ids % 2 == i % 2]
        want = ids[np.lexsort((ids, d2))][:k].tolist()
        assert got[got["id"] == i].sort_values("rank")["donor"].tolist() == want


def test_many_keys_are_one_ball_each(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(nb, "MAX_BALLS", 2)
    rows = spark.createDataFrame([(i, [float(i % 50)], i % 3) for i in range(900)], "id long, v array<double>, g int")
    got = nb.nearest(rows, rows, 4, 1, by=["g"], keep_self=False).toPandas()
    for i in (0, 1, 2, 500, 899):
        want = sorted((abs(i % 50 - j % 50) ** 2, j) for j in range(900) if j % 3 == i % 3 and j != i)[:4]
        assert got[got["id"] == i].sort_values("rank")["donor"].tolist() == [j for _, j in want]


def test_clustered_queries_visit_few_blocks(spark, small_blocks):
    """Forty clusters far apart: a query meets its own ball's blocks and hardly another."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8)) + rng.integers(0, 40, 4000)[:, None] * 100.0
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(4000)], "id long, v array<double>")
    donors = rows.withColumnRenamed("v", "_v")
    balls = nb.Balls(donors, [], "id", 8)
    blocks = sum(n for _, n, _ in balls.table[()])
    assert blocks >= 60
    assert balls.visits(donors, None).count() == 4000
    hits = nb.nearest(rows, rows, 5, 8)
    far = {r["id"]: r["d2"] ** 0.5 for r in hits.where("rank = 5").collect()}
    bound = spark.createDataFrame([(i, far[i]) for i in far], "id long, kth double")
    visits = balls.visits(donors.join(bound, "id"), nb.F.col("kth")).count()
    assert visits < 4000 * 6 < 4000 * blocks / 10


def test_self_is_left_out_and_few_donors_are_enough(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id long, v array<double>")
    got = {(r["id"], r["rank"]): r["donor"] for r in nb.nearest(rows, rows, 5, 1, keep_self=False).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}


def test_impute_keeps_observed_and_fills_all_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    rows = [(i, *[None if (i < 20 and j == i % 3) else float(v) for j, v in enumerate(x[i])]) for i in range(60)]
    out = nb.knn_impute(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"]).toPandas()
    assert len(out) == 60 and not out.isna().any().any()
    observed = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    z = (observed - np.nanmean(observed, axis=0)) / np.nanstd(observed, axis=0, ddof=1)
    got = out.sort_values("id")[["a", "b", "c"]].to_numpy()
    assert np.allclose(got[~np.isnan(z)], z[~np.isnan(z)])


def test_repeated_cv_matches_fold_by_fold(spark):
    from surveyloom.functions.draws import uniform
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(90, 3)), rng.integers(0, 3, 90)
    x[y == 1] += 1.5
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(90)], "id long, label int, v array<double>")
    own = {r["id"]: r["own"] for r in rows.select("id", F.floor(uniform(3, F.lit(1), "id") * 4).alias("own")).collect()}
    fold = np.array([own[i] for i in range(90)])
    right = 0
    for i in range(90):
        others = np.flatnonzero(fold != fold[i])
        mean, sd = x[others].mean(axis=0), x[others].std(axis=0, ddof=1)
        d2 = np.round((((x[others] - x[i]) / sd) ** 2).sum(axis=1), 8)
        near = others[np.lexsort((others, d2))][:5]
        right += np.bincount(y[near], minlength=3).argmax() == y[i]
    got = nb.repeated_cv(rows, 3, [5], folds=4, repeats=1, seed=3).first()
    assert got["n"] == 90 and got["accuracy"] == pytest.approx(right / 90)


@pytest.mark.parametrize("groups", [(8192, 2048, 4096), (30, 16, 20)])
def test_repeated_cv_over_all_rows_in_any_blocks(spark, monkeypatch, groups):
    """Whatever the blocks: every row votes among all rows of the other folds, in their scale."""
    from surveyloom.functions.draws import uniform
    from pyspark.sql import functions as F

    for name, value in zip(("GROUP_ROWS", "QUERY_ROWS", "PIVOT_ROWS"), groups):
        monkeypatch.setattr(nb, name, value)
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(240, 3)) * [1, 50, 0.01], rng.integers(0, 3, 240)
    x[:, 0] += 6 * (np.arange(240) % 4)
    x[:80] = x[0]
    rows = spark.createDataFrame([(i, "abc"[y[i]], x[i].tolist()) for i in range(240)], "id long, label string, v array<double>")
    fold = np.array([r["own"] for r in rows.orderBy("id").select(F.array(*[F.floor(uniform(3, F.lit(r), "id") * 4) for r in (1, 2)]).alias("own")).collect()])
    right = {1: 0, 5: 0, 9: 0}
    for r in range(2):
        for i in range(240):
            others = np.flatnonzero(fold[:, r] != fold[i, r])
            d2 = np.round((((x[others] - x[i]) / x[others].std(axis=0, ddof=1)) ** 2).sum(axis=1), 8)
            near = others[np.lexsort((others, d2))]
            for k in right:
                right[k] += np.bincount(y[near[:k]], minlength=3).argmax() == y[i]
    got = {r["k"]: (r["accuracy"], r["n"]) for r in nb.repeated_cv(rows, 3, [9, 1, 5], folds=4, repeats=2, seed=3).collect()}
    assert got == {k: (pytest.approx(v / 480), 480) for k, v in right.items()}


@pytest.mark.parametrize("kind", ["int", "text"])
def test_the_best_are_kept_in_order_of_distance_and_donor(kind):
    """However they come and are settled: NULL donors first, equal ones by id."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    best = nb.Best(np.full(40, np.inf), 5, "id")
    row, d2 = rng.integers(0, 40, 3000), rng.integers(0, 6, 3000).astype(float)
    ids = [None if i % 97 == 0 else int(i) for i in rng.permutation(3000)]
    donors = pa.table({"id": pa.array(ids if kind == "int" else [None if i is None else f"{i:05d}" for i in ids])})
    for s in range(0, 3000, 250):
        best.add(row[s : s + 250], d2[s : s + 250], donors.slice(s, 250), np.arange(250))
        if s % 500:
            best.settle()
    got_row, place, got, kept = best.settle()
    kept = [i if i is None else int(i) for i in kept["id"].to_pylist()]
    for r in range(40):
        want = sorted((d2[i], ids[i] is not None, ids[i] or 0) for i in np.flatnonzero(row == r))[:5]
        mine = got_row == r
        assert [(a, b is not None, b or 0) for a, b in zip(got[mine], np.array(kept, object)[mine])] == want
        assert place[mine].tolist() == [0, 1, 2, 3, 4] and best.kth[r] == want[-1][0]


@pytest.mark.parametrize("rows", [7, 32_768])
def test_sweep_copies_donors_by_groups_of_queries(spark, small_blocks, monkeypatch, rows):
    """Every ball is near every query: no query is copied, a donor at most once for a group; ids may come twice."""
    monkeypatch.setattr(nb, "SWEEP_ROWS", rows)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 12)).round(1)
    x[-9:] = x[:9]
    ids = [*range(691), *range(9)]
    frame = spark.createDataFrame([(ids[i], x[i].tolist()) for i in range(700)], "id long, v array<double>")
    met = []
    monkeypatch.setattr(nb, "attach_measured", lambda *a, f=nb.attach_measured: met.append(f(*a)) or met[-1])
    got = nb.nearest(frame, frame, 4, 12, keep_self=False).toPandas()
    assert met[0].groupBy("_group", "_g", "_sub").count().where("count > 1").count() == 0
    for i in (0, 5, 8, 100, 690):
        own = [j for j in range(700) if ids[j] == i]
        want = sorted((round(((x[j] - x[o]) ** 2).sum(), 8), ids[j]) for o in own for j in range(700) if ids[j] != i)[:4]
        mine = got[got["id"] == i].sort_values("rank")
        assert mine["donor"].tolist() == [j for _, j in want] and np.allclose(mine["d2"], [d for d, _ in want])
