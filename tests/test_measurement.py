"""Reliability and Rasch on small known cases."""

import numpy as np
import pytest

from surveyloom.operators import rasch, reliability


def long(spark, x, names):
    cells = [(i, names[j], None if np.isnan(v) else int(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "id long, item string, score int")


def test_alpha_on_complete_data(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 6, (200, 1))
    x = np.clip(base + rng.integers(-1, 2, (200, 4)), 1, 5).astype(float)
    y = x.copy()
    y[:, 3] = 6 - y[:, 3]
    names = ["a", "b", "c", "d"]
    rows = [("s", n, -1 if n == "d" else 1) for n in names]
    got = reliability.cronbach_alpha(long(spark, y, names), rows).first()
    want = 4 / 3 * (1 - x.var(axis=0, ddof=1).sum() / x.sum(axis=1).var(ddof=1))
    assert got["raw_alpha"] == pytest.approx(want)
    r = np.corrcoef(x.T)[np.triu_indices(4, 1)].mean()
    assert got["mean_r"] == pytest.approx(r) and got["std_alpha"] == pytest.approx(4 * r / (1 + 3 * r))
    drop = {q["item"]: q["r_drop"] for q in reliability.item_total_correlation(long(spark, y, names), rows).collect()}
    assert drop["a"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1:].sum(axis=1))[0, 1])


def test_constant_item_gives_null_not_error(spark):
    x = np.array([[3, 1.0], [3, 4], [3, 5], [3, 2]])
    rows = [("s", "a", 1), ("s", "b", 1)]
    drop = {q["item"]: q["r_drop"] for q in reliability.item_total_correlation(long(spark, x, ["a", "b"]), rows).collect()}
    assert drop == {"a": None, "b": None}


def answers(n=800, seed=6):
    rng = np.random.default_rng(seed)
    theta, beta = rng.normal(size=n), np.array([-1.5, -0.5, 0.0, 0.7, 1.3])
    x = (rng.random((n, 5)) < 1 / (1 + np.exp(beta - theta[:, None]))).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, beta


def test_difficulties_are_centred_and_recovered(spark):
    x, beta = answers(6000)
    names = [f"i{j}" for j in range(5)]
    got = {r["item"]: r["difficulty"] for r in rasch.item_difficulty(long(spark, x, names), names).collect()}
    assert sum(got.values()) == pytest.approx(0.0, abs=1e-9)
    assert np.allclose([got[n] for n in names], beta - beta.mean(), atol=0.15)


def test_theta_solves_the_likelihood_and_extremes_have_none(spark):
    x, _ = answers(200)
    x[0], x[1] = 1.0, 0.0
    names = [f"i{j}" for j in range(5)]
    cells = long(spark, x, names)
    difficulty = rasch.item_difficulty(cells, names)
    beta = {r["item"]: r["difficulty"] for r in difficulty.collect()}
    theta = {r["id"]: r for r in rasch.person_theta(cells, difficulty).collect()}
    assert theta[0]["theta"] is None and theta[1]["theta"] is None and theta[0]["se"] is None
    for i in range(2, 200):
        seen = [j for j in range(5) if not np.isnan(x[i, j])]
        raw = x[i, seen].sum()
        if 0 < raw < len(seen):
            p = [1 / (1 + np.exp(beta[names[j]] - theta[i]["theta"])) for j in seen]
            assert sum(p) == pytest.approx(raw, abs=1e-8)
            assert theta[i]["se"] == pytest.approx(1 / np.sqrt(sum(q * (1 - q) for q in p)))
    parts = rasch.residuals(cells, difficulty, rasch.person_theta(cells, difficulty), 5)
    fit = rasch.item_fit(parts).toPandas()
    assert fit["infit"].between(0.5, 1.6).all()
    share = rasch.misfit_share(rasch.person_fit(parts)).first()
    assert 0 <= share["misfit_share"] <= 0.3
