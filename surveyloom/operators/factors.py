"""Components, factor loadings and building scales from them."""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from surveyloom.functions.scores import sign_label, signed_score
from surveyloom.operators.crossproducts import cor_pairwise
from surveyloom.operators.ranking import average_rank_grouped
from surveyloom.session import attach, cut_lineage

MAX_ITEMS = 1000  # an items-by-items matrix of this size fits anywhere


def fit_pca(rows: DataFrame, k: int, vector: str = "v") -> PCAModel:
    """Principal components of complete (already standardised) vectors."""
    return PCA(k=k, inputCol="_features", outputCol="_scores").fit(rows.select(array_to_vector(vector).alias("_features")))


def pca_loadings(rows: DataFrame, model: PCAModel, names: Sequence[str]) -> DataFrame:
    """(item, component, loading), each component's largest entry made positive."""
    pc = model.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    table = [(names[i], j + 1, float(pc[i, j] * signs[j])) for i in range(pc.shape[0]) for j in range(pc.shape[1])]
    return rows.sparkSession.createDataFrame(table, "item string, component int, loading double")


def pca_variance(rows: DataFrame, model: PCAModel) -> DataFrame:
    """Share of variance per component and its running sum (scree data)."""
    share = model.explainedVariance.toArray()
    table = [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(share, np.cumsum(share)))]
    return rows.sparkSession.createDataFrame(table, "component int, share double, cumulative double")


def pca_contribution(loadings: DataFrame) -> DataFrame:
    """Percent of each component due to each variable."""
    square = F.col("loading") * F.col("loading")
    whole = Window.partitionBy("component")
    return loadings.select("item", "component", (100 * square / F.sum(square).over(whole)).alias("contribution"))


def pca_project(rows: DataFrame, model: PCAModel, ident: str = "id", vector: str = "v") -> DataFrame:
    """First two coordinates, signed as the loadings are."""
    pc = model.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    scores = vector_to_array("_scores")
    projected = model.transform(rows.withColumn("_features", array_to_vector(vector)))
    return projected.select(ident, *[(scores[j] * F.lit(float(signs[j]))).alias(f"pc{j + 1}") for j in range(2)])


def _varimax(loadings: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Kaiser-normalised varimax rotation."""
    size = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    a = loadings / np.where(size > 0, size, 1.0)
    rotation, last = np.eye(a.shape[1]), 0.0
    for _ in range(rounds):
        b = a @ rotation
        u, s, vt = np.linalg.svd(a.T @ (b**3 - b * (b**2).mean(axis=0)))
        rotation = u @ vt
        if s.sum() - last < tol * s.sum():
            break
        last = s.sum()
    return (a @ rotation) * size


def correlation_matrix(cor: DataFrame, items: Sequence[str], max_items: int = MAX_ITEMS) -> np.ndarray:
    """The items-by-items matrix on the driver; more than ``max_items`` items are refused."""
    if len(items) > max_items:
        raise ValueError(f"{len(items)} items exceed {max_items}")
    place = {name: i for i, name in enumerate(items)}
    out = np.eye(len(items))
    for row in cor.where(F.col("r").isNotNull()).select("item_a", "item_b", "r").collect():
        i, j = place[row["item_a"]], place[row["item_b"]]
        out[i, j] = out[j, i] = row["r"]
    return out


def factor_loadings(responses: DataFrame, items: Sequence[str], m: int, value: str = "score", max_items: int = MAX_ITEMS) -> DataFrame:
    """Varimax-rotated principal factors of the pair-complete correlations.

    The correlations are a Spark job over all answers; only the rotation of
    the items-by-items matrix is done on the driver.  Factors are ordered by
    their variance and signed so their largest loading is positive.
    """
    items = sorted(items)
    matrix = correlation_matrix(cor_pairwise(responses, items, value), items, max_items)
    values, vectors = np.linalg.eigh(matrix)
    top = np.argsort(-values)[:m]
    loadings = vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))
    if m > 1:
        loadings = _varimax(loadings)
    loadings = loadings[:, np.argsort(-(loadings**2).sum(axis=0))]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(m)])
    table = [(items[i], f"Scale_{j + 1}", float(loadings[i, j])) for i in range(len(items)) for j in range(m)]
    return responses.sparkSession.createDataFrame(table, "item string, scale string, loading double")


def _hashed_uniforms(seed: int, rep: int, column: int, keys: np.ndarray) -> np.ndarray:
    """Uniforms with 53 bits from 64-bit row keys, one stream per replicate and column."""
    with np.errstate(over="ignore"):
        start = (seed * 0x9E3779B97F4A7C15 + rep * 0xC2B2AE3D27D4EB4F + column * 0x165667B19E3779F9) % (1 << 64)
        z = keys ^ np.uint64(start)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def parallel_analysis(wide: DataFrame, items: Sequence[str], reps: int, seed: int, ident: str = "id", most_values: int = 10_000) -> DataFrame:
    """(component, observed, resampled): eigenvalues against data whose columns are resampled apart.

    In a replicate every answer is drawn anew from its column's distribution, by a hash of
    replicate, column and respondent; gaps stay where they are.  That breaks all associations and
    keeps each column's values.  Tasks read their rows once and send back cross-products only.
    Answers are categories: a column with over ``most_values`` different ones is refused.
    """
    items = list(items)
    p = len(items)
    wide = cut_lineage(wide.select(F.xxhash64(ident).alias("_key"), *[F.col(i).cast("double").alias(i) for i in items]))
    long = wide.unpivot([], items, "item", "value").where("value IS NOT NULL")
    counts = long.groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if seen > most_values:
        raise ValueError(f"a column has {seen} different answers; {most_values} are allowed")
    table = counts.toPandas().sort_values(["item", "value"])  # at most most_values rows per item
    drawn = {i: (part["value"].to_numpy(), np.cumsum(part["n"].to_numpy()) / part["n"].sum()) for i, part in table.groupby("item")}
    a, b = np.triu_indices(p, 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps + 1, 6, len(a)))
        for batch in batches:
            x = batch[items].to_numpy(dtype=float, na_value=np.nan)
            keys = batch["_key"].to_numpy().view(np.uint64)
            m = (~np.isnan(x)).astype(float)
            for rep in range(reps + 1):
                z = np.where(m > 0, x, 0.0)
                if rep:
                    for j, name in enumerate(items):
                        if name in drawn:
                            values, upto = drawn[name]
                            at = np.searchsorted(upto, _hashed_uniforms(seed, rep, j, keys), "right")
                            z[:, j] = values[np.minimum(at, len(values) - 1)] * m[:, j]
                s, ss, c, n = z.T @ m, (z * z).T @ m, z.T @ z, m.T @ m
                total[rep] += np.stack([n[a, b], s[a, b], s.T[a, b], ss[a, b], ss.T[a, b], c[a, b]])
        for rep in range(reps + 1):
            yield pd.DataFrame(dict(zip(("n", "sa", "sb", "saa", "sbb", "sab"), total[rep]))).assign(rep=rep, a=a, b=b)[["rep", "a", "b", "n", "sa", "sb", "saa", "sbb", "sab"]]

    schema = "rep int, a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"
    sums = wide.mapInPandas(products, schema)
    sums = sums.groupBy("rep", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])

    def eigen(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r = np.eye(p)
        n = np.maximum(cells["n"], 1)
        va = cells["saa"] - cells["sa"] ** 2 / n
        vb = cells["sbb"] - cells["sb"] ** 2 / n
        cov = cells["sab"] - cells["sa"] * cells["sb"] / n
        safe = (va > 1e-12) & (vb > 1e-12)
        cor = np.where(safe, cov / np.sqrt(np.where(safe, va * vb, 1.0)), 0.0)
        r[cells["a"], cells["b"]] = r[cells["b"], cells["a"]] = cor
        values = np.sort(np.linalg.eigvalsh(r))[::-1]
        return pd.DataFrame({"rep": key[0], "component": np.arange(1, p + 1), "eigen": values})

    # One items-by-items matrix per replicate: a bounded group.
    values = sums.groupBy("rep").applyInPandas(eigen, "rep int, component int, eigen double")
    return values.groupBy("component").agg(
        F.max(F.when(F.col("rep") == 0, F.col("eigen"))).alias("observed"),
        F.avg(F.when(F.col("rep") > 0, F.col("eigen"))).alias("resampled"),
    )


def build_scales(loadings: DataFrame, items: DataFrame, k_factors: int, k_items: int) -> DataFrame:
    """Best factors per item, then the strongest items per scale.

    Every dictionary item is considered; an item without loadings stays with a
    NULL scale.
    """
    strength = F.abs("loading")
    matched = average_rank_grouped(loadings, ["item"], strength, "_rank").where(F.col("_rank") <= k_factors)
    kept = average_rank_grouped(matched, ["scale"], strength, "_load").where(F.col("_load") <= k_items)
    unknown = items.join(loadings.where(F.col("loading").isNotNull()).select("item").distinct(), "item", "left_anti")
    empty = unknown.withColumn("scale", F.lit(None).cast("string")).withColumn("loading", F.lit(None).cast("double"))
    return kept.drop("_rank", "_load").join(items, "item").unionByName(empty)


def factor_scale_scores(responses: DataFrame, respondents: DataFrame, loadings: DataFrame, n_loadings: int, role: str = "role", value: str = "score") -> DataFrame:
    """Mean per respondent, role and scale, answers reversed under a non-positive loading."""
    joined = attach(responses, loadings, ["item"], n_loadings, "inner")
    turned = joined.withColumn("_signed", signed_score(F.col(value), F.col("loading"))).where(F.col("_signed").isNotNull())
    scores = turned.groupBy("id", "scale").agg(F.avg("_signed").alias("score"))
    return scores.join(respondents.select("id", role), "id")


def scale_composition(scales: DataFrame, tests: DataFrame) -> DataFrame:
    """How many items of each trait and sign make up each scale, with its test result."""
    joined = scales.join(tests.select("scale", "p", "significant"), "scale", "left").withColumn("sign", sign_label(F.col("loading")))
    return joined.groupBy("scale", "trait", "significant", "sign").agg(F.count(F.lit(1)).alias("n"))


def questionnaire_table(scales: DataFrame, tests: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale, trait, item, loading, mean, sd and content, the clearest scales first."""
    joined = scales.join(tests.select("scale", "p"), "scale", "left").join(stats.select("item", "mean", "sd"), "item", "left")
    return joined.orderBy(F.col("p").asc_nulls_last(), "scale", "item").select(
        "scale", "trait", "item", F.round("loading", 2).alias("loading"), "mean", "sd", "content"
    )
