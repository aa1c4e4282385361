"""Clustering of respondents, its validation, and cluster profiles."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from surveyloom.functions.draws import uniform
from surveyloom.operators.groups import group_contrast, group_share, summary_se
from surveyloom.operators.neighbors import nearest
from surveyloom.session import cut_lineage


def _assign(model_class, rows: DataFrame, k: int, seed: int, ident: str, vector: str) -> DataFrame:
    # Moved off the origin: repeated splitting perturbs a centre in proportion to
    # its length, which is zero for standardised rows.  Distances do not change.
    moved = F.transform(vector, lambda x: x + F.lit(1.0))
    ready = rows.select(ident, array_to_vector(moved).alias("features"), F.col(vector).alias("_v"))
    model = model_class(k=k, seed=seed, featuresCol="features", predictionCol="_raw").fit(ready)
    labelled = model.transform(ready)
    # k rows: the largest cluster becomes 1, equal sizes ordered by first coordinate.
    sizes = labelled.groupBy("_raw").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("_v")[0]).alias("_c"))
    order = Window.orderBy(F.col("_n").desc(), "_c")
    names = sizes.select("_raw", F.row_number().over(order).alias("cluster"))
    return labelled.join(F.broadcast(names), "_raw").select(ident, "cluster")


def kmeans(rows: DataFrame, k: int = 2, seed: int = 1, ident: str = "id", vector: str = "v") -> DataFrame:
    """(id, cluster) with clusters numbered by size."""
    return _assign(KMeans, rows, k, seed, ident, vector)


def bisecting_kmeans(rows: DataFrame, ks: Sequence[int], seed: int = 1, ident: str = "id", vector: str = "v") -> DataFrame:
    """(k, id, cluster) for each number of clusters, by repeated splitting."""
    out = None
    for k in ks:
        part = _assign(BisectingKMeans, rows, k, seed, ident, vector).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _medoids(x: np.ndarray, k: int) -> list[int]:
    """Greedy build, then swaps while they lower the cost."""
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0.0))
    chosen = [int(d.sum(axis=1).argmin())]
    while len(chosen) < k:
        near = d[:, chosen].min(axis=1)
        chosen.append(int(np.maximum(near[:, None] - d, 0.0).sum(axis=0).argmax()))
    cost = d[:, chosen].min(axis=1).sum()
    while True:
        best = None
        for slot in range(k):
            rest = d[:, chosen[:slot] + chosen[slot + 1 :]].min(axis=1) if k > 1 else np.full(len(d), np.inf)
            costs = np.minimum(rest[:, None], d).sum(axis=0)
            if costs.min() < cost - 1e-9:
                cost, best = costs.min(), (slot, int(costs.argmin()))
        if best is None:
            return chosen
        chosen[best[0]] = best[1]


def kmedoids_sampled(rows: DataFrame, ks: Sequence[int], samples: int = 5, size: int | None = None, seed: int = 1, ident: str = "id", vector: str = "v") -> DataFrame:
    """(k, id, cluster, distance): medoids of hashed samples, judged on every row.

    Each sample is solved in its own task; the medoid set with the lowest cost
    over the whole data wins and labels every row.
    """
    ks = list(ks)
    size = size or 40 + 2 * max(ks)
    rows = cut_lineage(rows.select(ident, F.col(vector).alias("v")))
    picks = None
    for s in range(samples):
        pick = rows.withColumn("_u", uniform(seed, F.lit(s), ident)).orderBy("_u", ident).limit(size).withColumn("sample", F.lit(s))
        picks = pick if picks is None else picks.unionByName(pick)

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ident).reset_index(drop=True)
        x = np.array(part["v"].tolist(), dtype=float)
        found = [(key[0], k, x[i].tolist()) for k in ks for i in _medoids(x, min(k, len(x)))]
        return pd.DataFrame(found, columns=["sample", "k", "medoid"])

    solved = picks.groupBy("sample").applyInPandas(solve, "sample int, k int, medoid array<double>")
    # samples x k medoids: a handful of vectors.
    table = solved.orderBy("sample", "k", "medoid").toPandas()
    sets = {key: np.array(part["medoid"].tolist()) for key, part in table.groupby(["k", "sample"])}

    def to_medoids(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * x @ m.T, 0.0))

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {key: 0.0 for key in sets}
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), -1)
            for key, m in sets.items():
                if len(x):
                    total[key] += float(to_medoids(x, m).min(axis=1).sum())
        yield pd.DataFrame([(int(k), int(s), c) for (k, s), c in total.items()], columns=["k", "sample", "cost"])

    cost = rows.select("v").mapInPandas(costs, "k int, sample int, cost double").groupBy("k", "sample").agg(F.sum("cost").alias("cost"))
    winner = {r["k"]: r["sample"] for r in cost.groupBy("k").agg(F.min_by("sample", F.struct(F.round("cost", 6), "sample")).alias("sample")).collect()}
    fields = f"k int, {ident} {rows.schema[ident].dataType.simpleString()}, cluster int, distance double"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["v"].tolist(), dtype=float)
            for k in ks:
                d = to_medoids(x, sets[(k, winner[k])])
                yield pd.DataFrame({"k": k, ident: batch[ident], "cluster": d.argmin(axis=1) + 1, "distance": d.min(axis=1)})

    return rows.mapInPandas(label, fields)


def labels_of(rows: DataFrame, ks: Sequence[int], method: str, seed: int = 1, ident: str = "id", vector: str = "v") -> DataFrame:
    """(k, id, cluster) by ``kmeans``, ``bisecting`` or ``kmedoids``."""
    if method == "bisecting":
        return bisecting_kmeans(rows, ks, seed, ident, vector)
    if method == "kmedoids":
        return kmedoids_sampled(rows, ks, seed=seed, ident=ident, vector=vector).select("k", ident, "cluster")
    if method != "kmeans":
        raise ValueError(f"no method {method}")
    found = [kmeans(rows, k, seed, ident, vector).withColumn("k", F.lit(k)) for k in ks]
    return reduce(DataFrame.unionByName, found).select("k", ident, "cluster")


METHODS = ("kmeans", "bisecting", "kmedoids")


def cluster_validity(rows: DataFrame, labels: DataFrame, dims: int, neighbours: int = 10, ident: str = "id", vector: str = "v", keys: Sequence[str] = ("k",)) -> DataFrame:
    """Silhouette, centroid Dunn index and connectivity for each clustering in ``labels``.

    ``keys`` tell the clusterings apart, for example (method, k).  Neighbours are found once and
    shared by all.  The silhouette is on squared distances.
    """
    keys = list(keys)
    rows = cut_lineage(rows.select(ident, F.col(vector).alias("v")))
    labels = cut_lineage(labels.select(*keys, ident, "cluster"))
    near = cut_lineage(nearest(rows, rows, neighbours, dims, ident, keep_self=False).select(ident, "donor", "rank"))
    own = near.join(labels, ident)
    other = labels.select(*keys, F.col(ident).alias("donor"), F.col("cluster").alias("_other"))
    apart = F.when(F.col("cluster") != F.col("_other"), F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0))
    connectivity = own.join(other, [*keys, "donor"]).groupBy(*keys).agg(F.sum(apart).alias("connectivity"))
    joined = cut_lineage(rows.join(labels, ident))
    centres = joined.groupBy(*keys, "cluster").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dims)]).alias("_c"))
    gap = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
    radius = joined.join(F.broadcast(centres), [*keys, "cluster"]).groupBy(*keys).agg((2 * F.max(gap(F.col("v"), F.col("_c")))).alias("_wide"))
    # Centres: a few per k, joined within their k.
    a = centres.select(*keys, F.col("cluster").alias("_a"), F.col("_c").alias("_ca"))
    b = centres.select(*keys, F.col("cluster").alias("_b"), F.col("_c").alias("_cb"))
    apart_most = a.join(b, keys).where(F.col("_a") < F.col("_b")).groupBy(*keys).agg(F.min(gap(F.col("_ca"), F.col("_cb"))).alias("_near"))
    dunn = radius.join(apart_most, keys, "left").select(*keys, (F.col("_near") / F.col("_wide")).alias("dunn"))
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="_prediction")
    ready = joined.select(*keys, array_to_vector("v").alias("features"), F.col("cluster").cast("double").alias("_prediction"))
    # One row per clustering; a single cluster has no silhouette.
    found = labels.groupBy(*keys).agg(F.countDistinct("cluster").alias("n")).orderBy(*keys).collect()
    own = lambda r: reduce(and_, [F.col(c) == r[c] for c in keys])
    scores = [(*[r[c] for c in keys], float(judge.evaluate(ready.where(own(r)))) if r["n"] > 1 else None) for r in found]
    fields = ", ".join(f"{c} {labels.schema[c].dataType.simpleString()}" for c in keys)
    silhouette = rows.sparkSession.createDataFrame(scores, f"{fields}, silhouette double")
    return silhouette.join(dunn, keys, "left").join(connectivity, keys, "left")


def cluster_stability(rows: DataFrame, ks: Sequence[int], dims: int, seed: int = 1, ident: str = "id", vector: str = "v", method: str = "kmeans", at_once: int = 4) -> DataFrame:
    """Refit without each column: share moved (apn), shift of means (adm), left-out error (fom).

    ``dims`` x ``ks`` fits by ``method``, each a distributed job and ``at_once`` of them running
    together; labels are compared by id.
    """
    rows = cut_lineage(rows.select(ident, F.col(vector).alias("v")))
    ks = list(ks)

    def labelled(j: int | None) -> DataFrame:
        rest = rows if j is None else rows.withColumn("v", F.concat(F.slice("v", 1, j), F.slice("v", j + 2, dims)))
        labels = labels_of(rest, ks, method, seed, ident, "v")
        return cut_lineage(labels.withColumnRenamed("cluster", "full") if j is None else labels.select("k", ident, F.col("cluster").alias("less"), F.lit(j).alias("column")))

    with ThreadPoolExecutor(at_once) as pool:
        full, *less = pool.map(labelled, [None, *range(dims)])
    found = cut_lineage(reduce(DataFrame.unionByName, less).join(full, ["k", ident]))
    joined = found.join(rows, ident)
    keys = ["k", "column"]
    means = lambda by, out: joined.groupBy(*keys, by).agg(
        F.count(F.lit(1)).alias(f"_n_{by}"), F.array(*[F.avg(F.col("v")[i]) for i in range(dims)]).alias(out)
    )
    full, less = means("full", "_mf"), means("less", "_ml")
    gap = F.sqrt(F.aggregate(F.zip_with("_mf", "_ml", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
    cells = found.groupBy(*keys, "full", "less").agg(F.count(F.lit(1)).alias("_n"))
    moved = (
        cells.join(full, [*keys, "full"])
        .join(less, [*keys, "less"])
        .groupBy(*keys)
        .agg(
            (F.sum(F.col("_n") * (1 - F.col("_n") / F.col("_n_full"))) / F.sum("_n")).alias("apn"),
            (F.sum(F.col("_n") * gap) / F.sum("_n")).alias("adm"),
        )
    )
    left_out = F.col("v")[F.col("column")]
    error = (
        joined.join(F.broadcast(less), [*keys, "less"])
        .groupBy(*keys)
        .agg(F.sqrt(F.avg((left_out - F.col("_ml")[F.col("column")]) * (left_out - F.col("_ml")[F.col("column")]))).alias("fom"))
    )
    return moved.join(error, keys).groupBy("k").agg(*[F.avg(c).alias(c) for c in ("apn", "adm", "fom")])


def cluster_profile(scores: DataFrame, labels: DataFrame, ident: str = "id", a: int = 1, b: int = 2) -> DataFrame:
    """Scale means by cluster with their gap between two clusters."""
    joined = scores.join(labels, ident)
    stats = summary_se(joined, ["cluster", "scale"], "score")
    gap = group_contrast(joined, ["scale"], "cluster", a, b, "score").select("scale", F.col("difference_abs").alias("delta"))
    return stats.join(gap, "scale")


def cluster_mix(people: DataFrame, labels: DataFrame, columns: Sequence[str], ident: str = "id") -> DataFrame:
    """Share of each answer within each cluster, for several columns at once."""
    joined = people.select(ident, *columns).join(labels, ident)
    long = joined.unpivot([ident, "cluster"], list(columns), "category", "response")
    return group_share(long, ["cluster", "category", "response"], ["cluster", "category"])
