"""Model frames, random forests and feature importance."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from surveyloom.functions.draws import poisson_one, uniform
from surveyloom.functions.numeric import safe_divide
from surveyloom.functions.scores import encode_levels, encode_yes_no, row_total
from surveyloom.operators.groups import impute_median
from surveyloom.operators.selection import hash_index, value_counts
from surveyloom.operators.trees import Forest, grow_forest, score
from surveyloom.session import cut_lineage, spread


def model_frame(people: DataFrame, role: str, roles: Sequence[str], flags: Sequence[str], levels: dict[str, dict[str, int]], total_of: Sequence[str], total: str, ident: str = "id") -> DataFrame:
    """Encode flags and ordered levels, total some flags, keep the compared roles
    and fill gaps by the role's median."""
    coded = people.where(F.col(role).isin(list(roles))).select(
        ident,
        role,
        *[encode_yes_no(F.col(c)).alias(c) for c in flags],
        *[encode_levels(F.col(c), codes).alias(c) for c, codes in levels.items()],
    )
    coded = coded.withColumn(total, row_total(total_of))
    return impute_median(coded, role, [*flags, *levels, total]).select(ident, role, *flags, *levels, total)


def random_forest(rows: DataFrame, trees: int, mtry: int, seed: int, vector: str = "v", label: str = "label", depth: int = 30) -> Forest:
    """Forest over numeric labels 0..c-1 with ``mtry`` features tried per split; its trees stay in a table."""
    return grow_forest(rows, trees, mtry, seed, vector, label, depth)


def predict(model: Forest, rows: DataFrame, vector: str = "v") -> DataFrame:
    """``rows`` with the class of most votes, the smallest of equals."""
    fields = T.StructType([*rows.schema.fields, T.StructField("predicted", T.IntegerType())])
    kept = rows.columns
    judge = lambda table, votes, _: table.select(kept).append_column("predicted", pa.array(votes.argmax(axis=1), pa.int32()))
    return score(model, rows, vector, judge, fields)


def confusion(predicted: DataFrame, label: str = "label") -> DataFrame:
    return predicted.groupBy("predicted", label).agg(F.count(F.lit(1)).alias("n"))


def accuracy(predicted: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    return predicted.groupBy(*keys).agg(
        F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def kappa(predicted: DataFrame, label: str = "label") -> DataFrame:
    """(kappa, accuracy, n): agreement beyond what the two margins give by chance; NULL where chance alone agrees fully."""
    cells = confusion(predicted.where(F.col("predicted").isNotNull() & F.col(label).isNotNull()), label)
    hit = F.when(F.col("predicted") == F.col(label), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    given = cells.select(F.col("predicted").alias("c"), F.col("n").alias("given"), none.alias("true"), hit.alias("right"))
    true = cells.select(F.col(label).alias("c"), none.alias("given"), F.col("n").alias("true"), none.alias("right"))
    by_class = given.unionByName(true).groupBy("c").agg(*[F.sum(k).alias(k) for k in ("given", "true", "right")])
    sums = by_class.agg(F.sum("true").alias("n"), F.sum("right").alias("right"), F.sum(F.col("given") * F.col("true").cast("double")).alias("chance"))
    seen, chance = safe_divide(F.col("right"), F.col("n")), safe_divide(F.col("chance"), F.col("n") * F.col("n").cast("double"))
    return sums.where("n > 0").select(safe_divide(seen - chance, 1 - chance).alias("kappa"), seen.alias("accuracy"), "n")


def _swapped_cells(rows: DataFrame, seed: int, ident: str) -> DataFrame:
    """(ident, _cells): for every feature another row's value of it, by feature."""
    cells = rows.select(ident, F.posexplode("v").alias("feature", "_given"))
    taker = hash_index(cells.select(ident, "feature"), ["feature"], uniform(seed, F.lit("to"), "feature", ident), ident, "_idx").drop("_idx_of")
    giver = hash_index(cells, ["feature"], uniform(seed, F.lit("from"), "feature", ident), ident, "_idx").select("feature", "_idx", "_given")
    return taker.join(giver, ["feature", "_idx"]).groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("feature", "_given"))).alias("_cells"))


def _shuffled_copies(rows: DataFrame, seed: int, ident: str) -> DataFrame:
    """``rows`` with ``feature``: each row as it is (feature -1) and once per feature with another row's value of it in ``v``."""
    others = [c for c in rows.columns if c != "v"]
    gathered = _swapped_cells(rows, seed, ident)
    swap = lambda c: F.struct(c["feature"].alias("feature"), F.transform("v", lambda x, i: F.when(i == c["feature"], c["_given"]).otherwise(x)).alias("v"))
    intact = F.array(F.struct(F.lit(-1).alias("feature"), F.col("v").alias("v")))
    return spread(rows.join(gathered, ident), ident).select(*others, F.inline(F.concat(intact, F.transform("_cells", swap))))


def permutation_importance(model: Forest, rows: DataFrame, names: Sequence[str], seed: int, ident: str = "id", vector: str = "v", label: str = "label") -> DataFrame:
    """Accuracy lost when one feature is shuffled, absolute and relative to the largest.

    A shuffle gives the row at one hashed position the value of the row at another.  Single values are
    exchanged and gathered per row; all its shuffled copies are scored with the row, and only
    sums per feature are shuffled.
    """
    rows = cut_lineage(rows.select(ident, F.col(vector).alias("v"), F.col(label).alias("label")))
    dims = len(model.cuts)
    joined = rows.join(_swapped_cells(rows, seed, ident), ident)
    # An id that comes several times has as many values of a feature: each of its rows takes them all, and counts once as it is.
    times = F.floor(F.size("_cells") / dims).cast("int")
    turns = F.sequence(F.lit(0), times - 1)
    joined = joined.withColumn("_turn", F.explode(turns)).withColumn("_times", times)
    other = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.col("_cells")[i * F.col("_times") + F.col("_turn")]["_given"])
    given = joined.select("v", other.alias("other"), F.col("label").cast("int").alias("label"), "_turn")

    def judge(table: pa.Table, votes: np.ndarray, swapped: np.ndarray) -> pa.Table:
        label = table["label"].to_numpy()
        known = ~np.isnan(label.astype(float))
        once = known & (table["_turn"].to_numpy() == 0)
        right = [int((votes.argmax(axis=1) == label)[once].sum()), *(swapped.argmax(axis=2) == label[:, None])[known].sum(axis=0).tolist()]
        seen = [int(once.sum()), *[int(known.sum())] * dims]
        return pa.table({"feature": pa.array(range(-1, dims), pa.int32()), "right": pa.array(right, pa.int64()), "n": pa.array(seen, pa.int64())})

    fields = T.StructType.fromDDL("feature int, right bigint, n bigint")
    sums = score(model, given, "v", judge, fields, "other").groupBy("feature").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    by_feature = cut_lineage(sums.select("feature", safe_divide(F.col("right"), F.col("n")).alias("accuracy")))
    base = by_feature.where(F.col("feature") == -1).select("accuracy").scalar()
    lost = by_feature.where(F.col("feature") >= 0).withColumn("importance", base - F.col("accuracy"))
    gini = model.importances()
    table = rows.sparkSession.createDataFrame([(i, n, float(gini[i])) for i, n in enumerate(names)], "feature int, name string, gini double")
    top = lost.agg(F.max("importance")).scalar()
    out = lost.join(F.broadcast(table), "feature").withColumn("_top", top)
    relative = F.when(F.col("_top") != 0, F.round(F.col("importance") / F.col("_top"), 1))
    return out.select("name", "importance", relative.alias("relative"), "gini")


# ---- forests whose bags are known ----


@dataclass
class BaggedForest:
    """Trees and the seed of their bags: row ``id`` is in the bag of tree t ``bag_weight(seed, t, id)`` times."""

    trees: list[RandomForestClassificationModel]
    seed: int
    ident: str


def bag_weights(trees: int, seed: int, ident: str) -> Column:
    """How often a row is in the bag of each tree: independent Poisson(1) counts by hash, made where the row is."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: uniform(seed, F.lit("bag"), k, F.col(ident)))
    return F.transform(draws, poisson_one)


def bagged_forest(rows: DataFrame, trees: int, mtry: int, seed: int, ident: str = "id", vector: str = "v", label: str = "label", depth: int = 30, parallelism: int = 4) -> BaggedForest:
    """A forest that knows which rows each tree did not see; ``parallelism`` trees are grown at a time.

    Each tree is grown from the rows of its bag, weighted by their counts.  Ids are unique.
    A tree whose bag is empty is left out of every vote.
    """
    ready = rows.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"), bag_weights(trees, seed, ident).alias("bags"))
    ready = cut_lineage(ready)

    def grow(k: int):
        bag = ready.select("features", "label", F.col("bags")[k].cast("double").alias("weight")).where("weight > 0")
        if bag.isEmpty():
            return None
        tree = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=str(mtry), seed=seed + k, maxDepth=depth, minInstancesPerNode=1, weightCol="weight")
        return tree.fit(bag)

    with ThreadPool(parallelism) as pool:
        grown = pool.map(inheritable_thread_target(rows.sparkSession)(grow), range(trees))
    return BaggedForest(grown, seed, ident)


def _with_bags(forest: BaggedForest, rows: DataFrame, vector: str, label: str) -> DataFrame:
    own = rows.select(forest.ident, F.col(vector).alias("v"), F.col(label).alias("label"))
    return cut_lineage(spread(own, forest.ident).withColumn("bags", bag_weights(len(forest.trees), forest.seed, forest.ident)))


def _tree_hits(forest: BaggedForest, rows: DataFrame, vector: str = "v", at_once: int = 25) -> DataFrame:
    """``rows``, which carry their ``bags``, with ``calls``: (tree, predicted) of every tree that did not see the row, in one pass over the rows.

    The trees' calls are columns of one projection; ``at_once`` of them are folded into the array at a time.
    """
    kept = [c for c in rows.columns if c != "bags"]
    out = rows.withColumn("_features", array_to_vector(vector)).withColumn("calls", F.array().cast("array<struct<tree:int,predicted:int>>"))
    known = [(k, tree) for k, tree in enumerate(forest.trees) if tree is not None]
    for i in range(0, len(known), at_once):
        part = known[i : i + at_once]
        for k, tree in part:
            tree = tree.copy().setFeaturesCol("_features").setPredictionCol(f"_p{k}").setRawPredictionCol("").setProbabilityCol("")
            out = tree.transform(out)
        calls = [F.when(F.col("bags")[k] == 0, F.struct(F.lit(k).alias("tree"), F.col(f"_p{k}").cast("int").alias("predicted"))) for k, _ in part]
        out = out.withColumn("calls", F.concat("calls", F.filter(F.array(*calls), lambda c: c.isNotNull()))).drop(*[f"_p{k}" for k, _ in part])
    return out.select(*kept, "calls")


def oob_votes(forest: BaggedForest, rows: DataFrame, classes: int, vector: str = "v", label: str = "label") -> DataFrame:
    """(ident, label, n_votes, predicted): majority of the trees that did not see the row, ties to the smaller class;
    NULL where every tree saw it.  ``rows`` are those the forest was grown from."""
    called = _tree_hits(forest, _with_bags(forest, rows, vector, label))
    votes = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(F.size(F.filter("calls", lambda x: x["predicted"] == c)).alias("n"), (-c).alias("less")))
    winner = -F.array_max(votes)["less"]
    return called.select(forest.ident, "label", F.size("calls").alias("n_votes"), F.when(F.size("calls") > 0, winner).alias("predicted"))


def oob_importance(forest: BaggedForest, rows: DataFrame, names: Sequence[str], seed: int, vector: str = "v", label: str = "label") -> DataFrame:
    """(name, importance, se, relative): accuracy that trees lose on the rows they did not see when a feature is shuffled.

    The loss is taken per tree and averaged; ``se`` is its standard error over trees.  One pass scores the
    rows and their shuffled copies by all trees, and only sums per feature and tree are shuffled.
    """
    rows = _with_bags(forest, rows, vector, label)
    called = _tree_hits(forest, _shuffled_copies(rows, seed, forest.ident))
    hits = called.select("feature", "label", F.inline("calls")).groupBy("feature", "tree").agg(F.avg((F.col("predicted") == F.col("label")).cast("int")).alias("accuracy"))
    hits = cut_lineage(hits)  # features x trees rows
    intact = hits.where("feature = -1").select("tree", F.col("accuracy").alias("intact"))
    lost = hits.where("feature >= 0").join(intact, "tree").withColumn("lost", F.col("intact") - F.col("accuracy"))
    by = lost.groupBy("feature").agg(F.avg("lost").alias("importance"), (F.stddev_samp("lost") / F.sqrt(F.count("lost"))).alias("se"))
    by = cut_lineage(by)
    table = rows.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    top = by.agg(F.max("importance")).scalar()
    out = by.join(F.broadcast(table), "feature").withColumn("_top", top)
    return out.select("name", "importance", "se", F.when(F.col("_top") > 0, F.round(F.col("importance") / F.col("_top"), 1)).alias("relative"))


def auc_importance(long: DataFrame, feature: str, value: str, positive: str) -> DataFrame:
    """Area under the ROC curve of each feature by rank sums.

    ``positive`` is 0/1.  Ranks come from counts per distinct value, so no
    feature's rows are sorted in one task.
    """
    ranked = value_counts(long, [feature], value, _pos=F.col(positive))
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    sums = ranked.groupBy(feature).agg(
        F.sum(F.col("_pos") * rank).alias("_ranks"), F.sum("_pos").alias("n1"), (F.sum("n") - F.sum("_pos")).alias("n0")
    )
    n1, n0 = F.col("n1"), F.col("n0")
    auc = (F.col("_ranks") - n1 * (n1 + 1) / F.lit(2.0)) / F.when(n1 * n0 != 0, n1 * n0)
    return sums.select(feature, "n1", "n0", auc.alias("auc"), F.greatest(auc, F.lit(1.0) - auc).alias("importance"))
