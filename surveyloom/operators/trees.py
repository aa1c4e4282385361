"""Classification trees over binned rows, and forests of them that no process holds whole.

A feature's values are cut at up to BINS - 1 places, and a row is one byte a feature.  Trees are
grown level by level in tasks of TASK_TREES trees, each of which reads all binned rows: 64
features are 64 bytes a row.  A tree is a row of a checkpointed table; rows are scored in blocks,
past which the trees are read one after the other.  The driver has the cuts and no tree.

The rules are those of Spark's trees: Poisson(1) bags, ``mtry`` features tried per node, the split
of largest gini gain, none without gain, and two leaves that call the same class are one.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from surveyloom.session import cut_lineage

BINS = 32
TASK_TREES = 8
BLOCK_ROWS = 16_384  # rows that the trees are read past at once
_CELLS = 2_000_000  # counts of a histogram at once
_PART_ROWS = 200_000  # rows added to a histogram at once
_ONE = 1 << 30  # a whole vote: votes are added as integers, in any order


def _matrix(column, dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), dims)


# ---- bins ----


def _cuts(rows: DataFrame, dims: int) -> list[np.ndarray]:
    """Per feature the places between bins, halfway from one value to the next: between all values where
    they are at most BINS, else at the 1/BINS quantiles."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    at = rows.agg(*[F.percentile_approx(F.col("v")[i], shares, 10_000).alias(str(i)) for i in range(dims)]).first()
    if at[0] is None:
        raise ValueError("a forest needs rows to grow from")
    marks = [np.unique(np.array(at[i], float)) for i in range(dims)]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = ([np.full(m.size + 1, v) for m in marks] for v in (np.inf, -np.inf))
        few = [np.empty(0)] * dims
        for batch in batches:
            x = _matrix(batch["v"], dims)
            for i in range(dims):
                bin_of = np.searchsorted(marks[i], x[:, i])
                np.minimum.at(low[i], bin_of, x[:, i])
                np.maximum.at(high[i], bin_of, x[:, i])
                if few[i].size <= BINS:
                    few[i] = np.unique(np.concatenate([few[i], x[:, i]]))[: BINS + 1]
        yield pd.DataFrame({"i": np.arange(dims, dtype=np.int32), "low": low, "high": high, "few": few})

    fields = ", ".join(f"{c} array<double>" for c in ("low", "high", "few"))
    out: list[np.ndarray] = [np.empty(0)] * dims
    low, high, few = ([None] * dims for _ in range(3))
    for r in rows.select("v").mapInPandas(ends, f"i int, {fields}").toLocalIterator():  # BINS values per feature and partition
        i = r["i"]
        low[i] = np.array(r["low"]) if low[i] is None else np.minimum(low[i], r["low"])
        high[i] = np.array(r["high"]) if high[i] is None else np.maximum(high[i], r["high"])
        few[i] = np.array(r["few"]) if few[i] is None else np.unique(np.concatenate([few[i], r["few"]]))[: BINS + 1]
    for i in range(dims):
        if few[i].size <= BINS:
            a, b = few[i][:-1], few[i][1:]
        else:
            full = np.isfinite(low[i]) & np.isfinite(high[i])
            a, b = high[i][full][:-1], low[i][full][1:]
        out[i] = np.unique(np.where(np.isfinite((a + b) / 2), (a + b) / 2, a))
    return out


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of every cell: code <= j says the value is at most cut j."""
    out = np.empty(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i])
    return out


# ---- one tree ----


def _best_splits(codes, label, weight, rows, pos, feats, total):
    """Of each node: (gain, feature, code, classes to the left) of its best split."""
    m, tried = feats.shape
    classes = total.shape[1]
    counts = np.zeros(m * tried * BINS * classes)
    for s in range(0, rows.size, _PART_ROWS):
        r, p = rows[s : s + _PART_ROWS], pos[s : s + _PART_ROWS]
        key = (p[:, None] * tried + np.arange(tried)) * BINS + codes[r[:, None], feats[p]]
        key = key * classes + label[r][:, None]
        counts += np.bincount(key.ravel(), np.repeat(weight[r], tried), minlength=counts.size)
    left = counts.reshape(m, tried, BINS, classes).cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left
    n_left, n_right = left.sum(-1), right.sum(-1)
    fair = (n_left > 0) & (n_right > 0)
    worth = (left * left).sum(-1) / np.where(fair, n_left, 1) + (right * right).sum(-1) / np.where(fair, n_right, 1)
    worth = np.where(fair, worth, -np.inf).reshape(m, -1)
    best = worth.argmax(axis=1)
    each, n = np.arange(m), total.sum(axis=1)
    gain = (worth[each, best] - (total * total).sum(axis=1) / n) / n
    j, code = best // (BINS - 1), best % (BINS - 1)
    return gain, feats[each, j], code, left[each, j, code]


def grow(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, mtry: int, depth: int, rng: np.random.Generator):
    """(feature, code, left, stats, worth) of a tree's nodes: feature -1 is a leaf, the right child comes after the left,
    ``worth`` is gain times rows."""
    dims = codes.shape[1]
    tried = min(mtry, dims)
    rows = np.flatnonzero(weight)
    weight = weight.astype(float)
    stats = [np.bincount(label[rows], weight[rows], minlength=classes)[None, :]]
    feature, code, left, worth = [], [], [], []
    open_ = np.array([0] if (stats[0] > 0).sum() > 1 else [], int)  # of the level, nodes that may be split
    pos = np.zeros(rows.size, int)  # of a row, its place in open_
    first = 1  # number of the next level's first node
    for level in range(depth + 1):
        here = stats[-1]
        f, c, l, g = np.full(len(here), -1, np.int16), np.zeros(len(here), np.uint8), np.zeros(len(here), np.int32), np.zeros(len(here))
        feature.append(f), code.append(c), left.append(l), worth.append(g)
        if level == depth or not open_.size:
            break
        step = max(1, _CELLS // (tried * BINS * classes))
        found = []
        edge = np.searchsorted(pos, np.arange(0, open_.size + step, step))
        for i, s in enumerate(range(0, open_.size, step)):
            nodes = open_[s : s + step]
            feats = np.argpartition(rng.random((nodes.size, dims)), tried - 1, axis=1)[:, :tried] if tried < dims else np.tile(np.arange(dims), (nodes.size, 1))
            cut = slice(edge[i], edge[i + 1])
            found.append(_best_splits(codes, label, weight, rows[cut], pos[cut] - s, feats, here[nodes]))
        gain, feat, at, to_left = (np.concatenate(x) for x in zip(*found))
        split = gain > 1e-12
        nodes = open_[split]
        if not nodes.size:
            break
        f[nodes], c[nodes], g[nodes] = feat[split], at[split], gain[split] * here[nodes].sum(axis=1)
        l[nodes] = first + 2 * np.arange(nodes.size)
        below = np.stack([to_left[split], here[nodes] - to_left[split]], axis=1).reshape(-1, classes)
        stats.append(below)
        first += len(below)
        child = np.where(split, 2 * (np.cumsum(split) - 1), -1)[pos]
        child = np.where(child < 0, -1, child + (codes[rows, feat[pos]] > at[pos]))
        mixed = (below > 0).sum(axis=1) > 1
        open_ = np.flatnonzero(mixed)
        on = (child >= 0) & mixed[child]
        rows, pos = rows[on], (np.cumsum(mixed) - 1)[child[on]]
        order = np.argsort(pos, kind="stable")
        rows, pos = rows[order], pos[order]
    return _pruned(feature, code, left, stats, worth)


def _pruned(feature, code, left, stats, worth):
    """Levels put together; from below, two leaves that call the same class become their parent."""
    start = np.concatenate([[0], np.cumsum([len(x) for x in feature])])
    feature, code, left, stats, worth = (np.concatenate(x) for x in (feature, code, left, stats[: len(feature)], worth))
    called = stats.argmax(axis=1)
    for a, b in zip(start[-2::-1], start[:0:-1]):
        i = a + np.flatnonzero(feature[a:b] >= 0)
        l = left[i]
        same = (feature[l] < 0) & (feature[l + 1] < 0) & (called[l] == called[l + 1])
        feature[i[same]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for a, b in zip(start[:-1], start[1:]):
        i = a + np.flatnonzero(kept[a:b] & (feature[a:b] >= 0))
        kept[left[i]] = kept[left[i] + 1] = True
    left = np.where(feature >= 0, (np.cumsum(kept) - 1)[left], 0).astype(np.int32)
    return feature[kept], code[kept], left[kept], stats[kept], np.where(feature >= 0, worth, 0.0)[kept]


# ---- a forest ----


@dataclass
class Forest:
    """A table with a row per tree, and what a row is binned by."""

    trees: DataFrame
    cuts: list[np.ndarray]
    classes: int

    def importances(self) -> np.ndarray:
        """Gini gain of each feature: a share of each tree, averaged over the trees that split."""
        of = self.trees.select(F.posexplode("worth").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("w")).collect()
        total = np.zeros(len(self.cuts))
        for r in of:
            total[r["i"]] = r["w"]
        return total / total.sum() if total.sum() > 0 else total


def grow_forest(rows: DataFrame, trees: int, mtry: int, seed: int, vector: str, label: str, depth: int) -> Forest:
    """A tree depends on the seed, its number and the rows, however they are laid out."""
    spark = rows.sparkSession
    rows = cut_lineage(rows.select(F.transform(vector, lambda x: x.cast("double")).alias("v"), F.col(label).cast("int").alias("label")))
    dims, least, most, unlabelled = rows.agg(F.max(F.size("v")), F.min("label"), F.max("label"), F.count_if(F.col("label").isNull())).first()
    if not dims or unlabelled or least is None or least < 0:
        raise ValueError("a forest needs rows with features and labels 0..c-1")
    classes = most + 1
    cuts = _cuts(rows, dims)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"codes": [_codes(_matrix(batch["v"], dims), cuts).tobytes()], "labels": [batch["label"].to_numpy(np.int32).tobytes()]})

    packed = cut_lineage(rows.mapInPandas(pack, "codes binary, labels binary"))
    tasks = -(-trees // TASK_TREES)

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, labels, task = [], [], None
        for batch in batches:
            codes += [np.frombuffer(x, np.uint8).reshape(-1, dims) for x in batch["codes"]]
            labels += [np.frombuffer(x, np.int32) for x in batch["labels"]]
            task = int(batch["task"].iloc[0]) if len(batch) else task
        if task is None:
            return
        x, y = np.concatenate(codes), np.concatenate(labels)
        del codes, labels
        # In the order of their contents: rows that are alike may change places.
        order = np.lexsort([y, *np.pad(x, ((0, 0), (0, -dims % 8))).view(np.uint64).T])
        x, y = x[order], y[order]
        for k in range(task * TASK_TREES, min(trees, (task + 1) * TASK_TREES)):
            rng = np.random.default_rng([seed, k])
            f, c, l, stats, worth = grow(x, y, rng.poisson(1.0, len(y)), classes, mtry, depth, rng)
            share = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1)
            votes = np.where((f < 0)[:, None], np.rint(share * _ONE), 0).astype(np.int32)
            by = np.bincount(np.maximum(f, 0), worth, minlength=dims)
            by = by / by.sum() if by.sum() > 0 else by
            yield pd.DataFrame({"tree": [k], "feature": [f.tobytes()], "code": [c.tobytes()], "left": [l.tobytes()], "votes": [votes.tobytes()], "worth": [by]})

    each = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    table = each.mapInPandas(grown, "tree int, feature binary, code binary, left binary, votes binary, worth array<double>")
    return Forest(cut_lineage(table), cuts, classes)


def _leaves(tree: tuple, x: np.ndarray, node: np.ndarray, swapped: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """The leaf of each row from ``node`` on; with ``swapped``, where feature ``of`` has the other value."""
    feature, code, left = tree
    node = node.copy()
    going = np.flatnonzero(feature[node] >= 0)
    while going.size:
        at = node[going]
        f = feature[at]
        value = x[going, f] if of is None else np.where(f == of[going], swapped[going, f], x[going, f])
        node[going] = left[at] + (value > code[at])
        going = going[feature[node[going]] >= 0]
    return node


def _parted(tree: tuple, x: np.ndarray, swapped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The leaf of each row, and (row, feature, leaf) wherever the other value of a feature leads off the row's path."""
    feature, code, left = tree
    node = np.zeros(len(x), np.int64)
    gone = np.zeros(x.shape, bool)
    row, of, to = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, int)]
    going = np.flatnonzero(feature[node] >= 0)
    while going.size:
        at = node[going]
        f = feature[at]
        own, other = x[going, f] > code[at], swapped[going, f] > code[at]
        off = np.flatnonzero((own != other) & ~gone[going, f])
        gone[going[off], f[off]] = True
        row.append(going[off]), of.append(f[off]), to.append(left[at[off]] + other[off])
        node[going] = left[at] + own
        going = going[feature[node[going]] >= 0]
    row, of, to = np.concatenate(row), np.concatenate(of), np.concatenate(to)
    return node, row, of, _leaves(tree, x[row], to, swapped[row], of)


def score(forest: Forest, rows: DataFrame, vector: str, judge: Callable, fields: T.StructType, swapped: str | None = None) -> DataFrame:
    """What ``judge(rows, votes, other)`` makes of each block, an Arrow table whose votes are summed over the trees.

    ``votes`` is (row, class).  With ``swapped``, a column of other values for ``vector``, ``other`` is (row,
    feature, class): the votes were that feature's value the other one; a row's path is followed once, and
    again only below the nodes where another value leaves it.
    """
    spark = rows.sparkSession
    kept = rows.columns
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    blocks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("_at"), F.lit(blocks)).cast("int")
    parts = ("feature", "code", "left", "votes")
    given = rows.select(block.alias("_block"), F.lit(-1).alias("_tree"), *kept, *[F.lit(None).cast("binary").alias(f"_{c}") for c in parts])
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in kept]
    each = forest.trees.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.select("_block", F.col("tree").alias("_tree"), *nothing, *[F.col(c).alias(f"_{c}") for c in parts])
    dealt = given.unionByName(each).repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "_tree")
    cuts, classes, dims = forest.cuts, forest.classes, len(forest.cuts)

    def coded(table: pa.Table, c: str) -> np.ndarray:
        values = table[c].combine_chunks()
        return _codes(values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), dims), cuts)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        table = x = y = votes = other = None
        for batch in batches:
            own = pc.equal(batch["_tree"], -1)
            mine = batch.filter(own)
            if mine.num_rows:
                held.append(mine.select(kept))
            trees = batch.filter(pc.invert(own))
            if not trees.num_rows or not held:
                continue
            if table is None:
                table = pa.Table.from_batches(held)
                x = coded(table, vector)
                votes = np.zeros((len(table), classes), np.int64)
                if swapped:
                    y, other = coded(table, swapped), np.zeros((len(table), dims, classes), np.int64)
            for f, c, l, v in zip(*(trees[f"_{p}"].to_pylist() for p in parts)):
                tree = np.frombuffer(f, np.int16), np.frombuffer(c, np.uint8), np.frombuffer(l, np.int32)
                v = np.frombuffer(v, np.int32).reshape(-1, classes).astype(np.int64)
                if y is None:
                    votes += v[_leaves(tree, x, np.zeros(len(x), np.int64))]
                    continue
                node, row, of, leaf = _parted(tree, x, y)
                votes += v[node]
                other[row, of] += v[leaf] - v[node[row]]  # a row leaves its path once for a feature
        if table is not None:
            out = judge(table, votes, None if other is None else other + votes[:, None, :])
            yield from out.to_batches()

    return dealt.mapInArrow(over, fields)
