"""Group tests, bootstrap intervals and permutation p-values.

Every trait is handled in the same job: traits are keys, replicates are rows.
"""

from __future__ import annotations

import hashlib
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from surveyloom.functions.draws import poisson_one, uniform
from surveyloom.functions.numeric import safe_divide
from surveyloom.functions.tdist import t_two_sided
from surveyloom.operators.groups import histogram, value_range
from surveyloom.operators.selection import cut_bin, hash_index
from surveyloom.session import attach, attach_measured, cut_lineage, spread

BUCKET_ROWS = 4096  # rows of a bootstrap bucket, about
MAX_BUCKETS = 1 << 16  # of a key; beyond, buckets grow


def _welch(pairs: DataFrame, with_p: bool) -> DataFrame:
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = pairs.withColumn("t", safe_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))).withColumn(
        "df", safe_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    )
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df"))) if with_p else out


def _moments(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def welch_t(df: DataFrame, group: str, value: str, a: str, b: str, keys: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Unequal-variance t-test of two named groups, one row per key."""
    side = lambda name, stat: F.max(F.when(F.col(group) == name, F.col(stat)))
    stats = _moments(df.where(F.col(group).isin(a, b)), keys, group, value)
    wide = stats.groupBy(*keys).agg(
        *[side(name, stat).alias(f"{stat}_{tag}") for tag, name in (("a", a), ("b", b)) for stat in ("n", "mean", "var")]
    )
    testable = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    return _welch(wide.where(testable), with_p)


def welch_t_by(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """All pairs of groups per key, with Holm adjustment within the key.

    The join pairs the grouped moments (one row per key and group), not rows
    of data.
    """
    keys = list(keys)
    stats = _moments(df, keys, group, value).where(F.col("n") > 1)
    side = lambda tag: stats.select(
        *keys, F.col(group).alias(f"group_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "mean", "var")]
    )
    pairs = side("a").join(side("b"), keys).where(F.col("group_a") < F.col("group_b"))
    return holm(_welch(pairs, True), keys, "p", ["group_a", "group_b"])


def holm(tests: DataFrame, keys: Sequence[str], p: str, ties: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within keys."""
    order = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last(), *ties)
    size = F.count(p).over(Window.partitionBy(*keys))
    stepped = tests.withColumn("_step", F.least(F.lit(1.0), F.col(p) * (size - F.row_number().over(order) + 1)))
    return stepped.withColumn(out, F.when(F.col(p).isNotNull(), F.max("_step").over(order))).drop("_step")


def significant_scales(tests: DataFrame, alpha: float, p: str = "p") -> DataFrame:
    """Yes/No flag, sorted by p, with the number of significant rows."""
    from surveyloom.functions.scores import yes_no

    flagged = tests.withColumn("significant", yes_no(F.col(p) < alpha))
    hits = tests.agg(F.count_if(F.col(p) < alpha)).scalar()
    return flagged.withColumn("n_significant", hits).orderBy(F.col(p).asc_nulls_last())


def _gap(group: str, value: str, a: str, b: str, weight: Column | None = None) -> Column:
    if weight is None:
        side = lambda name: F.avg(F.when(F.col(group) == name, F.col(value)))
        return side(a) - side(b)
    side = lambda name: safe_divide(
        F.sum(F.when(F.col(group) == name, weight * F.col(value))), F.sum(F.when(F.col(group) == name, weight))
    )
    return side(a) - side(b)


def observed_diff(df: DataFrame, group: str, value: str, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(_gap(group, value, a, b).alias("diff"))


def _replicated(df: DataFrame, ident: str, reps: int, seed: int, keyed: bool) -> DataFrame:
    """Every row in every replicate with its hash ``_u`` of (rep, id).

    The hash is the costly part and does not depend on the trait, so a
    respondent's traits, a declared handful, share one hash per replicate.
    """
    copies = F.explode(F.sequence(F.lit(1), F.lit(reps)))
    rows = spread(df, ident)
    if not keyed:
        return rows.withColumn("rep", copies).withColumn("_u", uniform(seed, "rep", ident))
    cells = F.collect_list(F.struct(*[c for c in df.columns if c != ident])).alias("_cells")
    packed = rows.groupBy(ident).agg(cells).withColumn("rep", copies)
    return packed.withColumn("_u", uniform(seed, "rep", ident)).select(ident, "rep", "_u", F.inline("_cells"))


def _resample(df: DataFrame, keys: list[str], ident: str, reps: int, seed: int, method: str) -> DataFrame:
    """Rows with ``rep`` and ``weight``: how often the row is drawn in the replicate.

    ``rows`` draws n rows with replacement for each replicate; its draws, n x reps
    of them, are counted per row before they meet the data; ``buckets`` (see ``_bucketed``) draws
    as many without shuffling any.  ``poisson`` gives
    every row an independent Poisson(1) count in place, so nothing but the
    sums per replicate is shuffled; use it beyond study-sized data.
    """
    copies = F.explode(F.sequence(F.lit(1), F.lit(reps)))
    if method == "poisson":
        return _replicated(df, ident, reps, seed, bool(keys)).withColumn("weight", poisson_one(F.col("_u")))
    if method != "rows":
        raise ValueError(f"unknown resampling method {method}")
    placed = hash_index(df, keys, uniform(seed, F.lit("row"), ident), ident, "_idx")
    placed = cut_lineage(placed)
    draws = spread(placed.select(*keys, F.col("_idx").alias("_k"), "_idx_of"), "_k").withColumn("rep", copies)
    hit = F.floor(uniform(seed, "rep", "_k") * F.col("_idx_of"))
    counts = draws.groupBy(*keys, "rep", hit.alias("_idx")).agg(F.count(F.lit(1)).alias("weight"))
    return placed.join(counts, [*keys, "_idx"])


def _seeded(*labels) -> np.random.Generator:
    """A generator that depends on its labels only."""
    return np.random.Generator(np.random.Philox(int.from_bytes(hashlib.md5("-".join(map(str, labels)).encode()).digest(), "little")))


def bucket_draws(sizes: np.ndarray, bucket: int, rep: int, *labels, draws: int | None = None) -> int:
    """How many of a replicate's draws fall in ``bucket``: over all buckets n of them, the sum of ``sizes``, with
    replacement, or ``draws`` of them without.

    The draws of a range of buckets are split between its halves by a binomial or a hypergeometric
    count, whose generator is named after the replicate and the range: every task that walks from all
    buckets to its own meets the same counts, and none has to hear of another.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, again = 0, sizes.size, draws is None
    draws = int(upto[-1]) if again else draws
    while hi - lo > 1 and draws:
        mid = (lo + hi) // 2
        below, above = int(upto[mid] - upto[lo]), int(upto[hi] - upto[mid])
        split = _seeded(*labels, rep, lo, hi)
        left = int(split.binomial(draws, below / (below + above)) if again else split.hypergeometric(below, above, draws))
        lo, hi, draws = (lo, mid, left) if bucket < mid else (mid, hi, draws - left)
    return draws


def _bucketed(df: DataFrame, keys: list[str], ident: str, value: str, group: str | None, sides: Sequence[str], reps: int, seed: int, labels_of: str | None = None) -> DataFrame:
    """(keys, rep, weight_i, total_i): rows and sums of each side, n draws per replicate with replacement.

    With ``labels_of`` the two sides are instead as many rows as ``group`` has of that name, drawn
    without replacement, and the rest: shuffled labels.

    Rows lie in hashed buckets of bounded size.  A bucket's task takes the draws that fall to it
    and returns sums per replicate, so no draw is ever shuffled: buckets x reps rows are.
    """
    rows = df.select(*keys, ident, value, *([group] if group else []))
    sizes = rows.groupBy(*keys).agg(F.least(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)), F.lit(MAX_BUCKETS)).cast("int").alias("_of"))
    rows = attach_measured(rows, sizes, keys) if keys else rows.withColumn("_of", F.coalesce(sizes.scalar(), F.lit(1)))
    rows = cut_lineage(rows.withColumn("_bucket", F.floor(uniform("bucket", ident) * F.col("_of")).cast("int")).drop("_of"))
    labelled = F.lit(0) if labels_of is None else F.count_if(F.col(group) == labels_of)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), labelled.alias("_labelled"))
    # In order of bucket; at most MAX_BUCKETS numbers for a key.
    listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bucket", "_n", "_labelled"))).alias("_sizes"))
    work = counts.drop("_n", "_labelled")
    work = attach_measured(work, listed, keys) if keys else work.withColumn("_sizes", listed.scalar())
    # Renamed onto themselves: both sides of the cogroup come from the same rows.
    work = work.select(*keys, "_bucket", "_sizes").toDF(*keys, "_bucket", "_sizes")
    names = [f"{kind}_{i}" for i in range(len(sides)) for kind in ("weight", "total")]
    kinds = [T.LongType(), T.DoubleType()] * len(sides)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def draw(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=schema.names)
        own = own.sort_values(ident, kind="stable")
        x = own[value].to_numpy(dtype=float)
        side = np.stack([np.ones(len(own)) if group is None else (own[group] == s).to_numpy(float) for s in sides], axis=1)
        listed = told["_sizes"].iloc[0]
        order, sizes = np.array([b["_bucket"] for b in listed]), np.array([b["_n"] for b in listed])
        take = None if labels_of is None else sum(b["_labelled"] for b in listed)
        place, labels, whole = int(np.searchsorted(order, key[-1])), [seed, *key[:-1]], x.sum()
        out = np.zeros((reps, 2 * len(sides)))
        for rep in range(1, reps + 1):
            n = bucket_draws(sizes, place, rep, *labels, draws=take)
            rng = _seeded(*labels, rep, "rows", place)
            if take is None:
                weight = np.bincount(rng.integers(len(x), size=n), minlength=len(x))
                out[rep - 1, 0::2] = weight @ side
                out[rep - 1, 1::2] = (weight * x) @ side
            else:
                got = x[rng.choice(len(x), n, replace=False, shuffle=False)].sum()
                out[rep - 1] = n, got, len(x) - n, whole - got
        frame = pd.DataFrame({"rep": np.arange(1, reps + 1, dtype=np.int32)})
        for k, v in zip(keys, key):
            frame[k] = v
        for i, n in enumerate(names):
            frame[n] = out[:, i].astype(np.int64) if i % 2 == 0 else out[:, i]
        return frame[schema.names]

    by = [*keys, "_bucket"]
    found = spread(rows, *by).groupBy(*by).cogroup(spread(work, *by).groupBy(*by)).applyInPandas(draw, schema)
    return found.groupBy(*keys, "rep").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_mean(df: DataFrame, ident: str, value: str, reps: int, seed: int, keys: Sequence[str] = (), method: str = "rows") -> DataFrame:
    """Mean of each bootstrap replicate."""
    usable = df.where(F.col(value).isNotNull()).select(*keys, ident, value)
    if method == "buckets":
        sums = _bucketed(usable, list(keys), ident, value, None, [""], reps, seed)
        return sums.select(*keys, "rep", safe_divide(F.col("total_0"), F.col("weight_0")).alias("stat"), F.col("weight_0").alias("n_draws"))
    drawn = _resample(usable, list(keys), ident, reps, seed, method)
    mean = safe_divide(F.sum(F.col("weight") * F.col(value)), F.sum("weight"))
    return drawn.groupBy(*keys, "rep").agg(mean.alias("stat"))


def bootstrap_diff(df: DataFrame, ident: str, group: str, value: str, a: str, b: str, reps: int, seed: int, keys: Sequence[str] = (), method: str = "rows") -> DataFrame:
    """Difference in means of each replicate, both groups resampled jointly."""
    usable = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    if method == "buckets":
        sums = _bucketed(usable, list(keys), ident, value, group, [a, b], reps, seed)
        side = lambda i: safe_divide(F.col(f"total_{i}"), F.col(f"weight_{i}"))
        return sums.select(*keys, "rep", (side(0) - side(1)).alias("stat"), (F.col("weight_0") + F.col("weight_1")).alias("n_draws"))
    drawn = _resample(usable.select(*keys, ident, group, value), list(keys), ident, reps, seed, method)
    return drawn.groupBy(*keys, "rep").agg(_gap(group, value, a, b, F.col("weight")).alias("stat"))


def percentile_ci(stats: DataFrame, level: float, keys: Sequence[str] = (), value: str = "stat") -> DataFrame:
    """Percentile interval over replicates (at most a few thousand per key)."""
    low, high = (1 - level) / 2, (1 + level) / 2
    return stats.groupBy(*keys).agg(F.percentile(value, low).alias("lower_ci"), F.percentile(value, high).alias("upper_ci"))


def resampling_chart(stats: DataFrame, level: float, bins: int = 30, value: str = "stat") -> DataFrame:
    """(bin, x, n, lower_ci, upper_ci): histogram of the replicates with the interval to mark in it."""
    settled = cut_lineage(stats.select(value))
    ends = value_range(settled, value).select(F.struct("lowest", "range").alias("e"))
    interval = percentile_ci(settled, level, value=value).select(F.struct("lower_ci", "upper_ci").alias("i"))
    counts = histogram(settled, value, bins).withColumn("_e", ends.scalar()).withColumn("_i", interval.scalar())
    x = F.col("_e.lowest") + (F.col("bin") + 0.5) * F.col("_e.range") / F.lit(float(bins))
    return counts.select("bin", x.alias("x"), "n", "_i.lower_ci", "_i.upper_ci")


def permute_null(df: DataFrame, ident: str, group: str, value: str, a: str, b: str, reps: int, seed: int, keys: Sequence[str] = (), key_rows: int | None = None, method: str = "bins") -> DataFrame:
    """Difference in means after shuffling labels within each replicate.

    ``bins``: a shuffled label goes to the ``n_a`` rows with the smallest hash.  Where that cut
    lies is found from bin counts, so neither labels nor rows are shuffled:
    only counts and sums per bin, and the rows of one narrow bin per replicate.
    ``key_rows`` bounds the number of keys (traits).

    ``buckets``: rows stay in hashed buckets, where each replicate draws the labels that fall to the bucket,
    how many in each being split by hypergeometric counts; no row is copied per replicate.  The two
    halves of a key may have up to 10^9 rows each.
    """
    rows, keys = _settled(df, ident, group, value, a, b, keys)
    if method == "buckets":
        return _null_of_buckets(rows, ident, group, value, a, reps, seed, keys).drop("_one")
    if method != "bins":
        raise ValueError(f"unknown permutation method {method}")
    return _null(rows, ident, group, value, a, reps, seed, keys, 1 if keys == ["_one"] else key_rows).drop("_one")


def _settled(df: DataFrame, ident: str, group: str, value: str, a: str, b: str, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The few columns a test needs, written once: they are read three times."""
    keys = list(keys) or ["_one"]
    usable = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    if keys == ["_one"]:
        usable = usable.withColumn("_one", F.lit(0))
    return cut_lineage(usable.select(*keys, ident, group, value)), keys


def _null_of_buckets(usable: DataFrame, ident: str, group: str, value: str, a: str, reps: int, seed: int, keys: list[str]) -> DataFrame:
    sums = _bucketed(usable, keys, ident, value, group, ["", ""], reps, seed, labels_of=a)
    side = lambda i: safe_divide(F.col(f"total_{i}"), F.col(f"weight_{i}"))
    return sums.select(*keys, "rep", (side(0) - side(1)).alias("stat"), F.col("weight_0").alias("n_labels"))


def _null(usable: DataFrame, ident: str, group: str, value: str, a: str, reps: int, seed: int, keys: list[str], key_rows: int | None) -> DataFrame:
    by = [*keys, "rep"]
    sizes = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_of"), F.count_if(F.col(group) == a).alias("_take"), F.sum(value).alias("_sum")
    )
    copies = _replicated(usable.select(*keys, ident, value), ident, reps, seed, keys != ["_one"])
    rows = attach(copies, sizes, keys, key_rows).withColumn("_b", cut_bin())
    upto = Window.partitionBy(*by).orderBy("_b")
    bins = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    found = (
        attach(bins, sizes, keys, key_rows)
        .withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_below", F.sum("_s").over(upto) - F.col("_s"))
        .where((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take")))
        .withColumn("_nth", F.col("_take") - F.col("_upto") + F.col("_n"))
    )
    edge = attach(rows.select(*by, "_b", "_u", ident, value), found, [*by, "_b"], reps * key_rows if key_rows else None, "inner")
    order = Window.partitionBy(*by).orderBy("_u", ident)
    taken = (
        edge.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= F.col("_nth"))
        .groupBy(*by, "_take", "_of", "_sum", "_below")
        .agg(F.sum(value).alias("_edge"))
        .withColumn("_got", F.col("_below") + F.col("_edge"))
    )
    rest = safe_divide(F.col("_sum") - F.col("_got"), F.col("_of") - F.col("_take"))
    return taken.select(*by, (F.col("_got") / F.col("_take") - rest).alias("stat"))


def p_value(df: DataFrame, ident: str, group: str, value: str, a: str, b: str, reps: int, seed: int, keys: Sequence[str] = (), key_rows: int | None = None, method: str = "bins") -> DataFrame:
    """One-sided permutation p-value on the side of the observed difference.

    Differences are compared to nine decimals, so replicates that equal the
    observed one count as such whatever the order of summation.
    """
    rows, keys = _settled(df, ident, group, value, a, b, keys)
    seen = observed_diff(rows, group, value, a, b, keys)
    if method == "buckets":
        null = _null_of_buckets(rows, ident, group, value, a, reps, seed, keys)
    elif method == "bins":
        null = _null(rows, ident, group, value, a, reps, seed, keys, 1 if keys == ["_one"] else key_rows)
    else:
        raise ValueError(f"unknown permutation method {method}")
    stat, diff = F.round("stat", 9), F.round("diff", 9)
    side = F.when(F.col("diff") > 0, stat >= diff).otherwise(stat <= diff)
    out = null.join(seen, keys).groupBy(*keys, "diff").agg(F.avg(side.cast("int")).alias("p_value"))
    return out.withColumn("side", F.when(F.col("diff") > 0, "right").otherwise("left")).drop("_one")


def confidence_interval(df: DataFrame, ident: str, group: str, value: str, a: str, b: str, reps: int, seed: int, level: float, keys: Sequence[str], method: str = "rows") -> DataFrame:
    """Percentile interval of the difference for every trait in one job."""
    return percentile_ci(bootstrap_diff(df, ident, group, value, a, b, reps, seed, keys, method), level, keys)
