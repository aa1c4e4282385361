"""Shared folders, settled tables, joins that survive hot keys, connected components."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from surveyloom.session import shared_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the session's JVM ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later stages start from files."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession, folder: str, name: str) -> None:
    """Remove a settled table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# A key is hot when it holds over 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys can be.
HOT_SHARE = 1000


def attach_counted(df: DataFrame, stats: DataFrame, keys: list[str], rows: str, how: str = "left", spread_by: list[str] | None = None) -> DataFrame:
    """Join per-key ``stats`` back to ``df`` without gathering a hot key's rows.

    ``stats`` has one row per key and must be a settled table; its column ``rows``
    says how many rows of ``df`` have the key at most.  Keys with over a
    thousandth of all rows, fewer than a thousand by arithmetic, are broadcast;
    rows that met one are spread by hash in the shuffled join of the others.
    Null keys meet no statistics.  ``how`` is ``left`` or ``inner``.
    """
    total = stats.agg(F.sum(rows)).first()[0] or 0
    values = [c for c in stats.columns if c not in keys]
    hot = stats.where(F.col(rows) * HOT_SHARE > F.lit(total)).select(*keys, F.struct(*values).alias("_hot"))
    cold = stats.where(F.col(rows) * HOT_SHARE <= F.lit(total)).select(*keys, F.struct(*values).alias("_cold"), F.lit(0).alias("_salt"))
    keep = [c for c in df.columns if c not in values]
    marked = df.select(*keep).join(F.broadcast(hot), keys, "left")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    away = F.col("_hot").isNotNull() | missing
    by = F.xxhash64(*(spread_by or keep))
    marked = marked.withColumn("_salt", F.when(away, F.pmod(by, F.lit(4093)) + 1).otherwise(0).cast("int"))
    joined = marked.join(cold, [*keys, "_salt"], "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    joined = joined.select(*keep, found.alias("_found"))
    if how == "inner":
        joined = joined.where(F.col("_found").isNotNull())
    return joined.select(*keep, *[F.col(f"_found.{c}").alias(c) for c in values])


def without_rows(docs: DataFrame, away: DataFrame, keys: list) -> DataFrame:
    """The rows of ``docs`` whose keys, null or not, are no row of ``away``; their columns may have any names.

    Merged at every size, as ``away`` grows with the documents.
    """
    names = [f"k{i}" for i in range(len(keys))]
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[k.alias(n) for k, n in zip(keys, names)])
    gone = away.distinct().toDF(*[f"away_{n}" for n in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"away_{n}"))
    return packed.join(gone.hint("merge"), same, "left_anti").select("row.*")


def components(edges: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node reachable.

    Alternating large-star and small-star steps on settled edge tables: nothing is
    collected, and a hub's edges stay spread (see :func:`attach_counted`).
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current, turn, before = settle(pairs, folder, "cc-0"), 0, None

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    while True:
        turn += 1
        both = current.union(current.select("v", "u")).toDF("u", "v")
        low = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), folder, f"cc-low-{turn}")
        low = low.withColumn("m", F.least("m", "u"))
        star = attach_counted(both.where("v > u"), low, ["u"], "n", spread_by=["u", "v"])
        large = settle(star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), folder, f"cc-large-{turn}")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), folder, f"cc-least-{turn}")
        star = attach_counted(large, low, ["u"], "n", spread_by=["u", "v"])
        small = star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        following = settle(small.where("u > v").distinct(), folder, f"cc-{turn}")
        now = mark(following)
        if now == before:
            break
        if turn > 1:
            for name in (f"cc-{turn - 2}", f"cc-low-{turn - 1}", f"cc-large-{turn - 1}", f"cc-least-{turn - 1}"):
                drop_settled(spark, folder, name)
        current, before = following, now
    roots = following.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return following.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
