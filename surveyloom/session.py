"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "surveyloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Have ``folder`` deleted when the session's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would lose data with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        own = tempfile.mkdtemp(prefix="surveyloom-")
        remove_at_end(spark, own)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read files, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Even partitions ahead of work that grows rows or runs in Python.

    Small frames come out of a shuffle in few partitions, sized by bytes; a
    thousand replicates of each row deserve every core.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *cols)


# Largest frame, in rows, that an operator may mark for broadcast.
BROADCAST_ROWS = 100_000


def attach(df: DataFrame, stats: DataFrame, on: list[str], rows: int | None = None, how: str = "left") -> DataFrame:
    """Join per-group statistics back to ``df`` on named keys.

    ``rows`` is an upper bound of the statistics' size known from a declared
    dictionary (items, scales, replicates).  Within :data:`BROADCAST_ROWS` the
    statistics are broadcast and ``df`` does not move; with no bound, or a
    larger one, Spark chooses the join from its own size estimate and splits
    skewed keys at run time.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        stats = F.broadcast(stats)
    return df.join(stats, on, how)


def attach_measured(df: DataFrame, stats: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join per-group statistics whose number of groups is not known beforehand.

    The statistics are settled and counted first: a small table is broadcast, so
    a group holding much of ``df`` is never gathered; a large one is joined
    by shuffle, where run-time skew handling splits such groups.
    """
    settled = cut_lineage(stats)
    return attach(df, settled, on, settled.count(), how)


def with_values(df: DataFrame, one: DataFrame, _on: list[str] | None = None) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery."""
    packed = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", packed).select(*df.columns, "_one.*")
