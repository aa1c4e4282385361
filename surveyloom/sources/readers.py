"""Typed readers.  Schemas are declared: nothing is inferred or positional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from surveyloom.model import ITEMS, NORMS, RESPONSES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_responses(spark: SparkSession, path: str, schema: T.StructType = RESPONSES, fmt: str = "parquet") -> DataFrame:
    """Respondent answers from Parquet or headed CSV under a declared schema."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    return reader.parquet(path)


def read_items(spark: SparkSession, path: str, schema: T.StructType = ITEMS, index: str = "Item", fmt: str = "parquet") -> DataFrame:
    """Item dictionary with its index as text."""
    frame = read_responses(spark, path, schema, fmt)
    return frame.withColumn(index, F.col(index).cast("string"))


def norms(spark: SparkSession, rows: list[tuple[str, float]] = NORMS) -> DataFrame:
    """Published norms as a table."""
    return spark.createDataFrame(rows, "dimension string, norm double")
