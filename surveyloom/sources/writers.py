"""Writers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame


def write_table_csv(df: DataFrame, path: str, cols: Sequence[str], order: Sequence[str | Column]) -> None:
    """A sorted question table as headed CSV part files."""
    df.orderBy(*order).select(*cols).write.mode("overwrite").option("header", True).csv(path)
