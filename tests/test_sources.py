"""Typed readers and the CSV writer."""

from pyspark.sql import functions as F

from surveyloom import model
from surveyloom.sources import readers, writers


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "Q1_A_1", "Very Accurate"), ("2", "Q1_A_1", None)]
    frame = spark.createDataFrame(rows, model.RESPONSES)
    path = str(tmp_path / "answers")
    writers.write_table_csv(frame, path, ["id", "item", "answer"], [F.col("id").desc()])
    back = readers.read_responses(spark, path, fmt="csv")
    assert sorted(map(tuple, back.collect())) == rows


def test_item_index_is_text(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([(1, "Q1_A_1", "t", "c")], "Item int, Question string, Trait string, Content string").write.parquet(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("Item", T.IntegerType()), *model.ITEMS.fields[1:]])
    assert readers.read_items(spark, path, schema).first()["Item"] == "1"


def test_norms(spark):
    assert {r["dimension"]: r["norm"] for r in readers.norms(spark).collect()} == dict(model.NORMS)
