"""NULL rules and labels of the scalar functions."""

from datetime import datetime

from pyspark.sql import functions as F

from surveyloom import model
from surveyloom.functions import scores as sc


def column(spark, rows, schema, expr):
    frame = spark.createDataFrame(rows, schema)
    return [r[0] for r in frame.select(expr).collect()]


def test_scale_tables_are_whole():
    rows = model.scale_key_rows()
    assert len(rows) == len({item for _, item, _ in rows}) == 174
    assert len({scale for scale, _, _ in rows}) == 27
    assert sum(sign < 0 for _, _, sign in rows) == len(model.REVERSED_ITEMS) == 20
    assert not any(item.startswith("Q2_") for _, item, _ in rows)
    assert len(model.cognitive_key_rows()) == 25
    assert {k: sum(s == k for s, _, _ in model.cognitive_key_rows()) for k, _ in model.NORMS} == dict.fromkeys(dict(model.NORMS), 5)
    revised = model.revised_key_rows()
    assert len(revised) == 96 and sum(sign < 0 for _, _, sign in revised) == 4
    assert {item for _, item, _ in revised} <= {item for _, item, _ in rows}


def test_likert_labels(spark):
    rows = [(label,) for label, _ in model.LIKERT] + [("Neither Agree Nor Disagree",), ("other",), (None,)]
    got = column(spark, rows, "a string", sc.likert_score(F.col("a")))
    assert got == [5, 4, 3, 2, 1, 5, 4, 3, 2, 1, None, None, None]


def test_unknown_stays_unknown(spark):
    rows = [("E",), ("A",), (None,)]
    assert column(spark, rows, "a string", sc.key_score(F.col("a"), F.lit("E"))) == [1, 0, None]
    assert column(spark, rows, "a string", sc.option_flag(F.col("a"), "E")) == ["Yes", "No", None]
    yes = [("Yes",), ("No",), (None,)]
    assert column(spark, yes, "a string", sc.encode_yes_no(F.col("a"))) == [1, 0, None]
    levels = [("High School",), ("Masters",), ("else",), (None,)]
    assert column(spark, levels, "a string", sc.encode_levels(F.col("a"), {"High School": 0, "Masters": 3})) == [0, 3, 0, None]
    numbers = [(0.5,), (0.0,), (-0.5,), (None,)]
    assert column(spark, numbers, "a double", sc.sign_label(F.col("a"))) == ["positive", "negative", "negative", None]
    assert column(spark, numbers, "a double", sc.signed_score(F.lit(2), F.col("a"))) == [2, 4, 4, None]
    assert column(spark, numbers, "a double", sc.within_limit(F.col("a"), 0.0)) == ["N", "Y", "Y", None]


def test_row_total_propagates_null(spark):
    rows = [(1, 1, 0), (1, None, 1)]
    assert column(spark, rows, "a int, b int, c int", sc.row_total(["a", "b", "c"])) == [2, None]


def test_recode_in_order(spark):
    rows = [("Bachelor's Degree (4 year)",), ("Associate Degree (2 year)",), ("odd",), (None,)]
    got = column(spark, rows, "a string", sc.recode(F.col("a"), model.RECODES["Degree"]))
    assert got == ["Bachelors", "Associates", "odd", None]


def test_collapse_and_override(spark):
    rows = [("T3", "Yes"), ("T4", None), ("T1", "No"), (None, "Yes")]
    schema = "role string, prior string"
    assert column(spark, rows, schema, sc.collapse(F.col("role"), ["T3", "T4"], "T3-4")) == ["T3-4", "T3-4", "T1", None]
    assert column(spark, rows, schema, sc.override_role(F.col("role"), F.col("prior"), True, "T1")) == ["T1", "T4", "T1", "T1"]
    assert column(spark, rows, schema, sc.override_role(F.col("role"), F.col("prior"), False, "T1")) == ["T3", "T4", "T1", None]


def test_duration_and_rounding(spark):
    start = datetime(2024, 1, 1, 10, 0, 0)
    rows = [(start, datetime(2024, 1, 1, 10, 2, 15)), (start, None)]
    got = column(spark, rows, "a timestamp, b timestamp", sc.duration_min(F.col("a"), F.col("b")))
    assert got == [2.25, 0.0]
    shares = [("low", 0.25), ("high", 0.35), ("low", 0.04)]
    got = column(spark, shares, "lvl string, s double", sc.signed_share(F.col("lvl"), F.col("s"), ["low"]))
    assert got == [-0.3, 0.4, 0.0]


def test_headers_levels_and_p_labels(spark):
    rows = [("12_Scale (Q1_A_1)",), ("plain",)]
    assert column(spark, rows, "a string", sc.label_part(F.col("a"), "parentheses")) == ["Q1_A_1", None]
    assert column(spark, rows, "a string", sc.label_part(F.col("a"))) == ["12_Scale", "plain"]
    assert column(spark, [("b",), ("z",), (None,)], "a string", sc.level_order(F.col("a"), ["a", "b"])) == [2, None, None]
    p = [(0.01,), (0.05,), (0.1,), (None,)]
    assert column(spark, p, "p double", sc.p_label(F.col("p"))) == ["p<0.05", "p<0.1", "no_sig", None]
    grades = [(0.81,), (0.8,), (0.41,), (0.21,), (0.2,), (None,)]
    assert column(spark, grades, "g double", sc.letter_grade(F.col("g"))) == ["A", "B", "C", "D", "F", None]
