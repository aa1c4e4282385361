"""Screening limits, missingness and scale means on hand-made frames."""

import pytest

from surveyloom import model
from surveyloom.operators import groups, reshape, screening


def test_limits_and_unknown_measures(spark):
    rows = [("in", 0.49, 0.49, 4, 0.9), ("at", 0.5, 0.1, 0, 0.1), ("null", 0.1, 0.1, 0, None), ("bad_null", 0.9, 0.1, 0, None)]
    frame = spark.createDataFrame(rows, "id string, miss_c double, miss_p double, sincere int, infreq double")
    flags = {r["id"]: r["completed_flag"] for r in screening.completion_flag(frame, model.COMPLETION).collect()}
    assert flags == {"in": "Yes", "at": "No", "null": None, "bad_null": "No"}
    assert [r["id"] for r in screening.screen(frame, model.COMPLETION).collect()] == ["in"]
    loose = model.ScreeningRules((model.Limit("miss_c", 0.5, inclusive=True),))
    assert {r["id"] for r in screening.screen(frame, loose).collect()} == {"in", "at", "null"}


def test_missing_counts_absent_and_null_cells(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    cells = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "x"), (2, "b", "y")], "id long, item string, answer string")
    got = {r["id"]: r["miss"] for r in screening.missing_rate(people, cells, 4, "miss").collect()}
    assert got == {1: 0.75, 2: 0.5, 3: 1.0}
    from pyspark.sql import functions as F

    by_item = screening.missing_by_item(cells, people.agg(F.count("id")), ["a", "b", "c"])
    assert {r["item"]: r["n_missing"] for r in by_item.collect()} == {"a": 1, "b": 2, "c": 3}


def test_scale_scores_skip_gaps_and_reverse(spark):
    cells = spark.createDataFrame([(1, "a", 5), (1, "b", 1), (2, "a", 2), (2, "b", None)], "id long, item string, score int")
    key = spark.createDataFrame([("s", "a", 1), ("s", "b", -1)], "scale string, item string, sign int")
    got = {r["id"]: r["score"] for r in screening.scale_scores(cells, key, 2).collect()}
    assert got == {1: 5.0, 2: 2.0}


def test_item_stats_break_ties_by_name(spark):
    cells = [(i, item, s) for i in range(4) for item, s in (("b", 4), ("a", 4), ("c", 1))]
    stats = screening.item_stats(spark.createDataFrame(cells, "id long, item string, score int"))
    assert {r["item"]: r["rank"] for r in stats.collect()} == {"a": 1, "b": 2, "c": 3}
    assert all(r["sd"] == 0.0 for r in stats.collect())


def test_completion_summary_matches_published_table(spark):
    # Partial and complete respondents by role, 66 in all.
    published = {"Tier_1": (10, 9), "Tier_2": (3, 0), "Tier_3": (8, 11), "Tier_4": (8, 17)}
    rows = [(role, 0.0 if i < part else 12.5) for role, (part, done) in published.items() for i in range(part + done)]
    frame = spark.createDataFrame(rows, "role string, duration double")
    from pyspark.sql import functions as F

    got = {r["role"]: (r["partial"], r["complete"], r["total"]) for r in groups.completion_summary(frame, "role", F.col("duration") > 0).collect()}
    assert got == {role: (p, c, p + c) for role, (p, c) in published.items()}


def test_tiny_groups_have_no_spread(spark):
    frame = spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 3.0)], "g string, x double")
    got = {r["g"]: r for r in groups.summary_se(frame, ["g"], "x", ci=0.95).collect()}
    assert got["one"]["sd"] is None and got["one"]["se"] is None and got["one"]["ci"] is None
    assert got["two"]["se"] == pytest.approx(1.0) and got["two"]["ci"] == pytest.approx(12.7062, abs=1e-3)


def test_not_in_keeps_unknown(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r["x"] for r in reshape.filter_not_in(frame, "x", ["a"]).collect()} == {"b", None}


def test_long_keeps_null_and_wide_returns(spark):
    frame = spark.createDataFrame([(1, "x", None), (2, None, "y")], "id long, a string, b string")
    long = reshape.to_long(frame, ["id"], ["a", "b"])
    assert long.count() == 4
    wide = reshape.to_wide(long, ["id"], "item", "answer", ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, "x", None), (2, None, "y")]
