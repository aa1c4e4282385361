"""Risk-controlled rules and the compression classifier."""

import math
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from surveyloom.llm import compression, quality_rules as rules
from .conftest import edge_rows


def slow_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + o for places in windows.values() if len(places) > 1 for i in places for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    return len(words), chars, sum(text.count(c) for c in rules.SYMBOLS), text.count("!"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures(edges, nothing):
    got = sorted(((r["doc_id"], *(r[m] for m in rules.MEASURES)) for r in rules.measure(edges).collect()), key=repr)
    assert got == sorted(((r[0], *slow_measures(r[1])) for r in edge_rows()), key=repr)
    assert rules.measure(nothing).count() == 0


def test_measures_of_repetitive_texts(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choices("ab", k=n)) + "\n" + "c! " * (n % 5) for n in range(0, 90)] + ["x\x0by\x0cz x y z # # x y z\r\n \n# #"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: tuple(r[m] for m in rules.MEASURES) for r in rules.measure(docs).collect()}
    assert got == {i: slow_measures(t) for i, t in enumerate(texts)}


def exact_cdf(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_bound(spark):
    cells = [(k, n) for n in (1, 5, 40, 900) for k in (0, 1, 2, 7, 10) if k <= n]
    frame = spark.createDataFrame(cells, "k long, n long").select("k", "n", rules.binomial_cdf("k", "n", 0.0125).alias("p"))
    for r in frame.collect():
        want = exact_cdf(r["k"], r["n"], 0.0125) if r["k"] < r["n"] * 0.0125 else 1.0
        assert r["p"] == pytest.approx(want, rel=1e-9)
    large = spark.createDataFrame([(11_800, 1_000_000)], "k long, n long").select(rules.binomial_cdf("k", "n", 0.0125)).first()[0]
    assert 0 < large < 1e-8  # 6.3 standard deviations below the mean


def corpus(spark, n=6000, noisy=0.002, seed=1):
    """Good prose and symbol-ridden texts; some good ones have symbols too."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        good = i % 4 > 0
        words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(60)]
        if not good or draw.random() < noisy / 4:
            words = [w + "**" for w in words]
        rows.append((i, " ".join(words), ["en", "fr"][i % 2], int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return frame.drop("quality"), frame.select("doc_id", "quality")


def test_rules_keep_their_promise(spark, folder):
    docs, labels = corpus(spark)
    judged = rules.apply_rules(docs, labels, folder).join(labels, "doc_id")
    lost = judged.groupBy("stratum").agg(F.avg(F.when((F.col("quality") == 1) & ~F.col("base_failed"), (~F.col("kept")).cast("int")))).collect()
    assert all(share < rules.RISK for _, share in lost)
    assert judged.where("quality = 0 and kept").count() == 0
    assert rules.keep_documents(docs, labels, folder + "/keep").count() == judged.where("kept").count()


def test_no_cutoff_without_evidence(spark, folder):
    docs, labels = corpus(spark, n=60)
    assert rules.apply_rules(docs, labels, folder).where("kept = base_failed").count() == 0
    risky, held = corpus(spark, noisy=1.2)  # a third of the good texts have symbols: no cutoff is safe
    assert rules.apply_rules(risky, held, folder + "/risky").where("kept = base_failed").count() == 0


def test_rules_on_edges(edges, nothing, spark, folder):
    labels = spark.createDataFrame([(9, 1), (9, 0), (3, None), (None, 1)], "doc_id long, quality int")
    judged = rules.apply_rules(edges, labels, folder)
    assert judged.count() == edges.count() and judged.where("kept is null or base_failed is null").count() == 0
    kept = rules.keep_documents(edges, labels, folder + "/keep")
    assert kept.columns == edges.columns and kept.count() == judged.where("kept").count()
    assert rules.keep_documents(nothing, labels, folder + "/none").count() == 0
    assert rules.keep_documents(edges, labels.limit(0), folder + "/free").count() == kept.count()


def learn():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1


def test_classifier_on_held_out_rows(spark):
    docs, labels = corpus(spark, n=1200, noisy=0)
    model = compression.fit(docs, labels, learn())
    scored = compression.score(docs, model).join(labels, "doc_id").where(~learn()).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)


def test_classifier_learns_admitted_rows_only(spark):
    docs, labels = corpus(spark, n=600, noisy=0)
    wrong = labels.withColumn("quality", F.when(learn(), F.col("quality")).otherwise(1 - F.col("quality")))
    one, two = compression.fit(docs, labels, learn()), compression.fit(docs, wrong, learn())
    assert one["good"] == two["good"] and one["bad"] == two["bad"] and (one["weights"] == two["weights"]).all()


@pytest.mark.parametrize("labels, constant", [([], 0.5), ([(0, 1), (3, 1)], 1.0), ([(0, None)], 0.5)])
def test_classifier_without_two_sides(spark, edges, labels, constant):
    model = compression.fit(edges, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
    got = compression.score(edges, model).collect()
    assert len(got) == edges.count() and {r["score"] for r in got} == {constant}


def test_classifier_on_edges(spark, edges, nothing):
    docs, labels = corpus(spark, n=600, noisy=0)
    model = compression.fit(docs, labels, learn())
    got = compression.score(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    assert compression.score(nothing, model).count() == 0


def test_scores_are_those_of_plain_compressors(spark, edges):
    docs, labels = corpus(spark, n=600, noisy=0)
    model = compression.fit(docs, labels, learn())
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    sides = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(model[k]), write_content_size=False, write_checksum=False) for k in ("good", "bad")]

    def slow_score(text):
        raw = (text or "").encode()
        good, bad, none = (len(c.compress(raw)) for c in (*sides, plain))
        n = len(raw) + 20
        x = [(bad - good) / n, good / n, bad / n, none / n, math.log(n)]
        z = model["weights"][0] + sum(w * (v - m) / s for w, v, m, s in zip(model["weights"][1:], x, model["mean"], model["sd"]))
        return 1 / (1 + math.exp(-max(-500, min(500, z))))

    for table in (docs, edges):
        got = sorted(((r["doc_id"], r["score"]) for r in compression.score(table, model).collect()), key=repr)
        want = sorted(((r["doc_id"], slow_score(r["text"])) for r in table.select("doc_id", "text").collect()), key=repr)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-12)


def test_dictionaries_see_whole_texts(spark):
    """Pieces come from all over a long text; a short one is whole."""
    long = "".join(chr(0x4E00 + i) for i in range(20000))
    rows = [(i, long) for i in range(400)] + [(1000, "short"), (1001, None), (1002, "x" * 2000)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", compression._pieces(F.col("text"), F.col("doc_id")).alias("p")).collect()
    pieces = {r["doc_id"]: r["p"] for r in got}
    assert pieces[1000] == ["short"] and pieces[1001] == [""] and pieces[1002] == ["x" * 2000]
    places = [long.index(p[:1]) for i in range(400) for p in pieces[i]]
    assert all(len(p) == compression.PIECE_CHARS and p in long for i in range(400) for p in pieces[i])
    assert len(places) == 3200 and min(places) < 200 and max(places) > 19500 and 8500 < np.median(places) < 11500
