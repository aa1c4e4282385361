"""The pipeline's stages in a row, against brute force on a small corpus with planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from surveyloom.llm import decontaminate
from .conftest import edge_rows, prose
from .test_dedup import slow_lines
from .test_quality import slow_measures
from .test_simhash import near, roots, slow_fingerprint


def lined(seed, n):
    return "\n".join(prose(seed * 1000 + i, 12).replace("\n", " ") for i in range(n))


def corpus():
    passage, item = lined(1, 4), prose(77, 40)
    texts = {i: lined(10 + i, 8) for i in range(30)}
    texts[30] = texts[3]  # a copy: its lines go, and nothing is left
    texts[31] = lined(60, 6) + "\n" + passage
    texts[32] = lined(61, 6) + "\n" + passage + "\n" + lined(62, 2)
    texts[33] = prose(63, 300).replace("\n", " ")
    texts[34] = texts[33]  # too few lines for line dedup: a group for SimHash
    texts[35] = prose(64, 200) + item
    texts[36] = "short"
    texts[37] = "again and again " * 100
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    return rows, [(0, item)]


def expected(rows, items):
    """Rows that reach the last stage; no labels, so the base rule alone rejects."""
    kept = []
    for r in rows:
        n, _, _, _, _, _, repeated = slow_measures(r[1])
        if n >= 50 and 100 * repeated <= 50 * n:
            kept.append(r)
    kept = [(i, t) for i, t, _, n in slow_lines(kept) if not n or t.strip()]
    root = roots([slow_fingerprint(t) for _, t in kept], near)
    kept = [k for j, k in enumerate(kept) if k[0] == min(kept[m][0] for m in range(len(kept)) if root[m] == root[j])]
    return [k for k in kept if not any(len(q & decontaminate.shingles_of(k[1].encode())) * 5 >= 4 * len(q) for q in [decontaminate.shingles_of(t.encode()) for _, t in items])]


def tables(spark, folder, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, folder):
    rows, items = corpus()
    tables(spark, folder, rows, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.dtypes
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.dtypes == names, name
    want = expected(rows, items)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    gone = set(range(38)) - {i for i, _ in want}
    assert {30, 34, 35, 36, 37} <= gone and not set(range(30)) & gone
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == len(want)


def test_edges_and_empty_tables(spark, folder):
    rows = [r[:5] for r in edge_rows()]
    random.Random(1).shuffle(rows)
    tables(spark, folder, rows, [(1, None), (2, "")])
    assert corpus_pipeline.run(spark, folder).count() > 0
    tables(spark, folder + "/none", [], [])
    assert corpus_pipeline.run(spark, folder + "/none").count() == 0


def test_registered():
    assert corpus_pipeline.queries() == {"pipeline": corpus_pipeline.run} and corpus_pipeline.ORACLE_SQL is None
