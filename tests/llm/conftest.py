import random

import pytest
from pyspark.sql import types as T

from surveyloom.llm.common import work_folder

# Columns whose names operators use inside.
EXTRA = ["n_words", "text_hash", "row", "k", "hash", "fingerprint", "start", "_lines", "stratum", "tie", "part"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.IntegerType()) for c in EXTRA],
    ]
)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    vocabulary = ["the", "of", "and", "Río", "élan", "x1", "it's", "…", "***"] + ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(400)]
    out = [draw.choice(vocabulary) + draw.choice(["", "", "", ",", "."]) for _ in range(words)]
    return "".join(w + ("\n" if i % 13 == 12 else " ") for i, w in enumerate(out))


def edge_rows():
    """Nulls in every column, empty, blank, short and long texts, copies, near copies, repeated rows, shared passages."""
    passage = prose(7, 120)
    near = prose(8, 400)
    texts = [None, "", " \n\t ", "a", "a b", "one two three", "aaaa " * 200, "z" * 3000, prose(1, 60), prose(2, 3000), prose(2, 3000)]
    texts += [passage, prose(3, 80) + "\n" + passage, passage + "\n" + prose(4, 50), near, near + "end", near.replace("the", "teh", 1), prose(5, 20000)]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, prose(6, 90), None, None, None), (None, None, None, None, None), (8, prose(9, 70), "en", "s", 1)]
    return [(*r, *([1] * len(EXTRA))) for r in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark):
    return work_folder(spark, "test")
