"""From raw documents to packed training sequences, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all rows its predecessor kept, and
is written as Parquet and read again before the next.  All but the last return the columns of
``documents``.

* quality_rules: documents that the base rule or a risk-controlled cutoff rejects go.
* line_dedup: passages of three lines and more that stood in an earlier document are taken out;
  documents without a word left go.
* near_duplicates: documents whose fingerprints of three-word shingles differ in at most three bits
  are linked; one document of each component stays, that of the smallest id.
* decontamination: documents that contain a benchmark item go.
* packing: pieces of sequences of at most 2048 tokens, with their ids.

Null and empty texts fail the first stage.  Null ids are carried along.  An empty table gives no
pieces.  Columns of ``documents`` may have any names besides ``doc_id``, ``text`` and ``lang``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from surveyloom.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from surveyloom.llm.common import work_folder
from surveyloom.llm.registry import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"), work_folder(spark, "stage-quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_first_passages(docs, work_folder(spark, "stage-lines"), chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, work_folder(spark, "stage-simhash"), size=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), work_folder(spark, "stage-benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, work_folder(spark, "stage-packing"), TOKENIZER, end_id=1, length=2048)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

# Components of near duplicates and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage having been written to the shared folder and read again."""
    folder = work_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
