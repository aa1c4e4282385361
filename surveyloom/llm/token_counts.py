"""Token counts of whole texts, without keeping the tokens.

Tasks read Arrow batches, cut their texts at places the model cannot join across, send
the distinct pieces to the library in batches of about equal bytes, and keep lengths only.

* A null text is an empty one and has no tokens.  A null ``doc_id`` stays null.
* Repeated rows are counted each; other columns of ``docs`` are not read, whatever their names.
* An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from surveyloom.llm import segments


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` of UTF-8, ``n_tokens``, ``over_limit`` (n_tokens > limit)."""

    def count(batches):
        counter = segments.piece_counter(model_path)
        for batch in batches:
            tokens = counter.count(batch.column(1))
            _, offsets = segments.text_bytes(batch.column(1))
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return docs.select(id_col, text_col).mapInArrow(count, schema)
