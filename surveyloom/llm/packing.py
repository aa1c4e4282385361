"""Packing documents into training sequences along a space-filling curve.

Each document becomes a hashed vector: every token id has a fixed pseudo-random direction in
four dimensions, and a document's weighted sum of them is scaled to length one.  The four
coordinates give a Hilbert key, so that documents near each other on the curve have similar
tokens.  Documents are range-partitioned and sorted by that key, their ids laid end to end, and
the line of ids is cut every ``length`` ids: no sequence but the last holds padding.

Range bounds come from the keys of a bounded sample; they only balance partitions.  A hash of
id and text extends the key, so that a large group of equal texts is spread.

* A null text is an empty one: its only id is the end id.  Null ids stay null.
* Repeated rows are packed each, other columns are not read, an empty table gives no pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from surveyloom.llm import segments
from surveyloom.llm.common import settle, shuffle_partitions

DIMENSIONS = 4
STEPS = 8  # bits per dimension
TIE_BITS = 31
SAMPLE_PER_PARTITION = 64  # documents whose keys set the range bounds
PARTITION_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    """A fixed direction per token id; rarer ids, which come later in the vocabulary, weigh more."""
    drawn = np.random.Generator(np.random.PCG64(20)).standard_normal((1 << 16, DIMENSIONS))
    return (drawn * np.log2(2 + np.arange(1 << 16))[:, None]).astype(np.float32)


def vectors(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit vectors of documents whose ids lie one after another; zero for documents without ids."""
    out = np.zeros((counts.size, DIMENSIONS), np.float64)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    if full.size:
        table = _directions()
        for d in range(DIMENSIONS):
            out[full, d] = np.add.reduceat(table[ids, d], starts, dtype=np.float64)
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None]


def hilbert_key(points: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n, dims), by Skilling's transform."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (steps - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ t)
            if i:
                x[:, i] = np.where(high, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (steps - 1)
    while q > 1:
        t = np.where(x[:, dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for bit in range(steps - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def curve_key(ids: np.ndarray, counts: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Hilbert key of each document, followed by the tie's bits."""
    cells = np.clip(((vectors(ids, counts) + 1) * (1 << (STEPS - 1))).astype(np.int64), 0, (1 << STEPS) - 1)
    return (hilbert_key(cells) << TIE_BITS) | tie


def pack(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (little-endian, 32 bits), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tie = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << TIE_BITS)).alias("tie")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tie)
    id_type = docs.schema[id_col].dataType
    n_docs, size = docs.select(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    n = max(shuffle_partitions(spark), -(-(size or 0) // PARTITION_BYTES))

    def keys(batches):
        encoder = segments.word_encoder(tokenizer_path)
        for batch in (part for whole in batches for part in segments.parts(whole, 0)):
            ids, counts = encoder.encode(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(curve_key(ids, counts, batch.column(1).to_numpy()))], ["key"])

    share = min(1.0, n * SAMPLE_PER_PARTITION / max(n_docs, 1))
    drawn = rows.where(F.pmod(F.xxhash64("tie"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else rows
    drawn = drawn.select("text", "tie").mapInArrow(keys, "key long")
    cuts = drawn.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    def encode(batches):
        encoder = segments.word_encoder(tokenizer_path)
        squeeze = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u2").tobytes()
        for batch in (part for whole in batches for part in segments.parts(whole, 1)):
            ids, counts = encoder.encode(batch.column(1))
            key = curve_key(ids, counts, batch.column(2).to_numpy())
            raw, stops = ids.astype("<u2").tobytes(), (np.cumsum(counts) * 2).tolist()
            packed = [squeeze.compress(raw[s - 2 * c : s] + end) for s, c in zip(stops, counts.tolist())]
            part = np.searchsorted(bounds, key, "right").astype(np.int32)
            columns = [batch.column(0), pa.array(part), pa.array(key), pa.array(counts + 1), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "key", "n_tokens", "ids"])

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            counts = batch.column(1).to_numpy()
            before = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            columns = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(before), batch.column(0), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "at", "doc_id", "n_tokens", "ids"])

    def struct(**fields):
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])

    long, binary, integer = T.LongType(), T.BinaryType(), T.IntegerType()
    encoded = rows.mapInArrow(encode, struct(doc_id=id_type, part=integer, key=long, n_tokens=long, ids=binary))
    sorted_ = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("key", "doc_id").select("doc_id", "n_tokens", "ids")
    line = settle(sorted_.mapInArrow(place, struct(part=integer, at=long, doc_id=id_type, n_tokens=long, ids=binary)), folder, "line")
    totals = line.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row per partition, of which there are len(bounds) + 1
    first = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first")
    totals = settle(totals.select("part", first), folder, "totals")
    placed = line.join(F.broadcast(totals), "part").select("doc_id", (F.col("first") + F.col("at")).alias("place"), "n_tokens", "ids")

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            place, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pieces = (place + counts - 1) // length - place // length + 1
            row = np.repeat(np.arange(batch.num_rows), pieces)
            nth = np.arange(row.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[row] // length + nth
            lo = np.maximum(sequence * length, place[row])
            hi = np.minimum((sequence + 1) * length, place[row] + counts[row])
            start = lo - place[row]
            ids, at = [], 0
            for packed, k in zip(batch.column(3).to_pylist(), pieces.tolist()):
                own = np.frombuffer(unpack.decompress(packed), "<u2").astype("<u4")
                for j in range(at, at + k):
                    ids.append(own[start[j] : start[j] + hi[j] - lo[j]].tobytes())
                at += k
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(ids, pa.binary()), pa.array(counts[row]), pa.array(sequence), pa.array(lo - sequence * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, struct(doc_id=id_type, start=long, length=long, ids=binary, doc_tokens=long, sequence_id=long, offset=long))
