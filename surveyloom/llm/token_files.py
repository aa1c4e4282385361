"""Token ids in binary shard files, each document compressed by itself.

A shard holds documents in ascending id order::

    head    magic, bytes per id, SHA-256 of the dictionary
    frames  one zstandard frame per document: its ids, little-endian, 2 or 4 bytes each
    index   Arrow stream: doc_id, frame offset, n_tokens
    foot    index offset, magic

One dictionary, trained on serialised id arrays of a bounded sample, is shared by all
frames, so that short documents compress well although each can be read alone.

* A null text is an empty one: its ids are the end id only.  Null ids come first, ties by text.
* Repeated rows are written each.  Other columns are not read.
* An empty table gives no shards.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from surveyloom.llm import segments
from surveyloom.llm.common import settle, shuffle_partitions
from surveyloom.llm.files import open_system, whole_file

MAGIC = b"TOKSHARD"
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 2048  # documents the dictionary is trained on, about
SAMPLE_CHARS = 4096  # of each of them
SHARD_BYTES = 64 << 20  # text bytes per shard, about
LEVEL = 3


def train_dictionary(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from about SAMPLE_DOCS documents drawn by hash; empty when there is nothing to learn.

    Only compression depends on the sample, never what is stored.
    """
    n = docs.count()
    if not n:
        return b""
    drawn = docs if n <= SAMPLE_DOCS else docs.where(F.pmod(F.xxhash64(id_col, F.lit("dictionary")), F.lit(1 << 30)) < F.lit(int((1 << 30) * SAMPLE_DOCS / n) + 1))
    rows = drawn.select(F.substring(text_col, 1, SAMPLE_CHARS).alias("t")).limit(4 * SAMPLE_DOCS).toArrow()
    ids, counts = segments.word_encoder(tokenizer_path).encode(rows.column("t"))
    ends = np.cumsum(counts)
    samples = sorted(ids[e - c : e].tobytes() for e, c in zip(ends, counts) if c)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves serve
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write shards into ``folder``; the settled manifest of the shards is returned.

    Manifest: shard, path, n_docs, n_tokens, and first, the ids of all shards before it.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer_path, id_col, text_col)
    digest = hashlib.sha256(raw).digest()
    with whole_file(f"{folder}/{digest.hex()[:16]}.zdict", 0) as out:
        out.write(raw)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-size // SHARD_BYTES))

    def write(batches):
        context = TaskContext.get()
        shard = context.partitionId()
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        encoder = segments.word_encoder(tokenizer_path)
        known = _dictionary(raw)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_dict_id=False)
        uri = f"{folder}/shard-{shard:06d}.tok"
        end = np.array([end_id], "<u2").tobytes()
        keys, places, lengths = [], [], []
        with whole_file(uri, context.taskAttemptId()) as out:
            out.write(MAGIC + struct.pack("<B", 2) + digest)
            at = len(MAGIC) + 1 + len(digest)
            while batch is not None:
                ids, counts = encoder.encode(batch.column(1))
                raw_ids = ids.astype("<u2").tobytes()
                ends = np.cumsum(counts) * 2
                for stop, c in zip(ends.tolist(), counts.tolist()):
                    frame = pack.compress(raw_ids[stop - 2 * c : stop] + end)
                    out.write(frame)
                    places.append(at)
                    at += len(frame)
                keys.append(batch.column(0))
                lengths.append(counts + 1)
                batch = next(batches, None)
            tokens = np.concatenate(lengths)
            index = pa.table({"doc_id": pa.chunked_array(keys), "at": pa.array(places, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, index.schema) as stream:
                stream.write_table(index)
            out.write(zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue().to_pybytes()))
            out.write(struct.pack("<Q", at) + MAGIC)
        columns = [pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(places)], pa.int64()), pa.array([int(tokens.sum())], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = settle(rows.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), folder, "shards")
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per shard
    return settle(made.withColumn("first", before), folder, "manifest")


class TokenShard:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        system, path = open_system(uri)
        self.file = system.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        size = self.file.size()
        foot = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or foot[8:] != MAGIC:
            raise ValueError(f"{uri} is no whole token shard")
        self.width = head[len(MAGIC)]
        self.digest = head[len(MAGIC) + 1 :]
        with system.open_input_stream(f"{path.rpartition('/')[0]}/{self.digest.hex()[:16]}.zdict") as known:
            raw = known.read()
        if hashlib.sha256(raw).digest() != self.digest:
            raise ValueError(f"the dictionary of {uri} is another one")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        self.end = struct.unpack("<Q", foot[:8])[0]
        index = zstandard.ZstdDecompressor().decompress(self.file.read_at(size - 8 - len(MAGIC) - self.end, self.end))
        self.index = pa.ipc.open_stream(index).read_all()
        self.places = np.append(self.index.column("at").to_numpy(), self.end)

    def ids(self, row: int) -> np.ndarray:
        """Ids of one document, reading its frame only."""
        lo, hi = int(self.places[row]), int(self.places[row + 1])
        return np.frombuffer(self.unpack.decompress(self.file.read_at(hi - lo, lo)), f"<u{self.width}")

    def runs(self, most: int = 4 << 20):
        """(first row, list of id arrays) over the shard, about ``most`` bytes of frames at a time."""
        row = 0
        while row < len(self.places) - 1:
            lo = int(self.places[row])
            stop = max(row + 1, int(np.searchsorted(self.places, lo + most, "right")) - 1)
            block = memoryview(self.file.read_at(int(self.places[stop]) - lo, lo))
            cuts = (self.places[row : stop + 1] - lo).tolist()
            yield row, [np.frombuffer(self.unpack.decompress(block[a:b]), f"<u{self.width}") for a, b in zip(cuts, cuts[1:])]
            row = stop


def read_token_files(manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """Every document of the shards in ``manifest``: doc_id, start, n_tokens, ids (little-endian, 32 bits each)."""
    n = max(shuffle_partitions(manifest.sparkSession), 1)

    def read(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = TokenShard(uri)
                counts = shard.index.column("n_tokens").to_numpy()
                start = first + np.cumsum(counts) - counts
                keys = shard.index.column("doc_id").combine_chunks()
                for row, runs in shard.runs():
                    stop = row + len(runs)
                    columns = [keys.slice(row, stop - row), pa.array(start[row:stop]), pa.array(counts[row:stop])]
                    columns.append(pa.array([r.astype("<u4").tobytes() for r in runs], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    schema = T.StructType(
        [
            T.StructField("doc_id", id_type or T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return manifest.select("path", "first").repartitionByRange(n, "path").mapInArrow(read, schema)


def token_files_of(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder written earlier."""
    return spark.read.parquet(f"{folder}/manifest")
