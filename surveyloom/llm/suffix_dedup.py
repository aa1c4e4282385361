"""Removing bytes covered by long strings that also start elsewhere.

A string of ``length`` bytes is repeated when it starts at two places or more of the corpus, in one
document or in several.  Every byte that a repeated string covers is removed.

1. *Routing.*  In each string of ``length`` bytes the 64-byte gram of least hash, the first of
   equals, is its anchor.  Equal strings have equal anchors at equal places, so the
   strings of one anchor can be compared apart from all others.  Neighbouring strings that share
   an anchor form a piece, about 570 bytes for 170 strings.
2. *Pieces.*  Anchors seen once are dropped.  Of equal pieces one remains with its count; a piece seen
   twice or more is repeated as it stands, every string of it.
3. *Suffix arrays.*  The different pieces of anchors are laid into shards, with a byte between
   that no UTF-8 text holds.  A shard's suffix array is built by induced sorting, and common
   prefixes tell which strings have a neighbour that agrees for ``length`` bytes.
4. *Removal.*  Marked ranges are merged per document, on the text as it was.

Anchors with very many different pieces are cut into chunks; every two chunks meet in a shard of their
own.  Texts travel compressed.

* A null text is empty.  A null id is an id of its own.  Rows with equal id and text each count as a place,
  and are treated alike.
* Texts shorter than ``length`` are left alone.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from surveyloom.llm import segments
from surveyloom.llm.common import attach_counted, settle, shuffle_partitions
from surveyloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
GRAM = 64
SHARD_BYTES = 1 << 20
CHUNK = 1024  # different pieces of one anchor in a shard, times two when chunks meet
GAP = 0xFF  # in no UTF-8 text


def least_grams(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, gram hashes, place of the least gram for each string of ``length`` bytes)."""
    prefix = segments.prefix_hash(data)
    place = np.arange(data.size - gram + 1)
    hashes = segments.range_hash(prefix, place, place + gram)
    bits = np.uint64(22)  # place within a slice
    least = (hashes >> bits << bits) | place.astype(np.uint64)
    span, step = length - gram + 1, 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: least.size - (span - step)], least[span - step :])
    return prefix, hashes, (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Pieces of the texts of a buffer, slice by slice: (text, start, strings, anchor hash, piece hash)."""
    for lo in range(0, max(0, data.size - length + 1), segments.SLICE):
        hi = min(lo + segments.SLICE, data.size - length + 1)  # starts lo..hi
        own = data[lo : hi + length - 1]
        prefix, hashes, anchor = least_grams(own, length)
        first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        inner = np.clip(offsets[first : last + 1], lo, hi) - lo
        text = np.repeat(np.arange(first, last), np.diff(inner))
        whole = np.arange(lo, hi) + length <= offsets[text + 1]
        cut = np.empty(hi - lo, bool)
        cut[0] = True
        cut[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
        starts = np.flatnonzero(cut)
        count = np.diff(np.append(starts, hi - lo))
        good = whole[starts]
        starts, count = starts[good], count[good]
        if starts.size:
            piece = segments.range_hash(prefix, starts, starts + count + length - 1)
            yield text[starts], starts + lo - offsets[text[starts]], count, hashes[anchor[starts]], piece


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def piece_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, start, strings, anchor, piece) of all texts."""

    def cut(batches):
        for batch in batches:
            data, offsets = segments.text_bytes(batch.column(2))
            for text, start, count, anchor, piece in pieces(data, offsets):
                at = pa.array(text)
                columns = [batch.column(0).take(at), batch.column(1).take(at), _long(start), pa.array(count.astype(np.int32)), _long(anchor), _long(piece)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "start", "strings", "anchor", "piece"])

    id_type = docs.schema[id_col].dataType
    fields = [("id", id_type), ("text_hash", T.LongType()), ("start", T.LongType()), ("strings", T.IntegerType()), ("anchor", T.LongType()), ("piece", T.LongType())]
    rows = docs.where(F.octet_length(text_col) >= LENGTH).select(id_col, F.xxhash64(text_col), text_col)
    return rows.mapInArrow(cut, T.StructType([T.StructField(*f) for f in fields]))


def shard_marks(rows: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(row, starts, ends) of the runs of repeated strings in a shard's pieces, given as (text, number of strings, wanted)."""
    gap = bytes([GAP])
    t = np.frombuffer(gap.join(r[0] for r in rows) + gap, np.uint8)
    order = suffix_array(t)
    size = np.array([len(r[0]) + 1 for r in rows])
    shared = common_prefixes(t, order, np.cumsum(size) - size) >= length
    agrees = shared.copy()  # with the one before; and with the one after:
    agrees[order[:-1]] |= shared[order[1:]]
    out, at = [], 0
    for k, (text, strings, wanted) in enumerate(rows):
        if wanted:
            flag = np.concatenate([[False], agrees[at : at + strings], [False]])
            edge = np.flatnonzero(flag[1:] != flag[:-1])
            if edge.size:
                out.append((k, edge[::2], edge[1::2] - 1 + length))
        at += len(text) + 1
    return out


def compressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_bytes, body): texts as zstandard frames, small enough to be shuffled twice."""

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = segments.text_bytes(batch.column(2))
            raw, cuts = memoryview(data), offsets.tolist()
            body = pa.array([pack.compress(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _long(np.diff(offsets)), body], ["id", "text_hash", "n_bytes", "body"])

    fields = [("id", docs.schema[id_col].dataType), ("text_hash", T.LongType()), ("n_bytes", T.LongType()), ("body", T.BinaryType())]
    rows = docs.select(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), text_col)
    return rows.mapInArrow(squeeze, T.StructType([T.StructField(*f) for f in fields]))


def _by_document(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Join per-document lists on (id, text_hash), ids null or not."""
    right = lists.toDF("own_id", "own_hash", *lists.columns[2:])
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    return docs.join(right, same, how)


def repeated_ranges(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, lo, hi): byte ranges that repeated strings cover; ranges may overlap."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    rows = settle(piece_rows(docs, id_col, text_col), folder, "pieces")
    seen = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = settle(seen, folder, "anchors")
    common = settle(attach_counted(rows, seen, ["anchor"], "n", how="inner", spread_by=["id", "text_hash", "start"]).drop("n"), folder, "common")
    where = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "start", "strings")
    different = settle(common.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("c"), F.min(where).alias("at")), folder, "different")
    twice = settle(different.where("c > 1").select("anchor", "piece", "c"), folder, "twice")
    whole = attach_counted(common, twice, ["anchor", "piece"], "c", how="inner", spread_by=["id", "text_hash", "start"])
    whole = whole.select("id", "text_hash", F.col("start").alias("lo"), (F.col("start") + F.col("strings") + LENGTH - 1).alias("hi"))

    several = settle(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), folder, "several")
    size = (several.agg(F.sum("d")).first()[0] or 0) * (LENGTH + LENGTH // 2)
    shards = max(1, -(-size // SHARD_BYTES))
    members = attach_counted(different, several, ["anchor"], "d", how="inner", spread_by=["piece"])
    chunks = F.ceil(F.col("d") / CHUNK).cast("int")
    members = members.withColumn("m", chunks).withColumn("k", F.pmod(F.xxhash64("piece", F.lit("chunk")), chunks).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda o: o != F.col("k"))
    meets = F.when(F.col("m") == 1, F.array(F.pmod(F.xxhash64("anchor"), F.lit(shards)))).otherwise(
        F.transform(others, lambda o: F.xxhash64("anchor", F.least(o, F.col("k")), F.greatest(o, F.col("k"))).bitwiseOR(F.lit(-(1 << 63))))
    )
    wanted = F.struct(F.col("at.start").alias("start"), F.col("at.strings").alias("strings"), (F.col("c") == 1).alias("wanted"), meets.alias("shards"))
    lists = members.select(F.col("at.id").alias("id"), F.col("at.text_hash").alias("text_hash"), wanted.alias("w"))
    lists = lists.groupBy("id", "text_hash").agg(F.collect_list("w").alias("wants"))  # of one document

    def fetch(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i, (body, wants) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                raw = unpack.decompress(body.as_py())
                for w in wants:
                    text = raw[w["start"] : w["start"] + w["strings"] + LENGTH - 1]
                    out += [(i, s, w["start"], w["strings"], w["wanted"], text) for s in w["shards"]]
            if out:
                at, shard, start, strings, flag, text = zip(*out)
                rows_ = pa.array(at)
                columns = [pa.array(shard, pa.int64()), batch.column(0).take(rows_), batch.column(1).take(rows_), pa.array(start, pa.int64()), pa.array(strings, pa.int32()), pa.array(flag), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "text_hash", "start", "strings", "wanted", "body"])

    def schema(*fields):
        return T.StructType([T.StructField(*f) for f in fields])

    joined = _by_document(compressed(docs, id_col, text_col), lists, "inner")
    fetched = joined.select("id", "text_hash", "body", "wants").mapInArrow(
        fetch, schema(("shard", T.LongType()), ("id", id_type), ("text_hash", T.LongType()), ("start", T.LongType()), ("strings", T.IntegerType()), ("wanted", T.BooleanType()), ("body", T.BinaryType()))
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows_ = list(zip(table.column("body").to_pylist(), table.column("strings").to_pylist(), table.column("wanted").to_pylist()))
        found = shard_marks(rows_) if len(rows_) > 1 else []
        row = np.repeat([k for k, _, _ in found], [lo.size for _, lo, _ in found]).astype(np.int64)
        lo = np.concatenate([np.zeros(0, np.int64), *[x for _, x, _ in found]])
        hi = np.concatenate([np.zeros(0, np.int64), *[x for _, _, x in found]])
        at = pa.array(row)
        start = table.column("start").to_numpy()[row]
        return pa.table({"id": table.column("id").take(at), "text_hash": table.column("text_hash").take(at), "lo": _long(lo + start), "hi": _long(hi + start)})

    fetched = fetched.repartition(shuffle_partitions(spark), "shard")
    partly = fetched.groupBy("shard").applyInArrow(compare, schema(("id", id_type), ("text_hash", T.LongType()), ("lo", T.LongType()), ("hi", T.LongType())))
    return whole.unionByName(partly)


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the same places, runs that touch being one."""
    by = np.argsort(lo, kind="stable")
    lo, reach = lo[by], np.maximum.accumulate(hi[by])
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, lo.size - 1)]


def remove_repeats(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_bytes, n_removed, spans, kept): the removed runs, and the bytes that remain."""
    id_type = docs.schema[id_col].dataType
    ranges = repeated_ranges(docs, folder, id_col, text_col)
    lists = ranges.groupBy("id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))  # of one document
    joined = _by_document(compressed(docs, id_col, text_col), lists, "left").select("id", "n_bytes", "body", "ranges.lo", "ranges.hi")

    def remove(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, spans, kept = [], [], []
            for body, lo, hi in zip(batch.column(2), batch.column(3), batch.column(4)):
                raw = unpack.decompress(body.as_py())
                if lo.as_py():
                    a, b = _merged(lo.values.to_numpy(), hi.values.to_numpy())
                    cuts = [0, *np.stack([a, b], axis=1).reshape(-1).tolist(), len(raw)]
                    kept.append(b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2])))
                    removed.append(int((b - a).sum()))
                    spans.append([{"lo": i, "hi": j} for i, j in zip(a.tolist(), b.tolist())])
                else:
                    kept.append(raw)
                    removed.append(0)
                    spans.append([])
            runs = pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), runs, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    spans = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    fields = [("doc_id", id_type), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", spans), ("kept", T.BinaryType())]
    return joined.mapInArrow(remove, T.StructType([T.StructField(*f) for f in fields]))
