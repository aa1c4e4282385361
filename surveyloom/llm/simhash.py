"""Near duplicates by SimHash, compared bit plane by bit plane.

Fingerprints within ``radius`` bits are linked.  Five blocks of bits cannot all differ within
three bits: at least two agree, so each distinct fingerprint goes to ten buckets, one per pair
of blocks, and nothing within the radius is missed.  Inside a bucket the fingerprints are
stored vertically, 64 to a word and plane.  A query's distances to 64 lanes at once are summed
by carry-save counters of two bits and an overflow; words whose lanes all overflow are
abandoned.  Links become spanning edges inside the task, and components are found over those.

Large buckets are cut into chunks and compared chunk by chunk, in tasks of their own; there is
no cap.  Exact copies are one fingerprint before anything is compared.

* A null text has no words and fingerprint zero, linked like any other.
* A null id is returned, but never names a group that has another id; a group of null ids only
  has a null component.
* Repeated rows are returned each.  Only id and text are read.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh64_intdigest

from surveyloom.llm.common import attach_counted, components, settle, shuffle_partitions, without_rows
from surveyloom.llm.segments import text_bytes

RADIUS = 3
BITS = 64
SEED = 42
BLOCKS = (13, 13, 13, 13, 12)  # bits per block; two of five agree within three differing bits
CHUNK = 8192  # fingerprints of a bucket that one task compares with as many others
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints ----


def fingerprint(raw: bytes, size: int) -> int:
    """Majority of the bits of the shingles' XXH64; lower case is for A-Z only."""
    words = raw.lower().split()  # bytes: ASCII letters and ASCII white space
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, hashes.size, 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size).view(">u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint as a long) of every whole text."""

    def compute(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw, cuts = memoryview(data), offsets.tolist()
            found = [fingerprint(bytes(raw[a:b]), size) for a, b in zip(cuts, cuts[1:])]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), column], ["doc_id", "text_hash", "fingerprint"])

    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fingerprint", T.LongType())]
    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(compute, T.StructType(fields))


# ---- bit-sliced comparison ----


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of all fingerprints, lane i in bit i of word i // 64."""
    words = -(-fps.size // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: fps.size] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _over(stored, masks, shape, radius: int, every: int = 8):
    """Overflow words of the distances: lanes whose count of differing planes is above ``radius``.

    ``stored(b, alive)`` and ``masks(b, alive)`` give plane b and the queries' bit b for the
    words still alive.  A counter of ``radius`` = 3 needs two bits; others start so that they
    overflow at the same count.
    """
    low, high, over = (np.zeros(shape, np.uint64) for _ in range(3))
    if radius in (0, 1, 2):  # start at 3 - radius
        low |= FULL if (3 - radius) & 1 else np.uint64(0)
        high |= FULL if (3 - radius) & 2 else np.uint64(0)
    elif radius != 3:
        raise ValueError("radius is at most 3")
    alive, result = None, np.full(shape, FULL)
    for b in range(BITS):
        differ = stored(b, alive) ^ masks(b, alive)
        carry = low & differ
        low ^= differ
        over |= high & carry
        high ^= carry
        if b % every == every - 1:
            open_words = np.flatnonzero((over != FULL).any(axis=0) if over.ndim == 2 else over != FULL)
            if not open_words.size:
                return result
            if open_words.size < over.shape[-1]:
                alive = open_words if alive is None else alive[open_words]
                low, high, over = low[..., open_words], high[..., open_words], over[..., open_words]
    if alive is None:
        return over
    result[..., alive] = over
    return result


def large_edges(fps: np.ndarray, radius: int = RADIUS, tile: int = 256) -> list[tuple[int, int]]:
    """Spanning edges (i, j) of the links among distinct fingerprints of one bucket."""
    n = fps.size
    store = planes(fps)
    words = store.shape[1]
    lanes = np.full(words, FULL)
    if n % 64:
        lanes[-1] = np.uint64((1 << (n % 64)) - 1)
    near = np.zeros((n, words), np.uint64)
    for lo in range(0, n, tile):
        part = fps[lo : lo + tile]
        bit = [np.where((part >> np.uint64(b)) & np.uint64(1), FULL, np.uint64(0))[:, None] for b in range(BITS)]
        over = _over(lambda b, alive: (store[b] if alive is None else store[b][alive])[None, :], lambda b, alive: bit[b], (part.size, words), radius)
        near[lo : lo + part.size] = ~over & lanes
    # Components by breadth-first search over the words of the neighbour sets; each set is read once.
    left, edges = lanes.copy(), []
    lonely = np.bitwise_count(near).sum(axis=1) == 1
    for i in np.flatnonzero(~lonely).tolist():
        if not (int(left[i >> 6]) >> (i & 63)) & 1:
            continue
        left[i >> 6] &= ~np.uint64(1 << (i & 63))
        front = np.array([i])
        while front.size:
            reach = np.bitwise_or.reduce(near[front], axis=0) & left
            left &= ~reach
            front = np.flatnonzero(np.unpackbits(reach.astype("<u8").view(np.uint8), bitorder="little"))
            edges += [(i, j) for j in front.tolist()]
    return edges


def small_edges(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Spanning edges, as places in ``fps``, of many buckets of at most 64 fingerprints each.

    A bucket is one word per plane; all buckets are compared at once, one query lane at a time.
    """
    sizes = np.diff(np.append(starts, fps.size))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    slots = np.zeros((starts.size, 64), np.uint64)
    lane = np.arange(64)
    filled = lane < sizes[:, None]
    slots[filled] = fps[(starts[:, None] + lane)[filled]]
    store = planes(slots.reshape(-1))  # one word per bucket
    full = np.where(sizes == 64, FULL, (np.uint64(1) << sizes.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    pairs = []
    for i in range(int(sizes.max(initial=0)) - 1):
        m = int(np.searchsorted(-sizes, -i, "left"))  # buckets with more than i fingerprints
        query = slots[:m, i]

        def mask(b, alive, query=query):
            q = query if alive is None else query[alive]
            return np.where((q >> np.uint64(b)) & np.uint64(1), FULL, np.uint64(0))

        over = _over(lambda b, alive, m=m: store[b, :m] if alive is None else store[b, :m][alive], mask, (m,), radius)
        later = FULL ^ np.uint64((1 << (i + 1)) - 1)
        near = ~over & full[:m] & later
        hit = np.flatnonzero(near)
        if hit.size:
            bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, to = np.nonzero(bits)
            pairs.append(np.stack([starts[hit[row]] + i, starts[hit[row]] + to], axis=1))
    return _spanning(np.concatenate(pairs)) if pairs else np.zeros((0, 2), np.int64)


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """Edges (root, node) with the same components as ``pairs``."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(nodes.size))
    return np.stack([nodes[label[moved]], nodes[moved]], axis=1)


def _bucket_edges(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(starts, fps.size))
    left, right = [], []
    big = np.flatnonzero(sizes > 64)
    for k in big.tolist():
        own = fps[starts[k] : starts[k] + sizes[k]]
        edges = np.array(large_edges(own), np.int64).reshape(-1, 2)
        left.append(own[edges[:, 0]])
        right.append(own[edges[:, 1]])
    small = np.flatnonzero((sizes <= 64) & (sizes > 1))
    for k in range(0, small.size, 4096):
        part = small[k : k + 4096]
        size = sizes[part]
        at = np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = fps[at]
        edges = small_edges(own, np.cumsum(size) - size)
        left.append(own[edges[:, 0]])
        right.append(own[edges[:, 1]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _edges_of_sorted(batches):
    """Spanning edges of buckets that arrive sorted, whole buckets at a time."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(keys, fps):
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        a, b = _bucket_edges(fps, starts)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        last = int(np.flatnonzero(key == key[-1])[0])
        if last:
            yield out(key[:last], fps[:last])
        held_key, held_fp = key[last:], fps[last:]
    if held_key.size:
        yield out(held_key, held_fp)


# ---- the whole job ----


def links(distinct: DataFrame, folder: str) -> DataFrame:
    """Spanning edges (a, b) between distinct fingerprints (column ``fingerprint``) within the radius."""
    spark = distinct.sparkSession
    ends = np.cumsum(BLOCKS)
    keys = []
    for table, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        def block(k):
            return F.shiftrightunsigned("fingerprint", int(ends[k] - BLOCKS[k])).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1))

        keys.append(F.shiftleft(F.shiftleft(block(i), 13).bitwiseOR(block(j)), 4).bitwiseOR(F.lit(table)))
    tables = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("bucket"))
    sizes = settle(tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), folder, "bucket-sizes")
    members = attach_counted(tables, sizes, ["bucket"], "n", how="inner")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = members.select("fingerprint", "bucket", chunks.alias("m"), F.pmod(F.xxhash64("fingerprint"), chunks).cast("int").alias("c"))
    small = members.where("m = 1").select("bucket", "fingerprint", F.lit(0).alias("i"), F.lit(0).alias("j"))
    pairs = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda o: o != F.col("c"))
    large = members.where("m > 1").select("bucket", "fingerprint", "c", F.explode(pairs).alias("o"))
    large = large.select("bucket", "fingerprint", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    work = small.unionByName(large).select(F.xxhash64("bucket", "i", "j").alias("key"), "fingerprint")
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    work = work.repartition(n, "key").sortWithinPartitions("key")
    return work.mapInArrow(_edges_of_sorted, "a long, b long")


def groups(docs: DataFrame, folder: str, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, text_hash, fingerprint, first), first being the least row of its component:
    a struct of no_id, doc_id and text_hash."""
    marked = settle(fingerprints(docs, size, id_col, text_col), folder, "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = settle(marked.groupBy("fingerprint").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n")), folder, "distinct")
    edges = settle(links(distinct.select("fingerprint"), folder), folder, "links")
    roots = components(edges, folder)
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = settle(named.select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root")), folder, "rooted")
    least = settle(named.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("k")), folder, "least")
    found = attach_counted(named, least, ["root"], "k", spread_by=["fingerprint"])
    found = settle(found.select("fingerprint", "n", "first"), folder, "groups")
    return attach_counted(marked, found, ["fingerprint"], "n", spread_by=["doc_id", "text_hash"]).select("doc_id", "text_hash", "fingerprint", "first")


def near_duplicates(docs: DataFrame, folder: str, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, fingerprint, component_id); a component is named by its smallest id."""
    return groups(docs, folder, size, id_col, text_col).select("doc_id", "fingerprint", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, folder: str, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with its columns: that of the smallest id, then of the smallest text hash."""
    return keep_first(docs, settle(groups(docs, folder, size, id_col, text_col), folder, "judged"), folder, id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are the first of their component; ``found`` is settled, with doc_id, text_hash and first."""
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    keys = [F.col(id_col), F.xxhash64(text_col)]
    kept = without_rows(docs, found.where(~own.eqNullSafe(F.col("first"))).select("doc_id", "text_hash"), keys)
    repeated = found.where(own.eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    repeated = settle(repeated, folder, "repeated-rows")
    if repeated.isEmpty():
        return kept
    single = without_rows(kept, repeated, keys)
    again = kept.join(repeated.toDF("_a", "_b"), F.col(id_col).eqNullSafe(F.col("_a")) & (F.xxhash64(text_col) == F.col("_b")), "left_semi")
    return single.unionByName(again.dropDuplicates([id_col, text_col]))
