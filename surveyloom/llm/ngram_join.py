"""Jaccard join of word n-grams: rare-first prefixes, filters on length, position and suffix.

Texts are linked when their sets of three-word shingles have a Jaccard similarity of 0.9 or more.
Such a set of n shingles shares all but n // 10 of them at least, so in one order of all shingles
two linked sets have one of their first n // 10 + 1 in common: the prefix.

* Order: rarest first, by counts over all documents in a fixed array of COUNTERS cells, then by
  hash.  Any order that all sets share misses nothing; a rare-first one leaves common lines, and
  what a family of copies shares, to the end, behind the shingles that only one text has.
* Buckets: the sets with one shingle in their prefixes.  In each, the set with the fewest rarer
  shingles is the hub.  First every set meets the hub it shares most with, one pair per set, filtered as
  below, and components are formed: a family of near copies is one after as many pairs as sets.
* Buckets that hold several components are then compared across them, tile by tile, by length, by
  position (shingles before the first shared one are not shared) and by suffix (counts of shingles
  between fixed pivots differ by no more than the sets do).  A set sends on its best SEND pairs;
  where more are possible, components are formed anew and the next round sends four times as many,
  until none is held back.  Only tiles that held pairs back come to the next round, as all pairs of the
  others were sent.  No pair is verified twice.
* A pair is verified on whole sets.  Those are made again from the texts, only for the sets that a
  bitmap of fixed size admits, so that sets of all texts are never written.

* A text with one or two words is one shingle.  Null texts and texts without words have no
  shingle, are linked with nothing, and are components of their own.
* Null ids and repeated rows are treated as in ``simhash``.  Only id and text are read.
* Shingles and sets are told apart by 64-bit hashes.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from surveyloom.llm.common import attach_counted, components, drop_settled, settle, shuffle_partitions
from surveyloom.llm.decontaminate import shingle_hashes, word_hashes
from surveyloom.llm.segments import parts, text_bytes

SHINGLE = 3
SHARE = (9, 10)  # 0.9, as a fraction; the prefix of n // 10 + 1 shingles belongs to it
COUNTERS = 1 << 24  # cells of the counts that order shingles, a byte each in the tasks
SLICES = 16  # rows in which a task hands its counts on
BINS = 128  # of a set's shingles by hash, for the suffix filter
TILE = 4096  # sets of a bucket in one tile
SEND = 8  # pairs that a set sends on from a tile in the first round
SMALL = 64  # sets of a bucket whose pairs are looked at where the bucket is formed
HOT_ROWS = 1 << 16  # sets that one bucket gathers in a task; shingles with more get several hubs
WORDS_OF_BITMAP = 1 << 18  # 64 bits each
SEEN = 1 << 20  # sets a task remembers

_SPACE = np.ones(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = False


# ---- sets ----


def sets_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text of each, set sizes): the distinct shingles of each text, in order of text and hash."""
    data, offsets = text_bytes(column)
    hashes, number = shingle_hashes(*word_hashes(data, offsets, _SPACE), SHINGLE)
    row = np.repeat(np.arange(number.size), number)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(row.size, bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, row, np.bincount(row, minlength=number.size)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def nodes_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, from the sum of its mixed hashes."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes), dtype=np.uint64)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return _mixed(total[ends[1:]] - total[ends[:-1]] + sizes.astype(np.uint64)).view(np.int64)


# ---- order of shingles ----


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)


def _count(batches):
    total = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for part in parts(batch, 0):
            cells, n = np.unique(_cells(sets_of(part.column(0))[0]), return_counts=True)
            total[cells] += n.astype(np.uint32)
    pack, blobs = zstandard.ZstdCompressor(level=1), []
    for own in np.split(total, SLICES):
        most = own.max()
        blobs.append(pack.compress(own.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The order of the cells in a byte each: logarithms of their counts."""
    return np.minimum(np.log2(counts + 1.0) * 8, 255).astype(np.uint8)


def _add(batches):
    """Slices of one number, one after another, are added; nothing but the sums is held."""
    size, sums = COUNTERS // SLICES, {}
    for batch in batches:
        for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = zstandard.decompress(blob.as_py())
            own = sums.setdefault(number, np.zeros(size, np.int64))
            own += np.frombuffer(raw, {size: "u1", 2 * size: "<u2", 4 * size: "<u4"}[len(raw)])
    for number, own in sums.items():
        hot = np.argsort(-own)[: size // 8]  # the fullest, at most an eighth of the cells
        hot = hot[own[hot] > HOT_ROWS]
        columns = [pa.array([number], pa.int32()), pa.array([ranks_of(own).tobytes()], pa.binary()), pa.array([(hot + number * size).tolist()], pa.list_(pa.int64())), pa.array([own[hot].tolist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "ranks", "hot", "sizes"])


def shingle_ranks(docs: DataFrame, text_col: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The rank of each cell by how many shingles of all documents fall in it, and the cells with over HOT_ROWS of them."""
    parts_of = docs.select(text_col).mapInArrow(_count, "slice int, counts binary").repartition(SLICES, "slice")
    ranks, hot = np.zeros(COUNTERS, np.uint8), []
    for r in parts_of.mapInArrow(_add, "slice int, ranks binary, hot array<long>, sizes array<long>").collect():  # SLICES rows
        at = r["slice"] * (COUNTERS // SLICES)
        ranks[at : at + COUNTERS // SLICES] = np.frombuffer(r["ranks"], np.uint8)
        hot += zip(r["hot"], r["sizes"])
    return ranks, hot


def prefixes(hashes: np.ndarray, row: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, length per text): the first n // 10 + 1 of each set, rarest first, then by hash."""
    order = np.argsort((row << 16) | ranks[_cells(hashes)], kind="stable")
    length = np.where(sizes > 0, sizes // (SHARE[1] // (SHARE[1] - SHARE[0])) + 1, 0)
    place = np.arange(row.size) - (np.cumsum(sizes) - sizes)[row]
    return hashes[order][place < length[row]], length


def bins_of(hashes: np.ndarray, row: np.ndarray, rows: int) -> list[bytes]:
    """Counts of each set by the high bits, in the least of one, two or four bytes that hold them."""
    counts = np.bincount(row * BINS + (hashes >> np.uint64(57)).astype(np.int64), minlength=rows * BINS).reshape(rows, BINS)
    most = counts.max(axis=1, initial=0)
    return [c.astype("u1" if m < 1 << 8 else "<u2" if m < 1 << 16 else "<u4").tobytes() for c, m in zip(counts, most)]


def _mark(ranks: np.ndarray):
    def compute(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in parts(batch, 1):
                hashes, row, sizes = sets_of(part.column(1))
                node = nodes_of(hashes, sizes)
                # A set that this task has handed on already is named only: a thousand copies send one prefix.
                fresh = np.zeros(part.num_rows, bool)
                for i, value in enumerate(node.tolist()):
                    if sizes[i] and value not in seen:
                        fresh[i] = True
                        seen.add(value)
                if len(seen) > SEEN:
                    seen.clear()
                chosen, length = prefixes(hashes, row, sizes, ranks)
                keep = np.repeat(fresh, length)
                ends = np.concatenate([[0], np.cumsum(np.where(fresh, length, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chosen[keep].view(np.int64)))
                bins = [b if f else None for b, f in zip(bins_of(hashes, row, part.num_rows), fresh.tolist())]
                columns = [part.column(0), part.column(2), pa.array(node), pa.array(sizes, pa.int32()), lists, pa.array(bins, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "prefix", "bins"])

    return compute


def marks(docs: DataFrame, ranks: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, node, size, prefix, bins) of every whole text; ``node`` names the set."""
    fields = [("doc_id", docs.schema[id_col].dataType), ("text_hash", T.LongType()), ("node", T.LongType()), ("size", T.IntegerType()), ("prefix", T.ArrayType(T.LongType())), ("bins", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(_mark(ranks), schema)


# ---- buckets and hubs ----


def fits(size, place, other_size, other_place):
    """Whether sets with a shingle at these places of theirs can be linked, if it is the first that they share."""
    needed = least_shared(size, other_size)
    close = np.minimum(size, other_size) * SHARE[1] >= np.maximum(size, other_size) * SHARE[0]
    return close & (np.minimum(size - place, other_size - other_place) >= needed)


def _with_partner(run: np.ndarray, size: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Rows that some other row of their run, of at most ``most`` rows, fits."""
    found = np.zeros(run.size, bool)
    for lag in range(1, min(most, run.size)):
        same = np.flatnonzero(run[lag:] == run[:-lag])
        if not same.size:
            break
        hit = same[fits(size[same], place[same], size[same + lag], place[same + lag])]
        found[hit] = found[hit + lag] = True
    return found


def _buckets(batches):
    """Members of buckets of several sets, with the hub of each: rows sorted by bucket, place and set.

    Of buckets of up to SMALL sets only those leave that another one fits.  Of a larger bucket at
    hand only the hub is held.  Rows of a shingle with several hubs are all sent on.
    A set that several tasks marked comes once, or twice where batches end: that changes no pair.
    """
    held, sent = np.zeros((0, 5), np.int64), False
    for batch in chain(batches, [None]):
        rows = held
        if batch is not None:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)])
        if not len(rows):  # shingle, salt, place, node, size
            continue
        start = np.ones(len(rows), bool)
        start[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        same = ~start
        same[1:] &= rows[1:, 3] == rows[:-1, 3]
        rows, start = rows[~same], start[~same]
        heads, run = np.flatnonzero(start), np.cumsum(start) - 1
        large = np.diff(np.append(heads, len(rows))) > SMALL
        large[0] |= sent
        out = large[run] | (rows[:, 1] >= 0)
        small = np.flatnonzero(~out)
        out[small] = _with_partner(run[small], rows[small, 4], rows[small, 2], SMALL)
        out[0] &= not sent
        last = heads[-1]
        if batch is not None and not large[-1]:
            out[last:] = False  # more of this bucket may come
            held, sent = rows[last:], False
        else:
            held, sent = rows[last : last + 1], True
        # The hub is the first that leaves, or has left.
        hub = np.full(heads.size, -1)
        at = np.flatnonzero(out)[::-1]
        hub[run[at]] = at
        hub[large] = heads[large]
        hub = rows[hub[run]]
        columns = [rows[out, 0], rows[out, 3], *(x[out, k].astype(np.int32) for x, k in ((rows, 4), (rows, 2))), hub[out, 3], *(hub[out, k].astype(np.int32) for k in (4, 2)), rows[out, 1] >= 0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "size", "place", "hub", "hub_size", "hub_place", "salted"])


def bucket_members(marked: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """(shingle, node, size, place, hub, hub_size, hub_place, salted) of the sets that meet one they can be linked with; ``hot`` has the fullest cells."""
    spark = marked.sparkSession
    rows = marked.where(F.size("prefix") > 0).select("node", "size", F.posexplode("prefix").alias("place", "shingle"))
    salt = F.lit(-1)
    if hot:
        # Such a cell may hold a shingle that would gather too many sets in a task.
        spread = spark.createDataFrame([(c, -(-n // HOT_ROWS)) for c, n in hot], "cell long, hubs long")  # at most an eighth of the cells
        cell = F.shiftrightunsigned("shingle", 65 - COUNTERS.bit_length())
        rows = rows.withColumn("cell", cell).join(F.broadcast(spread), "cell", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("node"), F.col("hubs")), F.lit(-1))
    rows = rows.select("shingle", salt.cast("long").alias("salt"), "place", "node", "size")
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(n, "shingle", "salt").sortWithinPartitions("shingle", "salt", "place", "node")
    return rows.mapInArrow(_buckets, "shingle long, node long, size int, place int, hub long, hub_size int, hub_place int, salted boolean")


def hub_pairs(members: DataFrame, marked: DataFrame, folder: str) -> DataFrame:
    """(a, b): every set with the hub it shares most prefix shingles with, hubs of one shingle with the least of them.

    Only pairs that sizes, places and bins allow.
    """
    size, other = F.col("size"), F.col("hub_size")
    needed = F.ceil((size + other) * SHARE[0] / F.lit(sum(SHARE)))
    fits = (F.least(size, other) * SHARE[1] >= F.greatest(size, other) * SHARE[0]) & (F.least(size - F.col("place"), other - F.col("hub_place")) >= needed)
    counted = members.where((F.col("node") != F.col("hub")) & fits).groupBy("node", "hub", "size", "hub_size").agg(F.count(F.lit(1)).alias("k"))
    best = counted.groupBy("node", "size").agg(F.min(F.struct((-F.col("k")).alias("k"), "hub", "hub_size")).alias("best"))
    pairs = best.select(F.col("node").alias("a"), "size", F.col("best.hub").alias("b"), F.col("best.hub_size").alias("other"))
    hubs = members.where("salted").select("shingle", "hub", "hub_place", "hub_size").distinct()
    least = hubs.groupBy("shingle").agg(F.min(F.struct("hub_place", "hub", "hub_size")).alias("least"))
    joined = hubs.join(least, "shingle").where(F.col("hub") != F.col("least.hub"))
    pairs = settle(pairs.union(joined.select("hub", "hub_size", "least.hub", "least.hub_size")).distinct(), folder, "hub-choices")
    bins = settle(bins_of_nodes(marked, _ends(pairs)), folder, "hub-bins")
    for own in ("a", "b"):
        pairs = attach_counted(pairs, bins.select(F.col("node").alias(own), "k", F.col("bins").alias(f"of_{own}")), [own], "k", how="inner").drop("k")
    kept = pairs.select("a", "b", "size", "other", "of_a", "of_b").mapInArrow(_allowed, "a long, b long")
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """(node, k): how many of the pairs (a, b) each node is in."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("k"))


def bins_of_nodes(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the bins of each set."""
    known = marked.where(F.col("bins").isNotNull()).select("node", "bins")
    return known.join(nodes.hint("merge"), "node").dropDuplicates(["node"])


def _allowed(batches):
    """Pairs (a, b) whose bins differ by no more than linked sets of their sizes do."""
    for batch in batches:
        size, other = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        differ = np.abs(_bins(batch.column(4).to_pylist()) - _bins(batch.column(5).to_pylist())).sum(axis=1)
        at = pa.array(np.flatnonzero(differ <= size + other - 2 * least_shared(size, other)))
        yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(2)], ["a", "b"])


# ---- pairs across components ----


def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared shingles that two sets of these sizes need."""
    return -(-(a + b) * SHARE[0] // sum(SHARE))


def _bins(blobs) -> np.ndarray:
    kinds = {BINS: "u1", 2 * BINS: "<u2", 4 * BINS: "<u4"}
    return np.stack([np.frombuffer(b, kinds[len(b)]).astype(np.int32) for b in blobs]) if len(blobs) else np.zeros((0, BINS), np.int32)


def possible_pairs(left: dict, right: dict | None, send: int):
    """(pairs (a, b), held) of one pair of tiles, or of one tile with itself: the best ``send`` for each set of ``left``.

    Tiles have node, root, size, place and bins.  ``held`` tells that a set had more of them.
    """
    other = left if right is None else right
    out, held = [], False
    for i in range(left["node"].size - (right is None)):
        lo = i + 1 if right is None else 0
        size, place = left["size"][i], left["place"][i]
        sizes, places = other["size"][lo:], other["place"][lo:]
        needed = least_shared(size, sizes)
        hit = np.flatnonzero((other["root"][lo:] != left["root"][i]) & fits(size, place, sizes, places))
        if not hit.size:
            continue
        differ = np.abs(other["bins"][lo:][hit] - left["bins"][i]).sum(axis=1)
        room = size + sizes[hit] - 2 * needed[hit]
        ok = differ <= room
        hit, slack = hit[ok], (room - differ)[ok]
        if not hit.size:
            continue
        if hit.size > send:  # another component first, then by room left
            held = True
            root = other["root"][lo:][hit]
            by = np.lexsort((other["node"][lo:][hit], -slack, root))
            again = np.concatenate([[0], (root[by][1:] == root[by][:-1]).astype(np.int64)])
            nth = np.arange(by.size) - np.maximum.accumulate(np.where(again == 0, np.arange(by.size), 0))
            best = by[np.lexsort((-slack[by], nth))[:send]]
            hit = hit[best]
        node, found = left["node"][i], other["node"][lo:][hit]
        out.append((np.minimum(node, found), np.maximum(node, found)))
    return out, held


def _tiles(send: int):
    """Work items arrive whole, sorted by shingle and pair of tiles (i, j).

    Rows out are pairs (a, b), or members (shingle, node, size, place) of the items that held pairs back.
    """

    def compute(batches):
        rows, pairs, kept, count = [], [], [], 0

        def tile(number):
            own = [r for r in rows if r[1] == number]
            columns = {name: np.array([r[k] for r in own], np.int64) for k, name in ((2, "node"), (3, "root"), (4, "size"), (5, "place"))}
            return columns | {"bins": _bins([r[6] for r in own])}

        def work():
            shingle, i, j = rows[0][0]
            found, held = possible_pairs(tile(i), None if i == j else tile(j), send)
            pairs.extend(found)
            kept.extend((shingle, r[2], r[4], r[5]) for r in rows if held)
            return sum(f[0].size for f in found) + held * len(rows)

        def out():
            a, b = np.unique(np.concatenate([np.stack(p) for p in pairs] or [np.zeros((2, 0), np.int64)], axis=1), axis=1)
            more = np.array(kept, np.int64).reshape(-1, 4).T
            columns = [pa.concat_arrays([pa.array(x), pa.nulls(len(kept), pa.int64())]) for x in (a, b)]
            columns += [pa.concat_arrays([pa.nulls(a.size, kind), pa.array(x, kind)]) for x, kind in zip(more, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "shingle", "node", "size", "place"])

        for batch in batches:
            c = batch.to_pydict()
            for row in zip(zip(c["shingle"], c["i"], c["j"]), c["tile"], c["node"], c["root"], c["size"], c["place"], c["bins"]):
                if rows and rows[0][0] != row[0]:
                    count += work()
                    rows = []
                    if count > 1 << 18:
                        yield out()
                        pairs, kept, count = [], [], 0
                rows.append(row)
        if rows:
            work()
            yield out()

    return compute


def cross_pairs(members: DataFrame, marked: DataFrame, roots: DataFrame, send: int, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) across the components of each bucket, and the members between which pairs were held back; ``roots`` has node and root."""
    spark = members.sparkSession
    rooted = members.select("shingle", "node", "size", "place").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = settle(rooted, folder, f"{name}-rooted")
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("n"))
    mixed = settle(mixed.where("_low != _high").select("shingle", "n"), folder, f"{name}-mixed")
    rows = settle(attach_counted(rooted, mixed, ["shingle"], "n", how="inner", spread_by=["node"]), folder, f"{name}-members")
    drop_settled(spark, folder, f"{name}-rooted")
    # Large buckets: the sets of the largest component are compared with the others only.
    large = rows.where(F.col("n") > TILE).groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("k"))
    large = large.groupBy("shingle").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("n"))
    split = settle(large.select("shingle", F.col("top.root").alias("main"), F.col("top.k").alias("inside"), "n"), folder, f"{name}-large")
    marked_rows = attach_counted(rows.where(F.col("n") > TILE).drop("n"), split, ["shingle"], "n", how="inner", spread_by=["node"])
    others = F.ceil((F.col("n") - F.col("inside")) / TILE).cast("int")
    tiles = F.when(F.col("root") == F.col("main"), F.ceil(F.col("inside") / TILE).cast("int")).otherwise(others)
    own = F.pmod(F.xxhash64("node"), tiles).cast("int") + F.when(F.col("root") == F.col("main"), others).otherwise(0)
    last = others + F.ceil(F.col("inside") / TILE).cast("int") - 1
    partners = F.sequence(F.lit(0), F.when(F.col("root") == F.col("main"), others - 1).otherwise(last))
    big = marked_rows.withColumn("tile", own).withColumn("o", F.explode(partners))
    big = big.select("shingle", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "node", "root", "size", "place")
    small = rows.where(F.col("n") <= TILE).select("shingle", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("tile"), "node", "root", "size", "place")
    wanted = rows.select("node").distinct()
    bins = settle(bins_of_nodes(marked, wanted), folder, f"{name}-bins")
    work = small.unionByName(big).join(bins.hint("merge"), "node")
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    keys = ["shingle", "i", "j"]
    work = work.select(*keys, "tile", "node", "root", "size", "place", "bins").repartition(n, *keys).sortWithinPartitions(*keys)
    found = settle(work.mapInArrow(_tiles(send), "a long, b long, shingle long, node long, size int, place int"), folder, f"{name}-found")
    held = found.where(F.col("shingle").isNotNull()).select("shingle", "node", "size", "place").distinct()
    return found.where(F.col("a").isNotNull()).select("a", "b").distinct(), settle(held, folder, f"{name}-held")


# ---- verification ----


def _wanted_sets(bitmap: np.ndarray):
    def compute(batches):
        for batch in batches:
            key = batch.column(1).to_numpy().view(np.uint64)
            word, bit = key % np.uint64(WORDS_OF_BITMAP), key >> np.uint64(58)
            ask = np.flatnonzero((bitmap[word] >> bit) & np.uint64(1))
            if not ask.size:
                continue
            for part in parts(batch.take(pa.array(ask)), 0):
                hashes, row, sizes = sets_of(part.column(0))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                raw = hashes.view(np.uint8).data
                blobs = [bytes(raw[8 * a : 8 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(hashes, sizes)), pa.array(blobs, pa.binary())], ["node", "hashes"])

    return compute


def _similar(batches):
    for batch in batches:
        a, b = (batch.column(i) for i in range(2))
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = np.intersect1d(x, y, assume_unique=True).size
            keep[i] = shared >= least_shared(x.size, y.size)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])


def verified(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity; ``pairs`` is settled, ``rows`` has text and row key."""
    spark = pairs.sparkSession
    wanted = settle(_ends(pairs).join(distinct.select("node", "row_key").hint("merge"), "node"), folder, f"{name}-wanted")
    word, bit = F.col("row_key").bitwiseAND(F.lit(WORDS_OF_BITMAP - 1)), F.shiftrightunsigned("row_key", 58).cast("int")
    flags = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("flags"))
    bitmap = np.zeros(WORDS_OF_BITMAP, np.uint64)
    got = np.array(flags.collect(), np.int64).reshape(-1, 2)  # at most WORDS_OF_BITMAP rows
    bitmap[got[:, 0]] = got[:, 1].view(np.uint64)
    found = rows.mapInArrow(_wanted_sets(bitmap), "node long, hashes binary")
    known = found.groupBy("node").agg(F.first("hashes").alias("hashes")).join(wanted.select("node", "k").hint("merge"), "node")
    known = settle(known, folder, f"{name}-sets")
    both = pairs.select("a", "b")
    for own, other in (("a", "b"), ("b", "a")):
        stats = known.select(F.col("node").alias(own), "k", F.col("hashes").alias(f"of_{own}"))
        both = attach_counted(both, stats, [own], "k", how="inner", spread_by=[other]).drop("k")
    near = settle(both.select("a", "b", "of_a", "of_b").mapInArrow(_similar, "a long, b long"), folder, f"{name}-links")
    drop_settled(spark, folder, f"{name}-sets")
    return near


# ---- the whole job ----


def linked(docs: DataFrame, marked: DataFrame, distinct: DataFrame, hot: list[tuple[int, int]], folder: str, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of the sets that are linked with any."""
    rows = docs.select(text_col, F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("row_key"))
    members = settle(bucket_members(marked, hot), folder, "members")
    tested = settle(hub_pairs(members, marked, folder), folder, "hub-pairs")
    near = verified(tested, rows, distinct, folder, "hub")
    roots = settle(components(near, f"{folder}/components"), folder, "roots")
    send, turn = SEND, 0
    while True:
        turn += 1
        across, members = cross_pairs(members, marked, roots, send, folder, f"cross-{turn}")
        across = settle(across.join(tested.hint("merge"), ["a", "b"], "left_anti"), folder, f"across-{turn}")
        if not across.isEmpty():
            near = settle(near.unionByName(verified(across, rows, distinct, folder, f"pairs-{turn}")), folder, f"near-{turn}")
            roots = settle(components(near, f"{folder}/components-{turn}"), folder, f"roots-{turn}")
        if members.isEmpty():
            return roots
        tested = settle(tested.unionByName(across), folder, f"tested-{turn}")
        send *= 4


def join(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; a component is named by its smallest id."""
    ranks, hot = shingle_ranks(docs, text_col)
    marked = settle(marks(docs, ranks, id_col, text_col), folder, "marks")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = marked.where("size > 0").groupBy("node").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = settle(distinct.withColumn("row_key", F.xxhash64("least.doc_id", "least.text_hash")), folder, "distinct")
    roots = linked(docs, marked, distinct, hot, folder, id_col, text_col)
    named = settle(distinct.join(roots.hint("merge"), "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")), folder, "rooted")
    least = settle(named.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("k")), folder, "least")
    found = attach_counted(named, least, ["root"], "k", spread_by=["node"])
    found = settle(found.select("node", "n", F.col("first.doc_id").alias("component_id")), folder, "groups")
    rows = marked.select("doc_id", "text_hash", "node", F.col("size").cast("long").alias("n_shingles"))
    placed = attach_counted(rows.where("n_shingles > 0"), found, ["node"], "n", spread_by=["doc_id", "text_hash"])
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return placed.select(*columns).unionByName(alone.select(*columns))
