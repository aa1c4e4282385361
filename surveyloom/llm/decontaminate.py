"""Benchmark items inside documents: MinHash containment search, verified exactly.

An item is contained in a document when the document has at least ``share`` of the item's
distinct word shingles.  Such a document misses at most q - need of the item's q shingles, so it
must have one of the item's q - need + 1 smallest shingle hashes.  Those minima are the item's
sketch; how many there are depends on the item's size, so items are partitioned by size, and a
partition only meets documents long enough for the least its items need.  A document that hits a
sketch is a candidate, and candidates are verified on the shingles themselves.  Nothing within
the threshold is missed, however long the document.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
An item with fewer words than a shingle is one shingle, of all its words, and is looked for among the
runs of as many words of every document.

The benchmark is the query set: it is sent to the tasks in blocks of bounded bytes, and each
block is searched for in all documents.

* Null texts and texts without words contain nothing and are contained in nothing.
* Repeated items and repeated documents are one: pairs are distinct, the largest share counts.
* Null ids stay null.  Other columns are not read.  Empty tables give no pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from surveyloom.llm import segments
from surveyloom.llm.common import settle, without_rows

SHINGLE = 5
SHARE = (4, 5)  # 0.8, as a fraction
BLOCK_BYTES = 8 << 20  # item text sent to the tasks at once
GROUP_BYTES = 4 << 20  # document text hashed at once

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPLIT = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(raw: bytes) -> list[bytes]:
    return [w for w in _SPLIT.split(raw.lower()) if w]


def shingles_of(raw: bytes, size: int = SHINGLE) -> set[bytes]:
    words = words_of(raw)
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def word_hashes(data: np.ndarray, offsets: np.ndarray, of_words: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text), vectorised over the texts of a buffer; ``of_words`` tells the bytes of words."""
    hashes, counts = [], np.zeros(offsets.size - 1, np.int64)
    gap = lambda lo, hi: lo + np.flatnonzero(~of_words[data[lo:hi]])
    for lo, hi in segments.slices(data, offsets, gap):
        own = data[lo:hi]
        first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        inner = np.clip(offsets[first : last + 1] - lo, 0, hi - lo)
        word = of_words[own]
        cut = np.zeros(own.size + 1, bool)
        cut[1:-1] = word[1:] != word[:-1]
        cut[inner] = True
        cut[[0, -1]] = True
        places = np.flatnonzero(cut)
        starts, ends = places[:-1], places[1:]
        is_word = word[starts]
        starts, ends = starts[is_word], ends[is_word]
        hashes.append(segments.range_hash(segments.prefix_hash(segments._LOWER[own]), starts, ends))
        counts[first:last] += np.diff(np.searchsorted(starts, inner, "left"))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, shingles per text)."""
    number = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(counts.size), number)
    start = (np.cumsum(counts) - counts)[row] + np.arange(row.size) - np.repeat(np.cumsum(number) - number, number)
    size = np.minimum(counts, shingle)[row]
    padded = np.concatenate([words, np.zeros(shingle, np.uint64)])
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(shingle):
            out = out + np.where(i < size, (padded[start + i] ^ (padded[start + i] >> np.uint64(31))) * _STEPS[i], np.uint64(0))
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9), number


class Sketches:
    """The minima of a block of items, by words of a shingle and size of item, and the items' shingles."""

    def __init__(self, items: list[tuple[object, bytes]]):
        items = sorted({(i, t) for i, t in items}, key=repr)
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        words, n_words = word_hashes(data, offsets)
        hashes, number = shingle_hashes(words, n_words)
        ends = np.cumsum(number)
        self.ids, self.shingles, self.need, self.words = [], [], [], []
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for (name, text), end, count, size in zip(items, ends.tolist(), number.tolist(), np.minimum(n_words, SHINGLE).tolist()):
            own = np.unique(hashes[end - count : end])
            if not own.size:
                continue
            exact = shingles_of(text, size)
            need = -(-len(exact) * SHARE[0] // SHARE[1])
            k = len(self.ids)
            self.ids.append(name)
            self.shingles.append(exact)
            self.need.append(need)
            self.words.append(size)
            parts.setdefault((size, own.size.bit_length()), []).append((own[: len(exact) - need + 1], k))
        self.partitions = []  # (words of a shingle, least number of shingles, sorted minima, items of each)
        for (size, _), members in sorted(parts.items()):
            keys = np.concatenate([m for m, _ in members])
            owner = np.repeat([k for _, k in members], [m.size for m, _ in members])
            order = np.argsort(keys, kind="stable")
            self.partitions.append((size, min(self.need[k] for _, k in members), keys[order], owner[order]))

    def candidates(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs that share a minimum of the item."""
        found, known = [], 0
        for words_of_shingle, least, keys, owner in self.partitions:
            if words_of_shingle != known:
                known = words_of_shingle
                hashes, number = shingle_hashes(words, counts, known)
                row = np.repeat(np.arange(number.size), number)
                long_enough = number[row]
            at = np.searchsorted(keys, hashes)
            hit = np.flatnonzero((keys[np.minimum(at, keys.size - 1)] == hashes) & (long_enough >= least))
            if hit.size:
                first, last = at[hit], np.searchsorted(keys, hashes[hit], "right")
                of = np.repeat(row[hit], last - first)
                item = owner[np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first) + np.arange((last - first).sum())]
                found.append(np.stack([of, item], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _groups(offsets: np.ndarray):
    lo = 0
    while lo < offsets.size - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id, n_shared, n_item): items of which a document holds the share."""
    given = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    blocks = max(1, -(-(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    fields = [("doc_id", id_type), ("item", T.IntegerType()), ("n_shared", T.LongType()), ("n_item", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def search(block: list[tuple[object, bytes]]):
        def run(batches):
            sketches = Sketches(block)
            for batch in batches:
                data, offsets = segments.text_bytes(batch.column(1))
                out = []
                for lo, hi in _groups(offsets):
                    base = offsets[lo]
                    words, counts = word_hashes(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                    held, own = -1, {}
                    for text, k in sketches.candidates(words, counts).tolist():
                        size = sketches.words[k]
                        if text != held:
                            held, own = text, {}
                        if size not in own:
                            own[size] = shingles_of(data[offsets[lo + text] : offsets[lo + text + 1]].tobytes(), size)
                        shared = len(own[size] & sketches.shingles[k])
                        if shared >= sketches.need[k]:
                            out.append((lo + text, k, shared, len(sketches.shingles[k])))
                if out:
                    text, k, shared, size = zip(*out)
                    columns = [batch.column(0).take(pa.array(text)), pa.array(k, pa.int32()), pa.array(shared, pa.int64()), pa.array(size, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "n_shared", "n_item"])

        names = Sketches(block).ids
        if not names:
            return None
        found = rows.mapInArrow(run, schema)
        table = docs.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)]))
        return found.join(F.broadcast(table), "item").select("doc_id", "item_id", "n_shared", "n_item")  # names of one block

    result = None
    for b in range(blocks):
        block = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a block of the query set
        found = search([(r["item_id"], r["text"].encode()) for r in block])
        if found is not None:
            result = found if result is None else result.unionByName(found)
    if result is None:
        result = rows.limit(0).select("doc_id", F.lit(None).cast(item_type).alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item"))
    best = result.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item")


def keep_clean(docs: DataFrame, items: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("doc")
    found = contained_items(docs.select(key, F.col(text_col).alias("text")), items, id_col="doc")
    away = settle(found.select("doc_id.*").distinct(), folder, "contaminated")
    return without_rows(docs, away, [F.col(id_col), F.xxhash64(text_col)])


SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), s AS (
  SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM w
), k AS (
  SELECT side, id, w, least(len(w), 5) AS k FROM s WHERE side = 'i' AND len(w) > 0 UNION ALL
  SELECT side, id, w, k FROM s, (SELECT DISTINCT least(len(w), 5) AS k FROM s WHERE side = 'i' AND len(w) > 0) WHERE side = 'd' AND len(w) >= k
), g AS (
  SELECT DISTINCT side, id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT side, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)
), q AS (
  SELECT id AS item_id, k, g, count(*) OVER (PARTITION BY id) AS n_item FROM g WHERE side = 'i'
)
SELECT g.id AS doc_id, item_id, count(*) AS n_shared, n_item FROM q JOIN g ON g.side = 'd' AND g.k = q.k AND g.g = q.g
GROUP BY ALL HAVING count(*) * 5 >= n_item * 4
"""
