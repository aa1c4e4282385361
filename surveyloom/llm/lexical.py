"""Ranked lexical search: the best documents for each item, by best-first document intervals.

Every document is indexed whole: its distinct terms by 64-bit hash, with their counts.  From the
index come the corpus statistics, over all documents.  Then tasks take shards of documents, at
most SHARD_POSTINGS postings of query terms each (one document at least), and lay out a posting
list per term with the exact share of the score, its impact, at every posting.  A sparse table over
the impacts answers where the largest one of any stretch of a list lies.

An item's search starts with the interval of all documents of the shard.  The largest impacts of
its terms inside an interval, summed, bound the score of every document there.  The intervals of
largest bound are split first, at the document of their largest impact, which is scored; both rests
are bounded anew.  The search ends when no interval's bound reaches the k-th best score, so equal
scores are all seen.  Shards send back k documents per item, and the best k of those remain.

Score of a document, with terms once each: sum of w * ((10^9 tf) div (1000 tf + 20 m)), where
w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L.

* Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
* Null and empty texts have no terms: such documents are not found, such items find nothing.
* Repeated documents are ranked each; of equal scores the smaller id comes first, null ids last.
* Repeated items are one; items of one id and different texts are ranked each.
* The items are the query set: they go to the tasks in blocks of BLOCK_BYTES of text.
* Only id and text are read.  Empty tables give no rows.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from surveyloom.llm import segments
from surveyloom.llm.common import settle
from surveyloom.llm.decontaminate import word_hashes

BLOCK_BYTES = 4 << 20  # item text searched for at once
SHARD_POSTINGS = 2_000_000  # postings of query terms in a shard, about
SPLITS = 48  # intervals of an item split at once
SEND_ROWS = 1 << 15


# ---- index ----


def _index(batches):
    for batch in batches:
        for part in segments.parts(batch, 1):
            data, offsets = segments.text_bytes(part.column(1))
            hashes, counts = word_hashes(data, offsets)
            row = np.repeat(np.arange(counts.size), counts)
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            new = np.ones(row.size, bool)
            new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, row.size)).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=counts.size))])
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[at].view(np.int64)))
            times = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tf))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), terms, times], ["doc_id", "n", "terms", "tfs"])


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every whole text, settled."""
    fields = [("doc_id", docs.schema[id_col].dataType), ("n", T.LongType()), ("terms", T.ArrayType(T.LongType())), ("tfs", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    return settle(docs.select(id_col, text_col).mapInArrow(_index, schema), folder, "index")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _hits(column, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``known``, place in the flat values) of the list entries that are in the sorted ``known``."""
    values, lengths = _flat(column)
    at = np.minimum(np.searchsorted(known, values), known.size - 1)
    hit = np.flatnonzero(known[at] == values)
    return np.repeat(np.arange(lengths.size), lengths)[hit], at[hit], hit


def document_counts(index: DataFrame, known: np.ndarray) -> np.ndarray:
    """How many documents hold each of the query terms."""

    def count(batches):
        total = np.zeros(known.size, np.int64)
        for batch in batches:
            _, term, _ = _hits(batch.column(0), known)
            total += np.bincount(term, minlength=known.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    df = np.zeros(known.size, np.int64)
    for r in index.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]  # a row per term of a block of items
    return df


# ---- search of a shard ----


class Shard:
    """Posting lists with impacts, and range maxima over them."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.key = term[order].astype(np.int64) * n_docs + self.doc
        longest = int(np.diff(self.starts).max(initial=1))
        # Level l holds the place of the largest impact among 2^l postings; no query crosses lists.
        self.levels = [np.arange(self.doc.size, dtype=np.int32)]
        for level in range(1, longest.bit_length()):
            before, half = self.levels[-1], 1 << (level - 1)
            a, b = before[:-half], before[half:]
            self.levels.append(np.where(self.impact[a] >= self.impact[b], a, b))
        self.offset = np.concatenate([[0], np.cumsum([x.size for x in self.levels])])
        self.table = np.concatenate(self.levels)
        self.levels = None

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impact, place) of the largest impact in lo..hi of each pair; 0 where empty."""
        size = hi - lo
        some = size > 0
        level = np.where(some, np.frexp(np.maximum(size, 1))[1] - 1, 0)
        if not self.table.size:
            return np.zeros(lo.shape, np.int64), np.zeros(lo.shape, np.int64)
        base = self.offset[level]
        a = self.table[np.where(some, base + lo, 0)]
        b = self.table[np.where(some, base + hi - (1 << level), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return np.where(some, self.impact[at], 0), at

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored) of the k best with a score above 0; equal scores by place."""
        lo, hi = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        impact, place = self.largest(lo, hi)
        bound = impact.sum(axis=1)
        docs, scores, least, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
        base = terms * self.n_docs
        while True:
            open_ones = np.flatnonzero(bound >= least)
            if not open_ones.size:
                return docs, scores, seen
            if open_ones.size > SPLITS:
                chosen = open_ones[np.argpartition(bound[open_ones], open_ones.size - SPLITS)[-SPLITS:]]
            else:
                chosen = open_ones
            rest = np.setdiff1d(open_ones, chosen, assume_unique=True)
            a, b, best = lo[chosen], hi[chosen], impact[chosen]
            at = place[chosen, :][np.arange(chosen.size), best.argmax(axis=1)]
            doc = self.doc[at]
            cut = np.searchsorted(self.key, base[None, :] + doc[:, None])
            cut = np.clip(cut, a, b)
            held = (cut < b) & (self.doc[np.minimum(cut, self.doc.size - 1)] == doc[:, None])
            score = np.where(held, self.impact[np.minimum(cut, self.doc.size - 1)], 0).sum(axis=1)
            seen += doc.size
            docs, scores = np.concatenate([docs, doc]), np.concatenate([scores, score])
            if docs.size > k:
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
            if docs.size == k:
                least = max(1, int(scores.min()))
            new_lo, new_hi = np.concatenate([a, cut + held]), np.concatenate([cut, b])
            new_impact, new_place = self.largest(new_lo, new_hi)
            new_bound = new_impact.sum(axis=1)
            keep = np.flatnonzero(new_bound >= least)
            lo, hi = np.concatenate([lo[rest], new_lo[keep]]), np.concatenate([hi[rest], new_hi[keep]])
            impact, place = np.concatenate([impact[rest], new_impact[keep]]), np.concatenate([place[rest], new_place[keep]])
            bound = np.concatenate([bound[rest], new_bound[keep]])


def _search(known: np.ndarray, weight: np.ndarray, items: list[np.ndarray], n_docs: int, n_terms: int, k: int):
    """Task of a block of items: (item, doc_id, score) of the k best of each shard."""

    def compute(batches):
        ids, rows, terms, impacts, size, held = [], [], [], [], 0, 0

        def out():
            id_column = pa.concat_arrays(ids)
            rank = np.empty(len(id_column), np.int64)  # documents in order of id: ties are decided by place
            rank[pa.compute.sort_indices(id_column, null_placement="at_end").to_numpy()] = np.arange(rank.size)
            back = np.argsort(rank)
            shard = Shard(np.concatenate(terms), rank[np.concatenate(rows)], np.concatenate(impacts), known.size, rank.size)
            found = []
            for i, own in enumerate(items):
                docs, scores, _ = shard.search(own, k)
                if docs.size:
                    found.append((np.full(docs.size, i, np.int32), back[docs], scores))
                if sum(f[0].size for f in found) > SEND_ROWS or (found and i == len(items) - 1):
                    item, doc, score = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(item), id_column.take(pa.array(doc)), pa.array(score)], ["item", "doc_id", "score"])
                    found = []
            if found:
                item, doc, score = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(item), id_column.take(pa.array(doc)), pa.array(score)], ["item", "doc_id", "score"])

        for batch in batches:
            n = batch.column(1).to_numpy()
            tfs, _ = _flat(batch.column(3))
            row, term, at = _hits(batch.column(2), known)
            tf = tfs[at].astype(np.int64)
            m = 50 + (50 * n[row] * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            some = impact > 0
            for values, mine in ((rows, row[some] + size), (terms, term[some]), (impacts, impact[some])):
                values.append(mine)
            ids.append(batch.column(0))
            size, held = size + batch.num_rows, held + int(some.sum())
            if held > SHARD_POSTINGS:
                yield from out()
                ids, rows, terms, impacts, size, held = [], [], [], [], 0, 0
        if held:
            yield from out()

    return compute


# ---- the whole job ----


def _terms_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(word_hashes(data, np.array([0, data.size]))[0].view(np.int64))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, folder: str, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, fewer where fewer have a score above 0."""
    spark = docs.sparkSession
    index = build_index(docs, folder, id_col, text_col)
    totals = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 0
    given = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    result = None
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a block of the query set
        own = [_terms_of(r["text"]) for r in rows]
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))
        if not known.size or not n_docs:
            continue
        df = document_counts(index, known)
        weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        places = [np.searchsorted(known, x) for x in own]
        found = index.mapInArrow(_search(known, weight, places, n_docs, n_terms, k), schema)
        # First within shards of shards, so that no task sees more than a part of an item's rows.
        found = _best(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), ["item", "part"], k)
        best = _best(found.drop("rank"), ["item"], k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)]))
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names of one block
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = index.limit(0).select(F.lit(None).cast(item_type).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return result


# Repeated rows of documents rank each; the tables have one row per item.
SQL = r"""
WITH b AS (
  SELECT DISTINCT item_id, text FROM benchmark
), t AS (
  SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, text, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '')) AS term FROM b
), c AS (
  SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM t WHERE len(w) > 0
), p AS (
  SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, doc_id, w, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), d AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_all
), i AS (
  SELECT row, doc_id, term, d.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))) AS impact FROM p JOIN d USING (term), c
), s AS (
  SELECT item_id, q.text, row, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s
QUALIFY rank <= 50
"""
