"""Spelling variants: words one edit apart, by dense tiles of common prefix and suffix lengths.

Words are maximal runs of Latin letters, A-Z counted as a-z.  By a hash of document and word some
occurrences lose one letter (``CUT_EVERY``), as the contract of the query asks.  Words of at least
``MIN_LENGTH`` letters that occur ``MIN_COUNT`` times overall are compared.

Two different words are one edit apart when their lengths differ by at most one and common
prefix plus common suffix reach the longer length minus one.  So they share the first half of the
longer one or, failing that, its last half: words meet in buckets of either.  A bucket is a pair of
zero-padded matrices of code points, of the words of a length L and of those one shorter; tiles of
TILE words each are compared at once, every pair of tiles in a work item of its own.  A pair that
shares the first half is left out where the last half brings it together again, so each pair is
found once, and tiles send back sums per word, no pairs.

* Null texts have no words.  A null id is hashed as an empty one.  Only id and text are read.
* Repeated rows count each.  Equal counts are decided by code-point order.
* An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import attach_counted, settle, shuffle_partitions

MIN_LENGTH = 7
MIN_COUNT = 2
CUT_EVERY = 31
LEAD = 10  # a form is so many times as frequent as its variant
TILE = 1024  # words of a bucket in one tile
HELD_WORDS = 1 << 18  # distinct words a task holds before it sends counts on
SENT = 1 << 16  # rows in a batch that leaves a task

# Fixed value: the letters of a run, A-Z lowered already.
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)


# ---- words ----


def _words_of(ident, text: str):
    """(word, occurrences) of one text, after the hashed deletions."""
    runs = Counter(_RUN.findall(text.encode().lower().decode()))  # bytes: lowers A-Z only
    start = crc32(b"" if ident is None else str(ident).encode())
    start = crc32(b":", start)
    for run, n in runs.items():
        h = crc32(run.encode(), start)
        if h % CUT_EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        yield run, n


def _count(batches):
    held: Counter = Counter()

    def out():
        rows = list(held.items())
        held.clear()
        for k in range(0, len(rows), SENT):
            words, n = zip(*rows[k : k + SENT])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    for batch in batches:
        for ident, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if text:
                for word, n in _words_of(ident.as_py(), text):
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield from out()
    yield from out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur MIN_COUNT times."""
    counts = docs.select(id_col, text_col).mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---- tiles ----


def _half(length: int) -> int:
    """Letters of the first half; a pair that does not share them shares the last ``length`` - half."""
    return length // 2


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    """(words, width) code points, zero beyond a word's end: the letters fit one byte."""
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


def _run_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of ``a`` with every row of ``b``."""
    alive = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.int32)
    for k in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        length += alive
    return length


def near_pairs(longer: list[bytes], other: list[bytes], shared_first: bool | None) -> np.ndarray:
    """Places (i, j) of words one edit apart; all of ``longer`` have one length, all of ``other`` that or one less.

    ``shared_first``: with False, pairs that share the first half are left out.
    """
    if not longer or not other:
        return np.zeros((0, 2), np.int64)
    size, less = len(longer[0]), len(other[0])
    a, b = _matrix(longer, size), _matrix(other, less)
    prefix = _run_lengths(a, b)
    suffix = _run_lengths(a[:, ::-1], b[:, ::-1])
    near = prefix + suffix >= size - 1
    if size == less:
        near &= prefix < size
    if shared_first is False:
        near &= prefix < _half(size)
    return np.argwhere(near)


def _tile(words: list[bytes], block: np.ndarray, size: int, by_prefix: bool, i: int, j: int):
    """Directed pairs (word, near word) as places, of one pair of tiles of a bucket of length ``size``."""
    long_ones = np.array([len(w) == size for w in words])
    found = []

    def meet(left, right):
        pairs = near_pairs([words[k] for k in left], [words[k] for k in right], None if by_prefix else False)
        if len(pairs):
            found.append(np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], axis=1))

    pick = lambda tile, which: np.flatnonzero((block == tile) & (long_ones == which))
    if i == j:
        own = pick(i, True)
        pairs = near_pairs([words[k] for k in own], [words[k] for k in own], None if by_prefix else False)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        if len(pairs):
            found.append(own[pairs])
        meet(own, pick(i, False))
    else:
        meet(pick(i, True), pick(j, True))
        meet(pick(i, True), pick(j, False))
        meet(pick(j, True), pick(i, False))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.concatenate([pairs, pairs[:, ::-1]])


def _sums(words: list[bytes], counts: np.ndarray, pairs: np.ndarray):
    """(word, near words, largest count among them, its word) per word that has any."""
    order = np.argsort(np.array(words, object))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    at, near = pairs[:, 0], pairs[:, 1]
    by = np.lexsort((place[near], -counts[near], at))
    at, near = at[by], near[by]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(head, at.size))
    return [words[k].decode("latin-1") for k in at[head]], n, counts[near[head]], [words[k].decode("latin-1") for k in near[head]]


def _compare(batches):
    """Work items arrive whole and in a row: sorted by bucket and pair of tiles."""
    held: list = []
    ready: list[list] = [[], [], [], []]

    def work(rows):
        words = [r[1].encode("latin-1") for r in rows]
        counts = np.array([r[2] for r in rows], np.int64)
        block = np.array([r[3] for r in rows])
        (size, by_prefix, i, j) = rows[0][0][:4]
        pairs = _tile(words, block, size, by_prefix, i, j)
        if len(pairs):
            for column, values in zip(ready, _sums(words, counts, pairs)):
                column.extend(values)

    def out():
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(ready, kinds)], ["word", "n_near", "most", "near"])
        for column in ready:
            column.clear()
        return batch

    for batch in batches:
        columns = batch.to_pydict()
        keys = zip(columns["size"], columns["by_prefix"], columns["i"], columns["j"], columns["part"])
        for row in zip(keys, columns["word"], columns["n"], columns["block"]):
            if held and held[0][0] != row[0]:
                work(held)
                held = []
                if len(ready[0]) > SENT:
                    yield out()
            held.append(row)
    if held:
        work(held)
    yield out()


def neighbours(words: DataFrame, folder: str) -> DataFrame:
    """(word, n_near, most, near): words one edit away, the largest count among them and its word; ``words`` is settled."""
    spark = words.sparkSession
    own = F.length("word")
    sizes = words.select("word", "n", F.explode(F.array(own, own + 1)).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")  # as _half
    first = F.col("word").substr(F.lit(1), half)
    last = F.col("word").substr(own - F.col("size") + half + 1, F.col("size") - half)
    sides = F.array(F.struct(F.lit(True).alias("by_prefix"), first.alias("part")), F.struct(F.lit(False).alias("by_prefix"), last.alias("part")))
    members = sizes.select("word", "n", "size", F.inline(sides))
    buckets = members.groupBy("size", "by_prefix", "part").agg(F.count(F.lit(1)).alias("k"), F.max(F.length("word") == F.col("size")).alias("any"))
    buckets = settle(buckets.where("k > 1 AND any").select("size", "by_prefix", "part", "k"), folder, "buckets")
    members = attach_counted(members, buckets, ["size", "by_prefix", "part"], "k", how="inner", spread_by=["word"])
    tiles = F.ceil(F.col("k") / TILE).cast("int")
    members = members.withColumn("tiles", tiles).withColumn("block", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    work = members.select("size", "by_prefix", "part", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "word", "n", "block")
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    keys = ["size", "by_prefix", "part", "i", "j"]
    work = work.repartition(n, *keys).sortWithinPartitions(*keys)
    found = work.mapInArrow(_compare, "word string, n_near long, most long, near string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("most"), "best.near")


# ---- forms and roots ----


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root): the end of each chain of forms, by pointer jumping; ``forms`` is settled, with word and form."""
    current, turn = forms.select("word", F.coalesce("form", "word").alias("root")), 0
    while True:
        turn += 1
        step = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # Merged at every size: the vocabulary grows with the documents.
        moved = settle(current.join(step.hint("merge"), "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), folder, f"roots-{turn}")
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def variants(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every compared word.

    ``form`` is the near word of largest count, where that is LEAD times the word's own; ``root``
    is where the chain of forms ends, the word itself without one.
    """
    words = settle(vocabulary(docs, id_col, text_col), folder, "words")
    near = neighbours(words, folder)
    leads = F.col("most") >= LEAD * F.col("n")
    forms = words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("most")).alias("form_n")
    )
    forms = settle(forms, folder, "forms")
    return forms.join(roots(forms, folder).hint("merge"), "word")
