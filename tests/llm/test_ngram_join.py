"""Components of the Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import ngram_join
from .conftest import edge_rows, prose


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def slow_join(rows):
    """(id, size, component) of every row, by all pairs of rows."""
    own = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 90 * len(own[i] | own[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (ident, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(ident)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((ident, len(own[i]), least[top(i)]) for i, (ident, _) in enumerate(rows)), key=repr)


def family(seed, n, words=120, most=6):
    """Copies of a text with a few words changed, at similarities around 0.9."""
    draw, base = random.Random(seed), prose(seed, words).split()
    out = []
    for i in range(n):
        own = base[:]
        for k in range(draw.randint(0, most)):
            own[draw.randrange(words)] = f"w{seed}x{i}x{k}"
        if draw.random() < 0.3:
            own = own[: -draw.randint(1, 8)]
        out.append(" ".join(own))
    return out


def corpus():
    line = prose(999, 14).replace("\n", " ")  # in every text
    texts = [t + " " + line for s in range(30) for t in family(s, 5)] + family(77, 90) + family(78, 60, words=40, most=2) + [prose(500 + i, 60) + line for i in range(60)]
    texts += texts[:7] + ["", None, " ", "one two", "One  two", "three", "one two three"]
    return list(enumerate(texts)) + [(None, texts[0]), (None, None), (3, texts[40]), (5, texts[5])]


@pytest.mark.parametrize("tile, hot, send, seen", [(4096, 1 << 16, 8, 1 << 20), (16, 1 << 16, 1, 3), (5, 20, 2, 1 << 20)])
def test_components_are_those_of_all_pairs(spark, folder, monkeypatch, tile, hot, send, seen):
    for name, value in (("TILE", tile), ("HOT_ROWS", hot), ("SEND", send), ("SEEN", seen)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    got = ngram_join.join(docs, folder).collect()
    assert sorted(map(tuple, got), key=repr) == slow_join(corpus())


def candidates(spark, folder):
    """Rows of all tables of pairs that a run wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return sum(spark.read.parquet(f"{folder}/{n}").count() for n in names if n == "hub-pairs" or n.startswith("across-"))


def test_pairs_stay_in_proportion_to_a_family(spark, folder):
    """A family of a thousand near copies has half a million pairs; a few for each copy are looked at."""
    base = prose(5, 400).split()
    texts = []
    for i in range(1000):
        own, draw = base[:], random.Random(i)
        for k in range(draw.randint(1, 5)):
            own[draw.randrange(400)] = f"y{i}x{k}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = ngram_join.join(docs, folder)
    assert got.select("component_id").distinct().count() == 1
    assert candidates(spark, folder) < 4000


def hidden_pairs(n):
    """Texts x, y and four z, n times, each time in one set of buckets: x and y are linked, a z with none, but by bins it looks nearer to both.

    Behind them come texts that make the shingles in which those differ common, so that no prefix has them.
    """
    texts, phrases = [], []
    for seed in range(n):
        base = [f"v{seed}x{i}" for i in range(100)]
        own = [base[58:60] + [f"e{seed}x{j}x{k}" for k in range(3)] + base[63:65] for j in range(20000)]
        end = [[f"a{seed}x{j}", f"b{seed}x{j}"] if j >= 10 else [] for j in range(len(own))]
        each = [" ".join(base[:58] + p + base[65:] + e) for p, e in zip(own, end)]
        hashes, row, sizes = ngram_join.sets_of(pa.array(each))
        bins = ngram_join._bins(ngram_join.bins_of(hashes, row, len(each)))
        differ = abs(bins - bins[0]).sum(axis=1)
        y = 1 + np.flatnonzero(differ[1:10] == 10)[0]
        near = np.flatnonzero((differ < 10) & (abs(bins - bins[y]).sum(axis=1) < 10))
        chosen = [0, y, *near[near >= 10][:4].tolist()]
        assert len(chosen) == 6
        texts += [each[j] for j in chosen]
        phrases += [p for j in chosen for p in (own[j], base[98:] + end[j])]
    return texts + [" ".join([*(w for i, p in enumerate(phrases) for w in [*p, f"f{k}x{i}"]), *(f"g{k}x{i}" for i in range(3000))]) for k in range(10)]


def test_rounds_take_up_only_tiles_that_held_pairs_back(spark, folder, monkeypatch):
    """A round after the first must not join the members of all buckets again."""
    texts = hidden_pairs(1)
    for s in range(60):
        base = [f"p{s}x{i}" for i in range(200)]
        texts += [" ".join(base), " ".join([*base[:198], "other", "end"])]
    monkeypatch.setattr(ngram_join, "SEND", 1)
    monkeypatch.setattr(ngram_join, "hub_pairs", lambda *_: spark.createDataFrame([], "a long, b long"))
    taken, attach = [], ngram_join.attach_counted

    def counting(df, stats, keys, *args, **more):
        if keys == ["shingle"] and "main" not in stats.columns:
            taken.append(df.count())
        return attach(df, stats, keys, *args, **more)

    monkeypatch.setattr(ngram_join, "attach_counted", counting)
    got = ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), folder)
    assert got.select("component_id").distinct().count() == len(texts) - 61
    assert len(taken) > 1 and sum(taken) < 1.5 * taken[0]


def test_prefixes_of_similar_sets_meet():
    draw = np.random.default_rng(3)
    ranks = draw.integers(0, 3, ngram_join.COUNTERS).astype(np.uint8)

    def prefix(own):
        return ngram_join.prefixes(own, np.zeros(own.size, np.int64), np.array([own.size]), ranks)[0]

    for n in [1, 2, 9, 10, 11, 19, 20, 50, 300]:
        for _ in range(50):
            a = np.unique(draw.integers(0, 1 << 63, n, np.uint64))
            b = np.unique(np.concatenate([a[draw.random(a.size) > 0.05], draw.integers(0, 1 << 63, n // 20, np.uint64)]))
            shared = np.intersect1d(a, b).size
            assert (shared >= ngram_join.least_shared(a.size, b.size)) == (100 * shared >= 90 * (a.size + b.size - shared))
            if b.size and shared >= ngram_join.least_shared(a.size, b.size):
                assert np.intersect1d(prefix(a), prefix(b)).size


def test_ranks_count_all_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 100)
    texts = [t for _, t in corpus()]
    hashes, _, _ = ngram_join.sets_of(pa.array(texts))
    ranks, hot = ngram_join.shingle_ranks(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text")
    counts = np.bincount(ngram_join._cells(hashes), minlength=ngram_join.COUNTERS)
    assert counts.sum() == hashes.size == sum(len(slow_set(t)) for t in texts)
    assert (ranks == ngram_join.ranks_of(counts)).all()
    assert sorted(hot) == [(c, counts[c]) for c in np.flatnonzero(counts > 100)] and hot


def test_buckets_in_any_batches():
    """Small buckets lose only sets that no other fits; large ones keep all, wherever batches end."""
    draw = np.random.default_rng(6)
    rows = np.array(sorted({(s, -1, int(draw.integers(0, 6)), n, int(30 + n % 40)) for s in range(60) for n in draw.integers(0, 500, 3 if s % 3 else 150).tolist()}))
    names = ["shingle", "salt", "place", "node", "size"]
    want = set()
    for s in range(60):
        own = rows[rows[:, 0] == s]
        want |= {(s, r[3]) for r in own if len({tuple(x) for x in own[:, 2:4]}) > ngram_join.SMALL or any(ngram_join.fits(r[4], r[2], x[4], x[2]) for x in own if x[3] != r[3])}
    for step in (1, 7, 64, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + step].T], names) for i in range(0, len(rows), step)]
        out = pa.Table.from_batches(list(ngram_join._buckets(batches))).to_pylist()
        assert {(r["shingle"], r["node"]) for r in out} == want
        assert all(len({r["hub"] for r in out if r["shingle"] == s}) <= 1 for s in range(60))


def test_edge_rows(spark, edges, nothing, folder):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = ngram_join.join(edges, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow_join(rows)
    assert ngram_join.join(nothing, folder + "/none").count() == 0
    assert ngram_join.join(edges.where(F.col("text").isNull()), folder + "/nulls").where("n_shingles = 0").count() == 2
