"""Fingerprints, bit-sliced links and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from surveyloom.llm import simhash
from surveyloom.llm.common import components
from .conftest import edge_rows


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near(a, b, radius=3):
    return (int(a) ^ int(b)).bit_count() <= radius


def flipped(draw, base, most):
    out = int(base)
    for b in draw.choice(64, draw.integers(0, most + 1), replace=False):
        out ^= 1 << int(b)
    return out


@pytest.mark.parametrize("n", [2, 3, 63, 64, 65, 300, 1000])
def test_bucket_links(n):
    draw = np.random.default_rng(n)
    centres = draw.integers(0, 1 << 63, max(1, n // 9), dtype=np.uint64)
    fps = np.unique(np.array([flipped(draw, draw.choice(centres), 4) for _ in range(n)], np.uint64))
    a, b = simhash._bucket_edges(fps, np.array([0]))
    want = roots(fps, near)
    edges = set(zip(a.tolist(), b.tolist()))
    assert all(near(x, y) or want[fps.tolist().index(x)] == want[fps.tolist().index(y)] for x, y in edges)
    got = roots(fps.tolist(), lambda x, y: (x, y) in edges or (y, x) in edges)
    assert got == want
    assert len(edges) <= fps.size  # spanning, not all pairs


def test_many_small_buckets():
    draw = np.random.default_rng(5)
    parts = [np.unique(np.array([flipped(draw, c, 3) for _ in range(int(draw.integers(1, 70)))], np.uint64)) for c in draw.integers(0, 1 << 63, 80, dtype=np.uint64)]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    a, b = simhash._bucket_edges(np.concatenate(parts), starts)
    edges = set(zip(a.tolist(), b.tolist()))
    for part in parts:
        own = part.tolist()
        assert roots(own, lambda x, y: (x, y) in edges or (y, x) in edges) == roots(part, near)


@pytest.mark.parametrize("chunk", [8192, 16])
def test_all_links_found(spark, folder, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = np.random.default_rng(11)
    centres = draw.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.array([flipped(draw, draw.choice(centres), 3) for _ in range(500)], np.uint64))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fingerprint long")
    edges = {(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(frame, folder).collect()}
    assert roots(fps.tolist(), lambda x, y: (x, y) in edges or (y, x) in edges) == roots(fps, near)


def test_near_duplicates(edges, folder):
    rows = edge_rows()
    fps = [slow_fingerprint(r[1]) for r in rows]
    root = roots(fps, near)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        want.append((r[0], int(np.uint64(fps[i]).astype(np.int64)), min(ids) if ids else None))
    got = [tuple(r) for r in simhash.near_duplicates(edges, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_of_each_group_stays(edges, nothing, folder):
    kept = simhash.keep_one(edges, folder)
    assert kept.columns == edges.columns
    rows = edge_rows()
    assert kept.count() == len(set(roots([slow_fingerprint(r[1]) for r in rows], near)))
    assert simhash.near_duplicates(nothing, folder + "/none").count() == 0
    assert simhash.keep_one(nothing, folder + "/none2").count() == 0


def test_components_of_chains_and_stars(spark, folder):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(1000, i) for i in range(1001, 1400)]
    frame = spark.createDataFrame([*chain, *star, (5, 6), (6, 5), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(frame, folder).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1000 for i in range(1000, 1400)}, 5: 5, 6: 5}


def test_hot_fingerprint_is_spread(spark, folder):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same words here again").otherwise(F.concat_ws(" ", F.sha1(F.col("id").cast("string")), F.md5(F.col("id").cast("string")))).alias("text"))
    got = simhash.near_duplicates(frame, folder)
    assert got.where("component_id = 1").count() == 2000 and got.count() == 3000
