"""Ranked search against scores of all documents."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from surveyloom.llm import lexical
from .conftest import edge_rows, prose


def slow_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow_search(docs, items, k):
    own = [(i, Counter(slow_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for ident, c in own:
            n, score = sum(c.values()), 0
            for t in set(slow_terms(text)) & set(c):
                w = floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * n * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, ident is None, ident or 0, ident))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus():
    docs = [(i, prose(i, 5 + 7 * (i % 40))) for i in range(240)] + [(1000 + i, prose(3, 30)) for i in range(12)]  # equal scores
    return docs + [(5000, prose(900, 4000)), (None, prose(3, 30)), (7, "Río x1 x1"), (8, None), (9, ""), (3, prose(3, 30)), (3, prose(3, 30))]


ITEMS = [(1, prose(3, 30)), (2, prose(55, 12)), (3, "x1"), (4, "of and the"), (5, None), (6, ""), (7, "nothingofthekind"), (1, prose(3, 30)), (1, "élan RÍO")]


@pytest.mark.parametrize("k, shard, splits, block", [(50, 2_000_000, 48, 4 << 20), (5, 300, 2, 100)])
def test_equals_all_scores(spark, folder, monkeypatch, k, shard, splits, block):
    for name, value in (("SHARD_POSTINGS", shard), ("SPLITS", splits), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(lexical, name, value)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(lexical.search(docs, items, folder, k)) == slow_search(corpus(), ITEMS, k)


def test_largest_of_any_stretch():
    draw = np.random.default_rng(4)
    sizes = [1, 2, 5, 64, 100, 33]
    term = np.repeat(np.arange(6), sizes)
    doc = np.concatenate([np.sort(draw.choice(200, n, replace=False)) for n in sizes])
    shard = lexical.Shard(term, doc, draw.integers(1, 50, term.size), 6, 200)
    for t in range(6):
        a, b = shard.starts[t], shard.starts[t + 1]
        lo, hi = (x.ravel() for x in np.meshgrid(np.arange(a, b + 1), np.arange(a, b + 1)))
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        most, at = shard.largest(lo, hi)
        assert most.tolist() == [shard.impact[x:y].max(initial=0) for x, y in zip(lo, hi)]
        assert all(shard.impact[p] == m for p, m in zip(at, most) if m)


def test_most_documents_are_never_scored():
    draw = np.random.default_rng(1)
    n = 20000
    term = np.repeat(np.arange(3), [n, n // 4, 60])
    doc = np.concatenate([np.arange(n), np.sort(draw.choice(n, n // 4, replace=False)), np.sort(draw.choice(n, 60, replace=False))])
    impact = np.concatenate([draw.integers(1, 100, n), draw.integers(100, 1000, n // 4), draw.integers(5000, 9000, 60)])
    shard = lexical.Shard(term, doc, impact, 3, n)
    docs, scores, seen = shard.search(np.arange(3), 20)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, impact)
    assert docs.tolist() == np.lexsort((np.arange(n), -total))[:20].tolist() and scores.tolist() == total[docs].tolist()
    assert seen < n // 20


def test_edge_rows(spark, edges, nothing, folder):
    docs = [(r[0], r[1]) for r in edge_rows()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumnRenamed("text", "body")
    found = lexical.search(edges, items, folder, 7, item_text_col="body")
    assert rows_of(found) == slow_search(docs, ITEMS, 7)
    assert lexical.search(nothing, items, folder + "/a", item_text_col="body").count() == 0
    assert lexical.search(edges, items.limit(0), folder + "/b", item_text_col="body").count() == 0
    assert lexical.search(edges, items, folder + "/c", item_text_col="body").columns == ["item_id", "rank", "doc_id", "score"]
