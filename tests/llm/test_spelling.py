"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from surveyloom.llm import spelling
from .conftest import edge_rows


def one_edit(a, b):
    """Plain definition: one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_words(rows):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def slow_variants(rows):
    words = slow_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def corpus():
    draw = random.Random(5)
    base = ["".join(draw.choices("abcdeéÿ×", k=draw.randint(6, 14))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "Straßen"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[min(int(draw.expovariate(0.1)), len(base) - 1)]
            if draw.random() < 0.15:
                k = draw.randrange(len(w))
                w = w[:k] + draw.choice(["", "x", w[k] + "y", w[k] * 2]) + w[k + 1 :]
            words.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i, " 1-".join(words)))
    rows += [(500 + i, "chainword " * 40 + ("chainwors " * 4 if i < 5 else "") + ("chainwxrs" if i > 3 else "")) for i in range(6)]  # a form of a form
    return rows + [(None, "Ergebnis ergebnis ergebnisse ERGEBNISSE"), (3, None), (4, ""), rows[0], rows[0]]


@pytest.mark.parametrize("tile, held", [(1024, 1 << 18), (7, 50)])
def test_equals_all_pairs(spark, folder, monkeypatch, tile, held):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.variants(docs, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = slow_variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.root != r.form for r in got if r.form) and any(r.form is None and r.n_near for r in got)


def test_near_pairs_of_one_letter():
    words = ["aaaaaaa", "aaaaaab", "baaaaaa", "abababa", "bababab", "aabaaaa", "aaaaaaa"]
    longer = [w + "a" for w in words] + ["aaaabaaa"]
    for a, b in [(words, words), (longer, longer), (longer, words)]:
        found = {(i, j) for i, j in spelling.near_pairs([w.encode() for w in a], [w.encode() for w in b], None).tolist()}
        assert found == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if one_edit(x, y)}


def test_edge_rows(edges, nothing, folder):
    rows = [(r[0], r[1]) for r in edge_rows()] * 2
    got = spelling.variants(edges.union(edges), folder).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == slow_variants(rows)
    assert spelling.variants(nothing, folder + "/none").count() == 0
