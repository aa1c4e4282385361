"""Suffix-array removal, line dedup and decontamination against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from surveyloom.llm import decontaminate, line_dedup, segments, suffix_dedup
from surveyloom.llm.suffix_array import common_prefixes, suffix_array
from .conftest import edge_rows, prose


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 255))
def test_suffix_array_and_prefixes(raw, times, letters):
    text = bytes(b % letters for b in raw) * times
    order = suffix_array(np.frombuffer(text, np.uint8))
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want
    prefix = common_prefixes(np.frombuffer(text, np.uint8), order)
    for a, b in zip(want, want[1:]):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert prefix[b] == n


def slow_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0, kept))
    return out


def removed(docs, folder):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, folder).collect()), key=repr)


def test_repeats_on_edges(edges, nothing, folder):
    rows = edge_rows()
    want = [(r[0], *w) for r, w in zip(rows, slow_repeats([r[1] for r in rows], 400))]
    assert removed(edges, folder) == sorted(want, key=repr)
    assert removed(nothing, folder + "/none") == []


@pytest.mark.parametrize("chunk, slice_", [(1024, 1 << 20), (2, 1 << 20), (1024, 1500)])
def test_overlapping_passages(spark, folder, monkeypatch, chunk, slice_):
    """One passage in many contexts, cut at many places: one anchor has many different pieces."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(segments, "SLICE", slice_)
    segments._powers.cache_clear()
    draw = random.Random(4)
    passage, texts = prose(20, 150), []
    for i in range(40):
        lo = draw.randint(0, 300)
        texts.append(prose(100 + i, 20) + passage[lo : lo + draw.randint(380, 700)] + prose(200 + i, 20))
    texts += ["ab" * 500, "ba" * 450, "x" * 900, "é" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *w) for i, w in enumerate(slow_repeats(texts, 400))]
    assert removed(docs, folder) == sorted(want, key=repr)
    segments._powers.cache_clear()


def slow_lines(rows):
    has_word = lambda x: any(c not in " \t\n\x0b\x0c\r" for c in x)
    texts = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    found = {}
    for t in texts:
        lines = t[2].split("\n")
        places = [i for i, x in enumerate(lines) if has_word(x)]
        for k in range(len(places) - 2):
            found.setdefault(tuple(lines[p] for p in places[k : k + 3]), []).append((t, k, places[k : k + 3]))
    gone = {}
    for places in found.values():
        for t, _, lines in sorted(places, key=lambda p: (p[0][:2], p[1]))[1:]:
            gone.setdefault(t, set()).update(lines)
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        lines, drop = r[1].split("\n"), gone.get((r[0] is None, r[0] or 0, r[1]), set())
        out.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop)))
    return out


def test_lines(edges, nothing, folder):
    rows = edge_rows()
    got = [(r["row"]["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(edges, folder).collect()]
    assert sorted(got, key=repr) == sorted(slow_lines(rows), key=repr)
    kept = line_dedup.keep_first_passages(edges, folder + "/keep", chars_col="n_chars")
    assert kept.columns == edges.columns
    assert kept.count() == sum(not n or bool((t or "").strip()) for _, t, _, n in slow_lines(rows))
    assert line_dedup.keep_first_passages(nothing, folder + "/none").count() == 0


def test_hot_line_passage(spark, folder):
    rows = [(i, f"start {i}\ncommon a\ncommon b\ncommon c\nend {i}") for i in range(2500)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert got.where("n_removed = 3").count() == 2499 and got.where("n_removed = 0 and row.doc_id = 0").count() == 1


ITEM = prose(50, 40)
WORDS = ITEM.split()
ITEMS = [(1, ITEM), (2, prose(51, 30)), (2, prose(51, 30)), (3, None), (4, " , "), (5, "two words"), (None, prose(52, 25)), (6, prose(2, 3000)), (7, prose(8, 60))]


def slow_contained(rows, items):
    want = set()
    for r in rows:
        for name, text in items:
            size = min(len(decontaminate.words_of((text or "").encode())), 5)
            own, shingles = (decontaminate.shingles_of((t or "").encode(), max(size, 1)) for t in (r[1], text))
            if shingles and len(shingles & own) * 5 >= len(shingles) * 4:
                want.add((r[0], name, len(shingles & own), len(shingles)))
    return want


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_contained_items(spark, edges, nothing, folder, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    cut = WORDS[:]
    cut[18:20] = ["other", "words"]  # 5 or 6 of 36 shingles go
    more = [
        (100, prose(60, 20000) + " " + ITEM.upper().replace("É", "é").replace("Í", "í") + prose(61, 10), "en", None, 0),
        (101, prose(62, 50) + " ".join(WORDS[:20]), "en", None, 0),
        (102, " ".join(cut), "en", None, 0),
        (103, "Two, words!", "en", None, 0),
        (104, "not two words but very many more", "en", None, 0),
        (105, "words two of these, two more words", "en", None, 0),
    ]
    extra = len(edges.columns) - 5
    docs = edges.unionByName(spark.createDataFrame([(*m, *([1] * extra)) for m in more], edges.schema))
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    rows = edge_rows() + more
    got = {tuple(r) for r in decontaminate.contained_items(docs, items).collect()}
    want = slow_contained(rows, ITEMS)
    best = {}
    for d, i, n, q in want:  # of several rows or items with equal ids the largest share counts
        best[(d, i)] = max(best.get((d, i), (0, 0, 0)), (n / q, n, q))
    assert got == {(d, i, n, q) for (d, i), (_, n, q) in best.items()}
    # An item of two words is found inside longer documents; words in another order are not it.
    assert {(100, 1), (103, 5), (104, 5)} <= {(d, i) for d, i, _, _ in got} and not {(101, 1), (105, 5)} & {(d, i) for d, i, _, _ in got}
    away = {(d, t) for d, t, *_ in rows if slow_contained([(d, t)], ITEMS)}
    kept = decontaminate.keep_clean(docs, items, folder)
    assert kept.columns == docs.columns and kept.count() == sum((r[0], r[1]) not in away for r in rows)
    assert decontaminate.contained_items(nothing, items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0


def test_shingle_hashes_cross_slices(monkeypatch):
    monkeypatch.setattr(segments, "SLICE", 50)
    segments._powers.cache_clear()
    texts = [(r[1] or "").encode() for r in edge_rows() if len(r[1] or "") < 30000]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, number = decontaminate.shingle_hashes(*decontaminate.word_hashes(data, ends))
    at = 0
    for t, n in zip(texts, number.tolist()):
        assert len(set(hashes[at : at + n].tolist())) == (len(decontaminate.shingles_of(t)) or min(1, len(decontaminate.words_of(t))))
        at += n
    segments._powers.cache_clear()
