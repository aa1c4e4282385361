"""Token counts, token files and packing against the libraries run on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyloom.llm import packing, segments, token_counts, token_files
from .conftest import edge_rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
FULL = Tokenizer.from_file(WORDS)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
HARD = st.lists(st.sampled_from(list("aZbe'slT19 \n\t#*.,’…éÉèİßẞ \x1c\x85\x0b中é́ﬁΣσ▁ ") + ["'s", "'ll", "<|endoftext|>", "<s>", "  ", "\n\n", "\r\n", "½", "_"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(HARD, max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    ids, counts = segments.word_encoder(WORDS).encode(pa.array(texts, pa.string()))
    want = [e.ids for e in FULL.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert segments.piece_counter(PIECES).count(pa.array(texts, pa.string())).tolist() == [len(MODEL.encode(t)) for t in texts]


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(segments, "SLICE", 64)
    segments._powers.cache_clear()
    texts = [r[1] for r in edge_rows() if r[1] and len(r[1]) < 20000]
    ids, counts = segments.WordEncoder(WORDS).encode(pa.array(texts))
    assert ids.tolist() == [i for e in FULL.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert segments.PieceCounter(PIECES).count(pa.array(texts)).tolist() == [len(MODEL.encode(t)) for t in texts]
    segments._powers.cache_clear()


def test_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(segments, "TABLE_ROWS", 50)
    encoder = segments.WordEncoder(WORDS)
    for seed in range(5):
        texts = [r[1] for r in edge_rows() if r[1]][seed::5]
        ids, _ = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for e in FULL.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_token_counts(edges, nothing):
    got = sorted(map(tuple, token_counts.token_counts(edges, PIECES, limit=100).collect()), key=key)
    want = []
    for r in edge_rows():
        n = len(MODEL.encode(r[1] or ""))
        want.append((r[0], len((r[1] or "").encode()), n, n > 100))
    assert got == sorted(want, key=key)
    assert token_counts.token_counts(nothing, PIECES, 1).collect() == []


def encoded(text, end):
    return np.array([*FULL.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, edges, folder):
    manifest = token_files.write_token_files(edges, folder, WORDS, end_id=2)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    want = sorted(((r[0] is None, r[0] or 0, encoded(r[1], 2).tobytes()) for r in edge_rows()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    assert token_files.token_files_of(spark, folder).count() == manifest.count()
    shard = token_files.TokenShard(manifest.orderBy("shard").first()["path"])
    assert shard.ids(0).astype("<u4").tobytes() == bytes(got[0]["ids"])


def test_broken_shards_are_refused(edges, folder):
    path = token_files.write_token_files(edges, folder, WORDS, end_id=2).first()["path"].removeprefix("file://")
    with open(path, "r+b") as f:
        f.truncate(60)
    with pytest.raises(ValueError):
        token_files.TokenShard(path)


def test_empty_table_has_no_shards(nothing, folder):
    manifest = token_files.write_token_files(nothing, folder, WORDS, end_id=2)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


def test_packing(edges, nothing, folder):
    rows = packing.pack(edges, folder, WORDS, end_id=1, length=128).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 128
    assert sum(128 - sum(n for _, n in p) for p in by_sequence.values()) < 128  # the last one's
    got = sum((r["length"] for r in rows))
    assert got == sum(len(encoded(r[1], 1)) for r in edge_rows())
    for r in edge_rows():
        whole = encoded(r[1], 1)
        if r[0] is not None and r[0] != 8:
            assert b"".join(i for _, i in sorted(by_doc[(r[0], len(whole))])) == whole.tobytes()
    assert packing.pack(nothing, folder + "/none", WORDS, end_id=1).count() == 0


def test_hilbert_key_steps_to_neighbours():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_key(grid, steps=3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_equal_texts_lie_together(spark, folder):
    rows = [(i, ["alpha beta gamma " * 30, "eins zwei drei vier " * 30][i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = packing.pack(docs, folder, WORDS, end_id=1, length=64).where("start = 0").orderBy("sequence_id", "offset").collect()
    kinds = [r["doc_id"] % 2 for r in order]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) == 1


def test_packed_ids_match_checksums(edges, folder):
    rows = packing.pack(edges, folder, WORDS, end_id=1).withColumn("crc", F.crc32("ids")).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["crc"] for r in rows)
