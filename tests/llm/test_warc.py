"""Archives: round trips, revisits, and magic strings inside payloads."""

import base64
import hashlib

import numpy as np
import pytest

from surveyloom.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, place string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a", "<p>one</p>"),
    (2, "http://b\r\nX: y", "<p>one</p>"),
    (3, None, "<p>one</p>"),
    (4, "http://d", None),
    (5, "http://e", ""),
    (6, "http://f", FAKE * 300),
    (7, "http://g", "ü" * 50000),
    (8, "http://h", "WARC/1.1\r\n" * 3000),
    (9, "http://i", "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999999\r\n\r\n"),
    (9, "http://i", "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999999\r\n\r\n"),
    (None, "http://j", "nobody"),
    (None, "http://j", "nobody"),
    (None, "http://j", "<p>one</p>"),
    (10, "http://k", FAKE + "\r\n\r\nWARC/1.1\r\nContent-Length: 60000\r\n\r\n"),
]


@pytest.mark.parametrize("block", [700, 4096, 1 << 20])
@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, folder, block, least):
    files = warc.write_archives(pages_of(spark, ROWS).repartition(2), folder, min_bytes=least)
    got = sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]), r["intact"]) for r in warc.read_archives(files, f"{folder}/read", block).collect()), key=repr)
    largest, want = {}, []
    for page, _, html in ROWS:
        if len((html or "").encode()) >= least and page is not None:
            largest[html or ""] = max(largest.get(html or "", page), page)
    for page, _, html in ROWS:
        html = html or ""
        first = largest.get(html)
        revisit = first is not None and page != first
        want.append((None if page is None else str(page), len(html.encode()), digest(html), "revisit" if revisit else "response", str(first) if revisit else None, None if revisit else html.encode(), True))
    assert [g[:-2] for g in got] == [w[:-2] for w in sorted(want, key=repr)]
    assert all(g[-1] for g in got) and sorted(map(repr, got)) == sorted(repr(w if w[5] != b"" else (*w[:5], b"", True)) for w in want)


def test_candidates_hold_fakes_that_the_chain_skips():
    record = warc.page_record("1", "http://a", FAKE.encode(), None, "x", len(FAKE), "2024-01-01T00:00:00Z")
    data = record + record
    places, following = warc.candidates(data, 0, len(data), 0, len(data))
    assert places.size == 4 and following[0] == len(record) and following[2] == len(data)
    out, records = warc.exits(places, following, len(data), len(data))
    assert records[0] == 2
    assert out[0] == len(data) and out[1] != len(data) or np.isin(following[1], places)


def test_cut_file_ends_its_chain(spark, folder):
    files = warc.write_archives(pages_of(spark, ROWS[:3]).coalesce(1), folder)
    path = files.first()["path"]
    name = path.removeprefix("file://")
    with open(name, "r+b") as f:
        f.truncate(files.first()["size"] - 7)
    shorter = spark.createDataFrame([(path, files.first()["size"] - 7)], "path string, size long")
    assert warc.read_archives(shorter, f"{folder}/read").count() == 2


def test_empty_table(spark, folder):
    files = warc.write_archives(pages_of(spark, ROWS).limit(0), folder)
    assert files.count() == 0 and warc.read_archives(files, f"{folder}/read").count() == 0


@pytest.mark.parametrize("block", [1 << 16, 1 << 20])
def test_headers_of_any_length(spark, folder, monkeypatch, block):
    """A data: url longer than what is read ahead at first, near a block's end and in its middle."""
    monkeypatch.setattr(warc, "AHEAD_BYTES", 1 << 10)
    rows = [(i, "data:" + "u" * 3_000_000 if i == 20 else "data:" + "WARC/1.1" * 40_000 if i % 13 == 5 else "http://x", f"<p>{i}</p>" * 900) for i in range(60)]
    files = warc.write_archives(pages_of(spark, rows).coalesce(1), folder)
    back = warc.read_archives(files, f"{folder}/read", block).collect()
    assert {r["record_id"]: (r["uri"], bytes(r["payload"]).decode(), r["intact"]) for r in back} == {str(i): (u, h, True) for i, u, h in rows}


def test_other_number_of_records_is_an_error(spark, folder):
    files = warc.write_archives(pages_of(spark, ROWS).coalesce(1), folder)
    warc.read_archives(files, f"{folder}/right")
    with pytest.raises(ValueError, match="records"):
        warc.read_archives(files.withColumn("n_records", files["n_records"] + 1), f"{folder}/wrong")
