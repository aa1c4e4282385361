"""Web archives (WARC/1.1): pages to records, equal payloads as revisits, and reading in blocks.

Writing: of pages with equal payloads the one with the largest id is stored as ``response``;
the others become ``revisit`` records that refer to it.  Payloads shorter than ``min_bytes``
are always stored.

Reading splits files into blocks, so that a large file is read by many tasks.  The magic string
can lie inside a payload, so a task only emits *candidates*: places that look like a record, each
with the place where the next record would start.  Within its block a task follows these
pointers to the first place outside.  Between blocks the pointers are doubled (pointer jumping)
from the start of each file; a block is then read from the one place where the true chain enters
it.  What the chain does not reach was no record.

* A null html is an empty payload; a null url leaves the target field out.
* Among equal payloads null ids never are the largest; without any id all are responses.  Rows that
  share the largest id are all responses.
* A header may have any length: a task reads on until it ends.
* A record that reaches beyond the end of its file ends the chain there.  Where the list of files says
  how many records they have, as the list that writing returns does, another number is an error.
* Other columns are not read.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import attach_counted, drop_settled, settle, shuffle_partitions
from surveyloom.llm.files import open_system, whole_file

VERSION = b"WARC/1.1\r\n"
MAGIC = b"WARC/1."
BLANK = b"\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
BLOCK_BYTES = 8 << 20
AHEAD_BYTES = 1 << 16  # read beyond a block for the header that starts in it; doubled until that header ends


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))]]
    return VERSION + "\r\n".join(lines).encode() + BLANK + block + BLANK


def _field(text: str) -> str:
    """A header value holds no line breaks."""
    return re.sub(r"[\r\n]+", "%0A", text)


def page_record(page_id, url, payload: bytes, refers_to, digest: str, size: int, date: str) -> bytes:
    """A response record with its payload, or a revisit record without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    return _record(fields, block)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives into ``folder``; returns the settled list of files (path, size, n_records)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
    same = settle(same.where("n > 1 and largest is not null"), folder, "equal-payloads")
    # A small list of repeated payloads is sent to the pages; only a long one makes the pages move.
    rows = attach_counted(rows, same.select("sha", "largest", "n"), ["sha"], "n", spread_by=["id"])
    revisits = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest")) & (F.octet_length("html") >= min_bytes)
    rows = rows.select(
        F.col("id").cast("string").alias("id"),
        "url",
        F.when(~revisits, F.col("html").cast("binary")).alias("payload"),
        F.when(revisits, F.col("largest").cast("string")).alias("refers_to"),
        "sha",
        F.octet_length("html").alias("size"),
    )

    def write(batches):
        context = TaskContext.get()
        part, made = 0, []
        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

        def records():
            for batch in batches:
                columns = [batch.column(i) for i in range(6)]
                for i in range(batch.num_rows):
                    page, url, payload, refers, sha, size = (c[i].as_py() for c in columns)
                    yield page_record(page, url, payload, refers, base64.b32encode(sha).decode(), size, date)

        source = records()
        record = next(source, None)
        while record is not None:
            uri = f"{folder}/part-{context.partitionId():06d}-{part:04d}.warc"
            with whole_file(uri, context.taskAttemptId()) as out:
                out.write(info)
                size, count = len(info), 1
                while record is not None and size < FILE_BYTES:
                    out.write(record)
                    size, count = size + len(record), count + 1
                    record = next(source, None)
            made.append((uri, size, count))
            part += 1
        if made:
            paths, sizes, counts = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "size", "n_records"])

    return settle(rows.mapInArrow(write, "path string, size long, n_records long"), folder, "files")


# ---- reading ----


def _header_at(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """(fields, end of the header) of the record header that starts at ``at``; None when it is none."""
    end = data.find(BLANK, at)
    if end < 0:
        return None
    lines = data[at:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return None
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, end + len(BLANK)


def candidates(data: bytes, lo: int, hi: int, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in lo..hi that look like a record, and where the next one would start.

    ``data`` begins at place ``base`` of the file and reaches past ``hi`` to the end of the last header.
    """
    at, places, following = data.find(MAGIC, lo - base), [], []
    while 0 <= at < hi - base:
        if at + base == 0 or data[at - 4 : at] == BLANK:
            found = _header_at(data, at)
            if found:
                after = base + found[1] + int(found[0][b"content-length"]) + len(BLANK)
                if after <= size:
                    places.append(at + base)
                    following.append(after)
        at = data.find(MAGIC, at + 1)
    return np.array(places, np.int64), np.array(following, np.int64)


def exits(places: np.ndarray, following: np.ndarray, hi: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place at or after ``hi`` that each candidate's chain reaches (-1 where it breaks, ``size`` at the end), and its records."""
    out, records = np.full(places.size, -1, np.int64), np.ones(places.size, np.int64)
    row = {int(p): i for i, p in enumerate(places)}
    for i in range(places.size - 1, -1, -1):
        after = int(following[i])
        if after >= hi or after >= size:
            out[i] = after
        elif after in row:
            out[i] = out[row[after]]
            records[i] += records[row[after]]
    return out, records


def _with_headers(source, base: int, lo: int, hi: int, size: int) -> bytes:
    """The file from ``base`` to beyond ``hi``, so far that every header that starts in lo..hi has its end."""
    ahead = AHEAD_BYTES
    while True:
        end = min(hi + ahead, size)
        data = source.read_at(end - base, base)
        last = data.rfind(MAGIC, lo - base, hi - base + len(MAGIC) - 1)
        if last < 0 or end == size or data.find(BLANK, last) >= 0:
            return data
        ahead *= 2


def _blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    n = shuffle_partitions(files.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))
    cut = files.where("size > 0").select("path", "size", F.explode(starts).alias("lo"))
    return cut.repartitionByRange(n, "path", "lo")


def chain_entries(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, size, block, entry): where the chain of true records enters each block it enters."""

    def scan(batches):
        for batch in batches:
            for path, size, lo in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, name = open_system(path)
                hi, base = min(lo + block_bytes, size), max(0, lo - len(BLANK))
                with system.open_input_file(name) as source:
                    data = _with_headers(source, base, lo, hi, size)
                places, following = candidates(data, lo, hi, base, size)
                if places.size:
                    out, records = exits(places, following, hi, size)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * places.size), pa.array(places), pa.array(out), pa.array(records)], ["path", "place", "next", "records"])

    scanned = settle(_blocks(files, block_bytes).mapInArrow(scan, "path string, place long, next long, records long"), folder, "candidates")
    found = scanned.drop("records")
    # Only places some chain arrives at, and the starts of files, can be entries.
    arrived = found.where("next >= 0").select("path", F.col("next").alias("place")).union(files.select("path", F.lit(0).cast("long").alias("place"))).distinct()
    nodes = found.join(arrived, ["path", "place"], "left_semi")
    jumps = settle(nodes, folder, "jumps-0")
    reached = settle(jumps.where("place = 0").select("path", "place"), folder, "reached-0")
    turn, before = 0, -1
    while (now := reached.count()) != before:
        before, turn = now, turn + 1
        step = reached.join(jumps, ["path", "place"]).where("next >= 0").select("path", F.col("next").alias("place"))
        valid = step.join(found, ["path", "place"], "left_semi")
        following = settle(reached.union(valid).distinct(), folder, f"reached-{turn}")
        further = jumps.select("path", F.col("place").alias("from"), F.col("next").alias("place")).join(jumps, ["path", "place"], "left")
        doubled = settle(further.select("path", F.col("from").alias("place"), F.coalesce("next", F.lit(-1).cast("long")).alias("next")), folder, f"jumps-{turn}")
        drop_settled(files.sparkSession, folder, f"jumps-{turn - 1}")
        drop_settled(files.sparkSession, folder, f"reached-{turn - 1}")
        reached, jumps = following, doubled
    if "n_records" in files.columns:
        read = reached.join(scanned, ["path", "place"]).groupBy("path").agg(F.sum("records").alias("read"))
        wrong = files.join(read, "path", "left").where(F.coalesce("read", F.lit(0)) != F.col("n_records")).select("path", "n_records", "read").first()
        if wrong:
            raise ValueError(f"{wrong['path']} has {wrong['n_records']} records, {wrong['read']} can be reached")
    own = files.select("path", "size")
    return reached.join(own, "path").select("path", "size", (F.floor(F.col("place") / block_bytes)).cast("long").alias("block"), F.col("place").alias("entry"))


def read_archives(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, payloads: bool = True) -> DataFrame:
    """Every record but warcinfo: path, place, record_type, record_id, uri, refers_to, payload_bytes, payload_digest, intact, payload.

    ``payload_digest`` and ``payload_bytes`` of a response come from its payload, those of a revisit
    from its header, as its payload is elsewhere.  ``intact``: digests agree with the headers.
    """
    entries = settle(chain_entries(files, folder, block_bytes), folder, "entries")
    names = ["path", "place", "record_type", "record_id", "uri", "refers_to", "payload_bytes", "payload_digest", "intact", "payload"]

    def text(value: bytes | None) -> str | None:
        return None if value is None else value.decode("utf-8", "replace")

    def named(value: bytes | None) -> str | None:
        found = re.fullmatch(rb"<urn:page:(.+)>", value or b"")
        return text(found[1]) if found else None

    def walk(source, size, place, hi):
        """Records from ``place`` on, up to the first that starts at or after ``hi``."""
        data, base = b"", place
        while place < min(hi, size):
            want = place - base
            ahead = 16 * AHEAD_BYTES
            while data.find(BLANK, want) < 0 and base + len(data) < size:
                base, data, want = place, source.read_at(min(ahead, size - place), place), 0
                ahead *= 2
            found = _header_at(data, want)
            if not found:
                return
            fields, end = found
            length = int(fields[b"content-length"])
            if base + end + length + len(BLANK) > size:
                return
            if end + length <= len(data):
                block = data[end : end + length]
            else:
                block = source.read_at(length, base + end)
            yield place, fields, block
            place = base + end + length + len(BLANK)

    def read(batches):
        for batch in batches:
            for path, size, block_no, entry in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, name = open_system(path)
                rows, held = [], 0
                with system.open_input_file(name) as source:
                    for place, fields, block in walk(source, size, entry, (block_no + 1) * block_bytes):
                        kind = text(fields.get(b"warc-type"))
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(BLANK)
                        told = text(fields.get(b"warc-payload-digest", b"")).removeprefix("sha1:")
                        whole = _digest(block) == text(fields.get(b"warc-block-digest", b"")).removeprefix("sha1:")
                        if kind == "revisit":
                            length = re.search(rb"(?im)^content-length: *(\d+)", head)
                            count, digest = int(length[1]) if length else None, told
                        else:
                            count, digest = len(payload), _digest(payload)
                        rows.append((path, place, kind, named(fields.get(b"warc-record-id")), text(fields.get(b"warc-target-uri")), named(fields.get(b"warc-refers-to")), count, digest, whole and digest == told, payload if payloads and kind != "revisit" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = shuffle_partitions(files.sparkSession)
    schema = "path string, place long, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary"
    return entries.select("path", "size", "block", "entry").repartitionByRange(n, "path", "block").mapInArrow(read, schema)
