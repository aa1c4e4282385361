"""Vectorised cutting and hashing of texts inside tasks.

Texts of an Arrow batch lie one after another in one byte buffer.  They are cut at
places where a tokenizer provably starts anew, the pieces are hashed by prefix sums
of a polynomial, and only pieces a worker has not met yet go through the tokenizer
library; their ids or counts are kept per worker in a bounded table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20  # bytes worked on at once; arrays of eight bytes per byte stay small
TABLE_ROWS = 1_500_000  # pieces a worker remembers before it starts anew

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
# Class of each byte.
SPACE, LETTER, DIGIT, SYMBOL, OTHER = 0, 1, 2, 3, 4
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[33:127] = SYMBOL
_CLASS[[9, 10, 12, 13, 32]] = SPACE
_CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[ord("A") : ord("Z") + 1] = LETTER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    usual = SLICE + (SLICE >> 2)
    return _powers(usual if n <= usual else 1 << (n - 1).bit_length())


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] telling the bytes s..e apart, up to a factor of place s."""
    up, _ = powers(data.size + 1)
    out = np.zeros(data.size + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, free of its place."""
    _, down = powers(prefix.size)
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * down[starts]
        h ^= (ends - starts).astype(np.uint64) * _LENGTH
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def parts(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """The batch in runs of rows whose texts have about ``most`` bytes, so that what is made from them stays small."""
    _, offsets = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def slices(data: np.ndarray, offsets: np.ndarray, is_cut) -> list[tuple[int, int]]:
    """Byte ranges of about SLICE bytes, ending where a text ends or, inside a long one, at a safe cut.

    ``is_cut(lo, hi)`` gives the places in lo..hi at which a range may end.
    """
    out, lo, n = [], 0, data.size
    while lo < n:
        hi = min(lo + SLICE, n)
        if hi < n:
            k = int(np.searchsorted(offsets, hi, "right")) - 1
            if offsets[k] > lo:
                hi = int(offsets[k])
            else:  # one text fills the slice
                end, at = int(offsets[k + 1]), hi
                while at < end:
                    found = is_cut(at, min(at + 65536, end))
                    if found.size:
                        at = int(found[0])
                        break
                    at += 65536
                hi = min(at, end)
        out.append((lo, hi))
        lo = hi
    return out


class PieceTable:
    """Values of pieces by hash: runs of ids in one flat array."""

    def __init__(self, values_of):
        self.values_of = values_of
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)

    def rows(self, keys, data, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in flat, lengths) per piece, and flat; unknown pieces are valued first."""
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.keys.size + unique.size > TABLE_ROWS:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(unique.size, bool)
        inside = at < self.keys.size
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            fresh = first[~known]
            raw = data.tobytes()
            flat, size = self.values_of([raw[s:e] for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist())])
            place = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[:-1] + self.flat.size
            self.flat = np.concatenate([self.flat, flat])
            spot = at[~known]
            self.keys = np.insert(self.keys, spot, unique[~known])
            self.at = np.insert(self.at, spot, place)
            self.size = np.insert(self.size, spot, size)
            at = np.searchsorted(self.keys, unique)
        return self.at[at][inverse], self.size[at][inverse], self.flat


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[at : at + size], one after another."""
    size = size.astype(np.int64)
    total = int(size.sum())
    before = np.cumsum(size) - size
    return flat[np.repeat(at - before, size) + np.arange(total)]


# ---- cuts of the tokenizer that lower-cases, splits by class and drops white space ----


def class_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (starts, ends) such that encoding them one by one equals encoding each text.

    Cuts lie at white space and between ASCII or Latin letters, digits and ASCII symbols;
    never beside another character, and never between an apostrophe and a letter.
    """
    n = data.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)) if n > 1 else np.zeros(0, np.int64)
    if lead.size:  # two-byte Latin letters, but for the signs of times and division, and dotted capital I
        one, two = data[lead], data[lead + 1]
        odd = ((one == 0xC3) & ((two == 0x97) | (two == 0xB7))) | ((one == 0xC4) & (two == 0xB0))
        lead = lead[~odd]
        kind[lead] = LETTER
        kind[lead + 1] = LETTER
    a, c = kind[:-1], kind[1:]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    inner = (a != c) & (a != OTHER) & (c != OTHER) & ~((data[:-1] == 39) & (c == LETTER))
    inner |= (a == DIGIT) & (c == DIGIT)
    inner |= (a == SPACE) != (c == SPACE)
    cut[1:n] = inner
    cut[offsets] = True
    places = np.flatnonzero(cut)
    starts, ends = places[:-1], places[1:]
    word = kind[starts] != SPACE
    return starts[word], ends[word]


_SIMPLE = re.compile(r"[a-zÀ-įı-ɏ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
# The byte-level vocabulary shows printable bytes as themselves, the others from code 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


class WordEncoder:
    """Ids of whole texts by ``tokenizers``; each distinct piece is encoded once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.merge = self.full.model.tokenize  # for pieces that are normal and whole already
        if self.full.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.table = PieceTable(self._values)

    def _values(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        merge, simple = self.merge, _SIMPLE.fullmatch
        ids, size, odd = [], [], []
        for p in pieces:
            word = p.decode("utf-8", "replace").lower()
            if simple(word):
                got = [t.id for t in merge(word if len(word) == len(p) else word.encode().decode("latin-1").translate(_SHOWN))]
            else:
                odd.append(len(size))
                got = None
            size.append(got)
        if odd:  # anything else takes the library's whole path
            for i, done in zip(odd, self.full.encode_batch([pieces[i].decode("utf-8", "replace") for i in odd], add_special_tokens=False)):
                size[i] = done.ids
        for got in size:
            ids += got
        return np.array(ids, np.uint16), np.fromiter(map(len, size), np.int32, len(size))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        if any(s in raw for s in _SPECIAL):
            return self._with_special(data, offsets)
        return self._encode(data, offsets)

    def _encode(self, data, offsets):
        parts, counts = [], np.zeros(offsets.size - 1, np.int64)
        space = lambda lo, hi: lo + np.flatnonzero(_CLASS[data[lo:hi]] == SPACE)
        for lo, hi in slices(data, offsets, space):
            own = data[lo:hi]
            first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            inner = np.clip(offsets[first : last + 1] - lo, 0, hi - lo)
            starts, ends = class_cuts(own, inner)
            if not starts.size:
                continue
            keys = range_hash(prefix_hash(_LOWER[own]), starts, ends)
            at, size, flat = self.table.rows(keys, own, starts, ends)
            parts.append(gather(flat, at, size))
            total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            counts[first:last] += np.diff(total[np.searchsorted(starts, inner, "left")])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), counts

    def _with_special(self, data, offsets):
        """Texts that hold a special string go whole through the library."""
        raw, ids, counts = data.tobytes(), [], np.zeros(offsets.size - 1, np.int64)
        for i in range(offsets.size - 1):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            if any(s in raw[lo:hi] for s in _SPECIAL):
                own = np.array(self.full.encode(raw[lo:hi].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16)
            else:
                own, _ = self._encode(data[lo:hi], np.array([0, hi - lo]))
            ids.append(own)
            counts[i] = own.size
        return np.concatenate(ids), counts


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary file."""
    return WordEncoder(path)


# ---- cuts of the piece model: spaces belong to the word after them, line breaks stand alone ----


def space_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (starts, ends): a run of spaces with the word after it, a line break with the word after it."""
    n = data.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space, line = data == 32, data == 10
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = (space[1:] & ~space[:-1]) | line[1:]
    cut[offsets] = True
    places = np.flatnonzero(cut)
    return places[:-1], places[1:]


class PieceCounter:
    """Token counts of whole texts by ``sentencepiece``; lengths only leave the library's call.

    The model turns spaces into a mark, puts one more before a text, and has no piece in which
    the mark follows another character and none with a line break.  So a text with a space put
    before it may be cut before each run of spaces and before each line break.
    """

    BATCH = 1 << 18  # bytes sent to the library at once
    MARK = "\u2581"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any(self.MARK in p.lstrip(self.MARK) or "\n" in p for p in pieces)
        kept = "".join(self.model.encode("a  b ", out_type=str)) == "\u2581a\u2581\u2581b\u2581"
        self.safe = kept and not inner
        self.table = PieceTable(self._values)

    def _values(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Count of each piece, as two halves of 16 bits."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        given = [t[1:] if t[0] == " " else t for t in texts]  # the model puts that space back
        batch = np.cumsum([len(p) for p in pieces]) // self.BATCH  # batches of about equal bytes
        count, lo = np.zeros(len(given), np.int64), 0
        for hi in [*(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(given)]:
            count[lo:hi] = [len(x) for x in self.model.encode(given[lo:hi], num_threads=1)]
            lo = hi
        for i, t in enumerate(texts):
            if t == " ":
                count[i] = 1  # a lone space: to the library it would be an empty text
            elif t[0] == "\n":
                count[i] -= 1  # without the space that the library put before it
        halves = np.zeros((len(count), 2), np.uint16)
        halves[:, 0], halves[:, 1] = count & 0xFFFF, count >> 16
        return halves.reshape(-1), np.full(len(count), 2, np.int32)

    def whole(self, raw: bytes) -> int:
        return len(self.model.encode(raw.decode("utf-8", "replace")))

    def count(self, column) -> np.ndarray:
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        mark = self.MARK.encode()
        if not self.safe or mark in raw:  # texts that hold the mark itself go whole through the library
            odd = [not self.safe or mark in raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            parts = []
            for i, whole in enumerate(odd):
                own = data[offsets[i] : offsets[i + 1]]
                parts.append([self.whole(own.tobytes())] if whole else self._count(own, np.array([0, own.size])))
            return np.concatenate(parts).astype(np.int64)
        return self._count(data, offsets)

    def _count(self, data, offsets):
        counts = np.zeros(offsets.size - 1, np.int64)
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[full], np.uint8(32))
        longer = np.zeros(offsets.size, np.int64)
        longer[full + 1] = 1
        offsets = offsets + np.cumsum(longer)
        cut = lambda lo, hi: lo + np.flatnonzero(((data[lo:hi] == 32) & (data[lo - 1 : hi - 1] != 32)) | (data[lo:hi] == 10))
        for lo, hi in slices(data, offsets, cut):
            own = data[lo:hi]
            first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            inner = np.clip(offsets[first : last + 1] - lo, 0, hi - lo)
            starts, ends = space_cuts(own, inner)
            keys = range_hash(prefix_hash(own), starts, ends)
            at, _, flat = self.table.rows(keys, own, starts, ends)
            value = flat[at].astype(np.int64) | (flat[at + 1].astype(np.int64) << 16)
            total = np.concatenate([[0], np.cumsum(value)])
            counts[first:last] += np.diff(total[np.searchsorted(starts, inner, "left")])
        return counts


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One counter per worker and model file."""
    return PieceCounter(path)
