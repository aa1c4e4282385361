"""Suffix arrays and common prefixes of a shard of bytes, in array operations.

Induced sorting: suffixes are classified as smaller (S) or larger (L) than the next one; the
leftmost S of each run (LMS) cut the text into substrings.  Two induced passes sort those, equal
ones get equal names, and the shorter text of names is sorted in turn; from the order of
the LMS suffixes two more passes induce that of all.  A pass goes through the 256 buckets; in a
bucket, all suffixes known so far induce their predecessors at once, again for those that fall
into the same bucket.

The text of names has too many letters for passes by bucket.  It is sorted by doubling
ranks of those suffixes that are not yet alone.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last is larger than the empty one."""
    n = t.size
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    step[-1] = -1
    told = np.flatnonzero(step)
    return step[told[np.searchsorted(told, np.arange(n))]] > 0


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes induces."""
    n = t.size
    per = np.bincount(t, minlength=256)
    ends = np.cumsum(per)
    starts = ends - per
    n_small = np.bincount(t[small], minlength=256)
    order = np.empty(n, np.int32)
    # S part of a bucket: the last n_small places.  LMS seeds are kept apart, by first letter.
    letters = t[lms]
    by_letter = lms[np.argsort(letters, kind="stable")]
    seed_ends = np.cumsum(np.bincount(letters, minlength=256))
    at = starts.copy()

    def put_up(places):
        """Append L-type predecessors to their buckets, in order."""
        places = places[places > 0] - 1
        places = places[~small[places]]
        if places.size:
            own = t[places]
            by = np.argsort(own, kind="stable")
            counts = np.bincount(own, minlength=256)
            sorted_ = own[by]
            order[at[sorted_] + np.arange(by.size) - (np.cumsum(counts) - counts)[sorted_]] = places[by]
            at[:] += counts

    put_up(np.array([n], np.int32))  # the empty suffix comes first
    for c in np.flatnonzero(per).tolist():
        done = starts[c]
        while done < at[c]:
            fresh = order[done : at[c]].copy()
            done = at[c]
            put_up(fresh)
        seeds = by_letter[seed_ends[c - 1] if c else 0 : seed_ends[c]]
        if seeds.size:
            put_up(seeds)
    down = ends.copy()

    def put_down(places):
        """Put S-type predecessors at the ends of their buckets, in falling order."""
        places = places[places > 0] - 1
        places = places[small[places]]
        if places.size:
            own = t[places]
            by = np.argsort(own, kind="stable")
            counts = np.bincount(own, minlength=256)
            sorted_ = own[by]
            order[down[sorted_] - 1 - (np.arange(by.size) - (np.cumsum(counts) - counts)[sorted_])] = places[by]
            down[:] -= counts

    for c in np.flatnonzero(per)[::-1].tolist():
        done = ends[c]
        while done > down[c]:
            fresh = order[down[c] : done][::-1].copy()
            done = down[c]
            put_down(fresh)
        larger = order[starts[c] : ends[c] - n_small[c]][::-1]
        if larger.size:
            put_down(larger)
    return order


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the text."""
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (t.size + 8, 8), (1, 1)).copy().view("<u8").reshape(-1)


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from a and from b are the same."""
    out = np.ones(a.size, bool)
    open_, at = np.arange(a.size), 0
    while open_.size:
        left = size[open_] - at
        keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.clip(left, 0, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        equal = ((words[a[open_] + at] ^ words[b[open_] + at]) & keep) == 0
        out[open_[~equal]] = False
        open_ = open_[equal & (left > 8)]
        at += 8
    return out


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of names, by doubling."""
    n = names.size
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_ = names[order]
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # first place of its group
    step = 1
    while True:
        head = np.concatenate([[True], rank[order[1:]] != rank[order[:-1]]])
        alone = head & np.concatenate([head[1:], [True]])
        at = np.flatnonzero(~alone)
        if not at.size:
            return order
        group = order[at]
        after = np.where(group + step < n, rank[np.minimum(group + step, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[group]))
        group, after = group[by], after[by]
        order[at] = group
        old = rank[group]
        fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])])
        rank[group] = at[np.maximum.accumulate(np.where(fresh, np.arange(at.size), 0))]
        step *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``t`` (bytes) in ascending order."""
    n = t.size
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if lms.size < 2:
        return _induce(t, small, lms)
    order = _induce(t, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = order[is_lms[order]]  # LMS substrings in order
    nth = np.empty(n, np.int32)
    nth[lms] = np.arange(lms.size, dtype=np.int32)
    size = np.append(np.diff(lms) + 1, n - lms[-1])  # up to and with the next LMS letter
    own = size[nth[by]]
    last = nth[by] == lms.size - 1  # reaches the end of the text: like no other
    equal = (own[1:] == own[:-1]) & ~last[1:] & ~last[:-1]
    pairs = np.flatnonzero(equal)
    equal[pairs] = _same(_words(t), by[pairs].astype(np.int64), by[pairs + 1].astype(np.int64), own[pairs])
    name = np.concatenate([[0], np.cumsum(~equal)])
    if name[-1] + 1 == lms.size:
        return _induce(t, small, by)
    names = np.empty(lms.size, np.int64)
    names[nth[by]] = name
    return _induce(t, small, lms[_rank_names(names)])


def common_prefixes(t: np.ndarray, order: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of each suffix, by place, with the one before it in order.

    Permuted order: a value is one less than that of the place before it unless the letters before
    the two suffixes differ; only those are compared.  Where ``t`` is several texts that begin at
    ``starts``, each begins with a comparison, and no comparison goes on for longer than the
    longest text: values are exact up to the end of a suffix's own text.
    """
    most = t.size if starts is None else int(np.diff(np.append(starts, t.size)).max()) + 8
    n = t.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    chained = (before > 0) & (place > 0)
    chained[chained] = t[place[chained] - 1] == t[before[chained] - 1]
    if starts is not None:
        chained[starts] = False
    own = np.flatnonzero(~chained)
    value = np.zeros(own.size, np.int64)
    words = _words(t)
    open_ = np.flatnonzero(before[own] >= 0)
    at = 0
    while open_.size and at < most:
        a, b = own[open_] + at, before[own[open_]] + at
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        same = np.minimum(same, n - np.maximum(a, b))
        value[open_] += same
        open_ = open_[same == 8]
        at += 8
    head = np.maximum.accumulate(np.where(~chained, place, 0))
    lookup = np.zeros(n, np.int64)
    lookup[own] = value
    return np.maximum(lookup[head] - (place - head), 0)
