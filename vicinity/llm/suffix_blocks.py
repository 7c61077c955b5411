"""Vectorised helpers of the suffix-array dedup: text blocks, window keys, and sorted suffixes of a bucket."""

from __future__ import annotations

import functools

import numpy as np

#: Length of the sub-strings whose least hash is a window's key.
GRAM = 26
#: A difference cover modulo 13: any two residues have a common shift below 13 that takes both into it.
CYCLE, COVER = 13, (0, 1, 3, 9)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every sub-string of ``length`` bytes, equal for equal sub-strings wherever they lie."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64)
    room = 1 << max(16, (n - 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers(_BASE, room)[:n], out=sums[1:])
    h = (sums[length:] - sums[:-length]) * powers(pow(_BASE, -1, 1 << 64), room)[:n - length + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    out, reach = h, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[:len(out) - (width - reach)], out[width - reach:]) if reach < width else out


def leads(hashes: np.ndarray, first: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Distance from each window start to the first sub-string that gives its key."""
    at, left = np.zeros(len(first), np.int64), np.arange(len(first))
    for shift in range(width):
        hit = hashes[first[left] + shift] == key[left]
        at[left[hit]] = shift
        left = left[~hit]
        if not len(left):
            break
    return at


class Runs:
    """The windows of a block of documents, in runs of neighbours with one key.

    A window's key is the least hash among its sub-strings of GRAM bytes, so equal
    windows have equal keys in whatever document they stand. ``first`` and ``stop``
    are window starts in the block, ``lead`` is how far before the sub-string of its
    key the first window starts (all its windows contain that one first), ``doc`` the place of the document in the block.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, window: int):
        width = window - GRAM + 1
        hashes = gram_hashes(data.astype(np.uint64), GRAM)
        if len(hashes) < width:
            keys = np.empty(0, np.uint64)
        else:
            keys = sliding_least(hashes, width)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[:len(keys)]
        inside = np.arange(len(keys)) + window <= ends[owner]
        change = np.ones(len(keys), bool)
        change[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        # Windows that reach into the next document end a run, too.
        bounds = np.flatnonzero(change)
        stops = np.r_[bounds[1:], len(keys)]
        fine = inside[bounds] if len(keys) else np.empty(0, bool)
        self.first, stop = bounds[fine], stops[fine]
        self.doc = owner[self.first]
        self.stop = np.minimum(stop, ends[self.doc] - window + 1)
        self.key = keys[self.first]
        self.lead = leads(hashes, self.first, self.key, width)
        self.window, self.data = window, data
        self._cut(hashes, width)

    def _cut(self, hashes: np.ndarray, width: int) -> None:
        """End every run where its sub-string is left behind and a later one gives the same key."""
        parts, more = [], (self.first, self.stop, self.lead, self.doc, self.key)
        while len(more[0]):
            first, stop, lead, doc, key = more
            parts.append((first, np.minimum(stop, first + lead + 1), lead, doc, key))
            go_on = np.flatnonzero(stop > first + lead + 1)
            first, stop, doc, key = (first + lead + 1)[go_on], stop[go_on], doc[go_on], key[go_on]
            more = first, stop, leads(hashes, first, key, width), doc, key
        if len(parts) > 1:
            merged = [np.concatenate(p) for p in zip(*parts)]
            order = np.argsort(merged[0], kind="stable")
            self.first, self.stop, self.lead, self.doc, self.key = (m[order] for m in merged)

    def shapes(self) -> np.ndarray:
        """A 64-bit hash of each run: its key, lead and whole text."""
        size = self.stop - self.first + self.window - 1
        n = len(self.data)
        room = 1 << max(16, (n - 1).bit_length()) if n else 1 << 16
        base, back = 0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(base, room)[:n], out=sums[1:])
        h = (sums[self.first + size] - sums[self.first]) * powers(back, room)[self.first]
        h = (h ^ (h >> np.uint64(31))) * _MIX + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + self.lead.astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return (h ^ (h >> np.uint64(29))) ^ self.key


class PieceRuns:
    """Runs of a block that is walked in pieces, so that a very long text needs little memory beside itself."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, window: int, piece: int):
        ends, parts = np.cumsum(lengths), []
        for a in range(0, max(1, len(data)), piece):
            part = data[a:min(a + piece + window - 1, len(data))]
            inner = np.clip(ends - a, 0, len(part))
            runs = Runs(part, np.diff(inner, prepend=0), window)
            fresh = runs.first < piece
            parts.append([x[fresh] for x in (runs.first + a, np.minimum(runs.stop, piece) + a, runs.lead, runs.doc, runs.key, runs.shapes())])
        self.first, self.stop, self.lead, self.doc, self.key, self.shape = (np.concatenate(x) for x in zip(*parts))


def words_at(text: np.ndarray, starts: np.ndarray, count: int) -> list[np.ndarray]:
    """``count`` big-endian 8-byte words from each start; numbers that sort like the bytes."""
    padded = np.r_[text, np.zeros(8 * count + 8, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return [np.ascontiguousarray(view[starts + 8 * i]).view(">u8")[:, 0].astype(np.uint64) for i in range(count)]


def numbered(*columns: np.ndarray) -> np.ndarray:
    """Rank of each row among the distinct rows of the columns, first column most significant."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sorted_classes(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Rank of the ``window``-byte prefix of the suffix at each start; equal prefixes share a rank.

    The caller lays the text so that equal windows start at equal residues modulo CYCLE. Then
    they have a common shift, below CYCLE, to the cover. Suffixes are bucketed by their first 16
    bytes; ties are not read on but take the rank that their cover position got when the cover's
    strings were sorted beforehand, and last the 16 bytes at the window's end, which that rank
    may not reach.
    """
    if not len(starts):
        return np.empty(0, np.int64)
    reach = window - CYCLE + 1
    samples = np.flatnonzero(np.isin(np.arange(len(text)) % CYCLE, COVER))
    ranks = np.zeros(len(text) + CYCLE, np.int64)
    ranks[samples] = numbered(*prefix_words(text, samples, reach))
    shift = np.array([min((c - r) % CYCLE for c in COVER) for r in range(CYCLE)])
    residue = starts % CYCLE
    return numbered(*words_at(text, starts, 2), residue, ranks[starts + shift[residue]], *words_at(text, starts + window - 16, 2))


def prefix_words(text: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Words of the first ``length`` bytes from each start."""
    words = words_at(text, starts, -(-length // 8))
    if length % 8:
        words[-1] &= np.uint64(((1 << (8 * (length % 8))) - 1) << (64 - 8 * (length % 8)))
    return words
