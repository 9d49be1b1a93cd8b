"""Words of whole batches of texts as arrays: bounds and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sessionlog.llm.perfect_hash import mixed

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LETTER = mixed(np.arange(256, dtype=np.uint64), 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Hasher:
    """Polynomial hashes of byte ranges, modulo 2**64, from running sums."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1), _powers(_BASE, 1)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            # A block of whole words, of _BLOCK bytes or of one longer word.
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
            first, last = int(starts[at]), int(ends[to - 1])
            n = last - first
            if len(self.up) <= n:
                self.up = _powers(_BASE, max(n + 1, _BLOCK + 1))
                self.down = _powers(pow(_BASE, -1, 2**64), max(n + 1, _BLOCK + 1))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTER[data[first:last]] * self.up[:n], out=sums[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = mixed((sums[e] - sums[s]) * self.down[s], 3)
            at = to
        return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, A-Z in lower case; or runs between other bytes.

    ``starts`` and ``ends`` are byte positions in ``data``; ``first[d]`` is the
    number of the first word of text d, ``first[-1]`` the number of all words.
    """

    def __init__(self, texts: pa.Array, gaps: np.ndarray = _SPACE):
        texts = texts.fill_null("").cast(pa.large_string())
        if len(texts):
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
        else:
            bounds, raw = np.zeros(1, np.int64), None
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        self.data, self.bounds = _LOWER[data], bounds
        word = ~gaps[data]
        cut = np.zeros(len(data) + 1, bool)  # where another text begins
        cut[bounds] = True
        self.starts = np.flatnonzero(word & (np.append(True, ~word[:-1])[: len(word)] | cut[:-1]))
        self.ends = np.flatnonzero(word & (np.append(~word[1:], True)[: len(word)] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        return Hasher()(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


class Lookup:
    """Positions of 64-bit keys in a sorted array, for keys of any spread: buckets by mixed hash, then compares."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, int(max(1, len(keys)) - 1).bit_length())
        h = mixed(keys.astype(np.uint64), 5) >> np.uint64(64 - self.bits)
        self.order = np.argsort(h, kind="stable")
        self.keys = keys.astype(np.uint64)[self.order]
        self.starts = np.searchsorted(h[self.order], np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        out = np.full(len(keys), -1, np.int32)
        h = (mixed(keys, 5) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[h], self.starts[h + 1]
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            same = self.keys[at] == keys[todo]
            out[todo[same]] = self.order[at[same]]
            at = at + 1
            more = ~same & (at < end)
            todo, at, end = todo[more], at[more], end[more]
        return out
