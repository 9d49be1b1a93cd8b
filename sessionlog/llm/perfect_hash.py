"""A minimal perfect hash over 64-bit keys, as arrays that can be memory-mapped.

Level by level, the keys that fall alone into a slot of a bit array stay there;
the others go on to the next, smaller level.  A key's index is the number of
set bits before its slot.  Equal keys can't be told apart, so keys must differ.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = keys + _STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray, room: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of all levels in 64-bit words, first word of each level and the end, set bits before each word)."""
    left, bits, starts = keys.astype(np.uint64), [], [0]
    while len(left):
        size = max(64, -(-int(len(left) * room) // 64) * 64)
        slot = (mixed(left, len(starts)) % np.uint64(size)).astype(np.int64)
        taken = np.bincount(slot, minlength=size)
        bits.append(np.packbits(taken == 1, bitorder="little").view("<u8"))
        starts.append(starts[-1] + len(bits[-1]))
        left = left[taken[slot] > 1]
        if len(starts) > 200:
            raise ValueError("keys repeat")
    words = np.concatenate(bits) if bits else np.empty(0, "<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    return words, np.array(starts, np.int64), before.astype("<u4")


def index(tables: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The index of each key; a key that isn't in the set gets -1 or any index."""
    words, starts, before = tables
    out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level in range(len(starts) - 1):
        if not len(todo):
            break
        size = int(starts[level + 1] - starts[level]) * 64
        slot = mixed(keys[todo], level + 1) % np.uint64(size)
        word, bit = starts[level] + (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
        one = np.uint64(1) << bit
        found = (words[word] & one) != 0
        at = word[found]
        out[todo[found]] = before[at] + np.bitwise_count(words[at] & (one[found] - np.uint64(1))).astype(np.int64)
        todo = todo[~found]
    return out
