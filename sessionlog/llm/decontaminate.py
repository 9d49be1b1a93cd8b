"""Operator 6: documents that hold a benchmark item, by edit distance over words.

A document holds an item if some passage of it is within ``floor((1 -
similarity) * n)`` word edits of the item's n words (in lower case).

* Embedding (CGK random walk): at step j the walk writes the word it stands on,
  then moves on to the next word or stays, as a random bit of (j, word) says.
  Texts at a small edit distance get embeddings at a small Hamming distance.
  The walks of all windows of a batch run together; two that meet stay
  together, so the work falls with each step.
* Bit-sampling LSH: each hash samples ``samples`` steps of the embedding of a
  window as long as the item.  Hashes are repeated, over ``walks`` walks with
  ``sets`` samples each, for each size class of items (sizes within a factor of
  two), also from later words of the item: an edit near its start then leaves
  other windows whole.  ``measured_recall`` gives the recall these reach.
* Each window whose hash equals an item's is verified: the exact smallest edit
  distance between the item and any passage around the window.

Items go to the tasks in blocks of ``block_items``, so a benchmark of any size
is searched in bounded memory.  Items of fewer than ``least_words`` words are
too short to embed: cut into one piece more than their edits, one piece at least
stays whole, so each place of a piece is verified and none is missed.  Null or
empty texts and items hold nothing.  A null item_id is reported as null.
Repeated rows are answered each on its own.  Other columns of the inputs are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sessionlog.llm.perfect_hash import mixed
from sessionlog.llm.shared import pick
from sessionlog.llm.words import Words

_TABLE_BITS = 20
#: Windows that are embedded at once; longer texts are taken piece by piece.
_PIECE = 1 << 20


def smallest_distance(item: list[int], passage: list[int]) -> int:
    """The fewest word edits between the item and any part of the passage (bit-parallel columns)."""
    n, masks = len(item), defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best = full, 0, n, n
    for w in passage:
        eq = masks.get(w, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        rise = down | (~(flat | up) & full)
        fall = up & flat
        now += bool(rise & top) - bool(fall & top)
        best = min(best, now)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (~(flat | rise) & full), rise & flat
    return best


class Plan:
    """Which steps of which walks each hash samples, for items of one size class (``size`` to 2 size - 1 words)."""

    def __init__(self, size: int, walks: int, sets: int, samples: int, seed: int = 5):
        rng = np.random.default_rng([seed, size])
        self.size = size
        reach = 2 * size  # steps that pass about ``size`` words
        # Spans from half the reach to all of it: short ones survive edits elsewhere, long ones tell items apart.
        spans = [max(samples, reach * (sets + s + 1) // (2 * sets)) for s in range(sets)]
        self.sets = [[np.sort(rng.choice(n, samples, replace=False)) for n in spans] for _ in range(walks)]


def _bits(hashes: np.ndarray, walk: int, word: int) -> np.ndarray:
    return mixed(hashes, 1000 + 100 * walk + word)


def window_hashes(hashes: np.ndarray, walk: int, plans: list[Plan]) -> Iterator[tuple[Plan, int, np.ndarray]]:
    """For each plan and sample set of a walk: a hash of the embedding of the window from each position."""
    n = len(hashes)
    if not n or not plans:
        return
    padded = np.append(hashes, np.uint64(0))  # past the end, the walk stays
    wanted = defaultdict(list)
    for p, plan in enumerate(plans):
        for s, steps in enumerate(plan.sets[walk]):
            for j in steps.tolist():
                wanted[j].append((p, s))
    left = {(p, s): len(steps) for p, plan in enumerate(plans) for s, steps in enumerate(plan.sets[walk])}
    sums = {}
    at, label, bits = np.arange(n), None, None  # the walkers' positions; each window's walker
    for j in range(max(wanted) + 1):
        if j % 64 == 0:
            bits = np.append(_bits(hashes, walk, j // 64), np.uint64(0))
        if j in wanted:
            seen = padded[at]
            seen = seen if label is None else seen[label]
            for key in wanted[j]:
                with np.errstate(over="ignore"):
                    sums[key] = (sums[key] * np.uint64(0x9E3779B97F4A7C15) + seen) if key in sums else seen.copy()
                left[key] -= 1
                if not left[key]:
                    yield plans[key[0]], key[1], mixed(sums.pop(key), key[1])
        at = at + ((bits[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        if j % 8 == 7:  # walkers on the same word go on together
            new = np.concatenate([[True], at[1:] != at[:-1]])
            number = np.cumsum(new) - 1
            at, label = at[new], number if label is None else number[label]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position that has as many."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = mixed(out ^ hashes[j : j + size], j)
    return out


class Items:
    """A block of items with the hashes of their windows."""

    def __init__(self, ids: list, texts: list[str], similarity: float, walks: int, sets: int, samples: int, least_words: int):
        self.ids, self.walks = ids, walks
        words = Words(pc.utf8_lower(pa.array(texts, pa.string())))
        hashes = words.hashes()
        self.words = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        # Rounded before the floor: 0.2 * 15 is three edits.
        self.edits = [int(round((1 - similarity) * len(w), 6)) for w in self.words]
        by_size, pieces = defaultdict(list), defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w) >= least_words:
                by_size[1 << ((len(w)).bit_length() - 1)].append(i)
            elif len(w):
                cuts = np.linspace(0, len(w), min(self.edits[i] + 1, len(w)) + 1).astype(int).tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    pieces[b - a].append((int(runs(w[a:b], b - a)[0]), i, a))
        #: For each length of pieces of short items: their hashes in order, items and offsets.
        self.pieces = {n: (np.array([h for h, _, _ in sorted(x)], np.uint64), [(i, o) for _, i, o in sorted(x)]) for n, x in pieces.items()}
        self.plans = [Plan(size, walks, sets, samples) for size in sorted(by_size)]
        self.tables: dict = {}
        for plan in self.plans:
            own = by_size[plan.size]
            # Windows from the item's start and from each later word that leaves at least half of the class size.
            for walk in range(walks):
                keys = defaultdict(list)
                for i in own:
                    for _, s, h in window_hashes(self.words[i], walk, [plan]):
                        for o, x in enumerate(h.tolist()):
                            if o <= len(self.words[i]) - plan.size // 2:
                                keys[s].append((x, i, o))
                for s, found in keys.items():
                    found.sort()
                    h = np.array([x for x, _, _ in found], np.uint64)
                    marks = np.zeros(1 << _TABLE_BITS, bool)
                    marks[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
                    self.tables[plan.size, walk, s] = (marks, h, np.array([i for _, i, _ in found]), np.array([o for _, _, o in found]))

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(item, position where the item's first word would stand) for windows with equal hashes."""
        out: set = set()
        for n, (keys, owners) in self.pieces.items():
            h = runs(hashes, n)
            a, b = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            at = np.flatnonzero(a < b)
            for pos, x, y in zip(at.tolist(), a[at].tolist(), b[at].tolist(), strict=True):
                out.update((i, pos - o) for i, o in owners[x:y])
        reach = 2 * max((p.size for p in self.plans), default=0)
        for base in range(0, len(hashes), _PIECE):
            for walk in range(self.walks):
                for plan, s, h in window_hashes(hashes[base : base + _PIECE + reach], walk, self.plans):
                    marks, keys, items, offsets = self.tables[plan.size, walk, s]
                    at = np.flatnonzero(marks[(h[:_PIECE] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
                    a, b = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
                    for pos, x, y in zip((base + at[b > a]).tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                        out.update(zip(items[x:y].tolist(), (pos - offsets[x:y]).tolist(), strict=True))
        return out

    def held(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, edits) for the items within their edits of a passage; ``first`` as in Words."""
        # A gap between texts, as long as the longest walk, that no item's words fill.
        gap = 2 * max((p.size for p in self.plans), default=0) * 2 + 2
        sizes = np.diff(first)
        begin = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]).astype(np.int64)
        spread = mixed(np.arange(int((sizes + gap).sum()), dtype=np.uint64), 77)
        spread[np.repeat(begin - first[:-1], sizes) + np.arange(len(hashes))] = hashes
        groups = defaultdict(list)
        for item, pos in self.candidates(spread):
            d = int(np.searchsorted(begin, max(pos, 0), "right")) - 1
            n = len(self.words[item])
            # A window may begin in the gap before its text when edits moved its words.
            for t in {d, min(d + 1, len(begin) - 1)}:
                lo, hi = max(pos - self.edits[item] - n, begin[t]), min(pos + 2 * n + self.edits[item], begin[t] + sizes[t])
                if lo < hi:
                    groups[t, item].append((lo, hi))
        out = []
        for (t, item), spans in sorted(groups.items()):
            spans.sort()
            best, words = len(self.words[item]) + 1, self.words[item].tolist()
            at = 0
            while at < len(spans) and best > 0:
                lo, hi = spans[at]
                while at < len(spans) and spans[at][0] <= hi:  # overlapping passages are one
                    hi = max(hi, spans[at][1])
                    at += 1
                best = min(best, smallest_distance(words, spread[lo:hi].tolist()))
            if best <= self.edits[item]:
                out.append((t, item, best))
        return out


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = 0.8,
    walks: int = 2,
    sets: int = 4,
    samples: int = 6,
    least_words: int = 8,
    block_items: int = 20_000,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id and edits: one row for each item that a document holds."""
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    id_type = to_arrow_type(items.schema[item_id].dataType)
    spark, rows = docs.sparkSession, pick(docs, doc_id=doc_id, text=text)

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items(*shared.value, similarity, walks, sets, samples, least_words)
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.slice(at, 512)
                    words = Words(pc.utf8_lower(part["text"]))
                    found = block.held(words.hashes(), words.first)
                    if found:
                        ids = pa.array([block.ids[i] for _, i, _ in found], id_type)
                        yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array([t for t, _, _ in found])), ids, pa.array([e for _, _, e in found], pa.int64())], ["doc_id", "item_id", "edits"])

        return rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, edits long")

    out, block = None, []
    for r in pick(items, item_id=item_id, text=item_text).filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == block_items:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out


def measured_recall(items: list[str], rate: float, walks: int = 2, sets: int = 4, samples: int = 6, trials: int = 200, seed: int = 3) -> float:
    """The share of items found again after a share ``rate`` of their words was replaced, dropped or doubled."""
    rng = np.random.default_rng(seed)
    block = Items(list(range(len(items))), items, 0.0, walks, sets, samples, 1)
    found = 0
    for _ in range(trials):
        i = int(rng.integers(len(items)))
        words = block.words[i].tolist()
        for at in sorted(rng.choice(len(words), int(rate * len(words)), replace=False).tolist(), reverse=True):
            fresh = int(rng.integers(1, 2**63))
            words[at : at + 1] = [[fresh], [], [words[at], fresh]][int(rng.integers(3))]
        text = np.concatenate([rng.integers(1, 2**63, 30).astype(np.uint64), np.array(words, np.uint64), rng.integers(1, 2**63, 200).astype(np.uint64)])
        found += any(item == i for item, _ in block.candidates(text))
    return found / trials
