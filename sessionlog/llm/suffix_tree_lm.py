"""Operator 7: scoring by a probabilistic suffix tree over words.

Tokens are words (A-Z in lower case) and one end token a text.  The tree's
states are word contexts of 0 to ``depth`` words, longest match first:

* An n-gram is in the tree if it occurs at least ``least_count`` times in the
  training rows, whatever their number.  (``least_share``, 0 unless asked for,
  raises that floor to a share of the training tokens.)  Lengths are counted one
  after another; a longer n-gram needs parts that are in the tree.
* A context is retained if the next-word distribution after it diverges from
  the one after its suffix: the G statistic over its frequent next words (and
  one class for all others) must exceed its mean by three deviations.
* Next words are smoothed towards the suffix state's distribution; a word that
  isn't a frequent next word gets the suffix state's probability times a factor
  that makes the state's distribution sum to one.
* The empty context is the unigram distribution ``(c + 0.1) / (N + 0.1 (V + 1))``
  over all words, those that occur once included.

The tree lies in files of the shared folder, dealt to shards by context, and
tasks read them memory-mapped.  An n-gram's number is its place in its level's
files; its key is the number of its context beside that of its last word (32
bits each).  Batches count their keys, shards of keys (as many as the data asks
for) add the counts up and drop those under the floor, shards of contexts test and
smooth their contexts.  A worker keeps ``_OPEN`` files of a level mapped at most.
The driver knows only the files' names and sizes.  ``Tree`` is the same tree in the
memory of one process, for tables of fewer than 2**20 n-grams a length.

Nulls: a null text counts as empty, one end token.  A null doc_id counts as an
empty text where its remainder is taken.  Repeated rows are scored each on its
own.  With no training rows every text scores 0 (N = V = 0).  Other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.llm.perfect_hash import mixed
from sessionlog.llm.shared import map_file, new_folder, release_shuffles, write_file
from sessionlog.llm.words import Lookup, Words
from sessionlog.spark import materialize

#: The end token's key among word hashes.
END = np.uint64(0x656E64)
_ID_BITS = 20
#: Shard files of a level that a worker keeps mapped.
_OPEN = 128


class Level:
    """Frequent n-grams of one length: keys ``(n-1)-gram index << 20 | word index``, counts, words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, words: np.ndarray):
        self.find, self.counts, self.words = Lookup(keys), counts, words
        self.kept = np.zeros(len(keys), bool)  # is it a retained context?
        self.log_rest = np.zeros(len(keys))  # of a retained context: log10 of the factor for other words
        self.log_next = np.full(len(keys), np.nan)  # log10 P(last word | the words before it), if those are retained


def _join_keys(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << _ID_BITS) | word


class Tree:
    """Levels 1, 2, ... of frequent n-grams; level 1 holds the frequent words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.words, self.total, self.distinct = Lookup(hashes), total, distinct
        self.levels = [Level(np.empty(0, np.int64), counts, np.arange(len(hashes), dtype=np.int32)[:, None])]
        self.log_one = np.log10(self.unigram(counts))
        self.end = int(self.words(np.array([END]))[0])

    def unigram(self, counts):
        return (counts + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def chains(self, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each level, the index of the n-gram that ends at each token (-1: not frequent, or it begins before its text)."""
        out = [ids]
        for n, level in enumerate(self.levels[1:], 2):
            before = np.concatenate([[-1], out[-1][:-1]]).astype(np.int32)
            before[starts] = -1
            out.append(self._step(level, before, ids))
        return out

    @staticmethod
    def _step(level: Level, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        found = np.full(len(ids), -1, np.int32)
        able = np.flatnonzero((before >= 0) & (ids >= 0))
        found[able] = level.find(_join_keys(before[able], ids[able]))
        return found

    def log_probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P(token | longest retained context); for a rare word without its unigram part."""
        out = np.where(ids >= 0, self.log_one[ids], 0.0) if len(self.log_one) else np.zeros(len(ids))
        chains = self.chains(ids, starts)
        for k in range(1, len(self.levels)):
            state = np.concatenate([[-1], chains[k - 1][:-1]])
            state[starts] = -1
            own = np.flatnonzero(state >= 0)
            own = own[self.levels[k - 1].kept[state[own]]]
            hit = chains[k][own] >= 0
            out[own[hit]] = self.levels[k].log_next[chains[k][own[hit]]]
            out[own[~hit]] += self.levels[k - 1].log_rest[state[own[~hit]]]
        return out

    def _ngram_log_probability(self, words: np.ndarray) -> np.ndarray:
        """log10 P(last word | the words before) of each row of frequent words, by the levels there are."""
        flat = words.reshape(-1).astype(np.int32)
        starts = np.arange(0, len(flat), words.shape[1])
        return self.log_probabilities(flat, starts).reshape(words.shape)[:, -1]

    def grow(self, keys: np.ndarray, counts: np.ndarray, smooth: float) -> None:
        """Add the next length's frequent n-grams and test the contexts that they extend."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        context, word = keys >> _ID_BITS, keys & ((1 << _ID_BITS) - 1)
        before = self.levels[-1]
        words = np.concatenate([before.words[context], word[:, None].astype(np.int32)], 1)
        level = Level(keys, counts, words)
        if len(keys):
            suffix = 10.0 ** self._ngram_log_probability(words[:, 1:])
            seen = before.counts[context]
            p = (counts + smooth * suffix) / (seen + smooth)
            add = lambda x: np.bincount(context, x, minlength=len(before.counts))
            rest_p, rest_q, n = 1 - add(p), 1 - add(suffix), add(np.ones(len(p)))
            rest_p, rest_q = np.maximum(rest_p, 1e-12), np.maximum(rest_q, 1e-12)
            g = 2 * before.counts * (add(p * np.log(p / suffix)) + rest_p * np.log(rest_p / rest_q))
            before.kept = (n > 0) & (g > n + 3 * np.sqrt(2 * n))
            before.log_rest = np.log10(rest_p / rest_q)
            level.log_next = np.log10(p)
        self.levels.append(level)


#: A shard's arrays: its n-grams' keys in order, counts, numbers of the n-grams without their first word, log10
#: probabilities of their last words; its retained contexts in order, log10 of their factors for other words.
_ARRAYS = (("keys", "<u8"), ("counts", "<u8"), ("suffixes", "<u4"), ("logs", "<f4"), ("kept", "<u4"), ("rests", "<f4"))
_WORD = np.uint64((1 << 32) - 1)


def _keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << np.uint64(32) | words.astype(np.uint64)


def _shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(x.astype(np.uint64), 13) % np.uint64(shards)).astype(np.int32)


def _by_shard(shard: np.ndarray, keys: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard; in order of ``keys``, as a search through a long array is faster then."""
    narrow = shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard  # 16 bits are sorted by radix
    order = np.argsort(narrow, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(own):
            yield int(shard[own[0]]), own if keys is None else own[np.argsort(keys[own])]


class Stored:
    """A level of the tree in shared files; ``sizes`` and ``names`` of its shards."""

    def __init__(self, folder: str, names: list[str | None], sizes: list[int]):
        self.folder, self.names = folder, names
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.open = lru_cache(maxsize=_OPEN)(self._open)

    def _open(self, shard: int) -> dict[str, np.ndarray] | None:
        if self.names[shard] is None:
            return None
        raw = map_file(self.folder, self.names[shard])
        lengths, at, out = raw[: 8 * len(_ARRAYS)].view("<i8"), 8 * len(_ARRAYS), {}
        for (name, kind), n in zip(_ARRAYS, lengths.tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            out[name] = raw[at : at + size].view(kind)
            at += -(-size // 8) * 8
        return out

    def find(self, keys: np.ndarray, deal: np.ndarray, *fields: str) -> list[np.ndarray]:
        """Numbers of the keys' n-grams (-1: not in the tree) and the asked fields; ``deal`` gives the shard."""
        out = [np.full(len(keys), -1, np.int64), *[np.zeros(len(keys)) for _ in fields]]
        for shard, own in _by_shard(_shard_of(deal, len(self.names)), keys):
            t = self.open(shard)
            if t is None or not len(t["keys"]):
                continue
            at = np.minimum(np.searchsorted(t["keys"], keys[own]), len(t["keys"]) - 1)
            hit = t["keys"][at] == keys[own]
            own, at = own[hit], at[hit]
            out[0][own] = at + self.offsets[shard]
            for x, f in zip(out[1:], fields, strict=True):
                x[own] = t[f][at]
        return out

    def rests(self, contexts: np.ndarray) -> np.ndarray:
        """log10 of the contexts' factors for other words; NaN: not retained."""
        out = np.full(len(contexts), np.nan)
        for shard, own in _by_shard(_shard_of(contexts, len(self.names)), contexts):
            t = self.open(shard)
            if t is None or not len(t["kept"]):
                continue
            at = np.minimum(np.searchsorted(t["kept"], contexts[own]), len(t["kept"]) - 1)
            hit = t["kept"][at] == contexts[own]
            out[own[hit]] = t["rests"][at[hit]]
        return out

    def take(self, numbers: np.ndarray, field: str) -> np.ndarray:
        out = np.zeros(len(numbers), dict(_ARRAYS)[field])
        for shard, own in _by_shard(np.searchsorted(self.offsets, numbers, "right") - 1):
            out[own] = self.open(shard)[field][numbers[own] - self.offsets[shard]]
        return out


def _chain(levels: list[Stored], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the last level's n-gram that ends at each token (-1: none)."""
    for level in levels[1:]:
        out = np.full(len(ids), -1, np.int64)
        before = _before(ids if level is levels[1] else now, starts)
        able = np.flatnonzero((before >= 0) & (ids >= 0))
        out[able] = level.find(_keys(before[able], ids[able]), before[able])[0]
        now = out
    return ids if len(levels) == 1 else now


def _before(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.concatenate([[-1], x[:-1]])[: len(x)]
    out[starts] = -1
    return out


def _log_probabilities(levels: list[Stored], ids: np.ndarray, starts: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 P(token | longest retained context); ``one``: that without a context."""
    out, now = one.copy(), ids
    for level in levels[1:]:
        state = _before(now, starts)
        at = np.flatnonzero(state >= 0)
        now = np.full(len(ids), -1, np.int64)
        rest = level.rests(state[at])
        known = ids[at] >= 0
        number, log = level.find(_keys(state[at[known]], ids[at[known]]), state[at[known]], "logs")
        now[at[known]] = number
        new = out[at] + rest
        hit = np.flatnonzero(known)[number >= 0]
        new[hit] = log[number >= 0]
        kept = ~np.isnan(rest)
        out[at[kept]] = new[kept]
    return out


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on: high bytes are alike and compress away."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def _packed(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    rows = [(s, _planes(keys[own]), _planes(counts[own].astype("<u8"))) for s, own in _by_shard(shard)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], ["shard", "keys", "counts"])


_PACKED = "shard int, keys binary, counts binary"


def _counted(keys: np.ndarray, shards: int) -> pa.RecordBatch:
    u, n = np.unique(keys, return_counts=True)
    return _packed(u, n, _shard_of(u, shards))


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of packed rows in order, and their counts added up."""
    keys, counts = (np.concatenate([_from_planes(x, "<u8") for x in table[c].to_pylist()]) for c in ("keys", "counts"))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _write(folder: str, shard: int, **arrays: np.ndarray) -> pa.Table:
    """Write a shard's file; its manifest row."""
    parts = [np.ascontiguousarray(arrays.get(name, np.empty(0)), kind) for name, kind in _ARRAYS]
    pad = lambda b: b + bytes(-len(b) % 8)
    name = write_file(folder, f"lm-{shard}", [np.array([len(x) for x in parts], "<i8").tobytes(), *[pad(x.tobytes()) for x in parts]])
    n = len(arrays["keys"])
    return pa.table({"shard": pa.array([shard], pa.int32()), "name": [name], "n": pa.array([n], pa.int64()), "total": pa.array([int(arrays["counts"].sum())], pa.int64())})


_MANIFEST = "shard int, name string, n long, total long"


def _level(folder: str, written: DataFrame, shards: int) -> tuple[tuple, int]:
    """What makes a Stored of the written shards, and the sum of their counts."""
    names, sizes, total = [None] * shards, [0] * shards, 0
    for r in written.collect():  # a row for each shard
        names[r.shard], sizes[r.shard], total = r.name, r.n, total + r.total
    if sum(sizes) >= 1 << 32:
        raise ValueError("more than 2**32 n-grams of one length")
    return (folder, names, sizes), total


def _smoothed(before: Stored, keys: np.ndarray, counts: np.ndarray, smooth: float, first: bool, unigram) -> dict[str, np.ndarray]:
    """A shard's arrays from its n-grams; each context is in one shard."""
    context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & _WORD).astype(np.int64)
    if first:
        suffixes = word
        q = unigram(before.take(word, "counts").astype(np.float64))
    else:
        shorter = before.take(context, "suffixes").astype(np.int64)
        suffixes, log = before.find(_keys(shorter, word), shorter, "logs")
        q = 10.0**log
    contexts, at = np.unique(context, return_inverse=True)
    seen = before.take(contexts, "counts").astype(np.float64)
    p = (counts + smooth * q) / (seen[at] + smooth)
    add = lambda x: np.bincount(at, x, minlength=len(contexts))
    n = add(np.ones(len(p)))
    rest_p, rest_q = np.maximum(1 - add(p), 1e-12), np.maximum(1 - add(q), 1e-12)
    g = 2 * seen * (add(p * np.log(p / q)) + rest_p * np.log(rest_p / rest_q))
    kept = g > n + 3 * np.sqrt(2 * n)
    return {"keys": keys, "counts": counts, "suffixes": suffixes, "logs": np.log10(np.where(kept[at], p, q)), "kept": contexts[kept], "rests": np.log10(rest_p / rest_q)[kept]}


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words and ends) and where each text's tokens begin, with the end of all."""
    words = Words(texts)
    counts = np.diff(words.first) + 1
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    ends = starts[1:] - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = words.hashes(), END
    return out, starts


def score(
    docs: DataFrame, held_out: Column, depth: int = 3, least_share: float = 0.0, least_count: int = 2, smooth: float = 4.0, shard_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from the rows for which ``held_out`` is false.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), held_out.alias("held_out"))
    folder = new_folder(spark, "lm-tree")

    # A shard of words for each 16 MB of training text.
    word_shards = max(64, (rows.filter("not held_out").agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> 24)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counted(_tokens(batch["text"])[0], word_shards)

    def write_words(table: pa.Table) -> pa.Table:
        keys, counts = _added(table)
        return _write(folder, table["shard"][0].as_py(), keys=keys, counts=counts)

    words = rows.filter("not held_out").select("text").mapInArrow(count_words, _PACKED).groupBy("shard").applyInArrow(write_words, _MANIFEST)
    level, total = _level(folder, words, word_shards)
    del words
    release_shuffles(spark)
    made, distinct = [level], sum(level[2])
    floor, shards = max(least_share * total, least_count), max(64, -(-total // shard_tokens))
    unigram = lambda counts: (counts + 0.1) / (total + 0.1 * (distinct + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Stored(*level)
        for batch in _slices(batches):
            tokens, starts = _tokens(batch["text"])
            ids = (words.find(tokens, tokens)[0] + 1).astype("<u4")  # 0: not known
            body = [_planes(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(body, pa.binary())], ["doc_id", "held_out", "ids"])

    encoded = materialize(rows.mapInArrow(encode, f"doc_id {kind}, held_out boolean, ids binary"), "lm-tokens")

    for _ in range(depth):
        known = list(made)

        def count_ngrams(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            levels = [Stored(*x) for x in known]
            for batch in batches:
                found = [np.empty(0, np.uint64)]
                for part in _slices([batch]):
                    ids, starts = _flat(part["ids"])
                    ends = _chain(levels, ids, starts[:-1])
                    before = _before(ends, starts[:-1])
                    able = (before >= 0) & (ends >= 0)  # parts of an n-gram in the tree are in it
                    found.append(_keys(before[able], ids[able]))
                yield _counted(np.concatenate(found), shards)

        def enough(table: pa.Table) -> pa.Table:
            keys, counts = _added(table)
            keep = counts >= floor
            return pa.Table.from_batches([_packed(keys[keep], counts[keep], _shard_of(keys[keep] >> np.uint64(32), shards))])

        def write_ngrams(table: pa.Table) -> pa.Table:
            keys, counts = _added(table)
            return _write(folder, table["shard"][0].as_py(), **_smoothed(Stored(*known[-1]), keys, counts, smooth, len(known) == 1, unigram))

        grams = encoded.filter("not held_out").select("ids").mapInArrow(count_ngrams, _PACKED).groupBy("shard").applyInArrow(enough, _PACKED)
        made.append(_level(folder, grams.groupBy("shard").applyInArrow(write_ngrams, _MANIFEST), shards)[0])
        del grams
        release_shuffles(spark)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [Stored(*x) for x in made]
        for batch in _slices(batches):
            ids, starts = _flat(batch["ids"])
            counts = np.zeros(len(ids))
            counts[ids >= 0] = levels[0].take(ids[ids >= 0], "counts")
            one = np.log10(unigram(counts))
            sums = [np.add.reduceat(x, starts[:-1]) if len(x) else x for x in (one, _log_probabilities(levels, ids, starts[:-1], one), (ids >= 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(np.diff(starts)), pa.array(sums[2]), pa.array(np.full(len(batch), total)), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The batch's word numbers in one array (-1: not known), and where each text's begin, with the end of all."""
    parts = [_from_planes(x.as_py(), "<u4") for x in ids]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts).astype(np.int64) - 1 if parts else np.empty(0, np.int64)), starts
