"""Operator 13: phrases whose words stand together more often than chance, counted in suffix subtrees.

A-Z count as lower case.  Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces
and pieces into words ``[^\\x20\\x09]+``; each language is counted by itself.

Counting follows ERA's vertical partitioning:

* The suffixes of all pieces are cut off after ``longest`` words, and where a word,
  or the pair it makes with the one before, is rarer than ``least`` (no frequent
  phrase holds one).  Two tables of hash bits name the frequent words and pairs;
  their size is fixed, so the more the corpus holds, the more rare ones pass, which
  costs space alone.  Equal suffixes of a batch are counted together, and a batch's
  suffixes travel as one row, of word numbers and the words that they stand for.
  These rows lie in files of the shared folder, from which tasks read them one by one.
* The word prefixes of the suffixes are dealt to groups of at most ``group_rows``
  suffixes, by the suffixes counted under each prefix (or hash bucket of prefixes).
  What exceeds that alone is dealt by prefixes of one more word, and so on.
* Each group is read by one task, which sorts its suffixes: runs of an equal
  prefix are the nodes of the group's subtree, cut off at ``longest`` words, and the
  counts of a run's leaves add up to the phrase's.  A node above its group's
  prefixes lies in several groups, and these parts are added up at the end.

Scores are exact integers (38 digits).  The driver holds the number of suffixes
of each hash bucket of prefixes: four to eight buckets a group.

Nulls: a null text counts as empty, a null language as ``und``.  Empty texts and
texts without words give nothing.  Repeated rows count each.  An empty table
gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.llm.perfect_hash import mixed
from sessionlog.llm.shared import by_bytes, new_folder, pick, read_batches, write_batches
from sessionlog.llm.words import Hasher, Words
from sessionlog.operators.sequence import top_k_per_group

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _BREAK.copy()
_GAPS[[0x20, 0x09]] = True
_PIECE = 1 << 21  # bytes of text that are numbered at once
_CHUNK = 4096


def _hashes(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return Hasher()(data, bounds[:-1], bounds[1:])


class Tokens:
    """The words of a batch, numbered among its distinct ones.

    ``joined``: the next word stands in the same piece.  ``key``: number of the
    word in its language, ``hash``: 64 bits for each pair of language and word.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array):
        words = Words(texts, _GAPS)
        sizes = words.ends - words.starts
        body, offsets = words.data[~_GAPS[words.data]], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs = langs.fill_null("und").dictionary_encode()
        self.langs = langs.dictionary
        doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        breaks = np.append(np.int32(0), np.cumsum(_BREAK[words.data], dtype=np.int32))
        self.joined = np.zeros(len(sizes), bool)
        self.joined[:-1] = (breaks[words.starts[1:]] == breaks[words.ends[:-1]]) & (doc[1:] == doc[:-1])
        self.key = self.lang * len(self.words) + self.code
        self._parts = _hashes(self.words), mixed(_hashes(self.langs), 17)

    def hash(self, key: np.ndarray) -> np.ndarray:
        lang, code = np.divmod(key, max(1, len(self.words)))
        return mixed(self._parts[0][code] + self._parts[1][lang], 19)


def _joined_words(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    parts = [words.take(pa.array(c, mask=c < 0)) for c in columns]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, c (occurrences) and h (64 bits of both), from columns text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _PIECE):
            t = Tokens(batch["text"], batch["lang"])
            key, c = np.unique(t.key, return_counts=True)
            lang, code = np.divmod(key, max(1, len(t.words)))
            yield pa.RecordBatch.from_arrays([t.langs.take(pa.array(lang)).cast(pa.string()), t.words.take(pa.array(code)).cast(pa.string()), pa.array(c.astype(np.int64)), pa.array(t.hash(key).view(np.int64))], ["lang", "word", "c", "h"])

    counts = rows.mapInArrow(count, "lang string, word string, c long, h long")
    return counts.groupBy("lang", "word").agg(F.sum("c").alias("c"), F.first("h").alias("h"))


def _bits(frequent: DataFrame, bits: int) -> np.ndarray:
    """Whether a frequent word has the first ``bits`` bits of its hash, for all values of these."""
    found = frequent.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("b")).distinct().toArrow()["b"]
    out = np.zeros(1 << bits, bool)
    out[found.to_numpy()] = True
    return np.packbits(out)


class _Starts:
    """The places of a batch where two frequent words of a piece stand together, by the words' hash bits."""

    def __init__(self, batch: pa.RecordBatch, able: np.ndarray, shift: np.uint64):
        self.tokens = t = Tokens(batch["text"], batch["lang"])
        distinct, number = np.unique(t.key, return_inverse=True)
        hashes = t.hash(distinct)
        known = able[(hashes >> shift).astype(np.int64)][number]
        self.joined = t.joined & known
        self.joined[:-1] &= known[1:]
        self.at = np.flatnonzero(self.joined)
        self.pairs = mixed(hashes[number[self.at]] * np.uint64(3) + hashes[number[self.at + 1]], 23)


def _pair_bits(rows: DataFrame, bits: np.ndarray, least: int, pair_bits: int) -> np.ndarray:
    """Whether ``least`` pairs of words or more share the first ``pair_bits`` bits of their hashes, for all values of these."""
    shift, pair_shift = _shift(bits), np.uint64(64 - pair_bits)
    kind = np.dtype(np.min_scalar_type(least))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able, counts = np.unpackbits(bits).astype(bool), np.zeros(1 << pair_bits, kind)  # up to ``least``
        for batch in by_bytes(batches, "text", _PIECE):
            at, c = np.unique(_Starts(batch, able, shift).pairs >> pair_shift, return_counts=True)
            at = at.astype(np.int64)
            counts[at] = np.minimum(counts[at].astype(np.int64) + c, least)
        for first in range(0, len(counts), 256 * _CHUNK):
            part = counts[first : first + 256 * _CHUNK]
            at = np.flatnonzero(part)
            chunk, cuts = at // _CHUNK, np.searchsorted(at // _CHUNK, np.arange(257))
            own = np.unique(chunk)
            spans = [(int(cuts[k]), int(cuts[k + 1])) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array((own + first // _CHUNK).astype(np.int32)), pa.array([(at[a:b] % _CHUNK).astype("<u2").tobytes() for a, b in spans], pa.binary()), pa.array([part[at[a:b]].tobytes() for a, b in spans], pa.binary())], ["chunk", "places", "counts"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(_CHUNK, np.int64)

        def closed(chunks: list[int], found: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(found, pa.binary())], ["chunk", "bits"])

        for batch in batches:
            chunks, found = [], []
            for chunk, places, counts in zip(*[batch[c].to_pylist() for c in ("chunk", "places", "counts")], strict=True):
                if now is not None and chunk != now:
                    chunks.append(now)
                    found.append(np.packbits(sums >= least).tobytes())
                    sums[:] = 0
                now = chunk
                sums[np.frombuffer(places, "<u2")] += np.frombuffer(counts, kind)
            yield closed(chunks, found)
        if now is not None:
            yield closed([now], [np.packbits(sums >= least).tobytes()])

    parts = rows.mapInArrow(add, "chunk int, places binary, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(((1 << pair_bits) // _CHUNK, _CHUNK // 8), np.uint8)
    for r in parts.mapInArrow(together, "chunk int, bits binary").toArrow().to_pylist():  # 512 bytes a chunk
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _shift(bits: np.ndarray) -> np.uint64:
    return np.uint64(64 - (len(bits) * 8).bit_length() + 1)


def _thin(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs: how many, all lowest bytes, all next ones, ..."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(thin: bytes) -> np.ndarray:
    planes = np.frombuffer(thin, np.uint8)[1:].reshape(thin[0], -1)
    out = planes[0].astype(np.int32 if len(planes) < 4 else np.int64)
    for k, plane in enumerate(planes[1:], 1):
        out |= plane.astype(out.dtype) << (8 * k)
    return out


def _renumbered(values: pa.Array, part: np.ndarray, codes: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """A list of the values that each part uses, and the codes (-1: none) as places in its list, from 1 (0: none)."""
    size, parts = len(values) + 1, int(part[-1]) + 1
    keys = np.append((part.reshape(-1, *[1] * (codes.ndim - 1)) * size + codes + 1).ravel(), np.arange(parts) * size)
    if parts == 1:
        seen = np.zeros(size, bool)
        seen[keys] = True
        used, number = np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]
    else:
        used, number = np.unique(keys, return_inverse=True)
    begins = number[len(number) - parts :]
    number = number[: len(number) - parts].reshape(codes.shape)
    number -= begins[part].reshape(-1, *[1] * (codes.ndim - 1))
    of_words = used % size
    bounds = np.append(begins, len(used)) - np.arange(parts + 1)
    return pa.ListArray.from_arrays(bounds.astype(np.int32), values.take(pa.array(of_words[of_words > 0] - 1)).cast(pa.string())), number


class Suffixes:
    """Distinct suffixes and their counts: numbers of ``words`` (-1 after the last one) and of ``langs``.

    Packed they are a row: the words, joined by line ends (no word holds one),
    the languages, and the numbers in as few bytes as they need, word by word.
    """

    SCHEMA = "words string, langs array<string>, lang binary, codes binary, counts binary"

    def __init__(self, words: pa.Array, langs: pa.Array, lang: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        self.words, self.langs, self.lang, self.codes, self.counts = words, langs, lang, codes, counts

    def prefix_hashes(self) -> Iterator[np.ndarray]:
        """For 1, 2, ... words: the hash of each suffix's prefix of as many words (or of all it has)."""
        word, now = _hashes(self.words), mixed(_hashes(self.langs), 17)[self.lang]
        for d, code in enumerate(self.codes.T):
            more = code >= 0
            now = now.copy()
            now[more] = mixed(now[more] * np.uint64(3) + word[code[more]], 31 + d)
            yield now

    def parts(self, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[pa.Array]]:
        """The values of ``which`` in order, their suffixes, and packed columns with a row for each value."""
        order = np.argsort(which, kind="stable")
        which = which[order]
        begins = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        bounds = np.append(begins, len(order))
        part = np.repeat(np.arange(len(begins)), np.diff(bounds))
        words, codes = _renumbered(self.words, part, self.codes[order])
        langs, lang = _renumbered(self.langs, part, self.lang[order])
        counts, spans = self.counts[order], [slice(a, b) for a, b in itertools.pairwise(bounds.tolist())]
        thin = [pa.array([_thin(x[at].T.ravel()) for at in spans], pa.binary()) for x in (lang, codes, counts)]
        return which[begins], [order[at] for at in spans], [pc.binary_join(words, "\n"), langs, *thin]

    @staticmethod
    def together(rows, longest: int) -> "Suffixes":
        """The suffixes of packed rows, with words and languages numbered for all of them."""
        flat, number, shift = [], [], []
        for lists in (pc.split_pattern(rows["words"], "\n"), rows["langs"]):
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            flat.append(lists.flatten().dictionary_encode())
            number.append(np.append(-1, flat[-1].indices.to_numpy(zero_copy_only=False)).astype(np.int32))
            shift.append([0, *np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()])

        def whole(name: str, k: int) -> Iterator[np.ndarray]:
            for x, a in zip(rows[name], shift[k], strict=False):
                places = _wide(x.as_py())
                yield number[k][np.where(places > 0, places + a, 0)]

        codes = np.concatenate([x.reshape(longest, -1) for x in whole("codes", 0)], axis=1).T
        return Suffixes(flat[0].dictionary, flat[1].dictionary, np.concatenate([*whole("lang", 1)]), codes, np.concatenate([_wide(x.as_py()).astype(np.int64) for x in rows["counts"]]))


_NAMES = ["words", "langs", "lang", "codes", "counts"]


class Packed(NamedTuple):
    """Packed suffixes in files of the shared folder, a row for each batch of texts; ``count``: of the suffixes.

    Tasks read the rows one by one from the files: a row is some MB, and sent
    through the JVM all rows of a task would stand in one Arrow batch, there and here.
    """

    spark: SparkSession
    folder: str
    files: list[str]
    count: int

    def map(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``f`` makes of the rows, a task for each file."""
        folder, files = self.folder, self.files

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(row for batch in batches for at in batch["id"].to_pylist() for row in read_batches(folder, files[at]))

        return self.spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, schema)


def suffixes(rows: DataFrame, bits: np.ndarray, pair_bits: np.ndarray, longest: int) -> Packed:
    """Packed suffixes of 2 to ``longest`` words: a row for each batch of texts."""
    spark, shift, pair_shift = rows.sparkSession, _shift(bits), _shift(pair_bits)
    folder = new_folder(spark, "phrase-suffixes")

    def cut(batch: pa.RecordBatch, able: np.ndarray) -> Suffixes:
        s = _Starts(batch, able, shift)
        t, place = s.tokens, (s.pairs >> pair_shift).astype(np.int64)
        joined = np.zeros(len(t.code) + longest, bool)
        joined[s.at] = pair_bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
        at = np.flatnonzero(joined)
        code = np.append(t.code, np.zeros(longest, np.int64)).astype(np.int32)
        columns, ids, on = [code[at]], t.key[at], np.ones(len(at), bool)
        for d in range(1, longest):
            on = on & joined[at + d - 1]
            columns.append(np.where(on, code[at + d], np.int32(-1)))
            ids = np.unique(ids, return_inverse=True)[1] * (len(t.words) + 1) + columns[-1] + 1
        _, first, c = np.unique(ids, return_index=True, return_counts=True)
        return Suffixes(t.words, t.langs, t.lang[at][first], np.stack([x[first] for x in columns], 1), c)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able, count = np.unpackbits(bits).astype(bool), 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for batch in by_bytes(batches, "text", _PIECE):
                s = cut(batch, able)
                if len(s.counts):
                    count += len(s.counts)
                    yield pa.RecordBatch.from_arrays(s.parts(np.zeros(len(s.counts), np.int64))[2], _NAMES)

        name = write_batches(folder, "suffixes", packed())
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "count"])

    found = rows.mapInArrow(write, "file string, count long").toArrow()  # a row a task
    return Packed(spark, folder, found["file"].to_pylist(), sum(found["count"].to_pylist()))


def _dealt(s: Suffixes, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each suffix's group (-1: none as yet), the words of the prefixes that made it, and its hash by one word more."""
    group, depth = np.full(len(s.counts), -1, np.int64), np.zeros(len(s.counts), np.int64)
    for d, h in enumerate(s.prefix_hashes(), 1):
        if d > len(tables):
            return group, depth, h
        left = np.flatnonzero(group < 0)
        group[left], depth[left] = tables[d - 1][(h[left] % np.uint64(len(tables[d - 1]))).astype(np.int64)], d
    return group, depth, np.zeros(len(group), np.uint64)


def prefix_groups(packed: Packed, longest: int, group_rows: int) -> list[np.ndarray]:
    """For prefixes of 1, 2, ... words: the group of each hash bucket (-1: dealt by longer prefixes)."""
    buckets, groups, filled, tables = max(1024, 1 << (4 * packed.count // group_rows).bit_length()), 0, group_rows + 1, []
    for words in range(1, longest + 1):

        def count(rows: Iterator[pa.RecordBatch], known=tuple(tables)) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(buckets, np.int64)
            for row in rows:
                group, _, h = _dealt(Suffixes.together(row, longest), list(known))
                sums += np.bincount((h[group < 0] % np.uint64(buckets)).astype(np.int64), minlength=buckets)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "c"])

        found = packed.map(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
        table = np.full(buckets, -1, np.int32)
        for b, c in zip(found["bucket"].to_pylist(), found["c"].to_pylist(), strict=True):
            if c > group_rows and words < longest:
                continue
            if filled + c > group_rows:
                groups, filled = groups + 1, 0
            table[b], filled = groups - 1, filled + c
        tables.append(table)
        if (table[found["bucket"].to_numpy()] >= 0).all():
            break
    return tables


def grouped(packed: Packed, tables: list[np.ndarray], longest: int) -> DataFrame:
    """The packed suffixes, a row for each batch and group, with ``group`` and ``depth`` (the words of its prefixes, a byte a suffix)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            s = Suffixes.together(row, longest)
            group, depth, _ = _dealt(s, tables)
            groups, own, columns = s.parts(group)
            yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array([depth[x].astype(np.uint8).tobytes() for x in own], pa.binary()), *columns], ["group", "depth", *_NAMES])

    return packed.map(run, f"group long, depth binary, {Suffixes.SCHEMA}")


def subtree(table: pa.Table, longest: int, least: int) -> pa.Table:
    """Phrases of a group's subtree with their counts: the leaves' totals under each node.

    Counts are whole for nodes at or below the group's prefixes, of which those
    under ``least`` are left out; a node above them has its part only.
    """
    s, depth = Suffixes.together(table, longest), np.frombuffer(b"".join(table["depth"].to_pylist()), np.uint8)
    order = np.lexsort((*s.codes.T[::-1], s.lang))
    codes, lang, c, depth = s.codes[order], s.lang[order], s.counts[order], depth[order]
    new, out = np.append(True, (lang[1:] != lang[:-1]) | (codes[1:, 0] != codes[:-1, 0])), []
    for d in range(2, longest + 1):
        new[1:] |= codes[1:, d - 1] != codes[:-1, d - 1]
        node = np.flatnonzero(new)
        total = np.add.reduceat(c, node)
        kept = (codes[node, d - 1] >= 0) & ((total >= least) | (depth[node] > d))
        node, total = node[kept], total[kept]
        out.append(pa.table({"lang": s.langs.take(pa.array(lang[node])), "phrase": _joined_words(s.words, list(codes[node, :d].T)), "size": pa.array(np.full(len(node), d, np.int32)), "c": pa.array(total)}))
    return pa.concat_tables(out)


def phrase_counts(rows: DataFrame, frequent: DataFrame, least: int, longest: int, group_rows: int, filter_bits: tuple[int, int]) -> DataFrame:
    """lang, phrase, size (words) and c of all phrases of 2 to ``longest`` words that occur ``least`` times or more."""
    bits = _bits(frequent, filter_bits[0])
    packed = suffixes(rows, bits, _pair_bits(rows, bits, least, filter_bits[1]), longest)
    ready = grouped(packed, prefix_groups(packed, longest, group_rows), longest)
    nodes = ready.groupBy("group").applyInArrow(lambda t: subtree(t, longest, least), "lang string, phrase string, size int, c long")
    return nodes.groupBy("lang", "phrase", "size").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def score_cuts(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, size, a, n and l, r and score of each phrase's lowest-scoring cut (the first of those)."""
    parts = phrases.select("lang", "phrase", "c").unionByName(words.select("lang", F.col("word").alias("phrase"), "c"))
    w = F.split("phrase", " ", -1)
    cuts = phrases.select("lang", "phrase", "size", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice(w, 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(w, F.col("k") + 1, F.col("size")), " "))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    wide = "CAST({} AS DECIMAL(38, 0))".format
    score = F.expr(f"CAST(({wide(1000)} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) AS BIGINT)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.first("n").alias("n"), best).select("lang", "phrase", "size", "a", "b.l", "b.r", "n", "b.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """lang, phrase and ``longer``: the largest count of a longer phrase that holds the phrase's words in a row."""
    w, size = F.split("phrase", " ", -1), F.col("size")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice(w, at, n), " "))))
    held = phrases.filter(size > 2).select("lang", "c", F.explode(spans).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorb_percent: int = 100, group_rows: int = 1 << 19, filter_bits: tuple[int, int] = (22, 23), text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n and score.

    A phrase is dropped if a longer one that holds it has at least ``absorb_percent``
    % of its count.  ``filter_bits``: hash bits of the tables of words and of pairs.
    """
    rows = pick(docs, text=text, lang=lang)
    spark = docs.sparkSession
    paths = [new_folder(spark, x) for x in ("phrase-words", "phrase-counts")]
    word_counts(rows).write.parquet(paths[0])
    words = spark.read.parquet(paths[0])
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    frequent = words.filter(F.col("c") >= least)
    phrase_counts(rows, frequent, least, longest, group_rows, filter_bits).write.parquet(paths[1])
    phrases = spark.read.parquet(paths[1])
    longer = inside_longer(phrases)
    left = phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("c") * absorb_percent)).drop("longer")
    scored = score_cuts(phrases, frequent, totals).join(left.select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    first = top_k_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
