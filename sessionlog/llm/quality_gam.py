"""Operator 12: text quality by a generalised additive model with pairwise interactions.

A text's score is the logistic function of an intercept, one table value for each
feature's bin and one for each chosen pair of features' bins.

* Features are numbers that are read off the text alone (``FEATURES``); bins are
  quantiles of the sample.
* Boosting goes round the features: each in turn gets a shallow tree (at most four
  leaves) on its bins, fitted to the gradients of the logistic loss, and a share of
  the leaves' values is added to its table.  A fifth of the sample, chosen by the
  hash of the id, tells the round to stop at.
* Pairs are ranked by how much a tree of one cut in each of both features lowers
  the loss that is left; the best ones are boosted round by round in the same way.
* Scoring looks bins up and adds tables, for whole batches.

The model is fitted on a bounded sample of labelled rows: at most ``most_docs``,
chosen by a hash of the id.  Only their features come to the driver.

Nulls: a null text counts as empty; empty texts have a score like all others
(features of zero).  Null labels, and labels without a document, teach nothing; of
repeated labels or rows each teaches.  If nothing teaches, every score is 0.5.
Repeated rows are scored each on its own; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.llm.perfect_hash import mixed
from sessionlog.llm.shared import by_bytes, pick
from sessionlog.llm.words import Words

FEATURES = (
    "log bytes", "log words", "mean word bytes", "log longest word", "short words",
    "upper-case letters", "digits", "marks", "symbols", "non-ASCII bytes", "sentence ends a word", "commas a word",
    "words that end in a mark", "words that end in a symbol", "words without lower case", "capitalised words",
    "words like the one before", "words like the second before", "distinct words", "commonest word", "log words a line", "lines that end a sentence",
)

_END, _COMMA, _SYMBOL, _UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _OTHER = range(9)
_CLASS = np.full(256, _SYMBOL, np.int64)
for _bytes, _kind in ((b".!?", _END), (b",;:'\"()-", _COMMA), (range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (b" \t\r\x0b\x0c", _SPACE), (b"\n", _LINE), (range(128, 256), _OTHER)):
    _CLASS[list(_bytes)] = _kind


def _share(part, whole) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=np.asarray(whole) > 0)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros((0, len(FEATURES)))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    kind, size = _CLASS[raw], np.diff(bounds)
    of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(of_byte * 9 + kind, minlength=n * 9).reshape(n, 9)

    words = Words(texts)
    count = np.diff(words.first)
    doc, length, h = np.repeat(np.arange(n), count), words.ends - words.starts, words.hashes()
    per_doc = lambda x: np.bincount(doc, x, minlength=n)
    last, head = kind[words.ends - 1], kind[words.starts]
    lower = np.concatenate([[0], np.cumsum((kind == _LOWER) | (kind == _OTHER))])
    upper = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    has_lower, has_upper = ((x[words.ends] > x[words.starts]) for x in (lower, upper))
    again = [np.zeros(len(h), bool), np.zeros(len(h), bool)]
    for k, x in enumerate(again, 1):
        x[k:] = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
    distinct, times = np.unique(h + mixed(doc.astype(np.uint64), 29), return_counts=True, return_index=True)[1:]
    commonest = np.zeros(n)
    np.maximum.at(commonest, doc[distinct], times)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    # A line's end is the last byte before a newline or before the text's end.
    line_ends = np.flatnonzero(kind[1:] == _LINE) if len(kind) else np.empty(0, np.int64)
    line_ends = line_ends[of_byte[line_ends] == of_byte[line_ends + 1]]
    line_ends = np.concatenate([line_ends, (bounds[1:] - bounds[0] - 1)[size > 0]])
    line_ends = line_ends[kind[line_ends] != _LINE]
    lines = np.bincount(of_byte[line_ends], minlength=n)
    good_lines = np.bincount(of_byte[line_ends], kind[line_ends] == _END, minlength=n)
    letters, solid = kinds[:, _UPPER] + kinds[:, _LOWER], size - kinds[:, _SPACE] - kinds[:, _LINE]
    marks = kinds[:, _END] + kinds[:, _COMMA]
    return np.stack([
        np.log1p(size), np.log1p(count), _share(per_doc(length), count), np.log1p(longest), _share(per_doc(length <= 3), count),
        _share(kinds[:, _UPPER], letters), _share(kinds[:, _DIGIT], solid), _share(marks, solid), _share(kinds[:, _SYMBOL], solid), _share(kinds[:, _OTHER], solid),
        _share(kinds[:, _END], count), _share(kinds[:, _COMMA], count),
        _share(per_doc((last == _END) | (last == _COMMA)), count), _share(per_doc(last == _SYMBOL), count), _share(per_doc(has_upper & ~has_lower), count), _share(per_doc(head == _UPPER), count),
        _share(per_doc(again[0]), count), _share(per_doc(again[1]), count), _share(np.bincount(doc[distinct], minlength=n), count), _share(commonest, count), np.log1p(_share(count, lines)), _share(good_lines, lines),
    ], 1)


def _cut(g: np.ndarray, h: np.ndarray, pull: float, least: float) -> tuple[float, int]:
    """The best place to cut a row of bins in two: gain and the last bin of the left part (-1: none)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + pull) + right_g**2 / (right_h + pull) - g.sum() ** 2 / (h.sum() + pull)
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, -1
    return float(gain.max()), int(gain.argmax())


def _tree(g: np.ndarray, h: np.ndarray, pull: float, least: float, depth: int = 2) -> np.ndarray:
    """Leaf values over the bins of a tree of at most 2**depth leaves."""
    at = _cut(g, h, pull, least)[1] if depth else -1
    if at < 0:
        return np.full(len(g), g.sum() / (h.sum() + pull))
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], pull, least, depth - 1), _tree(g[at + 1 :], h[at + 1 :], pull, least, depth - 1)])


def _cross(g: np.ndarray, h: np.ndarray, pull: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values over the bins of two features of a tree that cuts each of them once."""
    sums = [np.cumsum(np.cumsum(x, 0), 1) for x in (g, h)]
    parts = []
    for s in sums:
        a, b, c, d = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        parts.append(np.stack([a, b - a, c - a, d - b - c + a]))
    value = parts[0] / (parts[1] + pull)
    gain = np.where((parts[1] >= least).all(0), (parts[0] * value).sum(0) - g.sum() ** 2 / (h.sum() + pull), 0)
    out = np.zeros(g.shape)
    if not gain.size or gain.max() <= 1e-9:
        return 0.0, out
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value[:, i, j]
    return float(gain[i, j]), out


class Gam:
    """Tables for the bins of features and of pairs of features; without a label on either side, a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, bins: int = 32, rounds: int = 300, pairs: int = 8, rate: float = 0.1, pull: float = 1.0, least: float = 2.0):
        self.edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) if len(c) else np.empty(0) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        positive = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(positive / (1 - positive)))
        if not 0 < y.sum() < len(y):
            return
        learn = ~check if 0 < check.sum() < len(check) else np.ones(len(y), bool)
        at = self.bins(x)
        z = np.full(len(y), self.intercept)

        def boost(keys: list[np.ndarray], shapes: list[tuple[int, ...]], fit) -> list[np.ndarray]:
            tables = [np.zeros(s) for s in shapes]
            best, since, kept = np.inf, 0, [t.copy() for t in tables]
            for _ in range(rounds):
                for k, (key, shape) in enumerate(zip(keys, shapes, strict=True)):
                    p = 1 / (1 + np.exp(-z))
                    g, h = (np.bincount(key[learn], v[learn], minlength=int(np.prod(shape))).reshape(shape) for v in (y - p, p * (1 - p)))
                    step = rate * fit(g, h)
                    tables[k] += step
                    z[:] += step.reshape(-1)[key]
                held = ~learn if not learn.all() else learn
                loss = np.logaddexp(0, np.where(y[held] > 0, -z[held], z[held])).mean()
                if loss < best - 1e-5:
                    best, since, kept = loss, 0, [t.copy() for t in tables]
                elif (since := since + 1) >= 20:
                    break
            z[:] -= sum((t - k).reshape(-1)[key] for t, k, key in zip(tables, kept, keys, strict=True))
            return kept

        self.tables = boost(list(at.T), [t.shape for t in self.tables], lambda g, h: _tree(g, h, pull, least))
        p = 1 / (1 + np.exp(-z))
        ranked = []
        for i, j in combinations(range(x.shape[1]), 2):
            shape, key = (len(self.tables[i]), len(self.tables[j])), at[:, i] * len(self.tables[j]) + at[:, j]
            g, h = (np.bincount(key[learn], v[learn], minlength=shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))
            ranked.append((-_cross(g, h, pull, least)[0], i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(ranked)[:pairs] if gain < 0]
        keys = [at[:, i] * len(self.tables[j]) + at[:, j] for i, j in self.pairs]
        self.pair_tables = boost(keys, [(len(self.tables[i]), len(self.tables[j])) for i, j in self.pairs], lambda g, h: _cross(g, h, pull, least)[1])

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        z = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            z += table[at[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, most_docs: int = 20_000, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Gam:
    """A model of ``quality`` = 1 from the labelled rows for which ``teaches`` (a condition on column doc_id) holds."""
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    known = pick(labels, doc_id=doc_id, quality=quality).filter(teaches).filter("doc_id IS NOT NULL AND quality IS NOT NULL").withColumn("draw", draw)
    n = known.count()
    rate = min(1.0, most_docs / max(1, n))
    few = known.filter(F.col("draw") < int(rate * (1 << 30))).orderBy("draw", "doc_id", "quality").limit(most_docs).withColumnRenamed("doc_id", "label_id")
    # At most ``most_docs`` rows of three numbers; a document that is named by none of them goes no further.
    rows = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("text", "quality", "draw")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes([batch], "text"):
                x = features(part["text"])
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64())), part["quality"].cast(pa.int64()), part["draw"]], ["x", "quality", "draw"])

    # Of repeated rows, as many as the sample has room for.
    found = rows.mapInArrow(read, "x array<double>, quality long, draw long").orderBy("draw", "quality", "x").limit(most_docs).toArrow().combine_chunks()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(found) else np.zeros((0, len(FEATURES)))
    return Gam(x, (found["quality"].to_numpy() == 1).astype(float), found["draw"].to_numpy() % 5 == 0)


def predict(docs: DataFrame, gam: Gam, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document, by its whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(gam.scores(features(batch["text"])))], ["doc_id", "score"])

    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, score double")
