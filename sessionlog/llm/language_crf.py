"""Operator 10: languages of words and texts by a linear-chain conditional random field.

Words (runs of ASCII letters and non-ASCII characters, in lower case) are the
chain's positions, languages its labels.  A word's features are its byte
n-grams of 2 to 4, marks at both ends included (those with a mark are its
affixes), and the word itself as a lexicon entry; features are hashed into a
weight table.  Transition and start weights are learned with the others, by
gradients of the conditional likelihood from forward-backward sums.

The model is fitted on a bounded sample: about ``sample_docs`` labelled texts
for each language, chosen by a hash of the id, and at most ``most_docs`` in all.
As texts carry one label, their words are dealt into spans that are shuffled
across texts, so that the chain sees languages switch.

Prediction sums the words' marginal probabilities: the language with the
largest sum is the text's, and its share of the words is the score.

Nulls: a text that is null or has no letter is ``und`` with score 0.  Rows
without a label, or with a null label, teach nothing.  If no row teaches, every
text is ``und``.  Ties go to the language first in order.  Repeated rows are
predicted each on its own; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.llm.perfect_hash import mixed
from sessionlog.llm.words import Words

_BITS = 18
_NONE = 1 << (_BITS + 1)  # the feature of weight zero
_GAPS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_SEGMENT = 256


class Text:
    """The words of a column of texts, numbered among the distinct ones, with features of the distinct ones."""

    def __init__(self, texts: pa.Array):
        words = Words(pc.utf8_lower(texts.fill_null("")), _GAPS)
        hashes = words.hashes()
        self.first = words.first
        self.distinct, at, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.number = number.reshape(-1)
        self.features, self.begins = _features(words.data, words.starts[at], words.ends[at], self.distinct)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """A row of label weights for each distinct word."""
        if not len(self.begins):
            return np.zeros((0, weights.shape[1]), weights.dtype)
        per_byte = weights[self.features[:, 0]]
        for k in (1, 2, 3):  # one after another: all four at once take four times the memory
            per_byte += weights[self.features[:, k]]
        return np.add.reduceat(per_byte, self.begins, axis=0)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four feature numbers for each byte of the marked words, and where each word's bytes begin."""
    sizes = ends - starts + 2
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    n = int(sizes.sum())
    marked = np.zeros(n + 3, np.uint64)
    inside = np.ones(n, bool)
    inside[begins] = False
    inside[begins + sizes - 1] = False
    source = np.repeat(starts - begins - 1, sizes) + np.arange(n)
    marked[:n][inside] = data[source[inside]]
    marked[begins], marked[begins + sizes - 1] = 2, 3
    room = np.repeat(begins + sizes, sizes) - np.arange(n)  # bytes of the word from here on
    out = np.full((n, 4), _NONE, np.int64)
    code = marked[:n].copy()
    for k in (2, 3, 4):
        code |= marked[k - 1 : n + k - 1] << np.uint64(8 * (k - 1))
        ok = room >= k
        out[ok, k - 2] = (mixed(code[ok], k) >> np.uint64(64 - _BITS)).astype(np.int64)
    out[begins, 3] = (1 << _BITS) + (mixed(hashes, 9) >> np.uint64(64 - _BITS)).astype(np.int64)
    return out, begins


def marginals(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Label probabilities of each position of the chains, by forward-backward sums.

    ``emit``: a row of log weights for each position; chain c covers ``sizes[c]``
    (at least 1) positions from ``starts[c]``.  Chains are cut into segments that
    are summed side by side, so a long chain doesn't need one step a position.
    """
    labels = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True))
    a, pi = np.exp(move - move.max()), np.exp(begin - begin.max())
    count = -(-sizes // _SEGMENT)
    chain_first = np.concatenate([[0], np.cumsum(count)])
    seg_chain = np.repeat(np.arange(len(sizes)), count)
    seg_no = np.arange(chain_first[-1]) - chain_first[seg_chain]
    seg_at = starts[seg_chain] + seg_no * _SEGMENT
    seg_len = np.minimum(_SEGMENT, sizes[seg_chain] - seg_no * _SEGMENT)
    by_len = np.argsort(-seg_len, kind="stable")
    at, head = seg_at[by_len], (seg_no == 0)[by_len]
    alive = np.searchsorted(-seg_len[by_len], -np.arange(1, seg_len.max() + 1), "right") if len(seg_len) else np.empty(0, int)

    # How a segment carries the label before it (rows) to its last label (columns).
    carry = np.where(head[:, None, None], pi, a) * e[at][:, None, :]
    for t in range(1, len(alive)):
        m = alive[t]
        step = (carry[:m] @ a) * e[at[:m] + t][:, None, :]
        carry[:m] = step / step.sum((1, 2), keepdims=True)
    carries = np.empty_like(carry)
    carries[by_len] = carry
    before, after = np.empty((len(seg_at), labels)), np.empty((len(seg_at), labels))
    vec, back = np.ones((len(sizes), labels)) / labels, np.ones((len(sizes), labels))
    for r in range(int(count.max()) if len(count) else 0):
        own = np.flatnonzero(count > r)
        seg = chain_first[own] + r
        before[seg] = vec[own]
        v = (vec[own][:, None, :] @ carries[seg])[:, 0]
        vec[own] = v / v.sum(1, keepdims=True)
        seg = chain_first[own + 1] - 1 - r
        after[seg] = back[own]
        v = (carries[seg] @ back[own][:, :, None])[:, :, 0]
        back[own] = v / v.sum(1, keepdims=True)

    forward, backward = np.empty_like(e), np.empty_like(e)
    f = np.where(head[:, None], pi, before[by_len] @ a) * e[at]
    f /= f.sum(1, keepdims=True)
    forward[at] = f
    for t in range(1, len(alive)):
        m = alive[t]
        f = (f[:m] @ a) * e[at[:m] + t]
        f /= f.sum(1, keepdims=True)
        forward[at[:m] + t] = f
    b, ends, lens = after[by_len], at + seg_len[by_len] - 1, seg_len[by_len]
    backward[ends] = b
    for t in range(1, len(alive)):
        m = int(np.searchsorted(-lens, -t, "left"))  # segments of more than t positions
        b = (e[ends[:m] - t + 1] * b[:m]) @ a.T
        b /= b.sum(1, keepdims=True)
        backward[ends[:m] - t] = b
    gamma = forward * backward
    gamma /= gamma.sum(1, keepdims=True)
    if not pairs:
        return gamma
    inner = np.ones(len(e), bool)
    inner[starts] = False
    right = np.flatnonzero(inner)
    both = forward[right - 1][:, :, None] * a * (e * backward)[right][:, None, :]
    return gamma, (both / both.sum((1, 2), keepdims=True)).sum(0)


class Crf:
    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.weights = np.zeros((_NONE + 1, n), np.float32)
        self.move, self.begin = np.zeros((n, n)), np.zeros(n)

    def fit(self, texts: list[str], labels: list[int], rounds: int = 5, span: int = 40, chain: int = 2000, rate: float = 0.3, pull: float = 1e-4, seed: int = 1) -> None:
        """Learn from whole texts, their words dealt into spans of about ``span`` words in shuffled order."""
        text = Text(pa.array(texts, pa.string()))
        sizes = np.diff(text.first)
        truth = np.repeat(np.array(labels), sizes)
        rng = np.random.default_rng(seed)
        sums = [np.full(x.shape, 1e-6) for x in (self.weights, self.move, self.begin)]
        for _ in range(rounds):
            cut = np.unique(np.concatenate([text.first[:-1][sizes > 0], np.flatnonzero(rng.random(len(truth)) < 1 / span)]))
            spans = np.split(np.arange(len(truth)), cut[cut > 0])
            order = np.concatenate([spans[i] for i in rng.permutation(len(spans))])
            for at in range(0, len(order), 20 * chain):
                own = order[at : at + 20 * chain]
                starts = np.arange(0, len(own), chain)
                gamma, both = marginals(text.emissions(self.weights)[text.number[own]].astype(float), starts, np.diff(np.append(starts, len(own))), self.move, self.begin, pairs=True)
                right = truth[own]
                miss = -gamma
                miss[np.arange(len(own)), right] += 1
                inner = np.ones(len(own), bool)
                inner[starts] = False
                right_at = np.flatnonzero(inner)
                seen = np.zeros_like(self.move)
                np.add.at(seen, (right[right_at - 1], right[right_at]), 1)
                per_word = np.stack([np.bincount(text.number[own], m, minlength=len(text.distinct)) for m in miss.T], 1)
                per_byte = np.repeat(per_word, np.diff(np.append(text.begins, len(text.features))), 0)
                grad = np.stack([sum(np.bincount(text.features[:, k], g, minlength=_NONE + 1) for k in range(4)) for g in per_byte.T], 1)
                grad[_NONE] = 0
                n = len(own)
                for x, s, g in ((self.weights, sums[0], grad), (self.move, sums[1], seen - both), (self.begin, sums[2], miss[starts].sum(0))):
                    g = g / n - pull * x
                    s += g * g
                    x += (rate * g / np.sqrt(s)).astype(x.dtype)
                self.weights[_NONE] = 0

    def predict(self, texts: pa.Array, block: int = 1 << 17) -> tuple[list[str], list[float]]:
        names, scores = [], []
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // (8 * block))) + 1, [len(texts)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            text = Text(texts.slice(a, b - a))
            n = np.diff(text.first)
            own = np.flatnonzero(n > 0)
            share = np.zeros((b - a, len(self.labels)))
            if len(own) and self.labels:
                gamma = marginals(text.emissions(self.weights)[text.number].astype(float), text.first[own], n[own], self.move, self.begin)
                share[own] = np.add.reduceat(gamma, text.first[own]) / n[own][:, None]
            for d in range(b - a):
                known = letters[a + d] and n[d] and self.labels
                names.append(self.labels[int(share[d].argmax())] if known else "und")
                scores.append(min(1.0, float(share[d].max())) if known else 0.0)
        return names, scores


def fit(docs: DataFrame, teaches: Column, sample_docs: int = 200, most_docs: int = 20_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf:
    """A model from the labelled rows for which ``teaches`` holds, by a bounded sample of them."""
    rows = docs.filter(teaches).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.pmod(F.xxhash64(f"`{doc_id}`"), F.lit(1 << 20)).alias("draw")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Crf([])
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n) * (1 << 20)))])
    sample = rows.filter(F.col("draw") < rate[F.col("lang")]).orderBy("draw", "lang", F.xxhash64("text")).limit(most_docs).select("text", "lang").toArrow()
    crf = Crf(sorted(counts))
    where = {k: i for i, k in enumerate(crf.labels)}
    crf.fit(sample["text"].to_pylist(), [where[x] for x in sample["lang"].to_pylist()])
    return crf


def predict(docs: DataFrame, crf: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; only the text is looked at.

    Columns of these names that the input has already are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch[text].cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def word_languages(text: str, crf: Crf) -> list[tuple[str, str]]:
    """Each word of a text with its most likely language."""
    words, own = Words(pc.utf8_lower(pa.array([text], pa.string())), _GAPS), Text(pa.array([text], pa.string()))
    if not len(words.starts) or not crf.labels:
        return []
    gamma = marginals(own.emissions(crf.weights)[own.number].astype(float), np.array([0]), np.array([len(words.starts)]), crf.move, crf.begin)
    return [(words.word(i).decode(), crf.labels[int(k)]) for i, k in enumerate(gamma.argmax(1))]
