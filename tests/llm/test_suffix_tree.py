"""The suffix tree's retention, smoothing and scores against plain dictionaries."""

import math
from collections import Counter

import pytest

from sessionlog.llm import suffix_tree_lm
from sessionlog.llm.shared import id_remainder


def plain_scores(train, texts, depth=3, least=2, smooth=4.0):
    """Scores of lists of tokens by the docstring's rules, one n-gram at a time."""
    ones = Counter(t for text in train for t in text)
    total, distinct = sum(ones.values()), len(ones)
    unigram = lambda w: (ones[w] + 0.1) / (total + 0.1 * (distinct + 1))
    counts = [Counter({(w,): n for w, n in ones.items()})]
    for k in range(2, depth + 2):
        found = Counter(tuple(text[i : i + k]) for text in train for i in range(len(text) - k + 1))
        counts.append(Counter({g: n for g, n in found.items() if n >= least}))
    kept, given = {}, {}  # retained contexts' rests; P(last word | context) of n-grams

    def p(context, word):
        if not context:
            return unigram(word)
        return given[*context, word] if context in kept else p(context[1:], word)

    for k in range(1, depth + 1):
        after = {}
        for g in counts[k]:
            after.setdefault(g[:-1], []).append(g)
        for context, grams in after.items():
            seen = counts[k - 1][context]
            q = {g: p(context[1:], g[-1]) for g in grams}
            own = {g: (counts[k][g] + smooth * q[g]) / (seen + smooth) for g in grams}
            rest_p, rest_q = max(1 - sum(own.values()), 1e-12), max(1 - sum(q.values()), 1e-12)
            gain = 2 * seen * (sum(own[g] * math.log(own[g] / q[g]) for g in grams) + rest_p * math.log(rest_p / rest_q))
            if gain > len(grams) + 3 * math.sqrt(2 * len(grams)):
                kept[context] = math.log10(rest_p / rest_q)
                given |= own
    out = []
    for text in texts:
        score = 0.0
        for i, w in enumerate(text):
            log = math.log10(unigram(w))
            for k in range(1, min(depth, i) + 1):
                context = tuple(text[i - k : i])
                if context in kept and context in counts[k - 1]:
                    log = math.log10(given[*context, w]) if (*context, w) in counts[k] else log + kept[context]
            score += log
        out.append(score)
    assert kept
    return out


def test_scores(odd_docs, odd_rows):
    end = object()
    tokens = {i: [] for i, _ in odd_rows}
    for i, t in odd_rows:
        tokens[i].append([*(w.decode() for w in (t or "").encode().lower().split()), end])
    rows = odd_docs.filter("doc_id IS NOT NULL AND doc_id <> 12")
    learns = [i for i in tokens if i is not None and i != 12]
    out = {r.doc_id: r.held_out for r in rows.select("doc_id", (id_remainder("doc_id", 10) == 0).alias("held_out")).collect()}
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(rows, id_remainder("doc_id", 10) == 0, shard_tokens=64).collect()}
    want = plain_scores([tokens[i][0] for i in learns if not out[i]], [tokens[i][0] for i in learns])
    assert got == pytest.approx(dict(zip(learns, want, strict=True)), rel=1e-5, abs=1e-4)


def test_files_open(spark, tmp_path, monkeypatch):
    """A worker maps a bounded number of shard files, whatever their number."""
    monkeypatch.setattr(suffix_tree_lm, "_OPEN", 3)
    import numpy as np

    names, sizes = [], []
    for shard in range(20):
        keys = np.arange(shard, 200, 20).astype(np.uint64)
        row = suffix_tree_lm._write(str(tmp_path), shard, keys=keys, counts=keys + np.uint64(1))
        names.append(row["name"][0].as_py())
        sizes.append(len(keys))
    stored = suffix_tree_lm.Stored(str(tmp_path), names, sizes)
    numbers = np.arange(sum(sizes))
    assert sorted(stored.take(numbers, "counts").tolist()) == list(range(1, 201))
    assert stored.open.cache_info().currsize == 3
