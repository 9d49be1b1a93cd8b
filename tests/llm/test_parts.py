"""The operators' building blocks against plain statements of what they compute."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from sessionlog.llm import decontaminate, language_crf, perfect_hash, piece_bpe, sharding, simhash, token_counts
from sessionlog.llm.shared import Recent
from sessionlog.llm.suffix_tree_lm import END, Tree
from sessionlog.llm.token_files import _Encoder
from sessionlog.llm.words import Lookup, Words

PIECES = ["a", "b", "th", "he", " ", "  ", "\n", "1", ".", "é", "ß", "中", "😀", "▁", "<s>", "</s>", "<0x41>", "the", "ing", "\t", "\x00",
          "A", "aaa", "----", "====", "́", "İ", "'s", "<|endoftext|>", "ſ"]


def texts(seed, n, most=25):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.model(public_tokenizers.path("piece_bpe_32k.model"))


def test_prefix_tables_give_the_library_ids(bpe):
    ids = Recent(bpe.run_ids, most=20_000)  # small: values come and go
    for x in texts(1, 2000) + [c * n for c in (" ", "-", "0", "ha") for n in (1, 2, 17, 70)]:
        assert np.frombuffer(b"".join(ids(piece_bpe.runs(x))), "<u4").tolist() == bpe.library.encode(x), x


def test_counts_of_every_prefix(bpe):
    counts = Recent(bpe.run_counts)
    for x in texts(2, 60):
        table = token_counts.prefix_counts(x, counts)
        want = [len(bpe.library.encode(x[:k])) for k in range(len(x) + 1)]
        assert table.tolist() == want
        for budget in (0, 1, 3, 8, 10**6):
            assert token_counts.largest_prefix(table, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_words_encoded_apart_are_the_whole_text(bpe):
    encode = _Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2", most=40)
    all_texts = texts(3, 1500)
    for at in range(0, len(all_texts), 50):
        part = all_texts[at : at + 50]
        got = [np.frombuffer(b, "<u2").tolist() for b in encode(part)]
        assert got == [encode.library.encode(x, add_special_tokens=False).ids for x in part]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash_is_minimal(n):
    keys = perfect_hash.mixed(np.arange(n, dtype=np.uint64), 99)
    at = perfect_hash.index(perfect_hash.build(keys), keys)
    assert sorted(at.tolist()) == list(range(n))


def test_words_and_lookup():
    xs = [*texts(4, 300), None, "", " ", "A b\x0bC\x0c\rd", "é" * 300_000, "x " * 300_000]
    words = Words(pa.array(xs, pa.string()))
    want = [(x or "").encode().lower().split() for x in xs]
    got = [[words.word(i) for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == want
    flat, hashes = [w for ws in want for w in ws], words.hashes()
    assert len(set(flat)) == len(np.unique(hashes)) == len(set(zip(flat, hashes.tolist(), strict=True)))
    keys = np.unique(hashes)
    assert (Lookup(keys)(hashes) == np.searchsorted(keys, hashes)).all()
    assert (Lookup(keys)(hashes + np.uint64(1)) == -1).all()
    assert len(Words(pa.array([], pa.string())).hashes()) == 0


def test_longest_first():
    sizes = [7, 7, 6, 6, 5, 5, 4, 4, 4]
    at = sharding.longest_first(sizes, 3)
    assert sorted(sum(s for s, k in zip(sizes, at, strict=True) if k == j) for j in range(3)) == [16, 16, 16]


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    for x in [None, "", " \n", "one", "One two", "A b c", "a  b\tc d e f g a b c", *texts(5, 50)]:
        assert simhash.fingerprint(x, 3) % 2**64 == plain_fingerprint(x), x


def test_pivot_tables_keep_all_near_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    far = np.bitwise_count(a ^ b) > 3
    assert not far.any()
    table = simhash.distance_table
    assert len(simhash._within(a, b, table(a), table(b), 3)) == 500
    c = rng.integers(0, 2**63, 500).astype(np.uint64)
    assert len(simhash._within(a, c, table(a), table(c), 3)) == (np.bitwise_count(a ^ c) <= 3).sum()


def plain_distance(item, passage):
    row = [0] * (len(passage) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(passage, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_smallest_distance():
    rnd = random.Random(6)
    for _ in range(400):
        a = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))]
        b = [rnd.randint(1, 4) for _ in range(rnd.randint(0, 25))]
        assert decontaminate.smallest_distance(a, b) == plain_distance(a, b)


def test_embedded_windows_reach_the_recall():
    rnd = random.Random(7)
    items = [" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n)) for n in range(8, 90)]
    assert decontaminate.measured_recall(items, 0.0) == 1
    assert decontaminate.measured_recall(items, 0.1) >= 0.95
    assert decontaminate.measured_recall(items, 0.2) >= 0.9


def test_windows_of_long_texts_are_found_piece_by_piece(monkeypatch):
    monkeypatch.setattr(decontaminate, "_PIECE", 64)
    rnd = random.Random(8)
    item = [f"w{rnd.randint(0, 10**6)}" for _ in range(20)]
    text = [f"v{rnd.randint(0, 10**6)}" for _ in range(1000)]
    for at in (0, 50, 60, 64, 700, 1000):
        words = Words(pa.array([" ".join(text[:at] + item + text[at:]), "other"], pa.string()))
        block = decontaminate.Items([1], [" ".join(item)], 0.8, 2, 4, 6, 8)
        assert block.held(words.hashes(), words.first) == [(0, 0, 0)]


def test_marginals_are_those_of_all_label_sequences(monkeypatch):
    monkeypatch.setattr(language_crf, "_SEGMENT", 4)
    rng = np.random.default_rng(0)
    emit, move, begin = rng.normal(size=(40, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts, sizes = np.array([0, 5, 6, 19]), np.array([5, 1, 13, 21])
    got, both = language_crf.marginals(emit, starts, sizes, move, begin, pairs=True)
    for s, n in zip(starts, sizes, strict=True):
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        f[0] = np.exp(begin + emit[s])
        for t in range(1, n):
            f[t] = (f[t - 1] @ np.exp(move)) * np.exp(emit[s + t])
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(move) @ (np.exp(emit[s + t + 1]) * b[t + 1])
        assert np.allclose(got[s : s + n], f * b / (f * b).sum(1, keepdims=True))
    assert np.isclose(both.sum(), 36)


def test_words_of_a_mixed_text_get_their_languages():
    rnd = random.Random(9)
    word = {"x": lambda: "".join(rnd.choice(["the", "ing", "ou"]) for _ in range(3)), "y": lambda: "".join(rnd.choice(["zu", "ber", "ä"]) for _ in range(3))}
    made = [(k, " ".join(word[k]() for _ in range(60))) for k in "xy" * 40]
    crf = language_crf.Crf(["x", "y"])
    crf.fit([t for _, t in made], ["xy".index(k) for k, _ in made])
    mixed = [("x", word["x"]()) for _ in range(15)] + [("y", word["y"]()) for _ in range(15)] + [("x", word["x"]()) for _ in range(5)]
    got = language_crf.word_languages(" ".join(w for _, w in mixed), crf)
    assert [w for w, _ in got] == [w for _, w in mixed]
    assert np.mean([a[1] == b[0] for a, b in zip(got, mixed, strict=True)]) > 0.95


def test_suffix_tree_distributions_sum_to_one():
    rng = np.random.default_rng(3)
    body = rng.choice([1, 2, 3, 4, 5], 4000, p=[0.4, 0.3, 0.1, 0.1, 0.1])
    body[1::7] = np.where(body[::7][: len(body[1::7])] == 1, 5, body[1::7])  # 1 is often followed by 5
    tokens = body.astype(np.uint64)
    tokens[::50] = END
    keys, n = np.unique(tokens, return_counts=True)
    tree = Tree(keys, n, int(n.sum()), len(n))
    ids = tree.words(tokens)
    starts = np.flatnonzero(np.concatenate([[True], tokens[:-1] == END]))
    for _ in range(2):
        ends = tree.chains(ids, starts)[-1]
        before = np.concatenate([[-1], ends[:-1]])
        before[starts] = -1
        k, c = np.unique(((before.astype(np.int64) << 20) | ids)[before >= 0], return_counts=True)
        tree.grow(k[c > 1], c[c > 1], 4.0)
    assert tree.levels[0].kept.any()
    unseen = 0.1 / (tree.total + 0.1 * (tree.distinct + 1))
    words = np.arange(len(keys), dtype=np.int32)
    for length in (1, 2):
        for row in tree.levels[length - 1].words:
            gram = np.concatenate([np.repeat(row[None], len(words), 0), words[:, None]], 1)
            known = (10.0 ** tree._ngram_log_probability(gram)).sum()
            other = np.append(row, -1).astype(np.int32)
            rare = 10.0 ** tree.log_probabilities(other, np.array([0]))[-1] * unseen
            assert np.isclose(known + rare, 1)


def test_tasks_of_a_worker_share_the_token_file_encoder():
    from sessionlog.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    first = token_files._encoder(path, "<u2")
    whole = token_files._Encoder(path, "<u2")(["one two", "two three"])
    assert first(["one two"]) == whole[:1] and "two" in first.new
    assert token_files._encoder(path, "<u2") is first and first(["two three"]) == whole[1:]


def test_plain_words_go_to_the_tokenizers_model_alone():
    from types import SimpleNamespace

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, sent = _Encoder(path, "<u2"), []
    whole = encode.library

    def noted(text, **options):
        sent.append(text)
        return whole.encode(text, **options)

    encode.library = SimpleNamespace(model=whole.model, encode=noted)
    all_texts = ["I'LL say: Don't 12x!", "a\nb <|Endoftext|>", "x<|endoftext|>y Caf\u00e9 \x1cz \t!", ""]
    got = [np.frombuffer(b, "<u2").tolist() for b in encode(all_texts)]
    assert got == [whole.encode(x, add_special_tokens=False).ids for x in all_texts]
    assert sorted(w for x in sent for w in x.split(" ")) == ["\t!", "\x1cz", "Caf\u00e9", "x<|endoftext|>y"]


def test_other_tokenizers_send_all_words_to_the_library(tmp_path):
    import json

    from sessionlog.llm import token_files

    rules = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    rules["normalizer"]["normalizers"].pop()  # upper case stays
    path = str(tmp_path / "other.json")
    json.dump(rules, open(path, "w"))
    encode = token_files._Encoder(path, "<u2")
    assert encode.rule is None
    assert [np.frombuffer(b, "<u2").tolist() for b in encode(["Ab aB ab"])] == [encode.library.encode("Ab aB ab", add_special_tokens=False).ids]


def test_language_emissions_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(40_000)]
    crf = language_crf.Crf(["a", "b", "c", "d"])
    crf.weights[:] = rng.normal(size=crf.weights.shape)
    text = language_crf.Text(pa.array([" ".join(words)]))
    tracemalloc.start()
    got = text.emissions(crf.weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All four weights of each byte at once would take 64 bytes; their sums take 16, and so do those being added.
    assert peak < 48 * len(text.features)
    assert np.array_equal(got, np.add.reduceat(crf.weights[text.features].sum(1), text.begins, axis=0))


def test_language_shares_do_not_depend_on_the_block():
    crf = language_crf.Crf(["a", "b"])
    crf.fit(["the cat sat on the mat"] * 5, [0] * 5)
    all_texts = pa.array([x if i % 7 else None for i, x in enumerate(texts(8, 300))], pa.string())
    (names, scores), (want_names, want_scores) = crf.predict(all_texts, block=16), crf.predict(all_texts, block=1 << 18)
    assert names == want_names and np.allclose(scores, want_scores, rtol=0, atol=1e-12)


def test_the_pipeline_bounds_what_encoding_keeps(monkeypatch):
    import corpus_pipeline
    from sessionlog.llm import piece_codec

    sizes = []

    class Noted(Recent):
        def __init__(self, compute, most):
            sizes.append(most)
            super().__init__(compute, most)

    monkeypatch.setattr(piece_codec, "Recent", Noted)
    path, some = public_tokenizers.path("piece_bpe_32k.model"), pa.array(["one two", None, "two three"])
    small = piece_codec._encoder(path, True, True, 1000)(some)
    assert small == piece_codec._encoder(path, True, True)(some)
    assert sizes == [1000, 160 << 20] and corpus_pipeline.CACHE_BYTES <= 48 << 20
