"""Each operator as Spark runs it, on rows that are odd in many ways, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionlog.llm import decontaminate, language_crf, line_dedup, nn_descent, piece_codec, sharding, simhash, suffix_tree_lm, token_counts, token_files
from sessionlog.llm.shared import id_remainder
from tests.llm.test_parts import plain_distance, plain_fingerprint

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


def test_token_counts(odd_docs, odd_rows, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(odd_docs, PIECES, budgets=(10,), prefixes=(5,), tables=True).cache()
    same(rows(got.select("doc_id", "n_bytes", "n_tokens")), [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in odd_rows])
    same([(r.doc_id, r["at"][5]) for r in got.collect()], [(i, len(library.encode((t or "")[:5]))) for i, t in odd_rows])
    # stored tables answer again, without the texts
    same([(r.doc_id, r.cut) for r in token_counts.stored_answers(got, 10).collect()], [(r.doc_id, r.fits[10]) for r in got.collect()])
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


def test_sharding(odd_docs, odd_rows, no_docs):
    got = sharding.shard_by_bytes(odd_docs, shards=4, slot_rows=5).collect()
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows])
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    where, loads, groups = {}, Counter(), Counter()
    for r in got:
        assert where.setdefault(r.text_crc32, r.shard) == r.shard
        loads[r.shard] += r["size"]
        groups[r.text_crc32] += r["size"]
    assert max(loads.values()) <= max(max(groups.values()), 4 / 3 * sum(loads.values()) / 4)
    assert sharding.shard_by_bytes(no_docs).count() == 0


def components(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [2, 4096], ids=["tiles", "buckets"])
def test_simhash(odd_docs, odd_rows, no_docs, bucket_rows):
    fps = [plain_fingerprint(t) for _, t in odd_rows]
    root = components(fps)
    first = {}
    for (i, _), r in zip(odd_rows, root, strict=True):
        if i is not None:
            first[r] = min(first.get(r, i), i)
    got = simhash.near_duplicates(odd_docs, bucket_rows=bucket_rows)
    same([(r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()], [(i, f, first.get(r)) for (i, _), f, r in zip(odd_rows, fps, root, strict=True)])
    assert len(set(first.values())) < len(odd_rows) - 15
    if bucket_rows > 2:
        assert simhash.near_duplicates(no_docs).count() == 0


def plain_lines(odd_rows, least=10):
    low = -(2**63)
    key = lambda x: x.strip(b" \t\n\r\x0b\x0c").lower()
    holders = {}
    for i, t in odd_rows:
        for x in (t or "").encode().split(b"\n"):
            holders.setdefault(key(x), set()).add(low if i is None else i)
    out = []
    for i, t in odd_rows:
        split = (t or "").encode().split(b"\n")
        gone = [len(key(x).decode()) >= least and len(holders[key(x)]) > 1 and min(holders[key(x)]) != (low if i is None else i) for x in split]
        out.append((i, b"\n".join(x for x, g in zip(split, gone, strict=True) if not g).decode(), len(split), sum(gone)))
    return out


@pytest.mark.parametrize("direct_bytes", [1 << 30, -1], ids=["direct", "routed"])
def test_line_dedup(odd_docs, odd_rows, no_docs, direct_bytes):
    got = line_dedup.drop_repeated_lines(odd_docs, direct_bytes=direct_bytes)
    same(rows(got.select("doc_id", "text", "n_lines", "n_dropped")), plain_lines(odd_rows))
    assert got.columns[-2:] == ["n_lines", "n_dropped"] and "fp" in got.columns
    assert line_dedup.drop_repeated_lines(no_docs, direct_bytes=direct_bytes).count() == 0


def test_token_files(odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(WORDS)
    folder, manifest = token_files.write_token_files(odd_docs, WORDS, end_id=2, part_rows=20)
    assert manifest.count() > 2 and manifest.first().width == "<u2"
    got = token_files.read_token_files(folder, manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in odd_rows]
    same([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got], want)
    same([(r.doc_id, r.ids_crc32) for r in got], [(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want])
    assert token_files.read_token_files(*token_files.write_token_files(no_docs, WORDS, end_id=70_000)).count() == 0


def test_decontamination(spark, make_docs, no_docs, odd_rows):
    base = odd_rows[20][1].split()
    items = [(1, " ".join(base[10:40])), (2, " ".join(base[100:112]).upper()), (3, "two words"), (4, None), (None, "x y z"), (5, ""), (1, " ".join(base[10:40]))]
    long = ["filler"] * 3000
    docs = odd_rows + [(90, " ".join(long + base[12:39] + long)), (91, " ".join(base[10:25]) + " other words in between " + " ".join(base[25:33]))]
    table = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    got = decontaminate.contaminated(make_docs(docs), table, block_items=2).select("doc_id", "item_id", "edits").distinct()
    want = set()
    for i, t in docs:
        words = (t or "").lower().split()
        for k, x in items:
            item = (x or "").lower().split()
            if k is not None and len(item) >= 8 and (d := plain_distance(item, words)) <= int(0.2 * len(item) + 1e-9):
                want.add((i, k, d))
    assert len(want) > 40
    found = set(rows(got))
    assert found <= want and {w for w in want if w[2] <= 0.1 * 30} <= found
    assert decontaminate.contaminated(no_docs, table).count() == 0
    assert decontaminate.contaminated(make_docs(docs), table.filter("false")).count() == 0


def test_short_items_and_items_without_an_id(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(12))
    items = [(1, "yes"), (2, "what is it"), (3, "one two three four"), (4, "a1 a2 a3 a4 a5"), (5, "b1 b2 b3 b4 b5 b6 b7"), (None, long), (None, "no id here"), (6, "")]
    docs = [(1, "Yes"), (2, "well What is\nit then"), (3, "one two four three"), (4, "a1 a2 xx a4 a5"), (5, "z a1 a2 a4 a5"), (6, "b1 b2 b3 q b4 b5 b6 b7 b8"),
            (7, "b1 b2 x b4 b5 x b7"), (8, f"start {long} end"), (9, "there is no id here"), (10, None), (11, ""), (12, "one two three four yes"), (13, "a2 a3 a4 a5")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        words = (t or "").lower().split()
        for k, x in items:
            item = x.split()
            if item and (d := plain_distance(item, words)) <= int(0.2 * len(item) + 1e-9):
                want.add((i, k, d))
    assert len(want) >= 9 and {k for _, k, _ in want} == {1, 2, 3, 4, 5, None}
    same(set(rows(decontaminate.contaminated(make_docs(docs), table, block_items=3).select("doc_id", "item_id", "edits"))), want)


def test_suffix_tree_scores(odd_docs, odd_rows, no_docs):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in odd_rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in odd_rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    got = suffix_tree_lm.score(odd_docs, id_remainder("doc_id", 10) == 0, least_share=2.0**-10).collect()
    want = [(i, h, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws, h in zip(odd_rows, tokens, held, strict=True)]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
    assert all(r.score <= 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert suffix_tree_lm.score(no_docs, id_remainder("doc_id", 10) == 0).count() == 0
    none = suffix_tree_lm.score(odd_docs, F.lit(True)).collect()  # nothing to learn from
    assert {(r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in none} == {(0, 0, 0.0, 0.0)}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24))
    x[200:400] = x[199]  # copies: a third of all rows
    data = [(i, r.tolist(), "clash") for i, r in enumerate(x)] + [(1000, None, ""), (1001, [0.0] * 24, ""), (1002, [1.0, None, 2.0], ""), (1003, [float("nan")] * 24, ""), (1004, [1.0, float("inf")], ""), (1005, [1.0, 2.0], ""), (0, x[0].tolist(), "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, node string")
    got = nn_descent.nearest(df, F.col("vec_id") % 20 == 0, degree=12, beam=64, step=16).collect()
    ok = [(i, np.pad(np.array(v), (0, 24 - len(v)))) for i, v, _ in data[:-1] if i < 1000 or i == 1005]
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    found = 0
    for q in [i for i, _ in ok if i % 20 == 0]:
        own = m[ids == q][0]
        score = (m * own).sum(1) / (np.sqrt((own * own).sum()) * np.sqrt((m * m).sum(1)))
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(np.isclose(r.score, score[ids == r.vec_id][0], atol=1e-12) for r in mine)
        found += len({r.vec_id for r in mine} & set(ids[order].tolist()))
    assert found / (5 * sum(i % 20 == 0 for i in ids)) >= 0.9
    few = nn_descent.nearest(df.filter("vec_id in (20, 21, 22)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(20, 1), (20, 2)]
    assert nn_descent.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_piece_codec(odd_docs, odd_rows, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_codec.decode(piece_codec.encode(odd_docs, PIECES), PIECES).collect()
    want = []
    for i, t in odd_rows:
        ids = [1, *library.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids)))
    same([(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got], want)
    assert piece_codec.decode(piece_codec.encode(no_docs, PIECES), PIECES).count() == 0


def test_language(spark, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = id_remainder("doc_id", 5) == 0
    crf = language_crf.fit(docs, ~held)
    got = language_crf.predict(docs, crf)
    assert got.filter(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = {r.doc_id: r for r in language_crf.predict(odd_docs, crf).collect()}
    assert len(odd) == len({i for i, _ in odd_rows})
    assert {odd[i].lang_pred for i in (1, 2, 3, 7, 11)} == {"und"} and odd[1].score == 0
    assert all(0 <= r.score <= 1 and r.lang_pred in [*crf.labels, "und"] for r in odd.values())
    assert language_crf.predict(no_docs, crf).count() == 0
    nothing = language_crf.fit(no_docs, ~held)
    assert {r.lang_pred for r in language_crf.predict(odd_docs, nothing).collect()} == {"und"}


def test_suffix_tree_keeps_what_occurs_twice(make_docs):
    """A context and next word seen a few times stay in the tree in a table of any size; as the tree in memory has it."""
    rnd = np.random.default_rng(5)
    common = [f"c{i}" for i in range(50)]
    texts = [" ".join(rnd.choice(common, 400)) for _ in range(3500)]
    texts += ["rareone raretwo rarethree rarefour"] * 3
    docs = make_docs([(i, t) for i, t in enumerate([*texts, "rareone raretwo rarethree rarefour"])])
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs, F.col("doc_id") == 3503).collect()}
    assert got[3503].train_tokens > 2**20 and got[3503].n_known == 5
    assert got[3503].score > got[3503].base_score + 10
    tokens, starts = suffix_tree_lm._tokens(pa.array([*texts, "rareone raretwo rarethree rarefour"]))
    own = tokens[: starts[-2]]
    keys, n = np.unique(own, return_counts=True)
    tree = suffix_tree_lm.Tree(keys, n, len(own), len(keys))
    ids = tree.words(own)
    for _ in range(3):
        ends = tree.chains(ids, starts[:-2])[-1]
        before = np.concatenate([[-1], ends[:-1]])
        before[starts[:-2]] = -1
        able = (before >= 0) & (ends >= 0)
        k, c = np.unique((before[able].astype(np.int64) << 20) | ids[able], return_counts=True)
        tree.grow(k[c > 1], c[c > 1], 4.0)
    want = np.add.reduceat(tree.log_probabilities(tree.words(tokens), starts[:-1]), starts[:-1])
    assert np.allclose([got[i].score for i in range(len(want))], want, rtol=1e-5)


@pytest.mark.parametrize("noise", [0.01, 0.0001])
def test_nearest_among_near_copies(spark, noise):
    """A third of the rows are noisy copies of one vector: their neighbours are those of double precision."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + noise * rng.normal(size=(1000, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 60 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in range(0, 3000, 60):
        far = ((unit - unit[q]) ** 2).sum(1)
        far[q] = 9
        found += len(got[q] & set(np.argsort(far)[:5].tolist()))
    assert found / (5 * 50) >= 0.9
