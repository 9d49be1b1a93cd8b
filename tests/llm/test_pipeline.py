"""The pipeline and its stages against the same by brute force, on the tables and on odd rows."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_parts import plain_distance, plain_fingerprint
from tests.llm.test_queries import components, plain_lines

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def plain_near(docs):
    """One row of each component: the smallest id's, null ids last."""
    root = components([plain_fingerprint(t) for _, t in docs])
    first = {}
    for row, r in zip(docs, root, strict=True):
        first.setdefault(r, set()).add(row)
    least = {r: min((i is None, i or 0) for i, _ in rows) for r, rows in first.items()}
    return {r: {x for x in rows if (x[0] is None, x[0] or 0) == least[r]} for r, rows in first.items()}


def holds(items, words, vocabulary):
    """An item can only be where most of its words are: look at those texts alone."""
    own = set(words) & vocabulary
    return any(len(set(x) & own) >= 0.5 * len(set(x)) and plain_distance(x, words) <= int(0.2 * len(x) + 1e-9) for x in items)


def test_pipeline(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(x := (r.text or "").lower().split()) >= corpus_pipeline.LEAST_ITEM_WORDS]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    docs = [(i, t) for i, t, _, _ in plain_lines(docs)]
    docs = [row for rows in plain_near(docs).values() for row in rows]
    vocabulary = {w for x in items for w in x}
    kept = [(i, t) for i, t in docs if not holds(items, t.lower().split(), vocabulary)]
    assert len(kept) < len(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, hashlib.sha256(np.array([1, *library.encode(t), 2], "<u4").tobytes()).hexdigest()) for i, t in kept]
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted(want)


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", STAGE)
def test_empty(spark, no_docs, name):
    found = STAGE[name](spark, no_docs, SF)
    assert found.count() == 0
    assert name == corpus_pipeline.STAGES[-1][0] or tuple(found.columns) == corpus_pipeline.COLUMNS


def test_odd_languages(spark, make_docs, odd_rows):
    strange = "中文 字符 语言 測試 漢字 文章 " * 10
    docs = make_docs([*odd_rows, (7001, strange), (7002, None)])
    train = spark.read.parquet(f"{SF}/documents.parquet")
    both = rows(corpus_pipeline.language_id(spark, train.unionByName(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")), SF))
    letters = [(i, t) for i, t in rows(train) if any(c.isalpha() for c in t or "")]
    assert set(letters) <= set(both)  # all clean documents stay
    assert not {7001, 7002, 1, 2, 3, 7} & ({i for i, _ in both} - {i for i, _ in letters})


def test_odd_lines(spark, odd_docs, odd_rows):
    assert rows(corpus_pipeline.line_dedup_stage(spark, odd_docs, SF)) == sorted(((i, t) for i, t, _, _ in plain_lines(odd_rows)), key=str)


def test_odd_duplicates(spark, make_docs, odd_rows):
    # ids that come again with another text, equal rows, copies without an id
    more = [(20, "quite another text than the one before it"), (4, "One"), (4, "One"), (None, odd_rows[20][1]), (None, "only here without an id"), (None, "only here without an id")]
    docs = [*odd_rows, *more]
    found = rows(corpus_pipeline.near_duplicates(spark, make_docs(docs), SF))
    want = list(plain_near([(i, t or "") for i, t in docs]).values())
    assert len(found) == len(want)
    left = [(i, t or "") for i, t in found]
    assert all(sum(x in rows_ for x in left) == 1 for rows_ in want)
    assert (20, more[0][1]) in found


def test_odd_leaks(spark, make_docs, odd_rows, tmp_path):
    base = odd_rows[20][1].split()
    items = [" ".join(base[10:40]), "two words", "a b", None, "", "five words that stand here"]
    spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [*odd_rows, (8090, "now two words and a b"), (8091, "see five words that stand here too"), (8092, "five words that stood here")]
    found = rows(corpus_pipeline.benchmark_decontamination(spark, make_docs(docs), str(tmp_path)))
    long = [x.split() for x in (items[0].lower(), items[5])]
    assert found == sorted(((i, t) for i, t in docs if not holds(long, (t or "").lower().split(), {w for x in long for w in x})), key=str)
    assert {8090} <= {i for i, _ in found} and not {8091, 8092} & {i for i, _ in found}


def test_odd_codes(spark, odd_docs, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.sentencepiece(spark, odd_docs, SF).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, len(library.encode(t or "")) + 2) for i, t in odd_rows), key=str)
