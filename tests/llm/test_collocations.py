"""Phrase collocations against plain counting, with groups and filters of any size."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from sessionlog.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, longest=5):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    out = {}
    for (lang, p), a in often.items():
        if longer[lang, p] < a:
            cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


def texts():
    rnd = random.Random(5)
    words = ["The", "é", "中文", "x\x01y", "a\x0bb", "in", "of-the", "STATE", "q", "\x00", "zz", "İ"]
    rows = [(None, "en"), ("", "en"), ("  \t ", None), ("...!?", "de"), ("one", "xx"), ("und lang", None)]
    rows += [(" ".join(rnd.choices(words, [30, 20, 9, 5, 3, 9, 9, 9, 4, 2, 1, 1], k=rnd.randint(1, 60))).replace("zz", "\t, zz\n"), rnd.choice(["en", "en", "en", "de", None])) for _ in range(300)]
    return rows + [("Again and again it is said: so it is.", "en")] * 120 + [("the " * 3000, "en")]


SCHEMA = "text string, lang string, phrase string, a long, k int, size string, c string, h int"


@pytest.mark.parametrize("group_rows,filter_bits", [(1 << 18, (22, 23)), (50, (12, 13)), (1, (12, 12))], ids=["default", "small", "extended"])
def test_collocations(spark, group_rows, filter_bits):
    rows = texts()
    docs = spark.createDataFrame([(*r, "clash", 1, 2, "clash", "clash", 3) for r in rows], SCHEMA).repartition(5)
    for least, top in ((10, 2000), (100, 7)):
        got = rows_of(collocations.collocations(docs, least=least, top=top, group_rows=group_rows, filter_bits=filter_bits))
        assert sorted(got) == sorted(plain(rows, least, top))
    assert len(got) > 7


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None, "", 0, 0, "", "", 0)], SCHEMA), least=1).count() == 0


def test_products_pass_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 2, 4 * 10**14)], "lang string, phrase string, size int, c long")
    words = spark.createDataFrame([("en", "a", 5 * 10**14), ("en", "b", 7 * 10**14)], "lang string, word string, c long")
    totals = spark.createDataFrame([("en", 9 * 10**16)], "lang string, n long")
    assert collocations.score_cuts(phrases, words, totals).first().score == 1000 * 4 * 10**14 * 9 * 10**16 // (5 * 10**14 * 7 * 10**14)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = __spark_entry__.queries()["op13_collocations"](spark, sf)
    assert sorted(rows_of(found)) == sorted(plain(rows, 100, 2000))
    assert found.dtypes[1] == ("rank", "bigint")


def test_numbers_take_few_bytes():
    for most in (0, 1, 255, 256, 70_000, 2**24, 2**31, 2**40):
        numbers = np.array([0, most, most // 2, 0], np.int64)
        thin = collocations._thin(numbers)
        assert collocations._wide(thin).tolist() == numbers.tolist()
        assert len(thin) == 1 + 4 * max(1, (most.bit_length() + 7) // 8)


def test_packed_suffixes_are_small():
    """A packed suffix took 32 bytes, so rows of one task filled an executor's memory at 6 GB."""
    rnd = np.random.default_rng(3)
    n, words, langs = 3000, pa.array([f"word{i}é" for i in range(300)]), pa.array(["de", "en", "xx"])
    codes = rnd.integers(0, 300, (n, 5)).astype(np.int32)
    codes[:, 3:][rnd.random(n) < 0.3] = -1
    s = collocations.Suffixes(words, langs, rnd.integers(0, 3, n), codes, rnd.integers(1, 300, n))

    def plainly(x):
        spell = [*x.words.to_pylist(), None]
        return [(x.langs[int(a)].as_py(), *(spell[k] for k in c), int(m)) for a, c, m in zip(x.lang, x.codes.tolist(), x.counts, strict=True)]

    rows = plainly(s)
    for which in (np.zeros(n, np.int64), rnd.integers(0, 7, n) * 5):
        values, own, columns = s.parts(which)
        assert values.tolist() == sorted(set(which.tolist()))
        assert [sorted(x.tolist()) for x in own] == [np.flatnonzero(which == v).tolist() for v in values]
        assert sum(len(x.as_py()) for c in columns[2:] for x in c) <= n * (1 + 2 * 5 + 2) + 3 * len(values)
        back = plainly(collocations.Suffixes.together(pa.table(columns, collocations._NAMES), 5))
        assert back == [rows[i] for x in own for i in x]


def test_packed_suffixes_are_read_one_row_at_a_time(spark):
    """However many rows a task has: they came as one Arrow batch, which grew with the task's share of the input."""
    text = " ".join(random.Random(8).choices(["state", "of", "the", "art", "in"], k=20_000))
    docs = spark.createDataFrame([(text + " " + "x" * (5 << 19), "en") for k in range(4)], "text string, lang string").coalesce(1)
    every = [np.full(1 << 9, 255, np.uint8) for _ in range(2)]
    packed = collocations.suffixes(docs, *every, 5)
    assert len(packed.files) == 1

    def sizes(rows):
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([len(r)]), pa.array([len(collocations.Suffixes.together(r, 5).counts)])], ["rows", "count"])

    found = packed.map(sizes, "rows long, count long").collect()
    assert [r.rows for r in found] == [1] * 4
    assert sum(r["count"] for r in found) == packed.count
