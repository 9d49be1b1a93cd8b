import random

import pytest

EXTRA = ("fp", "node", "n_tokens", "shard", "n_lines", "lang_pred", "score", "word", "a", "b")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty, blank, very long and repeated texts, ties, shared lines."""
    rnd = random.Random(4)
    syllables = ["the", "an", "ing", "zu", "ver", "é", "ñ", "que", "os", "ber"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = line(12)
    rows = [(1, None), (2, ""), (3, "  \t\n "), (None, "a text of no document"), (4, "One"), (5, "one"), (6, "a b"),
            (7, "\n\n\n"), (8, f"{shared}\nown line of eight, here\n  {shared.upper()}  "), (9, f"{shared}\n\n{line(8)}."),
            (10, "中文 😀 <s> </s> <|endoftext|> <0x41> ▁x  y"), (11, "12345 ... !!!"), (12, line(4000)), (12, line(3)),
            (13, "x" * 5000), (-5, shared), (14, "  double  spaces   here ")]
    base = line(200)
    rows += [(20 + i, base) for i in range(12)]
    for i in range(12):
        words = base.split()
        words[i * 10] = word()
        rows.append((40 + i, " ".join(words)))
    rows += [(60 + i, "\n".join(line(rnd.randint(1, 30)) for _ in range(rnd.randint(1, 4)))) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as documents, with more columns whose names clash with those that operators use."""
    return frame(spark, odd_rows).cache()


def frame(spark, rows):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", None, *["clash"] * len(EXTRA)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: frame(spark, rows)
