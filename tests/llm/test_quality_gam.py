"""The quality model: features by hand, held-out accuracy, additivity, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sessionlog.llm import quality_gam

FEATURE = {name: i for i, name in enumerate(quality_gam.FEATURES)}


def test_features():
    x = quality_gam.features(pa.array([None, "", "Ab ab ab! X1\nno end", "Ab ab ab! X1\nno end" * 2, " \n", "é é\nx.\n"]))
    assert x.shape == (6, len(FEATURE)) and np.isfinite(x).all() and not x[0].any() and not x[1].any()
    f = dict(zip(FEATURE, x[2], strict=True))
    assert f["log bytes"] == np.log1p(19) and f["log words"] == np.log1p(6)
    assert f["mean word bytes"] == pytest.approx((2 + 2 + 3 + 2 + 2 + 3) / 6)
    assert f["upper-case letters"] == pytest.approx(2 / 12) and f["digits"] == pytest.approx(1 / 14)
    assert f["words like the one before"] == pytest.approx(1 / 6)  # Ab = ab; "ab!" is another word
    assert f["distinct words"] == pytest.approx(5 / 6) and f["commonest word"] == pytest.approx(2 / 6)
    assert f["words without lower case"] == pytest.approx(1 / 6) and f["lines that end a sentence"] == 0
    g = dict(zip(FEATURE, x[5], strict=True))
    assert g["words like the one before"] == pytest.approx(1 / 3) and g["lines that end a sentence"] == pytest.approx(1 / 2)
    # a text's features don't depend on its neighbours
    assert np.array_equal(x[3], quality_gam.features(pa.array(["Ab ab ab! X1\nno end" * 2]))[0])


def test_interaction():
    """A label that no single feature tells is learnt by the pair, and the score is a sum of tables."""
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    gam = quality_gam.Gam(x, y, np.arange(4000) % 5 == 0, pairs=1)
    assert gam.pairs == [(0, 1)]
    test = rng.random((1000, 3))
    found = gam.scores(test)
    assert (((found > 0.5) == ((test[:, 0] > 0.5) != (test[:, 1] > 0.5))).mean()) > 0.95
    at = gam.bins(test)
    z = [gam.intercept + sum(t[b] for t, b in zip(gam.tables, row, strict=True)) + gam.pair_tables[0][row[0], row[1]] for row in at]
    assert np.allclose(found, 1 / (1 + np.exp(-np.array(z))))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 60)] + [(None, 1), (20, 0), (9999, 1), (61, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    gam = quality_gam.fit(odd_docs, labels, F.lit(True))
    got = quality_gam.predict(odd_docs, gam).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality_gam.predict(no_docs, gam).count() == 0
    none = quality_gam.fit(odd_docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_gam.predict(odd_docs, none).collect()} == {0.5}
    assert quality_gam.fit(no_docs, labels, F.lit(True)).pairs == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in __spark_entry__.queries()["op12_quality_gam"](spark, sf).collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    own = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, q in own if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and min(good) >= 0.3
    assert {f.name: f.dataType.simpleString() for f in __spark_entry__.queries()["op12_quality_gam"](spark, sf).schema.fields} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
