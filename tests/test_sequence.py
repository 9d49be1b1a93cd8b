"""Sequencing and ordinals: range path == bounded-window path == plain row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlog.operators.sequence import ordinal_within, top_k_per_group
from sessionlog.sources.adapter import canonical_from_driver


def test_assign_seq_range_path_equals_window(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a = canonical_from_driver(raw, max_group_rows=0)        # forces the range-exchange path
    b = canonical_from_driver(raw)                           # bounded groups: plain window
    ka = a.select("session_id", "seq", "changed_tick")
    kb = b.select("session_id", "seq", "changed_tick")
    assert ka.exceptAll(kb).count() == 0 and kb.exceptAll(ka).count() == 0
    w = Window.partitionBy("session_id").orderBy("ts_us", "changed_tick")
    ref = b.select("session_id", "changed_tick", (F.row_number().over(w) - 1).alias("seq"))
    assert ref.exceptAll(kb.select("session_id", "changed_tick", "seq")).count() == 0


def test_ordinal_within_small_chunks(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1001).alias("o"))
    got = ordinal_within(df, ["k"], "o", "r", chunk_rows=16)
    w = Window.partitionBy("k").orderBy("o")
    ref = df.withColumn("r", F.row_number().over(w).cast("bigint"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_top_k_two_phase(spark):
    df = spark.range(0, 2000).select((F.col("id") % 4).alias("g"), F.col("id").alias("v"),
                                    F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"))
    got = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("name")], 10, "name", fanout=8)
    rows = got.collect()
    assert len(rows) == 40
    for g in range(4):
        vs = sorted((r.v for r in rows if r.g == g), reverse=True)
        assert vs == sorted([v for v in range(2000) if v % 4 == g], reverse=True)[:10]
