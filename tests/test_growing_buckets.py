"""Stored tables whose buckets are split one by one, also when a call is cut off."""

import glob
import hashlib
import os
from collections import Counter

import pytest

from pyspark.sql import functions as F
from sessionlog.sinks import replace
from sessionlog.sinks.replace import _source, bucket_of, grow, replace_sessions, table_buckets


def test_a_new_bucket_takes_rows_of_one_bucket_only(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("session_id"))
    ids = ids.unionByName(spark.createDataFrame([(None,)], "session_id string"))
    for now, want in [(1, 2), (2, 3), (5, 6), (7, 8), (8, 9), (3, 12), (64, 65)]:
        moves = ids.select(bucket_of("session_id", now).alias("a"), bucket_of("session_id", want).alias("b")).collect()
        assert all(0 <= r.a < now and 0 <= r.b < want for r in moves)
        assert all(r.a == r.b if r.b < now else r.a == _source(r.b, now) for r in moves)
    h = spark.range(50).select(F.col("id").cast("string").alias("session_id"))
    assert all(r.a == r.b for r in h.select(bucket_of().alias("a"), F.pmod(F.xxhash64("session_id"), F.lit(64)).alias("b")).collect())


def _text(s, version, i):
    return hashlib.sha256(f"{s}:{version}:{i}".encode()).hexdigest()  # text that doesn't compress


def _rows(spark, sessions, version, n=60):
    return spark.createDataFrame([(s, i, _text(s, version, i)) for s in sessions for i in range(n)], "session_id string, seq long, t string")


def _table(spark, path):
    return Counter((r.session_id, r.seq, r.t) for r in spark.read.parquet(path).drop("bucket").collect())


def _expected(held, n=60):
    return Counter({(s, i, _text(s, v, i)): 1 for s, v in held.items() for i in range(n)})


@pytest.mark.parametrize("cut", [None, "n", "clean"])
def test_replaced_sessions_while_the_table_grows(spark, tmp_path, monkeypatch, cut):
    path, held = str(tmp_path / "t"), {}
    opts = dict(order=["session_id", "seq"], buckets=2, bucket_bytes=4000)
    mark = replace._mark
    for version, sessions in enumerate([["a", "b"], [f"s{i}" for i in range(12)], ["a", "s3", None]]):
        rows = _rows(spark, sessions, version)
        if cut and version == 1:
            def fail(spark, path, kind, number):
                if kind == cut:
                    raise RuntimeError("lost")
                mark(spark, path, kind, number)
            monkeypatch.setattr(replace, "_mark", fail)
            with pytest.raises(RuntimeError):
                replace_sessions(rows, rows, path, **opts)
            monkeypatch.setattr(replace, "_mark", mark)
        else:
            replace_sessions(rows, rows, path, **opts)
        held |= {s: version for s in sessions}
    grow(spark, path, 4000, ["session_id", "seq"], buckets=2)
    assert _table(spark, path) == _expected(held)
    n = table_buckets(spark, path, 2)
    assert n > 2
    wrong = spark.read.parquet(path).filter(F.col("bucket") != bucket_of("session_id", n)).count()
    assert wrong == 0


def test_one_session_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = _rows(spark, [f"s{i}" for i in range(30)], 0)
    replace_sessions(rows, rows, path, buckets=4, bucket_bytes=3000)
    files = {b: sorted(os.listdir(b)) for b in glob.glob(f"{path}/bucket=*")}
    one = _rows(spark, ["s7"], 1)
    replace_sessions(one, one, path, buckets=4, bucket_bytes=1 << 30)
    changed = [b for b in glob.glob(f"{path}/bucket=*") if sorted(os.listdir(b)) != files.get(b)]
    assert len(files) > 4 and len(changed) == 1
    assert _table(spark, path) == _expected({f"s{i}": int(i == 7) for i in range(30)})


def test_upsert_reads_its_sessions_once(spark, tmp_path):
    """Both tables' replacements read the sessions' rows and ids; what makes these runs once."""
    from pyspark.sql import functions as F

    from sessionlog.schema import EVENT_SCHEMA
    from sessionlog.sinks.store import store_events, store_sessions, upsert_store

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    made = spark.range(7).selectExpr("concat('s', id) as session_id", "'/p' as project_path", "'sqlite' as output_format",
                                     "id as start_us", "id as end_us", "true as active")
    sessions = store_sessions(made.mapInArrow(count, made.schema))
    have = {"session_id": F.concat(F.lit("s"), F.col("id") % 7), "seq": F.col("id"), "ts_us": F.col("id"), "type": F.lit("annotation")}
    events = spark.range(70).select(*[have.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENT_SCHEMA.fields])
    upsert_store(sessions, store_events(events), str(tmp_path / "store"))
    assert seen.value == 7
    assert spark.read.parquet(str(tmp_path / "store" / "sessions")).count() == 7
    assert spark.read.parquet(str(tmp_path / "store" / "events")).count() == 70
