"""One session holding every row: chunked plans equal the single-chunk plans."""

import pytest
from pyspark.sql import functions as F

from sessionlog.config import ADAPTER_AGG, ADAPTER_FILTER, ExecConfig
from sessionlog.operators.blocks import activity_blocks
from sessionlog.operators.denoise import cursor_decisions
from sessionlog.operators.focus import file_focus
from sessionlog.operators.gaps import idle_gaps
from sessionlog.operators.timeline import timeline
from sessionlog.sources.adapter import canonical_from_driver


@pytest.fixture(scope="module")
def hot(spark):
    raw = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("user_id", F.lit(7).cast("bigint"))
    # max_group_rows below the session size: the range-exchange sequencing path
    return canonical_from_driver(raw, max_group_rows=1000)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_session_sequence_is_dense(hot):
    r = hot.agg(F.count("*").alias("n"), F.max("seq").alias("m"), F.countDistinct("seq").alias("d")).collect()[0]
    assert r.n == 10_000 and r.m == r.n - 1 and r.d == r.n


@pytest.mark.parametrize("op", ["blocks", "gaps", "focus", "timeline", "cursor"])
def test_hot_session_chunked_equals_unchunked(hot, op):
    big, small = ExecConfig(), ExecConfig(chunk_rows=1000)
    f = {
        "blocks": lambda e: activity_blocks(hot, ADAPTER_AGG, e),
        "gaps": lambda e: idle_gaps(hot, ADAPTER_AGG, e),
        "focus": lambda e: file_focus(hot, ADAPTER_AGG, e),
        "timeline": lambda e: timeline(hot, ADAPTER_AGG, e),
        "cursor": lambda e: cursor_decisions(hot, ADAPTER_FILTER, e),
    }[op]
    assert same(f(big), f(small))
