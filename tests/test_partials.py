"""Parts of summaries: any cut of a log gives the numbers of the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.operators.analytics import session_analytics
from sessionlog.operators.partials import extend, no_parts, summary
from sessionlog.operators.sequence import join_on
from sessionlog.operators.stats import session_state
from sessionlog.spark import materialize
from sessionlog.streaming.pipelines import latest_summaries, refresh_summaries
from tests.helpers import rows_to_df
from tests.test_property import random_logs

RULES = [AggregationConfig(flow_velocity=1.0, idle_threshold_us=2_000_000, lookback_us=10**9),
         AggregationConfig(lookback_us=10**9, annotation_file="last_active", lookback_events=3)]


def _with_lives(logs):
    """Some sessions start, end and resume."""
    rnd = random.Random(3)
    for events in logs.values():
        for kind in rnd.sample(["session_start", "session_end", "session_resume", "session_end"], rnd.randint(0, 4)):
            at = rnd.randint(0, len(events))
            events.insert(at, {"type": kind, "ts": events[at - 1]["ts"] if events else 5, "filename": None, "changed_tick": None, "note": None})
    return {sid: events for sid, events in logs.items() if events}


def _table(summaries):
    names = sorted(set(summaries.columns) - {"avg_velocity"})
    return sorted(map(str, (tuple(r) for r in summaries.select(*names, F.round("avg_velocity", 9)).collect())))


def _batch(df, agg, exe):
    return join_on(session_analytics(df, agg, exe), session_state(df), ["session_id"], "left")


@pytest.mark.parametrize("agg, chunk", [(RULES[0], 7), (RULES[1], 1 << 20), (RULES[1], 7)])
def test_any_cut_gives_the_same(spark, agg, chunk):
    logs = _with_lives(random_logs(11, n_sessions=25))
    logs[None] = logs.pop(next(iter(logs)))
    df, exe = rows_to_df(spark, logs).cache(), ExecConfig(chunk_rows=chunk)
    want = _table(_batch(df, agg, exe))
    assert len(want) == len(logs)
    parts, lo = no_parts(spark), 0
    for hi in (1, 9, 30, 10**7):
        rows = df.filter((F.col("seq") >= lo) & (F.col("seq") < hi))
        new = extend(parts, rows, agg, exe)
        rest = join_on(parts, rows.select("session_id").distinct(), ["session_id"], "left_anti")
        parts, lo = materialize(rest.unionByName(new), "parts"), hi
    assert _table(summary(parts, agg)) == want


def test_refresh_reads_no_log_but_for_rows_that_do_not_follow(spark, tmp_path):
    logs = _with_lives(random_logs(12, n_sessions=12))
    df, agg, exe = rows_to_df(spark, logs).cache(), RULES[0], ExecConfig()
    stored, out = str(tmp_path / "log"), str(tmp_path / "summaries")
    body = refresh_summaries(stored, out, agg, exe)  # there is no log yet
    first, second = df.filter("seq < 20"), df.filter("seq >= 20")
    body(first, 0)
    assert _table(latest_summaries(spark, out)) == _table(_batch(first, agg, exe))
    body(second.unionByName(first.filter("seq % 3 = 0")), 1)  # some rows are told again
    want = _table(_batch(df, agg, exe))
    assert _table(latest_summaries(spark, out)) == want
    # The rows in between were never told: these sessions are read from the log.
    from sessionlog.sinks.replace import bucket_of
    df.withColumn("bucket", bucket_of()).write.partitionBy("bucket").parquet(stored)
    again = str(tmp_path / "again")
    for epoch, rows in enumerate((df.filter("seq < 5"), df.filter("seq >= 9"), df.filter("seq between 5 and 8"))):
        refresh_summaries(stored, again, agg, exe)(rows, epoch)
    assert _table(latest_summaries(spark, again)) == want
    # Other rules: parts are made anew.
    refresh_summaries(stored, again, RULES[1], exe)(df.filter("seq >= 9"), 3)
    longer = [r.session_id for r in df.groupBy("session_id").count().filter("count > 9").collect()]
    got = latest_summaries(spark, again).filter(F.col("session_id").isin(longer))
    assert _table(got) == _table(_batch(df.filter(F.col("session_id").isin(longer)), RULES[1], exe))
