"""Streaming sinks and refresh, document statistics, small source helpers."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import parse_session_id
from sessionlog.operators.analytics import session_analytics
from sessionlog.operators.stats import session_stats
from sessionlog.sources.documents import flatten_diagnostics, read_sessions
from sessionlog.streaming.pipelines import (
    append_event_log, command_stream, latest_summaries, refresh_summaries, summary_refresh_query,
)
from sessionlog.streaming.processors import denoise_stream
from tests.test_streaming import write_command_log


def test_event_log_sink_and_summary_refresh(spark):
    src = tempfile.mkdtemp(prefix="cmd-")
    write_command_log(src, n_sessions=6, n_files=3, seed=9)
    out = tempfile.mkdtemp(prefix="out-")
    log_path, sum_path = os.path.join(out, "log"), os.path.join(out, "summaries")
    drain = {"availableNow": True}

    def refresh():
        summary_refresh_query(spark, log_path, sum_path, name=f"sum-{os.path.basename(out)}", trigger=drain).awaitTermination()

    os.makedirs(log_path)
    refresh()  # before anything is in the log
    raw, _ = command_stream(spark, src, 1)
    append_event_log(denoise_stream(raw), log_path, name=f"log-{os.path.basename(out)}", trigger=drain).awaitTermination()
    log = spark.read.parquet(log_path)
    assert log.select("session_id").distinct().count() == 6
    refresh()  # sees all that was appended since
    latest = latest_summaries(spark, sum_path)
    assert latest.count() == 6
    want = session_analytics(log, AggregationConfig(), ExecConfig())
    cols = ["session_id", "total_events", "activity_blocks", "idle_gaps", "error_corrections", "flow_blocks"]
    assert latest.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert latest.filter("active").count() == 0  # every generated session ends
    # one session again: the others' rows stay, none is there twice
    refresh_summaries(log_path, sum_path)(log.filter(F.col("session_id") == "1700000000_p"), 9)
    assert latest_summaries(spark, sum_path).count() == 6


def test_late_sessions_lose_nothing(spark):
    """Sessions a day apart, the latest first, one file a batch; a resumed session counts on."""
    src = tempfile.mkdtemp(prefix="late-")
    for k, day in enumerate([3, 2, 1]):
        lines = []
        stamp = lambda s: f"2024-01-{day:02d}T00:00:{s:02d}+00:00"  # noqa: E731,B023
        sid = f"{1700000000 + day}_p"
        lines.append({"id": 1, "command": "start", "args": [sid, "/p", "/s", "json"], "ts": stamp(0)})
        lines += [{"id": 2 + i, "command": "record-edit", "args": [sid, "/s", "a", "1", "1", "1", str(i), "x"], "ts": stamp(1 + i)}
                  for i in range(10)]
        lines.append({"id": 50, "command": "end", "args": [sid, "/s"], "ts": stamp(20)})
        p = os.path.join(src, f"{k}.jsonl")
        with open(p, "w") as f:
            f.write("".join(json.dumps(x) + "\n" for x in lines))
        os.utime(p, (1_700_000_000 + 10 * k,) * 2)
    p = os.path.join(src, "9.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"id": 60, "command": "resume", "args": ["1700000003_p", "/s"], "ts": "2024-01-09T00:00:00+00:00"}) + "\n")
    os.utime(p, (1_700_000_100,) * 2)
    raw, _ = command_stream(spark, src, 1)
    q = denoise_stream(raw).writeStream.format("memory").queryName("late_t").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("late_t").groupBy("session_id").agg(F.count("*").alias("n"), F.max("seq").alias("m")).collect()
    assert sorted((r.session_id, r.n, r.m) for r in got) == [
        ("1700000001_p", 12, 11), ("1700000002_p", 12, 11), ("1700000003_p", 13, 12)]


def test_document_stats_all_sessions(spark):
    d = tempfile.mkdtemp(prefix="docs-")
    doc = {"id": "s1", "project_path": "/p", "save_path": d, "output_format": "sqlite",
           "start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-01T01:30:00Z", "active": False,
           "events": [{"type": "session_start", "timestamp": "2024-01-01T00:00:00Z", "data": {"note": "x"}},
                      {"type": "file_edit", "timestamp": "2024-01-01T00:00:01Z",
                       "data": {"filename": "a", "changed_tick": 3}},
                      {"type": "cursor_move", "timestamp": "2024-01-01T00:00:02Z", "data": {"filename": "a"}}]}
    json.dump(doc, open(os.path.join(d, "s1_raw.json"), "w"))
    json.dump(dict(doc, id="s2", events=[], active=True, end_time="0001-01-01T00:00:00Z"),
              open(os.path.join(d, "s2.json"), "w"))
    open(os.path.join(d, "bad.json"), "w").write("{")
    sessions, events = read_sessions(spark, d)
    st = {r.session_id: r for r in session_stats(events, sessions).collect()}
    assert set(st) == {"s1", "s2"}
    assert st["s1"].status == "Completed" and st["s1"].duration_us == 5_400_000_000
    assert (st["s1"].total_events, st["s1"].file_edits, st["s1"].cursor_moves) == (3, 1, 1)
    assert st["s1"].edit_pct == 50 and st["s1"].nav_pct == 50
    assert st["s2"].status == "Active" and st["s2"].duration_us is None and st["s2"].total_events == 0


def test_parse_session_id_and_diagnostics(spark):
    r = spark.createDataFrame([("1700000000_my_proj",), ("plain",)], "sid string") \
        .select(parse_session_id(F.col("sid")).alias("p")).collect()
    assert (r[0].p.started_at_s, r[0].p.project) == (1700000000, "my_proj")
    assert (r[1].p.started_at_s, r[1].p.project) == (None, None)
    lines = spark.createDataFrame(
        [("s", 4, 1_000_000, "a.lua", 3, 1, [("undefined x", "Error"), ("unused y", "Warning")]),
         ("s", 5, 2_000_000, "a.lua", 4, 0, [])],
        "session_id string, seq long, ts_us long, filename string, line long, column long, "
        "diagnostics array<struct<message:string,severity:string>>").withColumn("ts", F.timestamp_micros("ts_us"))
    out = flatten_diagnostics(lines).orderBy("seq").collect()
    assert [o.seq for o in out] == [0, 1]
    assert [(o.type, o.message, o.level) for o in out] == [("lsp_diagnostic", "undefined x", "Error"),
                                                           ("lsp_diagnostic", "unused y", "Warning")]


def test_option_overlay():
    from sessionlog.config import from_options
    agg, flt, cap = from_options({"aggregation": {"merge_window": 3000, "distraction_files": ["tree"]},
                                  "debounce_interval": 100, "filter_threshold": 400, "max_cursor_events": 50,
                                  "log_events": {"lsp_diagnostics": False}})
    assert agg.merge_window_us == 3_000_000 and agg.distraction_patterns == ("tree",)
    assert agg.idle_threshold_us == 300_000_000
    assert (flt.debounce_us, flt.idle_us) == (100_000, 400_000)
    assert cap.max_cursor_events == 50 and not cap.lsp_diagnostics and cap.terminal_commands


def test_apply_capture_options(spark):
    from sessionlog.config import from_options
    from sessionlog.sources.command_log import apply_capture
    from tests.helpers import S, rows_to_df
    ev = rows_to_df(spark, {"s": [{"type": "cursor_move", "ts": S(i), "filename": "a"} for i in range(5)]
                            + [{"type": "file_edit", "ts": S(9), "filename": ""},
                               {"type": "lsp_diagnostic", "ts": S(10), "filename": "a"},
                               {"type": "terminal_command", "ts": S(11), "command": "ls"}]})
    _, _, cap = from_options({"max_cursor_events": 2, "log_events": {"lsp_diagnostics": False}})
    got = sorted((r.type, r.seq) for r in apply_capture(ev, cap).collect())
    assert got == [("cursor_move", 0), ("cursor_move", 1), ("terminal_command", 7)]


def test_integers_out_of_range_and_update_interval(spark):
    from sessionlog.config import from_options
    from sessionlog.sources.command_log import tolerant_int
    texts = ["7", "-7", "+7", " 7", "x", "", "9" * 30, "-" + "9" * 30, None]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tolerant_int(F.col("t")).alias("n")).collect()]
    assert got == [7, -7, 7, 0, 0, 0, 2**63 - 1, -(2**63), 0]
    assert from_options({"periodic_update_interval": 1500})[2].periodic_update_us == 1_500_000
    assert from_options()[2].periodic_update_us == 300_000_000
