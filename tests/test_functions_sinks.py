"""Scalar formats, store upsert, exports and report writing."""

import glob
import json
import os
import tempfile

from pyspark.sql import functions as F

from sessionlog.functions.scalar import (
    base_name, go_duration, location, snippet, title_case, type_icon, type_title,
)
from sessionlog.sinks.reports import render, summary_report, timeline_report, write_report
from sessionlog.sinks.store import read_store, store_events, store_sessions, upsert, write_store
from sessionlog.sinks.writers import export_json, route_by_format
from sessionlog.sources.adapter import load_driver_events
from sessionlog.operators.stats import session_state
from tests.helpers import S, rows_to_df


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


def test_text_helpers(spark):
    assert one(spark, title_case(F.lit("file_edit"))) == "File Edit"
    assert one(spark, title_case(F.lit("lsp_DIAG"))) == "Lsp DIAG"
    assert one(spark, type_title(F.lit("custom_kind"))) == "Custom Kind"
    assert one(spark, type_icon(F.lit("custom_kind"))) == "•"
    assert one(spark, base_name(F.lit("/a/b/c.lua"))) == "c.lua"
    assert one(spark, base_name(F.lit(""))) == "."
    assert one(spark, base_name(F.lit("dir/"))) == "dir"
    assert one(spark, location(F.lit("a.lua"), F.lit(3))) == "a.lua:3"
    assert one(spark, location(F.lit("a.lua"), F.lit(0))) == "a.lua"
    assert one(spark, snippet(F.lit("  x  "))) == "x"
    long = "é" * 100  # 200 bytes: cut to whole characters within 117 bytes
    assert one(spark, snippet(F.lit(long))) == "é" * 58 + "..."
    assert one(spark, go_duration(F.lit(5_400_000_000))) == "1h30m0s"
    assert one(spark, go_duration(F.lit(1_500_000))) == "1.5s"
    assert one(spark, go_duration(F.lit(250_000))) == "250ms"
    assert one(spark, go_duration(F.lit(0))) == "0s"


def test_store_upsert_replaces_whole_session(spark):
    old = rows_to_df(spark, {"a": [{"type": "file_edit", "ts": S(1), "filename": "x", "line": 0}],
                             "b": [{"type": "annotation", "ts": S(2), "note": ""}]})
    new = rows_to_df(spark, {"a": [{"type": "terminal_command", "ts": S(5), "command": "ls"},
                                   {"type": "file_open", "ts": S(6), "filename": "y"}]})
    ss = lambda ev: store_sessions(session_state(ev).withColumn("project_path", F.lit("/p"))
                                   .withColumn("save_path", F.lit("/s")).withColumn("output_format", F.lit("sqlite")))
    s, e = upsert(ss(old), store_events(old), ss(new), store_events(new))
    rows = sorted((r.session_id, r.type) for r in e.collect())
    assert rows == [("a", "file_open"), ("a", "terminal_command"), ("b", "annotation")]
    assert s.count() == 2
    b = e.filter("session_id = 'b'").collect()[0]
    assert b.note is None                      # "" is stored as NULL
    a_old = store_events(old).filter("session_id = 'a'").collect()[0]
    assert a_old.line is None and "line_text" not in store_events(old).columns
    d = tempfile.mkdtemp(prefix="store-")
    write_store(s, e, d)
    s2, e2 = read_store(spark, d)
    assert e2.count() == 3 and s2.count() == 2
    assert e2.filter(F.col("session_id") == "a").count() == 2


def test_exports_and_reports_write(spark):
    ev = load_driver_events(spark, "/root/testdata/sf0.001")
    sessions = session_state(ev).select("session_id", F.lit("/p").alias("project_path"), F.lit("/s").alias("save_path"),
                                        F.lit("json").alias("output_format"), "start_us", "end_us", "active")
    assert route_by_format(sessions)["json"].count() == sessions.count()
    d = tempfile.mkdtemp(prefix="export-")
    export_json(ev, sessions, d)
    sid = ev.select("session_id").first()[0]
    assert not glob.glob(os.path.join(d, "events", "session_id=*"))
    found = {}
    for bucket in glob.glob(os.path.join(d, "events", "bucket=*")):
        for p in sorted(glob.glob(os.path.join(bucket, "part-*"))):
            for ln in open(p):
                e = json.loads(ln)
                found.setdefault(e["session_id"], []).append(e["seq"])
    # every session whole and in order over the part files
    n = {r.session_id: r["count"] for r in ev.groupBy("session_id").count().collect()}
    assert found == {k: list(range(v)) for k, v in n.items()}
    rep = summary_report(ev)
    text = render(rep, sid)
    assert text.startswith("# Session Summary Report") and "## Activity Timeline" in text
    tl = timeline_report(ev)
    write_report(tl, os.path.join(d, "md"))
    assert render(spark.read.parquet(os.path.join(d, "md")), sid) == render(tl, sid)


def test_export_all_routes_each_format(spark):
    from sessionlog.sinks.writers import export_all
    ev = rows_to_df(spark, {
        "j": [{"type": "file_edit", "ts": S(1), "filename": "a", "changed_tick": 1}],
        "q": [{"type": "annotation", "ts": S(2), "note": "x"}],
        "m": [{"type": "file_edit", "ts": S(3), "filename": "b", "changed_tick": 2},
              {"type": "file_edit", "ts": S(4), "filename": "b", "changed_tick": 5}],
    })
    fmt = {"j": "json", "q": "sqlite", "m": "markdown"}
    sessions = session_state(ev).select(
        "session_id", F.lit("/p").alias("project_path"), F.lit("/s").alias("save_path"),
        F.element_at(F.create_map(*[x for k, v in fmt.items() for x in (F.lit(k), F.lit(v))]), F.col("session_id"))
        .alias("output_format"), "start_us", "end_us", "active")
    d = tempfile.mkdtemp(prefix="routes-")
    export_all(sessions, ev, d, report_lines=timeline_report(ev, sessions, flavour="intent"))
    stored = lambda: {r.id for r in spark.read.json(os.path.join(d, "json", "sessions")).collect()}
    ids = lambda df: {r.session_id for r in df.select("session_id").distinct().collect()}
    assert stored() == {"j"}
    s2, e2 = read_store(spark, os.path.join(d, "store"))
    assert ids(s2) == {"q"} and e2.count() == 1
    md = spark.read.parquet(os.path.join(d, "markdown"))
    assert ids(md) == {"m"}
    assert "- 2 edits" in render(md, "m")   # intent flavour: the real count of grouped edits

    # a second export keeps the first; a session exported again is replaced whole
    more = rows_to_df(spark, {
        "j2": [{"type": "file_edit", "ts": S(1), "filename": "a", "changed_tick": 1}],
        "q": [{"type": "annotation", "ts": S(2), "note": "y"}, {"type": "annotation", "ts": S(3), "note": "z"}],
        "m2": [{"type": "file_edit", "ts": S(3), "filename": "b", "changed_tick": 2}],
    })
    fmt = {"j2": "json", "q": "sqlite", "m2": "other"}
    sessions2 = session_state(more).select(
        "session_id", F.lit("/p").alias("project_path"), F.lit("/s").alias("save_path"),
        F.element_at(F.create_map(*[x for k, v in fmt.items() for x in (F.lit(k), F.lit(v))]), F.col("session_id"))
        .alias("output_format"), "start_us", "end_us", "active")
    for _ in range(2):
        export_all(sessions2, more, d)
    assert stored() == {"j", "j2"}
    s2, e2 = read_store(spark, os.path.join(d, "store"))
    assert ids(s2) == {"q"} and sorted(r.note for r in e2.collect()) == ["y", "z"]
    assert ids(spark.read.parquet(os.path.join(d, "markdown"))) == {"m", "m2"}


def test_replacing_with_nothing_empties_the_session(spark):
    from sessionlog.sinks.replace import replace_sessions
    path = os.path.join(tempfile.mkdtemp(prefix="replace-"), "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "session_id string, x int")
    replace_sessions(rows, rows, path)
    replace_sessions(rows.filter("false"), rows.filter("session_id = 'b'"), path)
    assert [(r.session_id, r.x) for r in spark.read.parquet(path).collect()] == [("a", 1)]


def test_lookup_type_filter_and_report_grep(spark):
    from sessionlog.operators.search import filter_types, search_lines
    from sessionlog.sinks.store import session_lookup
    ev = rows_to_df(spark, {
        "a": [{"type": "file_edit", "ts": S(1), "filename": "x", "changed_tick": 1},
              {"type": "annotation", "ts": S(2), "note": "Note: fix later"}],
        "b": [{"type": "cursor_move", "ts": S(1), "filename": "y"}],
    })
    assert [r.type for r in session_lookup(ev, "b").collect()] == ["cursor_move"]
    assert sorted(r.type for r in filter_types(ev, keep=["file_edit", "cursor_move"]).collect()) == \
        ["cursor_move", "file_edit"]
    assert [r.type for r in filter_types(ev, drop=["file_edit", "cursor_move"]).collect()] == ["annotation"]
    lines = timeline_report(ev)
    assert {h.session_id for h in search_lines(lines, "Notes").collect()} == {"a", "b"}  # stats row of each report
    hits = search_lines(lines, "fix later").collect()
    assert [(h.session_id, h.line) for h in hits] == [("a", "- Note: fix later")]


def test_report_texts_are_pinned(spark):
    """Both reports of a small session, as whole texts written down beside this test."""
    t = 1_704_067_200
    a = "/p/src/a.lua"
    ev = rows_to_df(spark, {"1704067200_demo": [
        {"type": "session_start", "ts": S(t), "note": "Started"},
        {"type": "file_edit", "ts": S(t + 1), "filename": a, "line": 3, "column": 1, "changed_tick": 5, "line_text": "x = 1"},
        {"type": "file_edit", "ts": S(t + 2), "filename": a, "line": 4, "column": 1, "changed_tick": 65, "line_text": "y = 2"},
        {"type": "terminal_command", "ts": S(t + 5), "command": "make"},
        {"type": "cursor_move", "ts": S(t + 6), "filename": "NvimTree_1", "line": 1, "column": 0},
        {"type": "annotation", "ts": S(t + 400), "note": "Fix bug", "filename": a},
        {"type": "session_end", "ts": S(t + 401), "note": "Ended"}]})
    here = os.path.join(os.path.dirname(__file__), "fixtures")
    for name, report in (("summary_report", summary_report(ev)), ("timeline_report", timeline_report(ev))):
        with open(os.path.join(here, f"{name}.md"), encoding="utf-8") as f:
            assert render(report, "1704067200_demo") == f.read(), name


def test_summary_report_plan_stays_small(spark):
    """The report reads what its sections share once."""
    ev = load_driver_events(spark, "/root/testdata/sf0.001")
    plan = summary_report(ev)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 12 and plan.count("Exchange ") <= 18, (plan.count("FileScan parquet"), plan.count("Exchange "))
