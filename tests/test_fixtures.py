"""Hand-computed micro fixtures (FIXTURES.md section 2)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig, FilterConfig
from sessionlog.functions.scalar import edit_percent, format_duration, nav_percent
from sessionlog.operators.analytics import session_analytics
from sessionlog.operators.blocks import activity_blocks
from sessionlog.operators.corrections import error_corrections
from sessionlog.operators.denoise import cursor_decisions
from sessionlog.operators.focus import file_focus, focus_summary
from sessionlog.operators.gaps import idle_gaps
from sessionlog.operators.timeline import timeline
from sessionlog.sources.command_log import read_command_log
from sessionlog.sources.documents import list_sessions
from tests.helpers import S, rows_to_df

AGG = AggregationConfig()
EXE = [ExecConfig(), ExecConfig(chunk_rows=2)]


def edit(f, t, k=0, **kw):
    return {"type": "file_edit", "ts": S(t), "filename": f, "changed_tick": k, **kw}


def ev(typ, t, **kw):
    return {"type": typ, "ts": S(t), **kw}


def blocks_of(spark, evs, exe):
    df = rows_to_df(spark, {"s": evs})
    return [r.asDict() for r in activity_blocks(df, AGG, exe).orderBy("block_no").collect()]


@pytest.mark.parametrize("exe", EXE, ids=["big", "chunk2"])
def test_m1_gap_of_exactly_two_seconds_merges(spark, exe):
    b = blocks_of(spark, [edit("A", 0, 1), edit("A", 1, 5), edit("A", 3, 9), edit("A", 5.5, 10)], exe)
    assert [(x["event_count"], x["delta_tick"], x["closed_by"]) for x in b] == [(3, 8, "timeout"), (1, 0, "session_end")]
    assert b[0]["velocity"] == pytest.approx(8 / 3) and b[1]["velocity"] == 0.0
    assert b[0]["start_us"] == 0 and b[0]["end_us"] == S(3) and b[1]["start_us"] == S(5.5)


@pytest.mark.parametrize("exe", EXE, ids=["big", "chunk2"])
def test_m2_any_event_clock(spark, exe):
    b = blocks_of(spark, [edit("A", 0), ev("cursor_move", 1.9, filename="A"), edit("A", 3.8)], exe)
    assert [x["event_count"] for x in b] == [2]


@pytest.mark.parametrize("exe", EXE, ids=["big", "chunk2"])
def test_m3_terminal_closes(spark, exe):
    b = blocks_of(spark, [edit("A", 0), ev("terminal_command", 1, command="ls"), edit("A", 1.5)], exe)
    assert [(x["event_count"], x["closed_by"]) for x in b] == [(1, "context_switch"), (1, "session_end")]


def test_m4_file_change_beats_timeout(spark):
    b = blocks_of(spark, [edit("A", 0), edit("B", 100)], EXE[0])
    assert b[0]["closed_by"] == "context_switch"


def test_m5_same_file_open_closes(spark):
    b = blocks_of(spark, [edit("A", 0), ev("file_open", 1, filename="A")], EXE[0])
    assert [(x["event_count"], x["closed_by"]) for x in b] == [(1, "context_switch")]


def test_m6_no_blocks_defaults(spark):
    df = rows_to_df(spark, {"s": [ev("session_start", 0, note="x"), ev("annotation", 1, note="hello")]})
    r = session_analytics(df, AGG, EXE[0]).collect()[0]
    assert (r.activity_blocks, r.avg_velocity, r.peak_velocity, r.focus_ratio, r.flow_blocks, r.idle_gaps,
            r.error_corrections) == (0, 0.0, 0.0, 0.0, 0, 0, 0)


def test_m7_idle_strictly_longer(spark):
    df = rows_to_df(spark, {"s": [ev("session_start", 0), ev("annotation", 300, note="a"),
                                  {"type": "annotation", "ts": S(600) + 1, "note": "b"}]})
    g = idle_gaps(df, AGG, EXE[0]).collect()
    assert [(r.start_us, r.end_us) for r in g] == [(S(300), S(600) + 1)]


def test_m8_sub_second_intervals_truncate(spark):
    df = rows_to_df(spark, {"s": [ev("file_open", 0, filename="A"), ev("cursor_move", 0.9, filename="A"),
                                  ev("cursor_move", 1.8, filename="A")]})
    f = file_focus(df, AGG, EXE[0]).collect()
    assert [(r.filename, r.seconds) for r in f] == [("A", 0)]
    assert focus_summary(file_focus(df, AGG, EXE[0])).collect()[0].focus_ratio == 0.0


def test_m9_forward_fill_and_ratio(spark):
    df = rows_to_df(spark, {"s": [ev("session_start", 0), ev("file_open", 10, filename="A"),
                                  ev("terminal_command", 15, command="x"), ev("cursor_move", 20, filename="NvimTree_1"),
                                  ev("session_end", 25)]})
    f = {r.filename: (r.seconds, r.distraction) for r in file_focus(df, AGG, EXE[0]).collect()}
    assert f == {"A": (10, False), "NvimTree_1": (5, True)}
    assert focus_summary(file_focus(df, AGG, EXE[0])).collect()[0].focus_ratio == pytest.approx(2 / 3)


def _corr(spark, evs, exe=EXE[0]):
    return [r.asDict() for r in error_corrections(rows_to_df(spark, {"s": evs}), AGG, exe).collect()]


def test_m10_corrections(spark):
    c = _corr(spark, [edit("A", 0, 3), edit("A", 1, 7), edit("A", 2, 9), ev("annotation", 3, filename="A", note="Fix bug")])
    assert [(x["blocks_affected"], x["ticks_reversed"], x["lines_deleted"]) for x in c] == [(3, 6, 0)]


def test_m11_annotation_without_file(spark):
    assert _corr(spark, [edit("A", 0, 3), edit("A", 1, 7), edit("A", 2, 9), ev("annotation", 3, note="Fix bug")]) == []


def test_m12_stop_at_old_event(spark):
    c = _corr(spark, [edit("A", 0, 1), edit("A", 400, 2), ev("annotation", 500, filename="A", note="debug")])
    assert [x["blocks_affected"] for x in c] == [1]


def test_m13_first_event_excluded(spark):
    assert _corr(spark, [ev("annotation", 0, filename="A", note="prefix"), edit("A", 1, 1)]) == []


def test_m14_timeline_grouping(spark):
    df = rows_to_df(spark, {"s": [edit("A", 0, 1, line=1, column=2, line_text="a"),
                                  edit("A", 1, 2, line=9, column=0), ev("cursor_move", 1.5, filename="A"),
                                  edit("A", 2, 3, line=12, column=4, line_text="c"), ev("annotation", 3, note="n")]})
    t = [r.asDict() for r in timeline(df, AGG, EXE[0]).orderBy("entry_no").collect()]
    assert len(t) == 2
    assert (t[0]["location_code"], t[0]["details_code"]) == ("L1:C2", "1 edit")
    assert (t[0]["location_intent"], t[0]["details_intent"], t[0]["edit_count"]) == ("L12:C4", "3 edits", 3)
    assert (t[0]["snippet_code"], t[0]["snippet_intent"]) == ("a", "c")


def _decisions(spark, evs, cfg=FilterConfig()):
    df = rows_to_df(spark, {"s": evs})
    return {r.seq: r.reason for r in cursor_decisions(df, cfg, ExecConfig(chunk_rows=2)).filter("kept").collect()}


def test_m15_to_m18_cursor_filter(spark):
    c = lambda t: ev("cursor_move", t, filename="A")
    assert _decisions(spark, [c(0), c(0.1), c(0.15), edit("A", 0.4)]) == {2: "trigger"}
    assert _decisions(spark, [c(0), c(0.1), c(0.15), edit("A", 0.7)]) == {2: "idle"}
    assert _decisions(spark, [c(0), c(0.1), c(0.15), edit("A", 0.7)], FilterConfig(idle_commit="drop")) == {}
    assert _decisions(spark, [c(0), c(0.3), c(0.6), ev("session_end", 5)]) == {2: "idle"}
    assert _decisions(spark, [edit("A", 0), c(0.1), ev("session_end", 5)]) == {1: "end"}


def test_m19_edit_nav_truncation(spark):
    r = spark.range(1).select(edit_percent(F.lit(29), F.lit(71)).alias("e"), nav_percent(F.lit(29), F.lit(71)).alias("n"),
                              edit_percent(F.lit(0), F.lit(0)).alias("z")).collect()[0]
    assert (r.e, r.n, r.z) == (28, 72, 0)


def test_m20_catalogue(spark):
    d = tempfile.mkdtemp(prefix="cat-")
    for n in ["a_raw.json", "a.json", "b.json", "b_export.json", "c_export.json"]:
        with open(os.path.join(d, n), "w") as fh:
            json.dump({"id": n}, fh)
    rows = list_sessions(spark, d).orderBy("session_id").collect()
    assert [(r.session_id, r.file_name) for r in rows] == [("a", "a_raw.json"), ("b", "b.json")]


def test_m21_durations(spark):
    vals = [2_500_000, 59_600_000, 61_000_000, 3_725_000_000]
    df = spark.createDataFrame([(v,) for v in vals], "us bigint")
    assert [r.d for r in df.select(format_duration(F.col("us")).alias("d")).collect()] == ["2s", "60s", "1m 1s", "1h 2m"]


def test_m22_command_log(spark):
    lines = [json.dumps({"id": 1, "command": "record-edit", "args": ["s", "/p", "a", "1", "2", "3", "4"]}),
             json.dumps({"id": 2, "command": "foo", "args": []}),
             json.dumps({"id": 3, "command": "record-cursor", "args": ["s", "/p", "a", "x", "5"],
                         "ts": "2024-01-01T00:00:00Z"})]
    ev_, _, rej = read_command_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.error for r in rej.collect()) == ["record-edit requires 8 args", "unknown command: foo"]
    r = ev_.collect()
    assert len(r) == 1 and r[0].type == "cursor_move" and r[0].line is None and r[0].column == 5


def test_m23_order_by_seq_not_ts(spark):
    df = rows_to_df(spark, {"s": [ev("file_open", 10, filename="A"), ev("cursor_move", 4, filename="A"),
                                  edit("A", 11)]})
    from sessionlog.operators.scan import scan
    gaps = [r.gap_us for r in scan(df, AGG, EXE[1]).orderBy("seq").collect()]
    assert gaps == [None, -S(6), S(7)]


def test_commands_for_unknown_sessions_are_rejected(spark):
    lines = [json.dumps({"id": 1, "command": "start", "args": ["a", "/p", "/s", "json"], "ts": "2024-01-01T00:00:00Z"}),
             json.dumps({"id": 2, "command": "annotate", "args": ["a", "/s", "hi"], "ts": "2024-01-01T00:00:01Z"}),
             json.dumps({"id": 3, "command": "annotate", "args": ["b", "/s", "hi"], "ts": "2024-01-01T00:00:02Z"}),
             json.dumps({"id": 4, "command": "annotate", "args": ["c", "/s", "hi"], "ts": "2024-01-01T00:00:03Z"})]
    known = spark.createDataFrame([("b",)], "session_id string")
    ev_, meta, rej = read_command_log(spark.createDataFrame([(x,) for x in lines], "value string"),
                                      known_sessions=known)
    assert sorted((r.session_id, r.type) for r in ev_.collect()) == [("a", "annotation"), ("a", "session_start"),
                                                                      ("b", "annotation")]
    assert [r.error for r in rej.collect()] == ["session not found: c"]
    assert [(r.session_id, r.output_format) for r in meta.collect()] == [("a", "json")]


def test_intent_options_for_corrections(spark):
    from dataclasses import replace
    evs = [edit("A", 0, 9), edit("A", 1, 7), edit("A", 2, 3), ev("annotation", 3, note="Fix bug")]
    df = rows_to_df(spark, {"s": evs})
    # recorder code: the annotation has no file, so nothing matches (M11)
    assert error_corrections(df, AGG, EXE[0]).count() == 0
    # documented intent: the last active file (A) is the annotation's file
    la = replace(AGG, annotation_file="last_active")
    r = error_corrections(df, la, EXE[1]).collect()
    assert [(x.blocks_affected, x.ticks_reversed) for x in r] == [(3, 0)]   # ticks fall: no forward progress
    tr = replace(la, true_reversals=True)
    r = error_corrections(df, tr, EXE[0]).collect()
    assert [(x.blocks_affected, x.ticks_reversed) for x in r] == [(3, 6)]   # 9 -> 7 -> 3 reverses 6 ticks


def test_session_state_with_resume(spark):
    from sessionlog.operators.stats import session_state
    df = rows_to_df(spark, {
        "r": [ev("session_start", 10, note="s"), ev("file_edit", 11, filename="a"), ev("session_end", 20, note="e"),
              ev("session_resume", 50, note="r"), ev("file_edit", 51, filename="a")],
        "e": [ev("session_start", 5), ev("session_end", 9)],
        "n": [ev("file_edit", 3, filename="a"), ev("file_edit", 4, filename="a")],
    })
    st = {r.session_id: (r.start_us, r.end_us, r.active) for r in session_state(df).collect()}
    assert st["r"] == (S(10), S(20), True)     # resumed: active, keeps the earlier end time
    assert st["e"] == (S(5), S(9), False)
    assert st["n"] == (S(3), S(4), False)      # no lifecycle events: a finished span of its events
