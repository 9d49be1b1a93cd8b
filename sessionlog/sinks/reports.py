"""Markdown reports as ordered line tables.

A report is never assembled into one string per session: every section yields
rows ``(session_id, sec, ord, sub, line)`` from the DataFrame it describes
(session totals, blocks, files, gaps, corrections, timeline entries) and the
writer range-partitions by ``(session_id, sec, ord, sub)``, so a long session's
report is spread over several ordered part files (read them in name order).

Numbers follow the recorder's formats: ``%.2f``/``%.1f`` with half-even
rounding (``bround``), durations through :func:`format_duration`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import (
    base_name, clock, day, format_duration, format_duration_or_progress, go_duration, title_case, us_to_ts,
    velocity_badge,
)
from sessionlog.operators.analytics import session_analytics
from sessionlog.operators.blocks import activity_blocks, flow_blocks
from sessionlog.operators.corrections import error_corrections
from sessionlog.operators.focus import file_focus
from sessionlog.operators.gaps import idle_gaps
from sessionlog.operators.scan import SCAN_INPUT, scan
from sessionlog.operators.sequence import join_on
from sessionlog.operators.stats import event_counts, session_state, session_stats
from sessionlog.operators.timeline import timeline
from sessionlog.operators.topk import top_files, with_ordinal
from sessionlog.spark import materialize

LINE_COLUMNS = ["session_id", "sec", "ord", "sub", "line"]

# ---------------------------------------------------------------------------
# The report texts, section by section in report order.
# ``{name}`` is filled from a column; a ``(condition, text)`` pair is a line
# printed only when the named condition holds.
# ---------------------------------------------------------------------------
TIMELINE_HEAD = [
    "# Session Report: {session_id}", "",
    "> **Project:** `{project}`",
    "> **Date:** `{date}`",
    "> **Duration:** `{duration}` | **Start:** `{start}`", "",
    "---", "",
    "## 📊 Quick Stats",
    "| Metric | Value |",
    "| :--- | :--- |",
    "| 🛠 Edits | {edits} |",
    "| 🎯 Navigation | {navs} |",
    "| 💻 Terminal | {terminal} |",
    "| 📝 Notes | {notes} |",
    "| ⚠️ LSP | {lsp} |", "",
    "### Focus Snapshot",
    "| Work vs Nav | % |",
    "| :--- | ---: |",
    "| Editing Time | {edit_pct}% |",
    "| Navigation Time | {nav_pct}% |", "",
    "---", "",
    "## 🕒 Timeline", "",
]
TIMELINE_ENTRY = [
    "### {time} {icon} {title}",
    ("has_where", "{where}"),
    ("has_snippet", "```\n{snippet}\n```"),
    ("has_details", "- {details}"),
    "",
]
TIMELINE_TAIL = [
    "---", "",
    "## 📝 Final Summary",
    "- **Total Events:** {total}",
    "- **Sessions Blocks:** {entries}", "",
    "---",
    "*Generated by sessionlog*",
]
SUMMARY_HEAD = [
    "# Session Summary Report", "",
    "**Session ID:** `{session_id}`",
    "**Project:** `{project}`",
    "**Started:** {started}",
    ("ended", "**Ended:** {ended_at}"),
    ("ended", "**Duration:** {duration}"),
    ("active", "**Status:** Active"), "",
    "---", "",
    "## Executive Summary", "",
    "- **Total Events:** {total}",
    "- **Activity Blocks:** {blocks}",
    "- **Average Velocity:** {avg_velocity} ticks/sec",
    "- **Peak Velocity:** {peak_velocity} ticks/sec",
    "- **Focus Ratio:** {focus_pct}%",
    "- **Flow State Blocks:** {flow}",
    "- **Idle Gaps:** {gaps} (Total: {idle_total})",
    "- **Error Corrections:** {corrections}", "",
    "## Velocity Analysis", "",
    "**What is Velocity?** Delta Tick / Duration. High velocity (>{flow_threshold} ticks/sec) indicates "
    "\"Flow State\" - you're coding fast and efficiently.", "",
    ("has_flow", "### Flow State Blocks ({flow})"),
    ("has_flow", ""),
    ("has_flow", "These are your most productive moments:"),
    ("has_flow", ""),
    ("no_flow", "*No flow state blocks detected. Try to minimize interruptions for deeper focus.*"),
    ("no_flow", ""),
]
SUMMARY_FLOW_BLOCK = [
    "{i}. **{time}** - `{file}`",
    "   - Velocity: **{velocity} ticks/sec** 🔥",
    "   - Duration: {duration}",
    "   - Changes: {delta} ticks across {events} events",
    "",
]
SUMMARY_FOCUS_HEAD = [
    "## Focus Ratio", "",
    "**Overall Focus:** {focus_pct}% of time spent on main code files", "",
    ("has_files", "### Time Spent by File"),
    ("has_files", ""),
]
SUMMARY_FILE = ["- `{file}`: {duration} ({pct}%)"]
SUMMARY_FOCUS_TAIL = [
    ("has_files", ""),
    ("distracted", "**Distraction Time:** {distraction} in file browsers/tools"),
    ("distracted", ""),
]
SUMMARY_CORRECTIONS_HEAD = [
    "## Error Correction Patterns", "",
    "Detected moments where you fixed errors after making mistakes:", "",
]
SUMMARY_CORRECTION = [
    "### {i}. {time} - `{file}`", "",
    "**Annotation:** \"{note}\"", "",
    "- Blocks affected: {blocks}",
    ("reversed", "- Changes reversed: {ticks} ticks"),
    ("deleted", "- Lines deleted: ~{lines}"),
    "",
]
SUMMARY_IDLE_HEAD = [
    "## Idle Periods", "",
    "Gaps > {idle_threshold} where you might have been stuck or took a break:", "",
]
SUMMARY_IDLE_GAP = ["{i}. **{time}** - {duration} idle"]
SUMMARY_IDLE_TAIL = [""]
SUMMARY_BLOCKS_HEAD = [
    "## Activity Timeline", "",
    "Aggregated blocks of continuous work (events < {merge_window} seconds apart):", "",
]
SUMMARY_BLOCK = [
    "### {time} - `{file}`", "",
    "- **Duration:** {duration}",
    "- **Events:** {events} edits",
    "- **Changes:** {start_tick} → {end_tick} ticks (Δ{delta})",
    ("moving", "- **Velocity:** {velocity} ticks/sec{badge}"),
    "- **Closed by:** {closed_by}",
    "",
]
SUMMARY_MORE_BLOCKS = ["", "*...and {more} more blocks (see raw JSON for full details)*"]
SUMMARY_COUNTS_HEAD = ["---", "", "## Raw Event Statistics", ""]
SUMMARY_COUNT = ["- **{type}:** {n}"]
SUMMARY_FOOT = [
    "", "---", "",
    "*Generated by sessionlog with smart aggregation*",
    "*Raw event data available in `{session_id}_raw.json`*",
]
STATS_SESSION = [
    "",
    "{session_id}:",
    "  Status: {status}",
    ("completed", "  Duration: {duration}"),
    "  Total Events: {total}",
    "  File Edits: {edits}",
    "  Cursor Moves: {navs}",
    "  Terminal Commands: {terminal}",
    "  Annotations: {notes}",
]
# ---------------------------------------------------------------------------

_FIELD = re.compile(r"\{(\w+)\}")


def _fill(text: str, vals: dict[str, Column]) -> Column:
    """A template line as a Column: literal pieces and ``{name}`` fields."""
    parts, pos = [], 0
    for m in _FIELD.finditer(text):
        if m.start() > pos:
            parts.append(F.lit(text[pos:m.start()]))
        parts.append(vals[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(text):
        parts.append(F.lit(text[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def _printed(template: list, vals: dict[str, Column], conds: dict[str, Column]) -> Column:
    """The template's printed lines as an array."""
    cols = [F.when(conds[item[0]], _fill(item[1], vals)) if isinstance(item, tuple) else _fill(item, vals)
            for item in template]
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


def _first(template: list) -> list:
    """The template's lines, printed under the condition ``first``."""
    return [("first", line) for line in template]


def _sections(df: DataFrame, sections: list[tuple]) -> DataFrame:
    """Rows of ``df`` -> the lines of several sections ``(sec, ord, template, vals, conds)``, in one pass."""
    made = F.array(*[F.struct(F.lit(sec).alias("sec"), ordinal.cast("bigint").alias("ord"),
                              _printed(template, vals, conds).alias("lines"))
                     for sec, ordinal, template, vals, conds in sections])
    each = df.select("session_id", F.explode(made).alias("s"))
    return each.select("session_id", "s.sec", "s.ord", F.posexplode("s.lines").alias("sub", "line")).select(*LINE_COLUMNS)


def _lines(df: DataFrame, sec: int, ord_col: Column, template: list, vals: dict[str, Column] | None = None,
           conds: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``df`` -> one output row per printed template line, in order."""
    return _sections(df, [(sec, ord_col, template, vals or {}, conds or {})])


def _f2(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x, 2))


def _f1(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x, 1))


def _dt(us: Column) -> Column:
    return F.date_format(us_to_ts(us), "yyyy-MM-dd HH:mm:ss")


def _c(name: str) -> Column:
    return F.col(name)


def timeline_report(events: DataFrame, sessions: DataFrame | None = None, agg: AggregationConfig = AggregationConfig(),
                    exe: ExecConfig = ExecConfig(), flavour: str = "code") -> DataFrame:
    """Per-session timeline report (quick stats, edit/navigation share, grouped
    timeline, totals).  ``flavour="code"`` prints grouped edits the way the
    recorder does (first edit, ``1 edit``); ``"intent"`` prints last values and counts."""
    st = session_stats(events, sessions)
    times = sessions if sessions is not None else session_state(events)
    spine = join_on(st, times.select("session_id", "start_us", "end_us"), ["session_id"], "left")
    tl = materialize(timeline(events, agg, exe), "report-timeline")  # read for entries and their number
    n_entries = tl.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"))
    spine = join_on(spine, n_entries, ["session_id"], "left")
    head = (0, F.lit(0), TIMELINE_HEAD, {
        "session_id": F.coalesce("session_id", F.lit("")), "project": F.coalesce("project_path", F.lit("")),
        "date": day(_c("start_us")), "duration": format_duration_or_progress(_c("start_us"), _c("end_us")),
        "start": clock(_c("start_us")), "edits": _c("file_edits"), "navs": _c("cursor_moves"),
        "terminal": _c("terminal_commands"), "notes": _c("annotations"), "lsp": _c("lsp_diagnostics"),
        "edit_pct": _c("edit_pct"), "nav_pct": _c("nav_pct"),
    }, {})
    k = "code" if flavour == "code" else "intent"
    file, loc, snip, det = _c("file"), _c(f"location_{k}"), _c(f"snippet_{k}"), _c(f"details_{k}")
    where = F.concat(F.when(file != "", F.concat(F.lit("`"), file, F.lit("`"))).otherwise(F.lit("")),
                     F.when(loc != "", F.concat(F.lit(" • "), loc)).otherwise(F.lit("")))
    body = _lines(tl, 1, _c("entry_no"), TIMELINE_ENTRY,
                  {"time": _c(f"time_{k}"), "icon": _c("icon"), "title": _c("title"), "where": where,
                   "snippet": snip, "details": det},
                  {"has_where": where != "", "has_snippet": snip != "", "has_details": det != ""})
    tail = (2, F.lit(0), TIMELINE_TAIL, {"total": _c("total_events"), "entries": F.coalesce(_c("entries"), F.lit(0))}, {})
    return _sections(spine, [head, tail]).unionByName(body)


def summary_report(events: DataFrame, sessions: DataFrame | None = None, agg: AggregationConfig = AggregationConfig(),
                   exe: ExecConfig = ExecConfig()) -> DataFrame:
    """Per-session analytics report: header, executive summary, velocity and flow
    blocks, focus and top files, error corrections, idle periods, the first
    ``agg.report_blocks`` activity blocks (+ how many more) and event counts."""
    s = scan(events.select(*SCAN_INPUT), agg, exe, materialize=True)  # read by several sections
    # what several sections read is written once: blocks, focus, corrections, the header row
    blocks = materialize(activity_blocks(events, agg, exe, scanned=s), "report-blocks")
    foc = materialize(file_focus(events, agg, exe, scanned=s), "report-focus")
    corr = materialize(error_corrections(events, agg, exe), "report-corrections")
    an = session_analytics(events, agg, exe, scanned=s, blocks=blocks, focus=foc, corrections=corr)
    meta = (sessions if sessions is not None
            else session_state(events).withColumn("project_path", F.lit(None).cast("string")))
    hdr = join_on(an, meta.select("session_id", "project_path", "start_us", "end_us"), ["session_id"], "left")
    n_main = foc.filter(~_c("distraction")).groupBy("session_id").agg(F.count(F.lit(1)).alias("k"))
    hdr = materialize(join_on(hdr, n_main, ["session_id"], "left"), "report-header")
    ended = _c("end_us").isNotNull()
    head = (0, F.lit(0), SUMMARY_HEAD, {
        "session_id": F.coalesce("session_id", F.lit("")), "project": F.coalesce("project_path", F.lit("")),
        "started": _dt(_c("start_us")), "ended_at": _dt(_c("end_us")),
        "duration": format_duration(_c("end_us") - _c("start_us")), "total": _c("total_events"),
        "blocks": _c("activity_blocks"), "avg_velocity": _f2(_c("avg_velocity")),
        "peak_velocity": _f2(_c("peak_velocity")), "focus_pct": _f1(_c("focus_ratio") * 100),
        "flow": _c("flow_blocks"), "gaps": _c("idle_gaps"), "idle_total": format_duration(_c("idle_total_us")),
        "corrections": _c("error_corrections"), "flow_threshold": F.lit(f"{agg.flow_velocity:g}"),
    }, {"ended": ended, "active": ~ended, "has_flow": _c("flow_blocks") > 0, "no_flow": _c("flow_blocks") == 0})

    fb = with_ordinal(flow_blocks(blocks, agg), "block_no", exe)
    flow = _lines(fb, 1, _c("ordinal"), SUMMARY_FLOW_BLOCK, {
        "i": _c("ordinal"), "time": clock(_c("start_us")), "file": base_name(_c("filename")),
        "velocity": _f2(_c("velocity")), "duration": format_duration(_c("duration_us")),
        "delta": _c("delta_tick"), "events": _c("event_count"),
    })

    tops = top_files(foc, agg, exe, summary=hdr)
    focus_conds = {"has_files": F.coalesce(_c("k"), F.lit(0)) > 0, "distracted": _c("distraction_seconds") > 0}
    focus_head = (2, F.lit(0), SUMMARY_FOCUS_HEAD, {"focus_pct": _f1(_c("focus_ratio") * 100)}, focus_conds)
    files = _lines(tops, 3, _c("rank"), SUMMARY_FILE, {
        "file": _c("base"), "duration": format_duration(_c("seconds") * 1_000_000),
        "pct": F.coalesce(_f1(_c("pct_vs_distraction")), F.lit("NaN")),
    })
    focus_tail = (4, F.lit(0), SUMMARY_FOCUS_TAIL,
                  {"distraction": format_duration(_c("distraction_seconds") * 1_000_000)}, focus_conds)

    is_first = {"first": _c("ordinal") == 1}
    corr_lines = _sections(with_ordinal(corr, "seq", exe), [(5, F.lit(0), _first(SUMMARY_CORRECTIONS_HEAD), {}, is_first),
                                                           (6, _c("ordinal"), SUMMARY_CORRECTION, {
        "i": _c("ordinal"), "time": clock(_c("ts_us")), "file": base_name(_c("filename")),
        "note": F.coalesce("annotation", F.lit("")), "blocks": _c("blocks_affected"),
        "ticks": _c("ticks_reversed"), "lines": _c("lines_deleted"),
    }, {"reversed": _c("ticks_reversed") > 0, "deleted": _c("lines_deleted") > 0})])

    gaps = with_ordinal(idle_gaps(events, agg, exe, scanned=s), "end_seq", exe)
    gap_lines = _sections(gaps, [
        (7, F.lit(0), _first(SUMMARY_IDLE_HEAD), {"idle_threshold": F.lit(format_minutes(agg.idle_threshold_us))}, is_first),
        (8, _c("ordinal"), SUMMARY_IDLE_GAP, {
            "i": _c("ordinal"), "time": clock(_c("start_us")), "duration": format_duration(_c("duration_us"))}, {}),
        (9, F.lit(0), _first(SUMMARY_IDLE_TAIL), {}, is_first)])

    first = blocks.filter(_c("block_no") <= agg.report_blocks)
    more = _c("activity_blocks") - F.lit(agg.report_blocks)
    tl_head = (10, F.lit(0), SUMMARY_BLOCKS_HEAD, {"merge_window": F.lit(f"{agg.merge_window_us / 1e6:g}")}, {})
    tl_body = _lines(first, 11, _c("block_no"), SUMMARY_BLOCK, {
        "time": clock(_c("start_us")), "file": base_name(_c("filename")),
        "duration": format_duration(_c("duration_us")), "events": _c("event_count"),
        "start_tick": _c("start_tick"), "end_tick": _c("end_tick"), "delta": _c("delta_tick"),
        "velocity": _f2(_c("velocity")), "badge": velocity_badge(_c("velocity"), agg.flow_velocity),
        "closed_by": _c("closed_by"),
    }, {"moving": _c("velocity") > 0})
    tl_more = (12, F.lit(0), _first(SUMMARY_MORE_BLOCKS), {"more": more}, {"first": more > 0})

    counts = event_counts(events)
    raw_head = (13, F.lit(0), SUMMARY_COUNTS_HEAD, {}, {})
    raw_body = _lines(with_type_rank(counts), 14, _c("type_rank"), SUMMARY_COUNT,
                      {"type": title_case(_c("type")), "n": _c("n")})
    foot = (15, F.lit(0), SUMMARY_FOOT, {"session_id": F.coalesce("session_id", F.lit(""))}, {})

    per_session = _sections(hdr, [head, focus_head, focus_tail, tl_head, tl_more, raw_head, foot])
    parts = [flow, files, corr_lines, gap_lines, tl_body, raw_body]
    out = per_session
    for p in parts:
        out = out.unionByName(p)
    return out


def stats_report(stats: DataFrame) -> DataFrame:
    """The statistics command's text for every session (``session_stats`` rows),
    as line rows: status, duration of finished sessions in ``1h30m0s`` form, and
    the event counts."""
    return _lines(stats, 0, F.lit(0), STATS_SESSION, {
        "session_id": F.coalesce("session_id", F.lit("")), "status": _c("status"),
        "duration": go_duration(F.coalesce(_c("duration_us"), F.lit(0))), "total": _c("total_events"),
        "edits": _c("file_edits"), "navs": _c("cursor_moves"), "terminal": _c("terminal_commands"),
        "notes": _c("annotations"),
    }, {"completed": _c("status") == "Completed"})


def format_minutes(us: int) -> str:
    """Threshold text for the idle section (``5 minutes``)."""
    m = us / 60_000_000
    return f"{m:g} minutes" if m >= 1 else f"{us / 1e6:g} seconds"


def with_type_rank(counts: DataFrame) -> DataFrame:
    """Event types in a fixed order (by name): few distinct types, so a bounded rank."""
    return counts.withColumn("type_rank", F.row_number().over(Window.partitionBy("session_id").orderBy("type")))


def write_report(lines: DataFrame, path: str, sessions: DataFrame | None = None) -> None:
    """Write ``lines`` under hash buckets of the session id, in report order over the
    part files; reports of other sessions stay.  ``sessions`` names the sessions
    written (default: those with lines)."""
    from sessionlog.sinks.replace import replace_sessions

    replace_sessions(lines.select(*LINE_COLUMNS), lines.select("session_id") if sessions is None else sessions, path,
                     ["session_id", "sec", "ord", "sub"])


def render(lines: DataFrame, session_id: str) -> str:
    """Assemble one session's report on the driver (tests and small previews only)."""
    rows = lines.filter(F.col("session_id").eqNullSafe(session_id)).orderBy("sec", "ord", "sub").select("line").collect()
    return "\n".join(r.line for r in rows) + "\n"
