"""DuckDB SQL twins of the registered queries.

Written independently of the Spark operators: they follow the recorder's
loops literally with plain windows over whole sessions (``lag``/``lead`` on
edits, a range self-join for the look-back), which is fine for a small-scale
oracle.  Parameters are the adapter-scaled ones from ``ADAPTER_AGG``.
"""

from __future__ import annotations

from sessionlog.config import ADAPTER_AGG, ADAPTER_FILTER, TIGHT_FILTER
from sessionlog.sources.adapter import ORACLE_EVENTS_CTE

A = ADAPTER_AGG
MERGE = A.merge_window_us
IDLE = A.idle_threshold_us
LOOKBACK = A.lookback_us
NBACK = A.lookback_events
FLOW = repr(A.flow_velocity)
CLOSERS = ", ".join(f"'{t}'" for t in A.block_closers)
DISTRACT = " OR ".join(f"contains(coalesce(active_file, ''), '{p}')" for p in A.distraction_patterns)
KEYWORDS = " OR ".join(f"contains(lower(coalesce(note, '')), '{k}')" for k in A.error_keywords)

# All events with gap to the previous event and the running closer count.
BASE = f"""
a AS (
  SELECT *, lag(ts_us) OVER w AS prev_ts,
         sum(CASE WHEN type IN ({CLOSERS}) THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS trig,
         last_value(nullif(filename, '') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active_file
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq)
)"""

BLOCKS = f"""
e AS (
  SELECT *, lag(seq) OVER we AS p_seq, lag(trig) OVER we AS p_trig, lag(coalesce(filename, '')) OVER we AS p_file,
         lead(seq) OVER we AS n_seq, lead(trig) OVER we AS n_trig, lead(coalesce(filename, '')) OVER we AS n_file
  FROM a WHERE type = 'file_edit' WINDOW we AS (PARTITION BY session_id ORDER BY seq)
),
s AS (
  SELECT *, CASE WHEN p_seq IS NULL OR trig <> p_trig OR coalesce(filename, '') <> p_file
                   OR ts_us - prev_ts > {MERGE} THEN 1 ELSE 0 END AS is_start
  FROM e
),
bn AS (
  SELECT *, sum(is_start) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS block_no,
         lead(is_start) OVER (PARTITION BY session_id ORDER BY seq) AS next_start
  FROM s
),
tot AS (
  SELECT session_id, sum(CASE WHEN type IN ({CLOSERS}) THEN 1 ELSE 0 END) AS trig_all FROM ev GROUP BY session_id
),
ends AS (
  SELECT bn.session_id, bn.block_no,
         CASE WHEN bn.n_seq IS NULL THEN CASE WHEN tot.trig_all > bn.trig THEN 'context_switch' ELSE 'session_end' END
              WHEN bn.n_trig > bn.trig THEN 'context_switch'
              WHEN bn.n_file <> coalesce(bn.filename, '') THEN 'context_switch'
              ELSE 'timeout' END AS closed_by
  FROM bn JOIN tot USING (session_id)
  WHERE bn.next_start IS NULL OR bn.next_start = 1
),
firsts AS (
  SELECT session_id, block_no, filename, ts_us AS start_us, coalesce(changed_tick, 0) AS start_tick, seq AS first_seq
  FROM bn WHERE is_start = 1
),
lasts AS (
  SELECT session_id, block_no, ts_us AS end_us, coalesce(changed_tick, 0) AS end_tick, seq AS last_seq
  FROM bn WHERE next_start IS NULL OR next_start = 1
),
cnt AS (SELECT session_id, block_no, count(*) AS event_count FROM bn GROUP BY session_id, block_no),
blocks AS (
  SELECT f.session_id, CAST(f.block_no AS BIGINT) AS block_no, f.filename, f.start_us, l.end_us,
         l.end_us - f.start_us AS duration_us, c.event_count, CAST(f.start_tick AS BIGINT) AS start_tick,
         CAST(l.end_tick AS BIGINT) AS end_tick, CAST(l.end_tick - f.start_tick AS BIGINT) AS delta_tick,
         CASE WHEN l.end_us - f.start_us > 0
              THEN CAST(l.end_tick - f.start_tick AS DOUBLE) / (CAST(l.end_us - f.start_us AS DOUBLE) / 1000000.0)
              ELSE 0.0 END AS velocity,
         x.closed_by, f.first_seq, l.last_seq
  FROM firsts f JOIN lasts l USING (session_id, block_no) JOIN cnt c USING (session_id, block_no)
  JOIN ends x USING (session_id, block_no)
)"""

GAPS = f"""
gaps AS (
  SELECT session_id, seq AS end_seq, prev_ts AS start_us, ts_us AS end_us, ts_us - prev_ts AS duration_us
  FROM a WHERE ts_us - prev_ts > {IDLE}
)"""

FOCUS = f"""
focus AS (
  SELECT session_id, active_file AS filename,
         CAST(sum(CASE WHEN ts_us - prev_ts >= 0 THEN (ts_us - prev_ts) // 1000000
                       ELSE -((prev_ts - ts_us) // 1000000) END) AS BIGINT) AS seconds,
         ({DISTRACT}) AS distraction
  FROM a WHERE prev_ts IS NOT NULL AND active_file IS NOT NULL
  GROUP BY session_id, active_file
),
focus_sum AS (
  SELECT session_id,
         CAST(coalesce(sum(CASE WHEN NOT distraction THEN seconds END), 0) AS BIGINT) AS main_seconds,
         CAST(coalesce(sum(CASE WHEN distraction THEN seconds END), 0) AS BIGINT) AS distraction_seconds,
         CAST(count(CASE WHEN NOT distraction THEN 1 END) AS BIGINT) AS main_files
  FROM focus GROUP BY session_id
),
focus_ratio AS (
  SELECT *, CASE WHEN main_seconds + distraction_seconds > 0
                 THEN CAST(main_seconds AS DOUBLE) / CAST(main_seconds + distraction_seconds AS DOUBLE)
                 ELSE 0.0 END AS focus_ratio
  FROM focus_sum
)"""

CORRECTIONS = f"""
ann AS (
  SELECT session_id, seq AS a_seq, ts_us AS a_ts, filename AS a_filename, coalesce(filename, '') AS a_file,
         note AS annotation
  FROM ev WHERE type = 'annotation' AND seq > 0 AND ({KEYWORDS})
),
pairs AS (
  SELECT n.*, x.seq AS t_seq, coalesce(x.changed_tick, 0) AS tick,
         (x.type = 'file_edit' AND coalesce(x.filename, '') = n.a_file) AS hit,
         (n.a_ts - x.ts_us) > {LOOKBACK} AS old
  FROM ann n JOIN ev x ON x.session_id = n.session_id AND x.seq BETWEEN n.a_seq - {NBACK} AND n.a_seq - 1
),
st AS (
  SELECT *, bool_or(old) OVER (PARTITION BY session_id, a_seq ORDER BY t_seq DESC ROWS UNBOUNDED PRECEDING) AS stopped
  FROM pairs
),
hits AS (
  SELECT *, lag(tick) OVER (PARTITION BY session_id, a_seq ORDER BY t_seq DESC) AS later
  FROM st WHERE NOT stopped AND hit
),
corr AS (
  SELECT session_id, a_seq AS seq, any_value(a_ts) AS ts_us, any_value(a_filename) AS filename,
         any_value(annotation) AS annotation, CAST(0 AS BIGINT) AS lines_deleted,
         CAST(sum(CASE WHEN later > 0 AND tick < later THEN later - tick ELSE 0 END) AS BIGINT) AS ticks_reversed,
         CAST(count(*) AS BIGINT) AS blocks_affected
  FROM hits GROUP BY session_id, a_seq
)"""

TIMELINE = """
nc AS (
  SELECT *, lag(type) OVER w AS p_type, lag(coalesce(filename, '')) OVER w AS p_file
  FROM ev WHERE type <> 'cursor_move' WINDOW w AS (PARTITION BY session_id ORDER BY seq)
),
r AS (
  SELECT *, sum(CASE WHEN type = 'file_edit' AND p_type = 'file_edit' AND coalesce(filename, '') = p_file
                     THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS entry_no,
         CASE WHEN type = 'file_edit' THEN 'L' || CAST(coalesce(line, 0) AS VARCHAR) || ':C' || CAST(coalesce("column", 0) AS VARCHAR)
              WHEN coalesce(filename, '') = '' THEN ''
              WHEN coalesce(line, 0) > 0 THEN filename || ':' || CAST(line AS VARCHAR)
              ELSE filename END AS loc,
         CASE WHEN octet_length(encode(trim(coalesce(line_text, '')))) > 120
              THEN left(trim(coalesce(line_text, '')), 117) || '...' ELSE trim(coalesce(line_text, '')) END AS snip,
         CASE type WHEN 'annotation' THEN coalesce(note, '') WHEN 'lsp_diagnostic' THEN coalesce(message, '')
                   WHEN 'terminal_command' THEN coalesce(command, '')
                   WHEN 'file_open' THEN CASE WHEN coalesce(file_type, '') <> '' THEN file_type ELSE 'opened' END
                   ELSE '' END AS det
  FROM nc
),
rr AS (
  SELECT *, min(seq) OVER g AS first_seq, max(seq) OVER g AS last_seq,
         count(CASE WHEN type = 'file_edit' THEN 1 END) OVER g AS edit_count,
         max(CASE WHEN coalesce(line_text, '') <> '' THEN seq END) OVER g AS lt_seq
  FROM r WINDOW g AS (PARTITION BY session_id, entry_no)
),
tl AS (
  SELECT f.session_id, CAST(f.entry_no AS BIGINT) AS entry_no, f.type, f.seq AS first_seq, f.ts_us AS first_us,
         l.ts_us AS last_us, strftime(make_timestamp(f.ts_us), '%H:%M:%S') AS time_code,
         strftime(make_timestamp(l.ts_us), '%H:%M:%S') AS time_intent,
         CASE f.type WHEN 'annotation' THEN '📝' WHEN 'file_edit' THEN '🛠' WHEN 'lsp_diagnostic' THEN '⚠️'
                     WHEN 'terminal_command' THEN '💻' WHEN 'file_open' THEN '📂' WHEN 'session_start' THEN '🚀'
                     WHEN 'session_end' THEN '🏁' WHEN 'session_resume' THEN '🔄' ELSE '•' END AS icon,
         CASE f.type WHEN 'annotation' THEN 'Note' WHEN 'file_edit' THEN 'Edits' WHEN 'lsp_diagnostic' THEN 'LSP'
                     WHEN 'terminal_command' THEN 'Terminal' WHEN 'file_open' THEN 'File Open'
                     WHEN 'session_start' THEN 'Session Started' WHEN 'session_end' THEN 'Session Ended'
                     WHEN 'session_resume' THEN 'Session Resumed' ELSE f.type END AS title,
         coalesce(f.filename, '') AS file, f.loc AS location_code, l.loc AS location_intent, f.snip AS snippet_code,
         coalesce(t.snip, f.snip) AS snippet_intent,
         CASE WHEN f.type = 'file_edit' THEN '1 edit' ELSE f.det END AS details_code,
         CASE WHEN f.type = 'file_edit' AND f.edit_count > 1 THEN CAST(f.edit_count AS VARCHAR) || ' edits'
              WHEN f.type = 'file_edit' THEN '1 edit' ELSE f.det END AS details_intent,
         CAST(f.edit_count AS BIGINT) AS edit_count
  FROM rr f JOIN rr l ON l.session_id = f.session_id AND l.seq = f.last_seq
  LEFT JOIN rr t ON t.session_id = f.session_id AND t.seq = f.lt_seq
  WHERE f.seq = f.first_seq
)"""

STATE = """
state AS (
  SELECT session_id,
         arg_min(ts_us, CASE WHEN type = 'session_start' THEN seq END) AS st_us,
         arg_min(ts_us, seq) AS first_us, arg_max(ts_us, seq) AS last_us,
         arg_max(ts_us, CASE WHEN type = 'session_end' THEN seq END) AS end_x,
         arg_max(type, CASE WHEN type IN ('session_start', 'session_resume', 'session_end') THEN seq END) AS life
  FROM ev GROUP BY session_id
),
state2 AS (
  SELECT session_id, coalesce(st_us, first_us) AS start_us,
         CASE WHEN life IS NULL THEN last_us ELSE end_x END AS end_us,
         CASE WHEN life IS NULL THEN false ELSE life <> 'session_end' END AS active
  FROM state
)"""


FC = ADAPTER_FILTER
DEB, CIDLE = FC.debounce_us, FC.idle_us
TRIGS = ", ".join(f"'{t}'" for t in FC.triggers)
END_OF_LOG = 1 << 60

def _cursor(debounce: int, idle: int, idle_commit: str = "record") -> str:
    """The recorder's filter as a walk over each session's events, one event a step.

    State after event ``seq``: the anchor, the pending move and the timer;
    ``timed`` and ``flushed`` are the moves that this event let go.
    """
    dropped = "AND false" if idle_commit == "drop" else ""
    return f"""
lens AS (SELECT session_id, max(seq) AS top FROM ev GROUP BY session_id),
walk AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS anchor, CAST(NULL AS BIGINT) AS pending,
         CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS timed, CAST(NULL AS BIGINT) AS flushed, '' AS type
  FROM lens
  UNION ALL
  SELECT session_id, seq,
         CASE WHEN type = 'session_end' THEN NULL WHEN trig OR (move AND NOT near) THEN ts_us ELSE anchor END,
         CASE WHEN trig THEN NULL WHEN move THEN seq ELSE left_pending END,
         CASE WHEN trig THEN NULL WHEN move AND NOT near THEN ts_us + {idle} ELSE left_due END,
         CASE WHEN ran_out THEN pending END,
         CASE WHEN trig THEN left_pending END,
         type
  FROM (
    SELECT e.session_id, e.seq, e.ts_us, e.type, w.anchor, w.pending,
           e.type IN ({TRIGS}) AS trig, e.type = 'cursor_move' AS move,
           coalesce(e.ts_us > w.due, false) AS ran_out,
           coalesce(e.ts_us - w.anchor < {debounce}, false) AS near,
           CASE WHEN coalesce(e.ts_us > w.due, false) THEN NULL ELSE w.pending END AS left_pending,
           CASE WHEN coalesce(e.ts_us > w.due, false) THEN NULL ELSE w.due END AS left_due
    FROM walk w JOIN ev e ON e.session_id = w.session_id AND e.seq = w.seq + 1
  ) step
),
kept AS (
  SELECT session_id, timed AS seq, 'idle' AS reason, seq AS flush_seq FROM walk WHERE timed IS NOT NULL {dropped}
  UNION ALL
  SELECT session_id, flushed, CASE WHEN type = 'session_end' THEN 'end' ELSE 'trigger' END, seq FROM walk WHERE flushed IS NOT NULL
  UNION ALL
  SELECT w.session_id, w.pending, 'idle', {END_OF_LOG} FROM walk w JOIN lens ON w.session_id = lens.session_id AND w.seq = lens.top
  WHERE w.pending IS NOT NULL AND w.due IS NOT NULL {dropped}
  UNION ALL
  SELECT w.session_id, w.pending, 'end', NULL FROM walk w JOIN lens ON w.session_id = lens.session_id AND w.seq = lens.top
  WHERE w.pending IS NOT NULL AND w.due IS NULL
),
denoised AS (
  SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS BIGINT) AS seq,
         type, ts_us, changed_tick, filename, note
  FROM (
    SELECT session_id, seq * 2 + 1 AS pos, type, ts_us, changed_tick, filename, note FROM ev WHERE type <> 'cursor_move'
    UNION ALL
    SELECT e.session_id, coalesce(k.flush_seq * 2, e.seq * 2 + 1) AS pos, e.type, e.ts_us, e.changed_tick,
           e.filename, e.note
    FROM ev e JOIN kept k USING (session_id, seq)
  ) u
)"""


CURSOR = _cursor(DEB, CIDLE)


# stand-in lifecycle: start 1 us before the first event, end 1 us after the last;
# output format from the code of the id's last character, modulo 3 (see plans/standins.py)
LIFE = """
life AS (
  SELECT session_id, min(ts_us) AS a, max(ts_us) AS z,
         ['markdown', 'json', 'sqlite'][CAST(ascii(right(session_id, 1)) % 3 AS INTEGER) + 1] AS fmt
  FROM ev GROUP BY session_id
)"""


# command-log events (stand-in log incl. lifecycle), sequenced by arrival
CEV = """
cev AS (
  SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts_us, cmd_id) - 1 AS BIGINT) AS seq,
         type, ts_us, filename, changed_tick, note
  FROM (
    SELECT session_id, changed_tick AS cmd_id, type, ts_us,
           CASE WHEN type IN ('file_edit', 'cursor_move', 'file_open', 'lsp_diagnostic') THEN nullif(filename, '') END AS filename,
           CASE WHEN type = 'file_edit' THEN nullif(changed_tick, 0) END AS changed_tick, nullif(note, '') AS note
    FROM ev WHERE type IN ('file_edit', 'terminal_command', 'cursor_move', 'file_open', 'lsp_diagnostic', 'annotation')
    UNION ALL SELECT session_id, -1, 'session_start', a - 1, NULL, NULL,
                     'Started debugging session in /work/proj-' || session_id FROM life
    UNION ALL SELECT session_id, -2, 'session_end', z + 1, NULL, NULL, 'Debugging session ended' FROM life
  ) u
)"""


def _on(cte: str, src: str) -> str:
    """The same CTE text reading ``src`` instead of ``ev``."""
    import re
    return re.sub(r"\bev\b", src, cte)


ANALYTICS_TAIL = f""",
vel AS (
  SELECT session_id, coalesce(avg(CASE WHEN velocity > 0 THEN velocity END), 0.0) AS avg_velocity,
         coalesce(max(CASE WHEN velocity > 0 THEN velocity END), 0.0) AS peak_velocity,
         count(*) AS n_blocks, count(CASE WHEN velocity > 0 AND velocity >= {FLOW} THEN 1 END) AS flow_blocks
  FROM blocks GROUP BY session_id
),
idl AS (SELECT session_id, count(*) AS idle_gaps, sum(duration_us) AS idle_total_us FROM gaps GROUP BY session_id),
cor AS (SELECT session_id, count(*) AS error_corrections FROM corr GROUP BY session_id),
spine AS (SELECT session_id, count(*) AS total_events FROM ev GROUP BY session_id)
SELECT s.session_id, CAST(s.total_events AS BIGINT) AS total_events,
       CAST(coalesce(v.n_blocks, 0) AS BIGINT) AS activity_blocks,
       round(coalesce(v.avg_velocity, 0.0), 9) AS avg_velocity, coalesce(v.peak_velocity, 0.0) AS peak_velocity,
       coalesce(f.focus_ratio, 0.0) AS focus_ratio,
       CAST(coalesce(f.distraction_seconds, 0) AS BIGINT) AS distraction_seconds,
       CAST(coalesce(v.flow_blocks, 0) AS BIGINT) AS flow_blocks,
       CAST(coalesce(i.idle_gaps, 0) AS BIGINT) AS idle_gaps,
       CAST(coalesce(i.idle_total_us, 0) AS BIGINT) AS idle_total_us,
       CAST(coalesce(c.error_corrections, 0) AS BIGINT) AS error_corrections
FROM spine s LEFT JOIN vel v USING (session_id) LEFT JOIN idl i USING (session_id)
LEFT JOIN focus_ratio f USING (session_id) LEFT JOIN cor c USING (session_id)"""


DN = """
dn AS (SELECT session_id, seq, type, ts_us, filename, changed_tick, note FROM denoised)"""


def _stream_summaries() -> str:
    """Analytics and session state over the cursor-filtered command log."""
    live = (LIFE, CEV, _on(CURSOR, "cev"), DN)
    analytics = _with(*live, _on(BASE, "dn"), _on(BLOCKS, "dn"), GAPS, FOCUS, _on(CORRECTIONS, "dn")) + \
        _on(ANALYTICS_TAIL, "dn")
    state = _with(*live, _on(STATE, "dn")) + "\nSELECT session_id, start_us, end_us, active FROM state2"
    return (f"SELECT a.*, st.start_us, st.end_us, st.active FROM ({analytics}) a "
            f"LEFT JOIN ({state}) st USING (session_id)")


def _sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_line(text: str, fields: dict[str, str]) -> str:
    """A report template line as SQL: ``||`` keeps Spark's NULL-propagating concat."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", text):
        if m.start() > pos:
            parts.append(_sql_str(text[pos:m.start()]))
        parts.append(f"CAST(({fields[m.group(1)]}) AS VARCHAR)")
        pos = m.end()
    if pos < len(text):
        parts.append(_sql_str(text[pos:]))
    return " || ".join(parts) if parts else "''"


def _sql_lines(template: list, fields: dict[str, str], conds: dict[str, str] | None = None) -> str:
    items = []
    for item in template:
        if isinstance(item, tuple):
            items.append(f"CASE WHEN {(conds or {})[item[0]]} THEN {_sql_line(item[1], fields)} END")
        else:
            items.append(_sql_line(item, fields))
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def _sql_duration(us: str) -> str:
    """Durations as in the reports: half-even seconds under a minute, then m/s, then h/m."""
    return (f"CASE WHEN ({us}) < 60000000 THEN printf('%.0fs', ({us}) / 1000000.0) "
            f"WHEN ({us}) < 3600000000 THEN CAST(({us}) // 60000000 AS VARCHAR) || 'm ' || "
            f"CAST((({us}) // 1000000) % 60 AS VARCHAR) || 's' "
            f"ELSE CAST(({us}) // 3600000000 AS VARCHAR) || 'h ' || CAST((({us}) // 60000000) % 60 AS VARCHAR) || 'm' END")


def _timeline_report() -> str:
    from sessionlog.sinks import reports as R
    day = "strftime(make_timestamp(start_us), '%Y-%m-%d')"
    clock = "strftime(make_timestamp({}), '%H:%M:%S')"
    head = _sql_lines(R.TIMELINE_HEAD, {
        "session_id": "session_id", "project": "''", "date": day,
        "duration": f"CASE WHEN end_us IS NULL THEN 'in progress' ELSE {_sql_duration('end_us - start_us')} END",
        "start": clock.format("start_us"), "edits": "file_edits", "navs": "cursor_moves",
        "terminal": "terminal_commands", "notes": "annotations", "lsp": "lsp_diagnostics",
        "edit_pct": "edit_pct", "nav_pct": "nav_pct"})
    where = ("(CASE WHEN file <> '' THEN '`' || file || '`' ELSE '' END || "
             "CASE WHEN location_code <> '' THEN ' • ' || location_code ELSE '' END)")
    body = _sql_lines(R.TIMELINE_ENTRY, {"time": "time_code", "icon": "icon", "title": "title", "where": where,
                                          "snippet": "snippet_code", "details": "details_code"},
                      {"has_where": f"{where} <> ''", "has_snippet": "snippet_code <> ''",
                       "has_details": "details_code <> ''"})
    tail = _sql_lines(R.TIMELINE_TAIL, {"total": "total_events", "entries": "coalesce(entries, 0)"})
    return _with(TIMELINE, STATE) + f""",
cnt AS (
  SELECT session_id, count(*) AS total_events,
         count(CASE WHEN type = 'file_edit' THEN 1 END) AS file_edits,
         count(CASE WHEN type = 'cursor_move' THEN 1 END) AS cursor_moves,
         count(CASE WHEN type = 'terminal_command' THEN 1 END) AS terminal_commands,
         count(CASE WHEN type = 'annotation' THEN 1 END) AS annotations,
         count(CASE WHEN type = 'lsp_diagnostic' THEN 1 END) AS lsp_diagnostics
  FROM ev GROUP BY session_id
),
spine AS (
  SELECT c.*, s.start_us, s.end_us, t.entries,
         CASE WHEN file_edits + cursor_moves = 0 THEN 0
              ELSE CAST(trunc(CAST(file_edits AS DOUBLE) / CAST(file_edits + cursor_moves AS DOUBLE) * 100) AS INTEGER) END AS edit_pct,
         CASE WHEN file_edits + cursor_moves = 0 THEN 0
              ELSE 100 - CAST(trunc(CAST(file_edits AS DOUBLE) / CAST(file_edits + cursor_moves AS DOUBLE) * 100) AS INTEGER) END AS nav_pct
  FROM cnt c JOIN state2 s USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS entries FROM tl GROUP BY session_id) t USING (session_id)
),
blocks_of_lines AS (
  SELECT session_id, 0 AS sec, CAST(0 AS BIGINT) AS ord, {head} AS lines FROM spine
  UNION ALL SELECT session_id, 1, entry_no, {body} FROM tl
  UNION ALL SELECT session_id, 2, CAST(0 AS BIGINT), {tail} FROM spine
)
SELECT session_id, CAST(sec AS INTEGER) AS sec, ord, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS sub,
       unnest(lines) AS line
FROM blocks_of_lines"""


def _summary_report() -> str:
    from sessionlog.sinks import reports as R
    dt = "strftime(make_timestamp({}), '%Y-%m-%d %H:%M:%S')"
    clock = "strftime(make_timestamp({}), '%H:%M:%S')"
    f2 = "printf('%.2f', round_even({}, 2))"
    f1 = "printf('%.1f', round_even({}, 1))"
    base = ("CASE WHEN coalesce({0}, '') = '' THEN '.' WHEN regexp_replace({0}, '/+$', '') = '' THEN '/' "
            "ELSE regexp_extract(regexp_replace({0}, '/+$', ''), '[^/]*$') END")
    dur = _sql_duration
    head = _sql_lines(R.SUMMARY_HEAD, {
        "session_id": "session_id", "project": "''", "started": dt.format("start_us"), "ended_at": dt.format("end_us"),
        "duration": dur("end_us - start_us"), "total": "total_events", "blocks": "n_blocks",
        "avg_velocity": f2.format("avg_velocity"), "peak_velocity": f2.format("peak_velocity"),
        "focus_pct": f1.format("focus_ratio * 100"), "flow": "flow_blocks", "gaps": "idle_gaps",
        "idle_total": dur("idle_total_us"), "corrections": "error_corrections",
        "flow_threshold": _sql_str(f"{A.flow_velocity:g}")},
        {"ended": "end_us IS NOT NULL", "active": "end_us IS NULL", "has_flow": "flow_blocks > 0",
         "no_flow": "flow_blocks = 0"})
    flow = _sql_lines(R.SUMMARY_FLOW_BLOCK, {
        "i": "ordinal", "time": clock.format("start_us"), "file": base.format("filename"),
        "velocity": f2.format("velocity"), "duration": dur("duration_us"), "delta": "delta_tick",
        "events": "event_count"})
    conds = {"has_files": "coalesce(k, 0) > 0", "distracted": "distraction_seconds > 0"}
    focus_head = _sql_lines(R.SUMMARY_FOCUS_HEAD, {"focus_pct": f1.format("focus_ratio * 100")}, conds)
    files = _sql_lines(R.SUMMARY_FILE, {"file": "base", "duration": dur("seconds * 1000000"),
                                        "pct": f"coalesce({f1.format('pct')}, 'NaN')"})
    focus_tail = _sql_lines(R.SUMMARY_FOCUS_TAIL, {"distraction": dur("distraction_seconds * 1000000")}, conds)
    corr_head = _sql_lines(R.SUMMARY_CORRECTIONS_HEAD, {})
    corr_body = _sql_lines(R.SUMMARY_CORRECTION, {
        "i": "ordinal", "time": clock.format("ts_us"), "file": base.format("filename"),
        "note": "coalesce(annotation, '')", "blocks": "blocks_affected", "ticks": "ticks_reversed",
        "lines": "lines_deleted"}, {"reversed": "ticks_reversed > 0", "deleted": "lines_deleted > 0"})
    idle_minutes = R.format_minutes(A.idle_threshold_us)
    gap_head = _sql_lines(R.SUMMARY_IDLE_HEAD, {"idle_threshold": _sql_str(idle_minutes)})
    gap_body = _sql_lines(R.SUMMARY_IDLE_GAP, {"i": "ordinal", "time": clock.format("start_us"),
                                               "duration": dur("duration_us")})
    gap_tail = _sql_lines(R.SUMMARY_IDLE_TAIL, {})
    tl_head = _sql_lines(R.SUMMARY_BLOCKS_HEAD, {"merge_window": _sql_str(f"{A.merge_window_us / 1e6:g}")})
    tl_body = _sql_lines(R.SUMMARY_BLOCK, {
        "time": clock.format("start_us"), "file": base.format("filename"), "duration": dur("duration_us"),
        "events": "event_count", "start_tick": "start_tick", "end_tick": "end_tick", "delta": "delta_tick",
        "velocity": f2.format("velocity"), "badge": f"CASE WHEN velocity >= {FLOW} THEN ' 🔥' ELSE '' END",
        "closed_by": "closed_by"}, {"moving": "velocity > 0"})
    tl_more = _sql_lines(R.SUMMARY_MORE_BLOCKS, {"more": "more_blocks"})
    raw_head = _sql_lines(R.SUMMARY_COUNTS_HEAD, {})
    title = ("list_aggregate(list_transform(string_split(type, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), "
             "'string_agg', ' ')")
    raw_body = _sql_lines(R.SUMMARY_COUNT, {"type": title, "n": "n"})
    foot = _sql_lines(R.SUMMARY_FOOT, {"session_id": "session_id"})
    return _with(BASE, BLOCKS, GAPS, FOCUS, CORRECTIONS, STATE) + f""",
an AS (
  SELECT sp.session_id, sp.total_events, st.start_us, st.end_us,
         coalesce(v.n_blocks, 0) AS n_blocks, coalesce(v.avg_velocity, 0.0) AS avg_velocity,
         coalesce(v.peak_velocity, 0.0) AS peak_velocity, coalesce(v.flow_blocks, 0) AS flow_blocks,
         coalesce(f.focus_ratio, 0.0) AS focus_ratio, coalesce(f.distraction_seconds, 0) AS distraction_seconds,
         coalesce(i.idle_gaps, 0) AS idle_gaps, coalesce(i.idle_total_us, 0) AS idle_total_us,
         coalesce(c.error_corrections, 0) AS error_corrections
  FROM (SELECT session_id, count(*) AS total_events FROM ev GROUP BY session_id) sp
  JOIN state2 st USING (session_id)
  LEFT JOIN (SELECT session_id, avg(CASE WHEN velocity > 0 THEN velocity END) AS avg_velocity,
                    max(CASE WHEN velocity > 0 THEN velocity END) AS peak_velocity, count(*) AS n_blocks,
                    count(CASE WHEN velocity > 0 AND velocity >= {FLOW} THEN 1 END) AS flow_blocks
             FROM blocks GROUP BY session_id) v USING (session_id)
  LEFT JOIN focus_ratio f USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS idle_gaps, sum(duration_us) AS idle_total_us FROM gaps GROUP BY session_id) i
    USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS error_corrections FROM corr GROUP BY session_id) c USING (session_id)
),
fb AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY block_no) AS ordinal
       FROM blocks WHERE velocity > 0 AND velocity >= {FLOW}),
tops AS (
  SELECT * FROM (
    SELECT f.session_id, f.filename, f.seconds, {base.format('f.filename')} AS base,
           CASE WHEN s.distraction_seconds + f.seconds = 0 THEN NULL
                ELSE CAST(f.seconds AS DOUBLE) / CAST(s.distraction_seconds + f.seconds AS DOUBLE) * 100 END AS pct,
           row_number() OVER (PARTITION BY f.session_id ORDER BY f.seconds DESC, f.filename) AS rank
    FROM focus f JOIN focus_sum s USING (session_id) WHERE NOT f.distraction) x
  WHERE rank <= {A.top_files}
),
fr AS (SELECT a.session_id, a.focus_ratio, a.distraction_seconds, t.k FROM an a
       LEFT JOIN (SELECT session_id, count(*) AS k FROM tops GROUP BY session_id) t USING (session_id)),
co AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS ordinal FROM corr),
ga AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY end_seq) AS ordinal FROM gaps),
nb AS (SELECT session_id, count(*) AS n FROM blocks GROUP BY session_id),
cnts AS (SELECT session_id, type, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY type) AS type_rank
         FROM ev GROUP BY session_id, type),
parts AS (
  SELECT session_id, 0 AS sec, CAST(0 AS BIGINT) AS ord, {head} AS lines FROM an
  UNION ALL SELECT session_id, 1, ordinal, {flow} FROM fb
  UNION ALL SELECT session_id, 2, 0, {focus_head} FROM fr
  UNION ALL SELECT session_id, 3, rank, {files} FROM tops
  UNION ALL SELECT session_id, 4, 0, {focus_tail} FROM fr
  UNION ALL SELECT session_id, 5, 0, {corr_head} FROM co WHERE ordinal = 1
  UNION ALL SELECT session_id, 6, ordinal, {corr_body} FROM co
  UNION ALL SELECT session_id, 7, 0, {gap_head} FROM ga WHERE ordinal = 1
  UNION ALL SELECT session_id, 8, ordinal, {gap_body} FROM ga
  UNION ALL SELECT session_id, 9, 0, {gap_tail} FROM ga WHERE ordinal = 1
  UNION ALL SELECT session_id, 10, 0, {tl_head} FROM an
  UNION ALL SELECT session_id, 11, block_no, {tl_body} FROM blocks WHERE block_no <= {A.report_blocks}
  UNION ALL SELECT session_id, 12, 0, {tl_more.replace('more_blocks', 'greatest(n - ' + str(A.report_blocks) + ', 0)')}
            FROM nb WHERE n > {A.report_blocks}
  UNION ALL SELECT session_id, 13, 0, {raw_head} FROM an
  UNION ALL SELECT session_id, 14, type_rank, {raw_body} FROM cnts
  UNION ALL SELECT session_id, 15, 0, {foot} FROM an
)
SELECT session_id, CAST(sec AS INTEGER) AS sec, CAST(ord AS BIGINT) AS ord,
       CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS sub, unnest(lines) AS line
FROM parts"""


def _sql_go_duration(d: str) -> str:
    """Duration text like ``1h30m0s``, ``2m5.5s``, ``1.5s``, ``250ms``, ``0s`` (non-negative input)."""
    sec_txt = (f"CAST((({d}) // 1000000) % 60 AS VARCHAR) || CASE WHEN ({d}) % 1000000 = 0 THEN '' "
               f"ELSE '.' || rtrim(lpad(CAST(({d}) % 1000000 AS VARCHAR), 6, '0'), '0') END || 's'")
    ms = (f"CASE WHEN ({d}) % 1000 = 0 THEN CAST(({d}) // 1000 AS VARCHAR) || 'ms' "
          f"ELSE regexp_replace(printf('%.3f', ({d}) / 1000.0), '\\.?0+$', '') || 'ms' END")
    return (f"CASE WHEN ({d}) = 0 THEN '0s' WHEN ({d}) < 1000 THEN CAST(({d}) AS VARCHAR) || 'µs' "
            f"WHEN ({d}) < 1000000 THEN {ms} "
            f"WHEN ({d}) // 3600000000 > 0 THEN CAST(({d}) // 3600000000 AS VARCHAR) || 'h' || "
            f"CAST((({d}) // 60000000) % 60 AS VARCHAR) || 'm' || {sec_txt} "
            f"WHEN (({d}) // 60000000) % 60 > 0 THEN CAST((({d}) // 60000000) % 60 AS VARCHAR) || 'm' || {sec_txt} "
            f"ELSE {sec_txt} END")


def _stats_report() -> str:
    from sessionlog.sinks import reports as R
    lines = _sql_lines(R.STATS_SESSION, {
        "session_id": "session_id", "status": "status", "duration": _sql_go_duration("coalesce(duration_us, 0)"),
        "total": "total_events", "edits": "file_edits", "navs": "cursor_moves", "terminal": "terminal_commands",
        "notes": "annotations"}, {"completed": "status = 'Completed'"})
    return _with(STATE) + f""",
st AS (
  SELECT s.session_id, CASE WHEN s.active THEN 'Active' ELSE 'Completed' END AS status,
         CASE WHEN NOT s.active AND s.end_us IS NOT NULL THEN s.end_us - s.start_us END AS duration_us,
         c.total_events, c.file_edits, c.cursor_moves, c.terminal_commands, c.annotations
  FROM state2 s JOIN (
    SELECT session_id, count(*) AS total_events, count(CASE WHEN type = 'file_edit' THEN 1 END) AS file_edits,
           count(CASE WHEN type = 'cursor_move' THEN 1 END) AS cursor_moves,
           count(CASE WHEN type = 'terminal_command' THEN 1 END) AS terminal_commands,
           count(CASE WHEN type = 'annotation' THEN 1 END) AS annotations
    FROM ev GROUP BY session_id) c USING (session_id)
),
parts AS (SELECT session_id, {lines} AS lines FROM st)
SELECT session_id, CAST(0 AS INTEGER) AS sec, CAST(0 AS BIGINT) AS ord,
       CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS sub, unnest(lines) AS line
FROM parts"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in (ORACLE_EVENTS_CTE, *parts))


ORACLE: dict[str, str] = {
    "activity_blocks": _with(BASE, BLOCKS) + "\nSELECT * FROM blocks",
    "velocity_metrics": _with(BASE, BLOCKS) + """
SELECT session_id, round(coalesce(avg(CASE WHEN velocity > 0 THEN velocity END), 0.0), 9) AS avg_velocity,
       coalesce(max(CASE WHEN velocity > 0 THEN velocity END), 0.0) AS peak_velocity,
       CAST(count(*) AS BIGINT) AS n_blocks
FROM blocks GROUP BY session_id""",
    "flow_blocks": _with(BASE, BLOCKS) + f"""
SELECT session_id, block_no, filename, start_us, duration_us, delta_tick, event_count, velocity
FROM blocks WHERE velocity > 0 AND velocity >= {FLOW}""",
    "idle_gaps": _with(BASE, GAPS) + "\nSELECT * FROM gaps",
    "idle_totals": _with(BASE, GAPS) + """
SELECT session_id, CAST(count(*) AS BIGINT) AS idle_gaps, CAST(sum(duration_us) AS BIGINT) AS idle_total_us
FROM gaps GROUP BY session_id""",
    "file_focus": _with(BASE, FOCUS) + "\nSELECT * FROM focus",
    "focus_summary": _with(BASE, FOCUS) + "\nSELECT * FROM focus_ratio",
    "error_corrections": _with(CORRECTIONS) + "\nSELECT * FROM corr",
    "timeline": _with(TIMELINE) + "\nSELECT * FROM tl",
    "event_counts": _with() + "\nSELECT session_id, type, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY session_id, type",
    "session_state": _with(STATE) + "\nSELECT session_id, start_us, end_us, active FROM state2",
    "session_stats": _with(STATE) + """,
cnt AS (
  SELECT session_id, CAST(count(*) AS BIGINT) AS total_events,
         CAST(count(CASE WHEN type = 'file_edit' THEN 1 END) AS BIGINT) AS file_edits,
         CAST(count(CASE WHEN type = 'terminal_command' THEN 1 END) AS BIGINT) AS terminal_commands,
         CAST(count(CASE WHEN type = 'annotation' THEN 1 END) AS BIGINT) AS annotations,
         CAST(count(CASE WHEN type = 'cursor_move' THEN 1 END) AS BIGINT) AS cursor_moves,
         CAST(count(CASE WHEN type = 'file_open' THEN 1 END) AS BIGINT) AS file_opens,
         CAST(count(CASE WHEN type = 'lsp_diagnostic' THEN 1 END) AS BIGINT) AS lsp_diagnostics
  FROM ev GROUP BY session_id
)
SELECT s.session_id, CAST(NULL AS VARCHAR) AS project_path,
       CASE WHEN s.active THEN 'Active' ELSE 'Completed' END AS status,
       CASE WHEN NOT s.active AND s.end_us IS NOT NULL THEN s.end_us - s.start_us END AS duration_us,
       c.total_events, c.file_edits, c.terminal_commands, c.annotations, c.cursor_moves, c.file_opens,
       c.lsp_diagnostics,
       CASE WHEN c.file_edits + c.cursor_moves = 0 THEN 0
            ELSE CAST(trunc(CAST(c.file_edits AS DOUBLE) / CAST(c.file_edits + c.cursor_moves AS DOUBLE) * 100) AS INTEGER) END AS edit_pct,
       CASE WHEN c.file_edits + c.cursor_moves = 0 THEN 0
            ELSE 100 - CAST(trunc(CAST(c.file_edits AS DOUBLE) / CAST(c.file_edits + c.cursor_moves AS DOUBLE) * 100) AS INTEGER) END AS nav_pct
FROM state2 s LEFT JOIN cnt c USING (session_id)""",
    "session_analytics": _with(BASE, BLOCKS, GAPS, FOCUS, CORRECTIONS) + ANALYTICS_TAIL,
    "cursor_filter": _with(CURSOR) + "\nSELECT session_id, seq, reason, CAST(flush_seq AS DOUBLE) AS flush_seq FROM kept",
    "cursor_filter_tight": _with(_cursor(TIGHT_FILTER.debounce_us, TIGHT_FILTER.idle_us))
    + "\nSELECT session_id, seq, reason, CAST(flush_seq AS DOUBLE) AS flush_seq FROM kept",
    "cursor_filter_drop": _with(_cursor(DEB, CIDLE, "drop"))
    + "\nSELECT session_id, seq, reason, CAST(flush_seq AS DOUBLE) AS flush_seq FROM kept",
    "denoised_log": _with(CURSOR) + "\nSELECT session_id, seq, type, ts_us, changed_tick FROM denoised",
    "top_files": _with(BASE, FOCUS) + """,
ranked AS (
  SELECT f.session_id, f.filename, f.seconds, s.distraction_seconds,
         row_number() OVER (PARTITION BY f.session_id ORDER BY f.seconds DESC, f.filename) AS rank
  FROM focus f JOIN focus_sum s USING (session_id) WHERE NOT f.distraction
)
SELECT session_id, CAST(rank AS BIGINT) AS rank, filename,
       CASE WHEN coalesce(filename, '') = '' THEN '.'
            WHEN regexp_replace(filename, '/+$', '') = '' THEN '/'
            ELSE regexp_extract(regexp_replace(filename, '/+$', ''), '[^/]*$') END AS base,
       seconds,
       round(CASE WHEN distraction_seconds + seconds = 0 THEN NULL
                  ELSE CAST(seconds AS DOUBLE) / CAST(distraction_seconds + seconds AS DOUBLE) * 100 END, 9) AS pct_vs_distraction
FROM ranked WHERE rank <= 10""",
    "report_blocks": _with(BASE, BLOCKS) + """
SELECT b.session_id, b.block_no, b.start_us, b.filename, b.closed_by,
       CAST(greatest(m.n - 50, 0) AS BIGINT) AS more_blocks
FROM blocks b JOIN (SELECT session_id, count(*) AS n FROM blocks GROUP BY session_id) m USING (session_id)
WHERE b.block_no <= 50""",
    "flow_block_ordinals": _with(BASE, BLOCKS) + f"""
SELECT session_id, block_no, CAST(row_number() OVER (PARTITION BY session_id ORDER BY block_no) AS BIGINT) AS ordinal
FROM blocks WHERE velocity > 0 AND velocity >= {FLOW}""",
    "idle_gap_ordinals": _with(BASE, GAPS) + """
SELECT session_id, end_seq, CAST(row_number() OVER (PARTITION BY session_id ORDER BY end_seq) AS BIGINT) AS ordinal
FROM gaps""",
    "correction_ordinals": _with(CORRECTIONS) + """
SELECT session_id, seq, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS ordinal
FROM corr""",
    "timeline_counts": _with(TIMELINE) + """
SELECT session_id, CAST(count(*) AS BIGINT) AS timeline_entries FROM tl GROUP BY session_id""",
    "store_events": _with() + """
SELECT session_id, seq, type, ts_us AS "timestamp", nullif(filename, '') AS filename,
       CAST(nullif(line, 0) AS DOUBLE) AS line, CAST(nullif("column", 0) AS DOUBLE) AS "column",
       CAST(nullif(line_count, 0) AS DOUBLE) AS line_count, CAST(nullif(changed_tick, 0) AS DOUBLE) AS changed_tick,
       nullif(file_type, '') AS file_type, nullif(message, '') AS message, nullif(level, '') AS level,
       nullif(command, '') AS command, nullif(note, '') AS note, CAST(nullif(prev_line, 0) AS DOUBLE) AS prev_line,
       CAST(nullif(prev_column, 0) AS DOUBLE) AS prev_column
FROM ev""",
    "captured_events": _with() + """
SELECT session_id, seq, type FROM ev
WHERE type <> 'lsp_diagnostic'
  AND CASE WHEN type IN ('file_edit', 'file_open') THEN coalesce(filename, '') <> ''
           WHEN type = 'annotation' THEN coalesce(note, '') <> '' ELSE true END""",
    "note_search": _with() + """
SELECT session_id, seq, note FROM ev WHERE type = 'annotation' AND regexp_matches(note, '(?i)(fix|debug)')""",
    "conversation_notes": """
SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, ' (the|und|que|les) ')""",
    "command_rejects": _with() + """,
bad AS (
  SELECT type, CASE type WHEN 'file_open' THEN '{broken ' || changed_tick
    WHEN 'lsp_diagnostic' THEN '{"id": ' || changed_tick || ', "command": "nope", "args": ["' || session_id || '"]}'
    WHEN 'terminal_command' THEN '{"id": ' || changed_tick || ', "command": "record-edit", "args": ["' || session_id || '"]}'
    WHEN 'annotation' THEN '{"id": ' || changed_tick || ', "command": "resume", "args": ["' || session_id || '"]}' END AS line
  FROM ev
)
SELECT line, CASE type WHEN 'file_open' THEN 'invalid json' WHEN 'lsp_diagnostic' THEN 'unknown command: nope'
  WHEN 'terminal_command' THEN 'record-edit requires 8 args' ELSE 'resume requires 2 args' END AS error
FROM bad WHERE line IS NOT NULL""",
    "logged_session_state": _with(LIFE, CEV, _on(STATE, "cev")) + "\nSELECT session_id, start_us, end_us, active FROM state2",
    "main_files_text": _with(BASE, FOCUS) + """
SELECT session_id, string_agg(filename || '=' || CAST(seconds AS VARCHAR), ';' ORDER BY filename) AS main_files
FROM focus WHERE NOT distraction GROUP BY session_id""",
    "session_lookup": _with() + """
SELECT session_id, seq, type, ts_us FROM ev WHERE session_id = (SELECT min(session_id) FROM ev)""",
    "type_filter": _with() + """
SELECT session_id, seq, type, 'keep' AS how FROM ev WHERE type IN ('file_edit', 'annotation')
UNION ALL SELECT session_id, seq, type, 'drop' FROM ev WHERE type NOT IN ('cursor_move', 'file_edit')""",
    "block_events": _with(BASE, BLOCKS) + """
SELECT session_id, seq, CAST(block_no AS BIGINT) AS block_no, changed_tick FROM bn""",
    "session_search": _with() + """
SELECT session_id, CAST(count(*) AS BIGINT) AS hits, min(seq) AS first_seq
FROM ev WHERE regexp_matches(filename, 'NvimTree|mod_1') GROUP BY session_id""",
    "cursor_cap": _with() + """
SELECT session_id, seq, type FROM (
  SELECT session_id, seq, type,
         row_number() OVER (PARTITION BY session_id, type = 'cursor_move' ORDER BY seq) AS r
  FROM ev) x
WHERE type <> 'cursor_move' OR r <= 5""",
    "command_log": _with(LIFE) + """
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts_us, cmd_id) - 1 AS BIGINT) AS seq,
       type, ts_us, filename, line, "column", line_count, changed_tick, note, command, file_type, message, level
FROM (
  SELECT session_id, changed_tick AS cmd_id, type, ts_us,
         CASE WHEN type IN ('file_edit', 'cursor_move', 'file_open', 'lsp_diagnostic') THEN nullif(filename, '') END AS filename,
         CAST(nullif(line, 0) AS DOUBLE) AS line, CAST(nullif("column", 0) AS DOUBLE) AS "column",
         CAST(nullif(line_count, 0) AS DOUBLE) AS line_count,
         CAST(CASE WHEN type = 'file_edit' THEN nullif(changed_tick, 0) END AS DOUBLE) AS changed_tick,
         nullif(note, '') AS note, nullif(command, '') AS command, nullif(file_type, '') AS file_type,
         nullif(message, '') AS message, nullif(level, '') AS level
  FROM ev WHERE type IN ('file_edit', 'terminal_command', 'cursor_move', 'file_open', 'lsp_diagnostic', 'annotation')
  UNION ALL
  SELECT session_id, -1, 'session_start', a - 1, NULL, NULL, NULL, NULL, NULL,
         'Started debugging session in /work/proj-' || session_id, NULL, NULL, NULL, NULL FROM life
  UNION ALL
  SELECT session_id, -2, 'session_end', z + 1, NULL, NULL, NULL, NULL, NULL,
         'Debugging session ended', NULL, NULL, NULL, NULL FROM life
) u""",
    "store_upsert": _with(LIFE) + """,
cmd AS (
  SELECT session_id, changed_tick AS cmd_id, type, ts_us, filename, changed_tick, note
  FROM ev WHERE type IN ('file_edit', 'terminal_command', 'cursor_move', 'file_open', 'lsp_diagnostic', 'annotation')
  UNION ALL SELECT session_id, -1, 'session_start', a - 1, NULL, NULL, 'Started debugging session in /work/proj-' || session_id FROM life
  UNION ALL SELECT session_id, -2, 'session_end', z + 1, NULL, NULL, 'Debugging session ended' FROM life
),
logged AS (
  SELECT c.session_id, CAST(row_number() OVER (PARTITION BY c.session_id ORDER BY c.ts_us, c.cmd_id) - 1 AS BIGINT) AS seq,
         c.type, c.ts_us AS "timestamp",
         CASE WHEN c.type IN ('file_edit', 'cursor_move', 'file_open', 'lsp_diagnostic') THEN nullif(c.filename, '') END AS filename,
         CAST(CASE WHEN c.type = 'file_edit' THEN nullif(c.changed_tick, 0) END AS DOUBLE) AS changed_tick,
         nullif(c.note, '') AS note
  FROM cmd c JOIN life l USING (session_id) WHERE l.fmt = 'sqlite'
)
SELECT session_id, seq, type, ts_us AS "timestamp", nullif(filename, '') AS filename,
       CAST(nullif(changed_tick, 0) AS DOUBLE) AS changed_tick, nullif(note, '') AS note
FROM ev WHERE session_id NOT IN (SELECT session_id FROM life WHERE fmt = 'sqlite')
UNION ALL
SELECT * FROM logged""",
    "stream_denoised": _with(LIFE, CEV, _on(CURSOR, "cev")) + """
SELECT session_id, seq, type, ts_us, CAST(changed_tick AS DOUBLE) AS changed_tick FROM denoised""",
    "stream_live_blocks": _with(LIFE, CEV, _on(BASE, "cev"), _on(BLOCKS, "cev")) + """
SELECT session_id, block_no, filename, start_us, end_us, event_count, start_tick, end_tick, delta_tick, velocity,
       closed_by FROM blocks""",
    "session_catalogue": _with() + r""",
ids AS (SELECT DISTINCT session_id, ascii(right(session_id, 1)) % 4 AS d FROM ev),
names AS (
  SELECT session_id || '_raw.json' AS file_name FROM ids WHERE d IN (0, 1)
  UNION ALL SELECT session_id || '.json' FROM ids WHERE d IN (1, 2, 3)
  UNION ALL SELECT session_id || '_export.json' FROM ids WHERE d = 3
),
named AS (
  SELECT file_name,
         CASE WHEN suffix(file_name, '_raw.json') THEN 0 WHEN suffix(file_name, '_export.json') THEN NULL
              WHEN suffix(file_name, '.json') THEN 1 END AS generation,
         regexp_replace(regexp_replace(file_name, '_raw\.json$', ''), '\.json$', '') AS session_id
  FROM names
)
SELECT session_id, arg_min(file_name, generation) AS file_name, CAST(min(generation) AS INTEGER) AS generation
FROM named WHERE generation IS NOT NULL GROUP BY session_id""",
    "recorder_ids": _with() + r""",
rid AS (
  SELECT session_id, CAST(CAST(floor(min(ts_us) / 1000000) AS BIGINT) AS VARCHAR) || '_proj' || session_id AS recorder_id
  FROM ev GROUP BY session_id
)
SELECT session_id, recorder_id,
       CAST(regexp_extract(recorder_id, '^(\d+)_(.*)$', 1) AS BIGINT) AS started_at_s,
       regexp_extract(recorder_id, '^(\d+)_(.*)$', 2) AS project
FROM rid""",
    "diagnostics_flat": _with() + """,
lines AS (SELECT session_id, seq AS lseq, ts_us, line, message, level FROM ev WHERE type = 'lsp_diagnostic'),
d AS (
  SELECT session_id, lseq, 0 AS i, ts_us, line, message, level FROM lines
  UNION ALL SELECT session_id, lseq, 1, ts_us, line, message || ' (hint)', 'HINT' FROM lines WHERE line % 2 = 0
)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY lseq, i) - 1 AS BIGINT) AS seq,
       'lsp_diagnostic' AS type, ts_us, line, message, level
FROM d""",
    "store_roundtrip": _with() + """
SELECT session_id, seq, type, ts_us, nullif(filename, '') AS filename, CAST(nullif(line, 0) AS DOUBLE) AS line,
       CAST(nullif(changed_tick, 0) AS DOUBLE) AS changed_tick, nullif(note, '') AS note
FROM ev""",
    "json_export": _with() + """
SELECT session_id, seq, type, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp",
       nullif(filename, '') AS filename, CAST(nullif(line, 0) AS DOUBLE) AS line,
       CAST(nullif(changed_tick, 0) AS DOUBLE) AS changed_tick, nullif(note, '') AS note
FROM ev""",
    "document_sessions": _with(STATE) + """
SELECT session_id, '/work/proj-' || session_id AS project_path, '/logs' AS save_path, 'json' AS output_format, start_us, end_us, active
FROM state2 WHERE session_id IS NOT NULL""",
    "document_events": _with() + """
SELECT session_id, seq, type, ts_us, nullif(filename, '') AS filename, CAST(nullif(line, 0) AS DOUBLE) AS line,
       CAST(nullif(changed_tick, 0) AS DOUBLE) AS changed_tick, nullif(note, '') AS note
FROM ev WHERE session_id IS NOT NULL""",
    "store_growth": _with() + """
SELECT session_id, seq, type, ts_us, nullif(filename, '') AS filename, CAST(nullif(line, 0) AS DOUBLE) AS line,
       CAST(nullif(changed_tick, 0) AS DOUBLE) AS changed_tick, nullif(note, '') AS note
FROM ev""",
    "stream_summaries": _stream_summaries(),
    "event_log": _with() + """
SELECT session_id, seq, type, ts_us, filename, changed_tick, note FROM ev""",
    "timeline_report": _timeline_report(),
    "summary_report": _summary_report(),
    "stats_report": _stats_report(),
    "error_corrections_intent": _with(BASE) + f""",
ann AS (
  SELECT session_id, seq AS a_seq, ts_us AS a_ts, filename AS a_filename,
         coalesce(nullif(filename, ''), active_file, '') AS a_file, note AS annotation
  FROM a WHERE type = 'annotation' AND seq > 0 AND ({KEYWORDS})
),
pairs AS (
  SELECT n.*, x.seq AS t_seq, coalesce(x.changed_tick, 0) AS tick,
         (x.type = 'file_edit' AND coalesce(x.filename, '') = n.a_file) AS hit,
         (n.a_ts - x.ts_us) > {LOOKBACK} AS old
  FROM ann n JOIN ev x ON x.session_id = n.session_id AND x.seq BETWEEN n.a_seq - {NBACK} AND n.a_seq - 1
),
st AS (
  SELECT *, bool_or(old) OVER (PARTITION BY session_id, a_seq ORDER BY t_seq DESC ROWS UNBOUNDED PRECEDING) AS stopped
  FROM pairs
),
hits AS (
  SELECT *, lag(tick) OVER (PARTITION BY session_id, a_seq ORDER BY t_seq DESC) AS later
  FROM st WHERE NOT stopped AND hit
)
SELECT session_id, a_seq AS seq, any_value(a_ts) AS ts_us, any_value(a_filename) AS filename,
       any_value(annotation) AS annotation, CAST(0 AS BIGINT) AS lines_deleted,
       CAST(sum(CASE WHEN later > 0 AND tick > later THEN tick - later ELSE 0 END) AS BIGINT) AS ticks_reversed,
       CAST(count(*) AS BIGINT) AS blocks_affected
FROM hits GROUP BY session_id, a_seq""",
    "command_log_sessions": _with(LIFE) + """
SELECT session_id, '/work/proj-' || session_id AS project_path, '/logs' AS save_path, fmt AS output_format FROM life""",
    "export_routes": _with(LIFE) + """
SELECT session_id, CASE fmt WHEN 'json' THEN 'json' WHEN 'sqlite' THEN 'store' ELSE 'markdown' END AS route FROM life""",
}

ORACLE["document_stats"] = ORACLE["session_stats"].replace(
    "CAST(NULL AS VARCHAR) AS project_path", "'/work/proj-' || s.session_id AS project_path") + " WHERE s.session_id IS NOT NULL"
