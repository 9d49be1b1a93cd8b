"""Command log (JSON lines ``{"id", "command", "args", "ts"}``) -> events + rejects.

Works on a batch DataFrame of text lines (``spark.read.text``) or on a stream
(``spark.readStream.text``): parsing is row-local, so the same function serves
both.  ``ts`` is the arrival time stamped by the writer of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.scalar import epoch_us, start_note
from sessionlog.schema import COMMAND_SCHEMA, EVENT_COLUMNS

# Minimum number of arguments per command, in the recorder's order.
ARITY = {
    "start": 4, "end": 2, "annotate": 3, "record-edit": 8, "record-terminal": 3, "record-cursor": 5,
    "record-file-open": 4, "record-lsp-diagnostic": 7, "resume": 2, "list": 1,
}
# Fixed notes of the lifecycle events.
END_NOTE = "Debugging session ended"
RESUME_NOTE = "Session resumed"

_INT_TEXT = r"^[+-]?[0-9]+$"


def tolerant_int(s):
    """Text -> BIGINT like a strict integer parse whose error is ignored: anything
    that is not an optionally signed run of digits (blanks included) gives 0, a
    number out of range the largest or smallest BIGINT."""
    limit = F.when(s.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(s.rlike(_INT_TEXT), F.coalesce(s.try_cast("bigint"), limit)).otherwise(F.lit(0)).cast("bigint")


def parse_commands(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Text lines -> parsed commands with an ``error`` column (NULL when accepted).
    Empty lines are skipped."""
    v = F.col(value_col)
    p = lines.filter(F.length(F.trim(v)) > 0).select(
        v.alias("line"), F.from_json(v, COMMAND_SCHEMA).alias("c"))
    cmd, args = F.col("c.command"), F.coalesce(F.col("c.args"), F.array().cast("array<string>"))
    need = None
    for name, n in ARITY.items():
        need = F.when(cmd == name, F.lit(n)) if need is None else need.when(cmd == name, F.lit(n))
    err = (
        F.when(F.col("c").isNull() | F.col("c.command").isNull() & F.col("c.id").isNull(), F.lit("invalid json"))
        .when(need.isNull(), F.concat(F.lit("unknown command: "), F.coalesce(cmd, F.lit(""))))
        .when(F.size(args) < need,
              F.concat(cmd, F.lit(" requires "), need.cast("string"),
                       F.when(need == 1, F.lit(" arg")).otherwise(F.lit(" args"))))
    )
    return p.select("line", F.col("c.id").alias("id"), cmd.alias("command"), args.alias("args"),
                    F.col("c.ts").alias("ts"), err.alias("error"))


def command_events(parsed: DataFrame) -> DataFrame:
    """Accepted commands -> raw event rows (no ``seq`` yet; see :func:`read_command_log`).

    ``start``/``end``/``resume`` become lifecycle events with fixed notes; ``list``
    produces no event.  Numeric arguments go through :func:`tolerant_int`."""
    ok = parsed.filter(F.col("error").isNull() & (F.col("command") != "list"))
    a = lambda i: F.get(F.col("args"), i)
    c = F.col("command")
    typ = (F.when(c == "start", "session_start").when(c == "end", "session_end").when(c == "resume", "session_resume")
           .when(c == "annotate", "annotation").when(c == "record-edit", "file_edit")
           .when(c == "record-terminal", "terminal_command").when(c == "record-cursor", "cursor_move")
           .when(c == "record-file-open", "file_open").when(c == "record-lsp-diagnostic", "lsp_diagnostic"))
    has_file = c.isin("record-edit", "record-cursor", "record-file-open", "record-lsp-diagnostic")
    has_pos = c.isin("record-edit", "record-cursor", "record-lsp-diagnostic")
    blank = lambda col: F.when(col == "", F.lit(None)).otherwise(col)  # noqa: E731  ("" means absent)
    zero = lambda col: F.when(col == 0, F.lit(None)).otherwise(col)  # noqa: E731   (0 means absent)
    return ok.select(
        a(0).alias("session_id"), F.col("id").alias("cmd_id"), typ.alias("type"), F.col("ts"),
        epoch_us(F.col("ts"), parsed.schema["ts"].dataType).alias("ts_us"),
        F.when(has_file, blank(a(2))).alias("filename"),
        F.when(has_pos, zero(tolerant_int(a(3)))).alias("line"),
        F.when(has_pos, zero(tolerant_int(a(4)))).alias("column"),
        F.when(c == "record-edit", zero(tolerant_int(a(5)))).alias("line_count"),
        F.when(c == "record-edit", zero(tolerant_int(a(6)))).alias("changed_tick"),
        F.when(c == "record-edit", blank(a(7))).alias("line_text"),
        F.when(c == "record-file-open", blank(a(3))).alias("file_type"),
        F.when(c == "record-lsp-diagnostic", blank(a(5))).alias("message"),
        F.when(c == "record-lsp-diagnostic", blank(a(6))).alias("level"),
        F.when(c == "record-terminal", blank(a(2))).alias("command"),
        F.when(c == "annotate", blank(a(2))).when(c == "start", start_note(a(1)))
        .when(c == "end", F.lit(END_NOTE)).when(c == "resume", F.lit(RESUME_NOTE)).alias("note"),
        F.lit(None).cast("bigint").alias("prev_line"), F.lit(None).cast("bigint").alias("prev_column"),
        # session metadata carried by ``start``
        F.when(c == "start", a(1)).alias("project_path"), F.when(c == "start", a(2)).alias("save_path"),
        F.when(c == "start", a(3)).alias("output_format"),
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """Dead letters: ``id, command, error, line`` (the recorder's error responses)."""
    return parsed.filter(F.col("error").isNotNull()).select("id", "command", "error", "line")


def check_sessions(parsed: DataFrame, known_sessions: DataFrame) -> DataFrame:
    """Commands for a session that is neither in ``known_sessions`` (``session_id``,
    e.g. the catalogue) nor started in this log fail like a session that cannot be
    loaded.  ``start`` and ``list`` need no existing session.  One left join with
    the id table (AQE broadcasts it when small)."""
    sid = F.get(F.col("args"), 0)
    started = parsed.filter((F.col("command") == "start") & F.col("error").isNull()).select(
        sid.alias("session_id"))
    ok_ids = (started.unionByName(known_sessions.select("session_id")).distinct()
              .select(F.col("session_id").alias("_sid"), F.lit(True).alias("_known")))
    needs = F.col("error").isNull() & ~F.col("command").isin("start", "list")
    out = parsed.withColumn("_sid", sid).join(ok_ids, "_sid", "left")  # no id: no session, known or not
    return out.withColumn(
        "error", F.when(needs & F.col("_known").isNull(), F.concat(F.lit("session not found: "), F.coalesce("_sid", F.lit(""))))
        .otherwise(F.col("error"))).drop("_sid", "_known")


def read_command_log(lines: DataFrame, value_col: str = "value", max_group_rows: int = 1 << 20,
                     known_sessions: DataFrame | None = None):
    """Batch: ``(events, sessions_meta, rejects)``.  ``seq`` orders each session's
    events by arrival ``(ts, id)`` (skew-safe sequencing).  With ``known_sessions``
    commands for sessions that do not exist are rejected (see :func:`check_sessions`)."""
    from sessionlog.operators.sequence import assign_seq

    parsed = parse_commands(lines, value_col)
    if known_sessions is not None:
        parsed = check_sessions(parsed, known_sessions)
    raw = command_events(parsed)
    meta = raw.filter(F.col("type") == "session_start").groupBy("session_id").agg(
        F.min_by(F.struct("project_path", "save_path", "output_format"), F.struct("ts_us", "cmd_id")).alias("m"),
    ).select("session_id", "m.*")
    ev = assign_seq(raw.drop("project_path", "save_path", "output_format"), "session_id", ["ts_us", "cmd_id"],
                    max_group_rows=max_group_rows)
    return ev.select(*EVENT_COLUMNS), meta, rejects(parsed)


def apply_capture_filters(events: DataFrame, terminal_commands: bool = True, file_open: bool = True,
                          lsp_diagnostics: bool = True) -> DataFrame:
    """Capture-side rules: edits and opens need a file name, annotations a
    non-empty note (cursor moves and diagnostics are kept as they come); event
    kinds switched off in the ``log_events`` options are dropped."""
    t = F.col("type")
    named = F.coalesce(F.col("filename"), F.lit("")) != ""
    keep = (
        F.when(t.isin("file_edit", "file_open"), named)
        .when(t == "annotation", F.coalesce(F.col("note"), F.lit("")) != "")
        .otherwise(F.lit(True))
    )
    off = [k for k, on in (("terminal_command", terminal_commands), ("file_open", file_open),
                           ("lsp_diagnostic", lsp_diagnostics)) if not on]
    if off:
        keep = keep & ~t.isin(*off)
    return events.filter(keep)


def apply_capture(events: DataFrame, options, exe=None) -> DataFrame:
    """Apply a ``CaptureOptions`` (see ``config.from_options``): the capture filters,
    the ``log_events`` switches and, when set, the per-session cursor cap."""
    from sessionlog.config import ExecConfig
    from sessionlog.operators.search import cap_cursor_events

    out = apply_capture_filters(events, options.terminal_commands, options.file_open, options.lsp_diagnostics)
    if options.max_cursor_events is not None:
        out = cap_cursor_events(out, int(options.max_cursor_events), exe or ExecConfig())
    return out
