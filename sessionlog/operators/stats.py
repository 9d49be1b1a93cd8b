"""Counts, per-session statistics and session state derived from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.scalar import edit_percent, nav_percent
from sessionlog.operators.sequence import join_on

LIFECYCLE = ("session_start", "session_resume", "session_end")


def event_counts(events: DataFrame) -> DataFrame:
    """Events per (session, type); hash aggregate with map-side partial counts."""
    return events.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"))


def session_state(events: DataFrame) -> DataFrame:
    """Session start, end and liveness from lifecycle events.

    start = first ``session_start`` (else the first event); active after a
    start/resume, inactive after an end; a resume keeps the earlier end time.
    A log without lifecycle events is taken as a finished session spanning its
    events.
    """
    t = F.col("type")
    life_seq = F.when(t.isin(*LIFECYCLE), F.col("seq"))
    g = events.groupBy("session_id").agg(
        F.min_by("ts_us", F.when(t == "session_start", F.col("seq"))).alias("_start"),
        F.min_by("ts_us", "seq").alias("_first"),
        F.max_by("ts_us", "seq").alias("_last"),
        F.max_by("ts_us", F.when(t == "session_end", F.col("seq"))).alias("_end"),
        F.max_by("type", life_seq).alias("_life"),
    )
    no_life = F.col("_life").isNull()
    return g.select(
        "session_id",
        F.coalesce("_start", "_first").alias("start_us"),
        F.when(no_life, F.col("_last")).otherwise(F.col("_end")).alias("end_us"),
        F.when(no_life, F.lit(False)).otherwise(F.col("_life") != "session_end").alias("active"),
    )


def session_stats(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Statistics per session: duration (finished sessions only), total events
    (all types) and counts of edits, terminal commands, annotations, cursor
    moves, file opens and diagnostics, plus the edit/navigation percentages.

    ``sessions`` (``session_id, project_path, start_us, end_us, active``) is the
    spine; sessions without events report zeros.  Without it the spine is
    derived from the log by :func:`session_state`.
    """
    t = F.col("type")
    counts = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(t == "file_edit").alias("file_edits"),
        F.count_if(t == "terminal_command").alias("terminal_commands"),
        F.count_if(t == "annotation").alias("annotations"),
        F.count_if(t == "cursor_move").alias("cursor_moves"),
        F.count_if(t == "file_open").alias("file_opens"),
        F.count_if(t == "lsp_diagnostic").alias("lsp_diagnostics"),
    )
    if sessions is None:
        sessions = session_state(events).withColumn("project_path", F.lit(None).cast("string"))
    spine = sessions.select("session_id", "project_path", "start_us", "end_us", "active")
    j = join_on(spine, counts, ["session_id"], "left")
    zero = F.lit(0).cast("bigint")
    cols = ["total_events", "file_edits", "terminal_commands", "annotations", "cursor_moves", "file_opens",
            "lsp_diagnostics"]
    j = j.select("session_id", "project_path", "start_us", "end_us", "active",
                 *[F.coalesce(F.col(c), zero).alias(c) for c in cols])
    return j.select(
        "session_id", "project_path",
        F.when(F.col("active"), F.lit("Active")).otherwise(F.lit("Completed")).alias("status"),
        F.when(~F.col("active") & F.col("end_us").isNotNull(), F.col("end_us") - F.col("start_us")).alias("duration_us"),
        *cols,
        edit_percent(F.col("file_edits"), F.col("cursor_moves")).alias("edit_pct"),
        nav_percent(F.col("file_edits"), F.col("cursor_moves")).alias("nav_pct"),
    )
