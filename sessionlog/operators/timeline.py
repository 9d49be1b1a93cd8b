"""Grouped timeline: consecutive edits of one file collapse into one entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import (
    clock, detail, edit_location, location, snippet, type_icon, type_title,
)
from sessionlog.operators.scan import scan

TIMELINE_COLUMNS = [
    "session_id", "entry_no", "type", "first_seq", "first_us", "last_us", "time_code", "time_intent", "icon",
    "title", "file", "location_code", "location_intent", "snippet_code", "snippet_intent", "details_code",
    "details_intent", "edit_count",
]


def timeline(events: DataFrame, agg: AggregationConfig = AggregationConfig(), exe: ExecConfig = ExecConfig(),
             scanned: DataFrame | None = None) -> DataFrame:
    """One row per timeline entry (``entry_no`` = 1-based position).

    Cursor moves are skipped; a run of consecutive ``file_edit`` rows on one
    file is one entry, every other event is its own entry.  ``*_code`` columns
    keep the first edit's time, location and snippet and the text ``1 edit``
    (what the recorder's report prints); ``*_intent`` columns carry the last
    edit's values and the real count.
    """
    s = scanned if scanned is not None else scan(events, agg, exe)
    nc = s.filter(F.col("type") != "cursor_move")
    is_edit = F.col("type") == "file_edit"
    info = F.struct(
        F.col("type").alias("type"), F.col("ts_us").alias("ts"), F.col("filename").alias("file"),
        F.when(is_edit, edit_location(F.col("line"), F.col("column")))
        .otherwise(location(F.col("filename"), F.col("line"))).alias("loc"),
        snippet(F.col("line_text")).alias("snip"),
        detail(F.col("type"), F.col("note"), F.col("message"), F.col("command"), F.col("file_type")).alias("det"),
    )
    g = nc.groupBy("session_id", "run_no").agg(
        F.min_by(info, F.col("seq")).alias("a"),
        F.max_by(info, F.col("seq")).alias("z"),
        F.max_by(F.col("line_text"), F.when(F.coalesce(F.col("line_text"), F.lit("")) != "", F.col("seq"))).alias("lt"),
        F.min("seq").alias("first_seq"),
        F.count_if(is_edit).alias("edit_count"),
    )
    a, z = F.col("a"), F.col("z")
    run_is_edit = a["type"] == "file_edit"
    n = F.col("edit_count")
    return g.select(
        "session_id", F.col("run_no").alias("entry_no"), a["type"].alias("type"), "first_seq",
        a["ts"].alias("first_us"), z["ts"].alias("last_us"),
        clock(a["ts"]).alias("time_code"), clock(z["ts"]).alias("time_intent"),
        type_icon(a["type"]).alias("icon"), type_title(a["type"]).alias("title"),
        F.coalesce(a["file"], F.lit("")).alias("file"),
        a["loc"].alias("location_code"), z["loc"].alias("location_intent"),
        a["snip"].alias("snippet_code"),
        F.when(F.col("lt").isNotNull(), snippet(F.col("lt"))).otherwise(a["snip"]).alias("snippet_intent"),
        F.when(run_is_edit, F.lit("1 edit")).otherwise(a["det"]).alias("details_code"),
        F.when(run_is_edit & (n > 1), F.format_string("%d edits", n))
        .when(run_is_edit, F.lit("1 edit")).otherwise(a["det"]).alias("details_intent"),
        "edit_count",
    )
