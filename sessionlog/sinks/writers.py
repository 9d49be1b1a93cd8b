"""Event-log and JSON exports, and the export router by ``output_format``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.operators.sequence import join_on
from sessionlog.functions.scalar import us_to_ts
from sessionlog.sinks.replace import BUCKETS, bucket_of, replace_sessions

_DATA_FIELDS = ["filename", "line", "column", "line_count", "changed_tick", "line_text", "file_type", "message",
                "level", "command", "note", "prev_line", "prev_column"]


def write_event_log(events: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Persist the canonical log (append by default), partitioned by session bucket.

    Rows are dealt by bucket and position first, so a call writes a few files a
    bucket instead of one for each task and bucket."""
    keys = ["bucket", "session_id", "seq"]
    (events.withColumn("bucket", bucket_of("session_id", buckets)).repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode(mode).partitionBy("bucket").parquet(path))


def event_json_lines(events: DataFrame) -> DataFrame:
    """One JSON object per event in the recorder's shape ``{"type", "timestamp",
    "data": {...}}`` after its session and position; absent (NULL/""/0) fields are omitted."""
    data = F.struct(*[
        (F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c)) if dict(events.dtypes)[c] == "string"
         else F.when(F.col(c) == 0, F.lit(None)).otherwise(F.col(c))).alias(c)
        for c in _DATA_FIELDS
    ])
    doc = F.struct(F.col("session_id"), F.col("seq"), F.col("type"), F.date_format(us_to_ts(F.col("ts_us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
                   .alias("timestamp"), data.alias("data"))
    return events.select("session_id", "seq", F.to_json(doc).alias("value"))


def export_json(events: DataFrame, sessions: DataFrame, path: str) -> None:
    """JSON export as JSON lines: ``events/bucket=B/part-*`` hold the events of the
    bucket's sessions in ``(session_id, seq)`` order (part files in name order),
    ``sessions/bucket=B`` one metadata object per session.  A session is never
    gathered into one row.  Sessions exported before stay, those of ``sessions`` are replaced."""
    ids = sessions.select("session_id")
    replace_sessions(event_json_lines(events), ids, f"{path}/events", ["session_id", "seq"], fmt="text",
                     read=lambda old: old.select(
                         F.get_json_object("value", "$.session_id").alias("session_id"),
                         F.get_json_object("value", "$.seq").cast("bigint").alias("seq"), "value", "bucket"),
                     write=lambda rows: rows.select("value", "bucket"))
    meta = sessions.select("session_id", F.to_json(F.struct(
        F.col("session_id").alias("id"), "project_path", "save_path", "output_format",
        us_to_ts(F.col("start_us")).alias("start_time"), us_to_ts(F.col("end_us")).alias("end_time"), "active")).alias("value"))
    replace_sessions(meta, ids, f"{path}/sessions", ["session_id"], fmt="text",
                     read=lambda old: old.select(F.get_json_object("value", "$.id").alias("session_id"), "value", "bucket"),
                     write=lambda rows: rows.select("value", "bucket"))


def route_by_format(sessions: DataFrame) -> dict[str, DataFrame]:
    """Export routing: ``json`` -> JSON export, ``sqlite`` -> relational store,
    anything else -> Markdown report.  Returns the session ids per route."""
    f = F.coalesce(F.col("output_format"), F.lit(""))
    return {
        "json": sessions.filter(f == "json").select("session_id"),
        "store": sessions.filter(f == "sqlite").select("session_id"),
        "markdown": sessions.filter(~f.isin("json", "sqlite")).select("session_id"),
    }


def export_all(sessions: DataFrame, events: DataFrame, path: str, report_lines: DataFrame | None = None) -> None:
    """Run every route for the sessions that asked for it (writer registry); what
    earlier calls exported for other sessions stays.  ``report_lines`` defaults to
    the timeline report of the sessions on the Markdown route."""
    from sessionlog.sinks.reports import timeline_report, write_report
    from sessionlog.sinks.store import store_events, store_sessions, upsert_store

    routes = route_by_format(sessions)
    own = {name: (join_on(sessions, ids, ["session_id"], "left_semi"), join_on(events, ids, ["session_id"], "left_semi"))
           for name, ids in routes.items()}
    export_json(own["json"][1], own["json"][0], f"{path}/json")
    upsert_store(store_sessions(own["store"][0]), store_events(own["store"][1]), f"{path}/store")
    lines = timeline_report(own["markdown"][1], own["markdown"][0]) if report_lines is None else report_lines
    write_report(join_on(lines, routes["markdown"], ["session_id"], "left_semi"), f"{path}/markdown", routes["markdown"])
