"""Canonical schemas shared by batch and streaming paths."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, LongType, StringType, StructField, StructType, TimestampType,
)

# Column order of the canonical ``events`` table.  Key = (session_id, seq);
# ``ts_us`` is the event time as epoch microseconds and drives all arithmetic.
EVENT_COLUMNS = [
    "session_id", "seq", "type", "ts", "ts_us", "filename", "line", "column", "line_count", "changed_tick",
    "line_text", "file_type", "message", "level", "command", "note", "prev_line", "prev_column",
]

EVENT_SCHEMA = StructType([
    StructField("session_id", StringType()),
    StructField("seq", LongType()),
    StructField("type", StringType()),
    StructField("ts", TimestampType()),
    StructField("ts_us", LongType()),
    StructField("filename", StringType()),
    StructField("line", LongType()),
    StructField("column", LongType()),
    StructField("line_count", LongType()),
    StructField("changed_tick", LongType()),
    StructField("line_text", StringType()),
    StructField("file_type", StringType()),
    StructField("message", StringType()),
    StructField("level", StringType()),
    StructField("command", StringType()),
    StructField("note", StringType()),
    StructField("prev_line", LongType()),
    StructField("prev_column", LongType()),
])

# Payload of one event inside a session document (absent fields omitted).
EVENT_DATA_SCHEMA = StructType([
    StructField("filename", StringType()),
    StructField("line", LongType()),
    StructField("column", LongType()),
    StructField("line_count", LongType()),
    StructField("changed_tick", LongType()),
    StructField("line_text", StringType()),
    StructField("file_type", StringType()),
    StructField("message", StringType()),
    StructField("level", StringType()),
    StructField("command", StringType()),
    StructField("note", StringType()),
    StructField("prev_line", LongType()),
    StructField("prev_column", LongType()),
])

# One session document as written by the recorder (one JSON file per session).
SESSION_DOC_SCHEMA = StructType([
    StructField("id", StringType()),
    StructField("project_path", StringType()),
    StructField("save_path", StringType()),
    StructField("output_format", StringType()),
    StructField("start_time", TimestampType()),
    StructField("end_time", TimestampType()),
    StructField("events", ArrayType(StructType([
        StructField("type", StringType()),
        StructField("timestamp", TimestampType()),
        StructField("data", EVENT_DATA_SCHEMA),
    ]))),
    StructField("active", BooleanType()),
])

SESSIONS_COLUMNS = ["session_id", "project_path", "save_path", "output_format", "start_us", "end_us", "active"]

# One JSON line of the command log; ``ts`` is the arrival time stamped by the writer.
COMMAND_SCHEMA = StructType([
    StructField("id", LongType()),
    StructField("command", StringType()),
    StructField("args", ArrayType(StringType())),
    StructField("ts", TimestampType()),
])
