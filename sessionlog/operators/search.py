"""Search and cap operators (predicates over the event table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.config import ExecConfig
from sessionlog.operators.sequence import ordinal_within


def search_notes(events: DataFrame, pattern: str = "Note") -> DataFrame:
    """Annotations whose note matches a (Java) regular expression."""
    return events.filter((F.col("type") == "annotation") & F.coalesce(F.col("note").rlike(pattern), F.lit(False)))


def search_sessions(events: DataFrame, pattern: str) -> DataFrame:
    """Sessions that touched a file whose name matches ``pattern``, with the hit count."""
    hit = F.coalesce(F.col("filename").rlike(pattern), F.lit(False))
    return events.filter(hit).groupBy("session_id").agg(F.count(F.lit(1)).alias("hits"),
                                                       F.min("seq").alias("first_seq"))


def search_lines(lines: DataFrame, pattern: str, col: str = "line") -> DataFrame:
    """Grep over rendered report lines (``session_id, sec, ord, sub, line``)."""
    return lines.filter(F.col(col).rlike(pattern))


def filter_types(events: DataFrame, keep=None, drop=None) -> DataFrame:
    """Keep or skip event types."""
    t = F.col("type")
    if keep is not None:
        events = events.filter(t.isin(*keep))
    if drop:
        events = events.filter(~t.isin(*drop))
    return events


def cap_cursor_events(events: DataFrame, max_cursor: int = 100, exe: ExecConfig = ExecConfig()) -> DataFrame:
    """Keep at most ``max_cursor`` cursor moves per session (the first ones); other
    events pass.  The rank is chunked, so a long session is not ranked in one task."""
    cur = ordinal_within(events.filter(F.col("type") == "cursor_move"), ["session_id"], "seq", "_r", exe.chunk_rows)
    kept = cur.filter(F.col("_r") <= max_cursor).drop("_r")
    return events.filter(F.col("type") != "cursor_move").unionByName(kept)
