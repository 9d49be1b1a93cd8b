"""The two-table relational copy (``sessions``, ``events``) and its upsert.

Store form: empty strings and zero integers are NULL (an absent field), the
event ``line_text`` is not stored, and ``created_at`` stamps the session row
when it is (re)written.  ``upsert`` replaces a session row and all its events
(existing minus key, plus new) and is idempotent per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.functions.scalar import epoch_us, us_to_ts
from sessionlog.operators.sequence import join_on
from sessionlog.sinks.replace import BUCKET_BYTES, BUCKETS, bucket_of, replace_sessions
from sessionlog.spark import materialize

STORE_EVENT_COLUMNS = [
    "session_id", "seq", "type", "timestamp", "filename", "line", "column", "line_count", "changed_tick",
    "file_type", "message", "level", "command", "note", "prev_line", "prev_column",
]
STORE_SESSION_COLUMNS = ["id", "project_path", "start_time", "end_time", "active", "output_format", "created_at"]
_STR = ["filename", "file_type", "message", "level", "command", "note"]
_INT = ["line", "column", "line_count", "changed_tick", "prev_line", "prev_column"]


def store_events(events: DataFrame) -> DataFrame:
    """Canonical events -> store rows (15 recorder columns + ``seq`` as row order)."""
    return events.select(
        "session_id", "seq", "type", us_to_ts(F.col("ts_us")).alias("timestamp"),
        *[F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c)).alias(c) for c in _STR[:1]],
        *[F.when(F.col(c) == 0, F.lit(None)).otherwise(F.col(c)).alias(c) for c in _INT[:4]],
        *[F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c)).alias(c) for c in _STR[1:]],
        *[F.when(F.col(c) == 0, F.lit(None)).otherwise(F.col(c)).alias(c) for c in _INT[4:]],
    ).select(*STORE_EVENT_COLUMNS)


def store_sessions(sessions: DataFrame) -> DataFrame:
    """``sessions`` -> store rows; ``created_at`` is the write time."""
    return sessions.select(
        F.col("session_id").alias("id"), "project_path", us_to_ts(F.col("start_us")).alias("start_time"),
        us_to_ts(F.col("end_us")).alias("end_time"), "active", "output_format",
        F.current_timestamp().alias("created_at"),
    )


def upsert(base_sessions: DataFrame, base_events: DataFrame, new_sessions: DataFrame,
           new_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace by key: sessions in ``new_sessions`` lose their old row and *all*
    their old events; everything else is kept.  The anti-joins use the (small)
    set of replaced ids as the build side."""
    ids = new_sessions.select(F.col("id").alias("session_id")).distinct()
    s = join_on(base_sessions, ids.withColumnRenamed("session_id", "id"), ["id"], "left_anti").unionByName(new_sessions)
    e = join_on(base_events, ids, ["session_id"], "left_anti").unionByName(new_events)
    return s, e


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scan of a written store: ``(sessions, events)`` back in canonical form."""
    s = spark.read.parquet(f"{path}/sessions")
    e = spark.read.parquet(f"{path}/events")
    st, et = s.schema["start_time"].dataType, e.schema["timestamp"].dataType
    sessions = s.select(F.col("id").alias("session_id"), "project_path", F.lit(None).cast("string").alias("save_path"),
                        "output_format", epoch_us(F.col("start_time"), st).alias("start_us"),
                        epoch_us(F.col("end_time"), st).alias("end_us"), "active")
    events = e.select("session_id", "seq", "type", F.col("timestamp").alias("ts"),
                      epoch_us(F.col("timestamp"), et).alias("ts_us"), "filename", "line", "column", "line_count",
                      "changed_tick", F.lit(None).cast("string").alias("line_text"), "file_type", "message", "level",
                      "command", "note", "prev_line", "prev_column")
    return sessions, events


def write_store(sessions: DataFrame, events: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write both tables anew; rows are partitioned by a hash bucket of the session id,
    so a session's rows live in one folder and a lookup prunes the rest."""
    (sessions.withColumn("bucket", bucket_of("id", buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/sessions"))
    (events.withColumn("bucket", bucket_of("session_id", buckets))
     .repartitionByRange("bucket", "session_id", "seq").sortWithinPartitions("bucket", "session_id", "seq")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events"))


def upsert_store(sessions: DataFrame, events: DataFrame, path: str, buckets: int = BUCKETS,
                 bucket_bytes: int = BUCKET_BYTES) -> None:
    """Replace the given sessions, with all their events, in a written store (a
    first call makes it).  Only the buckets of these sessions are rewritten;
    buckets are split as the tables grow."""
    sessions = materialize(sessions, "upsert-sessions")  # read for each table's ids and rows
    ids = sessions.select(F.col("id").alias("session_id"))
    replace_sessions(events, ids, f"{path}/events", ["session_id", "seq"], buckets=buckets, bucket_bytes=bucket_bytes)
    replace_sessions(sessions, sessions.select("id"), f"{path}/sessions", key="id", buckets=buckets, bucket_bytes=bucket_bytes)


def session_lookup(events: DataFrame, session_id: str) -> DataFrame:
    """Point lookup by id (pushed down to the scan as a filter)."""
    return events.filter(F.col("session_id") == F.lit(session_id))
