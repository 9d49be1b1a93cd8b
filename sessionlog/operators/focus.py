"""Focus time per file, distraction time and focus ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import is_distraction, secs_trunc
from sessionlog.operators.scan import scan


def file_focus(events: DataFrame, agg: AggregationConfig = AggregationConfig(), exe: ExecConfig = ExecConfig(),
               scanned: DataFrame | None = None) -> DataFrame:
    """Whole seconds per (session, file).

    Each interval between adjacent events goes to the last named file seen
    before the later event, truncated to whole seconds toward zero *before*
    summing; nothing is counted before the first named event.  Files summing
    to 0 s are kept.  ``distraction`` flags tool buffers (file tree, chat...).
    """
    s = scanned if scanned is not None else scan(events, agg, exe)
    return (
        s.filter(F.col("prev_ts_us").isNotNull() & F.col("active_file").isNotNull())
        .groupBy("session_id", F.col("active_file").alias("filename"))
        .agg(F.sum(secs_trunc(F.col("gap_us"))).alias("seconds"))
        .withColumn("distraction", is_distraction(F.col("filename"), agg.distraction_patterns))
    )


def focus_summary(focus: DataFrame) -> DataFrame:
    """Per session: main seconds, distraction seconds, focus ratio (0 when no time)."""
    d = F.col("distraction")
    s = focus.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(~d, F.col("seconds"))), F.lit(0)).alias("main_seconds"),
        F.coalesce(F.sum(F.when(d, F.col("seconds"))), F.lit(0)).alias("distraction_seconds"),
        F.count_if(~d).alias("main_files"),
    )
    tot = F.col("main_seconds") + F.col("distraction_seconds")
    return s.withColumn(
        "focus_ratio", F.when(tot > 0, F.col("main_seconds").cast("double") / tot.cast("double")).otherwise(F.lit(0.0))
    )
