"""Idle gaps: pauses longer than the idle threshold between adjacent events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.operators.scan import scan


def idle_gaps(events: DataFrame, agg: AggregationConfig = AggregationConfig(), exe: ExecConfig = ExecConfig(),
              scanned: DataFrame | None = None) -> DataFrame:
    """One row per gap strictly longer than ``idle_threshold`` (any event types)."""
    s = scanned if scanned is not None else scan(events, agg, exe)
    return s.filter(F.col("gap_us") > F.lit(agg.idle_threshold_us)).select(
        "session_id", F.col("seq").alias("end_seq"), F.col("prev_ts_us").alias("start_us"),
        F.col("ts_us").alias("end_us"), F.col("gap_us").alias("duration_us"),
    )


def idle_totals(gaps: DataFrame) -> DataFrame:
    """Idle gap count and summed duration per session."""
    return gaps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("idle_gaps"), F.sum("duration_us").alias("idle_total_us"),
    )
