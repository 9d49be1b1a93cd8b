"""Activity blocks (merged bursts of edits) and the velocity metrics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import velocity
from sessionlog.operators.scan import scan

BLOCK_COLUMNS = [
    "session_id", "block_no", "filename", "start_us", "end_us", "duration_us", "event_count",
    "start_tick", "end_tick", "delta_tick", "velocity", "closed_by", "first_seq", "last_seq",
]


def activity_blocks(events: DataFrame, agg: AggregationConfig = AggregationConfig(),
                    exe: ExecConfig = ExecConfig(), scanned: DataFrame | None = None) -> DataFrame:
    """One row per block: an edit starts a block when it is the first edit, a
    closer (terminal command, file open) came after the previous edit, the file
    changed, or more than ``merge_window`` passed since the previous event of
    any type.  ``closed_by`` comes from what ended the block: a closer or file
    change (``context_switch``), the gap (``timeout``) or the end of the log
    (``session_end``).

    Aggregation is a single hash aggregate on ``(session_id, block_no)`` with
    partial aggregation, over block members plus *closer records*: the start
    edit of block b+1 reports its reason to block b, and every closer event
    reports ``context_switch`` to the block open at that moment.
    """
    s = scanned if scanned is not None else scan(events, agg, exe)
    is_edit = F.col("type") == "file_edit"
    is_trig = F.col("type").isin(*agg.block_closers)
    rec = F.struct
    entries = F.array(
        F.when(is_edit, rec(F.col("block_no").alias("k"), F.lit(True).alias("m"), F.lit(None).cast("string").alias("r"))),
        F.when(is_edit & F.col("block_reason").isin("context_switch", "timeout"),
               rec((F.col("block_no") - 1).alias("k"), F.lit(False).alias("m"), F.col("block_reason").alias("r"))),
        F.when(is_trig & (F.col("block_no") >= 1),
               rec(F.col("block_no").alias("k"), F.lit(False).alias("m"), F.lit("context_switch").alias("r"))),
    )
    x = (
        s.filter(is_edit | is_trig)
        .select("session_id", "seq", "ts_us", "filename", F.coalesce("changed_tick", F.lit(0)).alias("tick"),
                F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        .select("session_id", "seq", "ts_us", "filename", "tick",
                F.col("e.k").alias("block_no"), F.col("e.m").alias("m"), F.col("e.r").alias("r"))
    )
    mseq = F.when(F.col("m"), F.col("seq"))
    b = x.groupBy("session_id", "block_no").agg(
        F.min_by("filename", mseq).alias("filename"),
        F.min_by("ts_us", mseq).alias("start_us"),
        F.max_by("ts_us", mseq).alias("end_us"),
        F.count_if(F.col("m")).alias("event_count"),
        F.min_by("tick", mseq).alias("start_tick"),
        F.max_by("tick", mseq).alias("end_tick"),
        F.min(mseq).alias("first_seq"),
        F.max(mseq).alias("last_seq"),
        F.max((F.col("r") == "context_switch").cast("int")).alias("_cs"),
        F.max((F.col("r") == "timeout").cast("int")).alias("_to"),
    )
    dur = F.col("end_us") - F.col("start_us")
    delta = F.col("end_tick") - F.col("start_tick")
    return b.select(
        "session_id", "block_no", "filename", "start_us", "end_us", dur.alias("duration_us"), "event_count",
        "start_tick", "end_tick", delta.alias("delta_tick"), velocity(delta, dur).alias("velocity"),
        F.when(F.col("_cs") == 1, F.lit("context_switch")).when(F.col("_to") == 1, F.lit("timeout"))
        .otherwise(F.lit("session_end")).alias("closed_by"),
        "first_seq", "last_seq",
    )


def block_events(events: DataFrame, agg: AggregationConfig = AggregationConfig(),
                 exe: ExecConfig = ExecConfig()) -> DataFrame:
    """Edits tagged with their ``block_no`` (the long form of a block's nested event list)."""
    s = scan(events, agg, exe)
    return s.filter(F.col("type") == "file_edit").select(*events.columns, "block_no", "block_reason")


def velocity_metrics(blocks: DataFrame) -> DataFrame:
    """Mean and max of positive block velocities per session (0 when none)."""
    pos = F.when(F.col("velocity") > 0, F.col("velocity"))
    return blocks.groupBy("session_id").agg(
        F.coalesce(F.avg(pos), F.lit(0.0)).alias("avg_velocity"),
        F.coalesce(F.max(pos), F.lit(0.0)).alias("peak_velocity"),
        F.count(F.lit(1)).alias("n_blocks"),
    )


def flow_blocks(blocks: DataFrame, agg: AggregationConfig = AggregationConfig()) -> DataFrame:
    """Blocks whose (positive) velocity reaches the flow threshold."""
    return blocks.filter((F.col("velocity") > 0) & (F.col("velocity") >= F.lit(agg.flow_velocity)))
