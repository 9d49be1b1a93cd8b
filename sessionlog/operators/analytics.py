"""Per-session analytics: the one-row summary behind the smart report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.operators.blocks import activity_blocks
from sessionlog.operators.corrections import error_corrections
from sessionlog.operators.focus import file_focus, focus_summary
from sessionlog.operators.scan import SCAN_INPUT, scan
from sessionlog.operators.sequence import join_on


def session_analytics(events: DataFrame, agg: AggregationConfig = AggregationConfig(),
                      exe: ExecConfig = ExecConfig(), scanned: DataFrame | None = None, blocks: DataFrame | None = None,
                      focus: DataFrame | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """avg/peak velocity, focus ratio, flow/idle/correction counts and idle total.

    All parts read one scanned copy of the log (one exchange on
    ``(session_id, chunk)``); each part is a per-session aggregate and they are
    joined on ``session_id`` from the session spine.  A caller that has blocks,
    focus or corrections already passes them in.
    """
    # read by three branches: materialize only the columns they use (no text payload)
    s = scanned if scanned is not None else scan(events.select(*SCAN_INPUT), agg, exe, materialize=True)
    # one aggregate over the scanned rows: spine (all events) + idle gaps
    gap = F.col("gap_us") > F.lit(agg.idle_threshold_us)
    spine = s.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(gap).alias("idle_gaps"),
        F.sum(F.when(gap, F.col("gap_us"))).alias("idle_total_us"),
    )
    # one aggregate over blocks: velocity metrics + flow count
    blocks = blocks if blocks is not None else activity_blocks(events, agg, exe, scanned=s)
    pos = F.when(F.col("velocity") > 0, F.col("velocity"))
    vel = blocks.groupBy("session_id").agg(
        F.avg(pos).alias("avg_velocity"), F.max(pos).alias("peak_velocity"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if((F.col("velocity") > 0) & (F.col("velocity") >= F.lit(agg.flow_velocity))).alias("flow_blocks"),
    )
    foc = focus_summary(focus if focus is not None else file_focus(events, agg, exe, scanned=s))
    corr = (corrections if corrections is not None else error_corrections(events, agg, exe)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("error_corrections"))
    j = spine
    for part in (vel, foc, corr):
        j = join_on(j, part, ["session_id"], "left")
    z = F.lit(0).cast("bigint")
    return j.select(
        "session_id", "total_events",
        F.coalesce("n_blocks", z).alias("activity_blocks"),
        F.coalesce("avg_velocity", F.lit(0.0)).alias("avg_velocity"),
        F.coalesce("peak_velocity", F.lit(0.0)).alias("peak_velocity"),
        F.coalesce("focus_ratio", F.lit(0.0)).alias("focus_ratio"),
        F.coalesce("distraction_seconds", z).alias("distraction_seconds"),
        F.coalesce("flow_blocks", z).alias("flow_blocks"),
        F.coalesce("idle_gaps", z).alias("idle_gaps"),
        F.coalesce("idle_total_us", z).alias("idle_total_us"),
        F.coalesce("error_corrections", z).alias("error_corrections"),
    )
