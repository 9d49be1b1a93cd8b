"""Report-side rankings: top files, first blocks, ordinals of listed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import base_name, pct_vs_distraction
from sessionlog.operators.focus import focus_summary
from sessionlog.operators.sequence import join_on, ordinal_within, top_k_per_group
from sessionlog.spark import materialize


def top_files(focus: DataFrame, agg: AggregationConfig = AggregationConfig(), exe: ExecConfig = ExecConfig(),
              summary: DataFrame | None = None) -> DataFrame:
    """Top ``agg.top_files`` main (non-distraction) files per session by seconds
    (ties by file name), with ``pct_vs_distraction`` = t / (distraction + t) * 100.
    ``summary``: a table with each session's distraction seconds, if the caller has one."""
    main = focus.filter(~F.col("distraction"))
    ranked = top_k_per_group(main, ["session_id"], [F.col("seconds").desc(), F.col("filename")], agg.top_files,
                             "filename", exe.topk_fanout)
    dist = (focus_summary(focus) if summary is None else summary).select("session_id", "distraction_seconds")
    return join_on(ranked, dist, ["session_id"], "left").select(
        "session_id", F.col("rank").cast("bigint").alias("rank"), "filename", base_name(F.col("filename")).alias("base"),
        "seconds", pct_vs_distraction(F.col("seconds"), F.coalesce("distraction_seconds", F.lit(0)))
        .alias("pct_vs_distraction"),
    )


def main_files_map(focus: DataFrame) -> DataFrame:
    """``file -> seconds`` map per session (the report model's map form; the
    long ``file_focus`` table is canonical).  The map holds one entry per
    distinct file of the session, so its size follows the number of files a
    session touched, not the number of events; for sessions that touch unbounded
    numbers of files use the long form.  Entries are ordered by file name."""
    return focus.filter(~F.col("distraction")).groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("filename", "seconds")))).alias("main_files"))


def report_blocks(blocks: DataFrame, agg: AggregationConfig = AggregationConfig()) -> tuple[DataFrame, DataFrame]:
    """First ``agg.report_blocks`` blocks per session (``block_no`` is already the
    dense ordinal) and the count of blocks beyond them.  Both read one written copy."""
    blocks = materialize(blocks, "blocks")
    first = blocks.filter(F.col("block_no") <= agg.report_blocks)
    more = blocks.groupBy("session_id").agg(
        F.greatest(F.count(F.lit(1)) - agg.report_blocks, F.lit(0)).cast("bigint").alias("more_blocks"))
    return first, more


def with_ordinal(df: DataFrame, order_col: str, exe: ExecConfig = ExecConfig(), out: str = "ordinal") -> DataFrame:
    """1-based position of each row in its session by ``order_col`` (flow blocks,
    corrections, idle gaps), chunked so a long session is not ranked in one task.
    The rows are written once; ranks and chunk counts read that copy."""
    df = materialize(df, "listed")
    return ordinal_within(df, ["session_id"], order_col, out, exe.chunk_rows)


def timeline_entry_counts(tl: DataFrame) -> DataFrame:
    """Number of grouped timeline entries per session."""
    return tl.groupBy("session_id").agg(F.count(F.lit(1)).alias("timeline_entries"))
