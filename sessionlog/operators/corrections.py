"""Error-correction patterns: keyword annotations and the edits just before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import has_error_keyword
from sessionlog.operators.scan import spans_chunks
from sessionlog.operators.sequence import join_on

KEY = ["session_id", "_chunk"]


def _with_halo(events: DataFrame, rows: int, chunk_rows: int) -> DataFrame:
    """Each row in its chunk, and again in every later chunk that begins within the next ``rows`` rows (``own`` false)."""
    chunk = f"CAST(seq AS BIGINT) div {int(chunk_rows)}"
    reach = F.expr(f"sequence({chunk}, (CAST(seq AS BIGINT) + {int(rows)}) div {int(chunk_rows)})")
    return events.select("*", F.explode(reach).alias("_chunk")).withColumn("own", F.expr(f"{chunk} = _chunk"))


def _files_before_chunks(events: DataFrame, chunk_rows: int) -> DataFrame:
    """(session_id, _chunk, carry_file): the last file named in the chunks before (a row for each chunk)."""
    named = F.when(F.col("filename") != "", F.col("seq"))
    chunks = events.groupBy("session_id", F.expr(f"CAST(seq AS BIGINT) div {int(chunk_rows)}").alias("_chunk")).agg(
        F.max_by("filename", named).alias("f"))
    before = Window.partitionBy("session_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(*KEY, F.last("f", ignorenulls=True).over(before).alias("carry_file"))


def error_corrections(events: DataFrame, agg: AggregationConfig = AggregationConfig(),
                      exe: ExecConfig = ExecConfig(), files_before: DataFrame | None = None) -> DataFrame:
    """For each annotation whose note holds an error keyword (and is not the
    first event), walk back over at most ``lookback_events`` events, stopping at
    the first one older than ``lookback_us``; edits on the annotation's file are
    the matches.  ``blocks_affected`` = matches, ``ticks_reversed`` = sum of
    ``later - earlier`` over adjacent matches (later > 0, earlier < later),
    ``lines_deleted`` = 0.  Only annotations with a match are returned.

    Events are exchanged once, by ``(session_id, seq div chunk_rows)``; a chunk
    also gets the last ``lookback_events`` rows before it (its halo).  A bounded
    frame tells each row which annotations look back on it, so lists are built for
    annotations alone, and their groups lie in the chunk already.

    ``files_before`` (session_id, file_before): the last file named before ``events``, for a
    log that is told in parts.
    """
    back = agg.lookback_events
    keyword = (F.col("type") == "annotation") & (F.col("seq") > 0) & has_error_keyword(F.col("note"), agg.error_keywords)
    slim = events.select("session_id", "seq", "ts_us", "filename", (F.col("type") == "file_edit").alias("edit"),
                         F.coalesce("changed_tick", F.lit(0)).alias("tick"), F.coalesce(keyword, F.lit(False)).alias("keyword"),
                         F.when(keyword, F.col("note")).alias("note"))
    rows = _with_halo(slim, back, exe.chunk_rows)
    by_seq = Window.partitionBy(*KEY).orderBy("seq")
    asks = F.col("keyword") & F.col("own")
    named = F.when(F.col("filename") != "", F.col("filename"))  # "" means absent
    rows = rows.select(
        *KEY, "seq", "ts_us", "filename", "note", "edit", "tick",
        (F.last(named, ignorenulls=True).over(by_seq.rowsBetween(Window.unboundedPreceding, -1))
         if agg.annotation_file == "last_active" else F.lit(None).cast("string")).alias("active"),
        F.concat(F.collect_list(F.when(asks, F.col("seq"))).over(by_seq.rowsBetween(1, max(back, 1))),
                 F.when(asks, F.array("seq")).otherwise(F.array().cast("array<bigint>"))).alias("asked"),
    )
    rows = rows.select("*", F.explode("asked").alias("a_seq")).filter(F.col("seq") >= F.col("a_seq") - back).drop("asked")
    self = F.col("seq") == F.col("a_seq")
    file = F.coalesce("filename", F.lit(""))
    g = rows.groupBy(*KEY, "a_seq").agg(
        F.max(F.when(self, F.col("ts_us"))).alias("a_ts"), F.max(F.when(self, F.col("filename"))).alias("a_filename"),
        F.max(F.when(self, F.col("note"))).alias("annotation"), F.max(F.when(self, F.col("active"))).alias("active"),
        F.sort_array(F.collect_list(F.when(~self, F.struct("seq", "ts_us", "edit", file.alias("file"), "tick"))), asc=False).alias("items"),
    )
    if agg.annotation_file == "last_active":
        if spans_chunks(events, exe.chunk_rows):
            g = join_on(g, _files_before_chunks(events, exe.chunk_rows), KEY, "left").withColumn("active", F.coalesce("active", "carry_file"))
        if files_before is not None:
            g = join_on(g, files_before, ["session_id"], "left").withColumn("active", F.coalesce("active", "file_before"))
        own_file = F.when(F.col("a_filename") != "", F.col("a_filename"))
        g = g.withColumn("a_file", F.coalesce(own_file, F.col("active"), F.lit("")))
    else:
        g = g.withColumn("a_file", F.coalesce("a_filename", F.lit("")))
    init = F.struct(F.lit(False).alias("stop"), F.lit(0).cast("bigint").alias("n"),
                    F.lit(0).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("rev"))

    def step(acc, x):
        old = (F.col("a_ts") - x["ts_us"]) > F.lit(agg.lookback_us)
        hit = x["edit"] & (x["file"] == F.col("a_file"))
        if agg.true_reversals:
            add = F.when((acc["last"] > 0) & (x["tick"] > acc["last"]), x["tick"] - acc["last"]).otherwise(0)
        else:
            add = F.when((acc["last"] > 0) & (x["tick"] < acc["last"]), acc["last"] - x["tick"]).otherwise(0)
        live = ~acc["stop"] & ~old
        return F.struct(
            (acc["stop"] | old).alias("stop"),
            (acc["n"] + F.when(live & hit, 1).otherwise(0)).alias("n"),
            F.when(live & hit, x["tick"]).otherwise(acc["last"]).alias("last"),
            (acc["rev"] + F.when(live & hit, add).otherwise(0)).alias("rev"),
        )

    folded = g.withColumn("f", F.aggregate("items", init, step))
    return folded.filter(F.col("f.n") > 0).select(
        "session_id", F.col("a_seq").alias("seq"), F.col("a_ts").alias("ts_us"), F.col("a_filename").alias("filename"),
        "annotation", F.lit(0).cast("bigint").alias("lines_deleted"),
        F.col("f.rev").cast("bigint").alias("ticks_reversed"), F.col("f.n").cast("bigint").alias("blocks_affected"),
    )
