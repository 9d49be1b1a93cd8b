"""Streaming entry points: command-log ingest, event-log sink, periodic summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.operators.partials import INPUT, PARTS, extend, heads, rules_mark, summary
from sessionlog.operators.sequence import join_on
from sessionlog.schema import EVENT_SCHEMA
from sessionlog.sinks.replace import bucket_of, replace_sessions, stored_sessions
from sessionlog.sources.command_log import command_events, parse_commands, rejects
from sessionlog.spark import ensure_checkpoint_dir, materialize


def command_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> tuple[DataFrame, DataFrame]:
    """``readStream.text`` over a folder of JSON-lines command logs ->
    ``(raw events, rejects)`` streams (parsing is row-local)."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    parsed = parse_commands(lines)
    return command_events(parsed), rejects(parsed)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """Streaming checkpoints live under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def append_event_log(events: DataFrame, path: str, name: str = "event_log", trigger: dict | None = None):
    """Append-only event log sink (parquet, exactly-once through the checkpoint),
    partitioned by session bucket so readers of a few sessions prune the rest."""
    w = (events.withColumn("bucket", bucket_of()).repartition("bucket").writeStream.format("parquet").option("path", path)
         .partitionBy("bucket")
         .option("checkpointLocation", checkpoint_location(events.sparkSession, name)).outputMode("append"))
    w = w.trigger(**(trigger or {"processingTime": "5 seconds"}))
    return w.start()


def log_stream(spark: SparkSession, log_path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The rows appended to the stored event log, as a stream.  (The log's folder must exist.)"""
    schema = StructType([*EVENT_SCHEMA.fields, StructField("bucket", LongType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(log_path)


def refresh_summaries(log_path: str, out_path: str, agg: AggregationConfig = AggregationConfig(),
                      exe: ExecConfig = ExecConfig()):
    """``foreachBatch`` body: put the micro-batch's rows onto the parts of their sessions
    (:mod:`sessionlog.operators.partials`, kept at ``<out_path>_parts``) and replace these
    sessions' rows in the summary table, which holds one row a session.

    A refresh reads the new rows and the touched buckets of the parts.  The log itself
    is read only for sessions whose rows don't follow on their parts: files that come out
    of order, or parts made by other rules; these are made anew from all their rows.  Rows
    that the parts hold already (a batch told again) change nothing.
    """
    parts_path = f"{out_path}_parts"

    def body(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch.select(*INPUT), "new-rows")
        touched = batch.select("session_id").distinct()
        parts = stored_sessions(spark, touched, parts_path, PARTS).filter(F.col("rules") == rules_mark(agg))
        ends = heads(parts).select("session_id", "upto")
        fresh = join_on(batch, ends, ["session_id"], "left").filter(F.col("seq") > F.coalesce("upto", F.lit(-1)))
        fresh = materialize(fresh, "fresh-rows")
        found = fresh.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.max("upto").alias("upto"))
        follows = (F.col("lo") == F.coalesce("upto", F.lit(-1)) + 1) & (F.col("hi") - F.col("lo") + 1 == F.col("n"))
        apart = materialize(found.filter(~follows).select("session_id"), "apart")
        rows, known = fresh.select(*INPUT), parts
        if not apart.isEmpty():
            log = _log_of(spark, log_path, apart).select(*INPUT)
            rows = join_on(rows, apart, ["session_id"], "left_anti").unionByName(log)
            known = join_on(parts, apart, ["session_id"], "left_anti")
        replace_sessions(extend(known, rows, agg, exe), found.select("session_id"), parts_path)
        # of all touched sessions, should the last call have ended between the two tables
        replace_sessions(summary(stored_sessions(spark, touched, parts_path, PARTS), agg), touched, out_path)

    return body


def _log_of(spark: SparkSession, log_path: str, ids: DataFrame) -> DataFrame:
    """The stored rows of some sessions; joining on the partition column lets Spark skip the other buckets."""
    log = spark.read.parquet(log_path)
    ids = ids.select(F.col("session_id").alias("_id"), bucket_of().alias("_bucket"))
    return log.join(ids, (log["bucket"] == ids["_bucket"]) & log["session_id"].eqNullSafe(ids["_id"]), "left_semi").drop("bucket")


def summary_refresh_query(spark: SparkSession, log_path: str, out_path: str, agg: AggregationConfig = AggregationConfig(),
                          exe: ExecConfig = ExecConfig(), every: str = "5 minutes", name: str = "summaries",
                          trigger: dict | None = None):
    """The periodic summary: ``trigger(processingTime=every)`` + ``foreachBatch`` over
    the stored event log itself, so rows that are appended later are summarised later,
    in whatever order the queries run (``trigger`` overrides, e.g. ``{"availableNow":
    True}`` for a catch-up run at the end)."""
    return (log_stream(spark, log_path).writeStream.foreachBatch(refresh_summaries(log_path, out_path, agg, exe))
            .option("checkpointLocation", checkpoint_location(spark, name))
            .trigger(**(trigger or {"processingTime": every})).start())


def latest_summaries(spark: SparkSession, out_path: str) -> DataFrame:
    """The summary table: each session's row."""
    return spark.read.parquet(out_path).drop("bucket")
