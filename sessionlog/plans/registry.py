"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver's ``events`` table (mapped by the adapter) and
runs the library operator over the whole table with the adapter-scaled
parameters (see ``sessionlog.config.ADAPTER_AGG``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlog.config import ADAPTER_AGG, ADAPTER_FILTER, TIGHT_FILTER, ExecConfig
from sessionlog.operators.analytics import session_analytics
from sessionlog.operators.blocks import BLOCK_COLUMNS, activity_blocks, flow_blocks, velocity_metrics
from sessionlog.operators.corrections import error_corrections
from sessionlog.operators.focus import file_focus, focus_summary
from sessionlog.operators.gaps import idle_gaps, idle_totals
from sessionlog.operators.sequence import join_on
from sessionlog.operators.stats import event_counts, session_state, session_stats
from sessionlog.operators.timeline import TIMELINE_COLUMNS, timeline
from sessionlog.sources.adapter import load_driver_events
from sessionlog.spark import materialize

EXE = ExecConfig()
CONVERSATION_PATTERN = " (the|und|que|les) "


NULLABLE_INTS = ["line", "column", "line_count", "changed_tick", "prev_line", "prev_column"]


def _as_double(df: DataFrame, cols) -> DataFrame:
    """Nullable integer outputs as DOUBLE (exact below 2**53): pandas turns a
    BIGINT column with NULLs into float64 on one side and nullable Int64 on the
    other, so both sides of the oracle check use DOUBLE for these columns."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_driver_events(spark, sf_dir)


def q_activity_blocks(spark, sf_dir):
    """Activity blocks with metrics and ``closed_by``."""
    return activity_blocks(_ev(spark, sf_dir), ADAPTER_AGG, EXE).select(*BLOCK_COLUMNS)


def q_velocity_metrics(spark, sf_dir):
    """Mean and peak positive block velocity per session."""
    v = velocity_metrics(activity_blocks(_ev(spark, sf_dir), ADAPTER_AGG, EXE))
    return v.select("session_id", F.round("avg_velocity", 9).alias("avg_velocity"), "peak_velocity", "n_blocks")


def q_flow_blocks(spark, sf_dir):
    """Blocks at or above the flow velocity."""
    return flow_blocks(activity_blocks(_ev(spark, sf_dir), ADAPTER_AGG, EXE), ADAPTER_AGG).select(
        "session_id", "block_no", "filename", "start_us", "duration_us", "delta_tick", "event_count", "velocity")


def q_idle_gaps(spark, sf_dir):
    """Pauses longer than the idle threshold."""
    return idle_gaps(_ev(spark, sf_dir), ADAPTER_AGG, EXE)


def q_idle_totals(spark, sf_dir):
    """Idle gap count and total per session."""
    return idle_totals(idle_gaps(_ev(spark, sf_dir), ADAPTER_AGG, EXE))


def q_file_focus(spark, sf_dir):
    """Whole seconds per file (forward-filled active file), distraction flag."""
    return file_focus(_ev(spark, sf_dir), ADAPTER_AGG, EXE)


def q_focus_summary(spark, sf_dir):
    """Main and distraction seconds and the focus ratio per session."""
    return focus_summary(file_focus(_ev(spark, sf_dir), ADAPTER_AGG, EXE))


def q_error_corrections(spark, sf_dir):
    """Keyword annotations with the edits just before them."""
    return error_corrections(_ev(spark, sf_dir), ADAPTER_AGG, EXE)


def q_timeline(spark, sf_dir):
    """Grouped timeline entries (recorder and intent columns)."""
    return timeline(_ev(spark, sf_dir), ADAPTER_AGG, EXE).select(*TIMELINE_COLUMNS)


def q_event_counts(spark, sf_dir):
    """Events per session and type."""
    return event_counts(_ev(spark, sf_dir))


def q_session_state(spark, sf_dir):
    """Session start, end and liveness from lifecycle events."""
    return session_state(_ev(spark, sf_dir))


def q_session_stats(spark, sf_dir):
    """Per-session statistics with edit/navigation percentages."""
    return session_stats(_ev(spark, sf_dir))


def q_session_analytics(spark, sf_dir):
    """One analytics row per session (the flagship)."""
    a = session_analytics(_ev(spark, sf_dir), ADAPTER_AGG, EXE)
    return a.withColumn("avg_velocity", F.round("avg_velocity", 9))


def q_cursor_filter(spark, sf_dir):
    """Surviving cursor moves with reason and the event they are recorded before."""
    from sessionlog.operators.denoise import cursor_decisions
    d = cursor_decisions(_ev(spark, sf_dir), ADAPTER_FILTER, EXE)
    return _as_double(d.filter(F.col("kept")).select("session_id", "seq", "reason", "flush_seq"), ["flush_seq"])


def q_cursor_filter_tight(spark, sf_dir):
    """The cursor filter with an idle time below twice the debounce."""
    from sessionlog.operators.denoise import cursor_decisions
    d = cursor_decisions(_ev(spark, sf_dir), TIGHT_FILTER, EXE)
    return _as_double(d.filter(F.col("kept")).select("session_id", "seq", "reason", "flush_seq"), ["flush_seq"])


def q_cursor_filter_drop(spark, sf_dir):
    """The cursor filter as the recorder's code runs it: idle moves are not recorded."""
    from dataclasses import replace

    from sessionlog.operators.denoise import cursor_decisions
    d = cursor_decisions(_ev(spark, sf_dir), replace(ADAPTER_FILTER, idle_commit="drop"), EXE)
    return _as_double(d.filter(F.col("kept")).select("session_id", "seq", "reason", "flush_seq"), ["flush_seq"])


def q_denoised_log(spark, sf_dir):
    """The re-sequenced log after the cursor filter."""
    from sessionlog.operators.denoise import cursor_filter
    return cursor_filter(_ev(spark, sf_dir), ADAPTER_FILTER, EXE).select("session_id", "seq", "type", "ts_us",
                                                                        "changed_tick")


def q_top_files(spark, sf_dir):
    """Top 10 main files per session with the share against distraction time."""
    from sessionlog.operators.topk import top_files
    t = top_files(file_focus(_ev(spark, sf_dir), ADAPTER_AGG, EXE), ADAPTER_AGG, EXE)
    return t.withColumn("pct_vs_distraction", F.round("pct_vs_distraction", 9))


def q_report_blocks(spark, sf_dir):
    """First 50 blocks per session and how many blocks follow them."""
    from sessionlog.operators.topk import report_blocks
    first, more = report_blocks(activity_blocks(_ev(spark, sf_dir), ADAPTER_AGG, EXE), ADAPTER_AGG)
    return first.select("session_id", "block_no", "start_us", "filename", "closed_by").transform(join_on, more, ["session_id"])


def q_flow_block_ordinals(spark, sf_dir):
    """Position of each flow block in its session's list."""
    from sessionlog.operators.topk import with_ordinal
    fb = flow_blocks(activity_blocks(_ev(spark, sf_dir), ADAPTER_AGG, EXE), ADAPTER_AGG)
    return with_ordinal(fb, "block_no", EXE).select("session_id", "block_no", "ordinal")


def q_idle_gap_ordinals(spark, sf_dir):
    """Position of each idle gap in its session's list."""
    from sessionlog.operators.topk import with_ordinal
    g = idle_gaps(_ev(spark, sf_dir), ADAPTER_AGG, EXE)
    return with_ordinal(g, "end_seq", EXE).select("session_id", "end_seq", "ordinal")


def q_correction_ordinals(spark, sf_dir):
    """Position of each correction in its session's list."""
    from sessionlog.operators.topk import with_ordinal
    c = error_corrections(_ev(spark, sf_dir), ADAPTER_AGG, EXE)
    return with_ordinal(c, "seq", EXE).select("session_id", "seq", "ordinal")


def q_timeline_counts(spark, sf_dir):
    """Number of timeline entries per session."""
    from sessionlog.operators.topk import timeline_entry_counts
    return timeline_entry_counts(timeline(_ev(spark, sf_dir), ADAPTER_AGG, EXE))


def q_store_events(spark, sf_dir):
    """Relational-store projection: the store's event columns plus ``seq``, ''/0 stored
    as NULL; the timestamp as epoch micros and nullable integers as DOUBLE."""
    from sessionlog.sinks.store import store_events
    from sessionlog.functions.scalar import epoch_us
    st = store_events(_ev(spark, sf_dir))
    st = st.withColumn("timestamp", epoch_us(F.col("timestamp"), st.schema["timestamp"].dataType))
    return _as_double(st, NULLABLE_INTS)


def q_captured_events(spark, sf_dir):
    """Capture filters with diagnostics switched off."""
    from sessionlog.sources.command_log import apply_capture_filters
    return apply_capture_filters(_ev(spark, sf_dir), lsp_diagnostics=False).select("session_id", "seq", "type")


def q_note_search(spark, sf_dir):
    """Annotations whose note matches a regular expression."""
    from sessionlog.operators.search import search_notes
    return search_notes(_ev(spark, sf_dir), "(?i)(fix|debug)").select("session_id", "seq", "note")


def q_conversation_notes(spark, sf_dir):
    """Note search over the conversations table (second text input): turns that name a step."""
    from sessionlog.operators.search import search_notes
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    notes = conv.select("conv_id", "turn", F.lit("annotation").alias("type"), F.col("text").alias("note"))
    return search_notes(notes, CONVERSATION_PATTERN).select("conv_id", "turn")


def q_cursor_cap(spark, sf_dir):
    """Per-session cap on recorded cursor moves (5): the capped log."""
    from sessionlog.operators.search import cap_cursor_events
    return cap_cursor_events(_ev(spark, sf_dir), 5, EXE).select("session_id", "seq", "type")


def q_command_log(spark, sf_dir):
    """Command-log reader over a log rendered from every driver event."""
    from sessionlog.plans.standins import command_lines, lifecycle_lines
    from sessionlog.sources.command_log import read_command_log
    src = _ev(spark, sf_dir)
    ev, _, rej = read_command_log(command_lines(src).unionByName(lifecycle_lines(src)))
    return _as_double(ev.select("session_id", "seq", "type", "ts_us", "filename", "line", "column", "line_count",
                                "changed_tick", "note", "command", "file_type", "message", "level"), NULLABLE_INTS)


def q_command_log_sessions(spark, sf_dir):
    """Session metadata carried by ``start`` commands of the command log."""
    from sessionlog.plans.standins import command_lines, lifecycle_lines
    from sessionlog.sources.command_log import read_command_log
    src = _ev(spark, sf_dir)
    _, meta, _ = read_command_log(command_lines(src).unionByName(lifecycle_lines(src)))
    return meta


def q_export_routes(spark, sf_dir):
    """Export routing by output format (json / store / markdown) of the logged sessions."""
    from sessionlog.plans.standins import command_lines, lifecycle_lines
    from sessionlog.sinks.writers import route_by_format
    from sessionlog.sources.command_log import read_command_log
    src = _ev(spark, sf_dir)
    _, meta, _ = read_command_log(command_lines(src).unionByName(lifecycle_lines(src)))
    routes = route_by_format(meta)
    out = None
    for name, ids in routes.items():
        part = ids.withColumn("route", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def q_store_upsert(spark, sf_dir):
    """Relational store on disk: written from the events table, then upserted twice with
    the sessions the command log routes to the store (their rows are replaced whole,
    and a repeated upsert changes nothing), and scanned back."""
    import uuid

    from sessionlog.operators.stats import session_state
    from sessionlog.plans.standins import command_lines, lifecycle_lines
    from sessionlog.sinks.store import store_events, store_sessions, upsert_store, write_store
    from sessionlog.sinks.writers import route_by_format
    from sessionlog.sources.command_log import read_command_log
    from sessionlog.spark import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    src = _ev(spark, sf_dir)
    base_s = store_sessions(session_state(src).select(
        "session_id", F.lit("/old").alias("project_path"), F.lit("/logs").alias("save_path"),
        F.lit("markdown").alias("output_format"), "start_us", "end_us", "active"))
    write_store(base_s, store_events(src), path)
    new_ev, meta, _ = read_command_log(command_lines(src).unionByName(lifecycle_lines(src)))
    meta = materialize(meta, "command-sessions")  # the log is routed once, whatever the upserts read of it
    ids = route_by_format(meta)["store"]
    new_s = store_sessions(join_on(join_on(session_state(new_ev), meta, ["session_id"]), ids, ["session_id"], "left_semi"))
    new_e = store_events(join_on(new_ev, ids, ["session_id"], "left_semi"))
    for _ in range(2):
        upsert_store(new_s, new_e, path)
    e = spark.read.parquet(f"{path}/events")
    from sessionlog.functions.scalar import epoch_us
    e = e.withColumn("timestamp", epoch_us(F.col("timestamp"), e.schema["timestamp"].dataType))
    return _as_double(e.select("session_id", "seq", "type", "timestamp", "filename", "changed_tick", "note"),
                      ["changed_tick"])


def _stream_to_table(spark, sf_dir, build, name, resumed=False):
    """Write the stand-in command log as text files in rounds, run ``build(raw_stream)``
    over them in several micro-batches (state goes from batch to batch, sessions lie out
    of time order) to a parquet sink until the input is drained, and read the sink back."""
    import uuid

    from sessionlog.plans.standins import write_command_log
    from sessionlog.spark import ensure_checkpoint_dir
    from sessionlog.streaming.pipelines import command_stream

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write_command_log(_ev(spark, sf_dir), f"{base}/log", resumed=resumed)
    raw, _ = command_stream(spark, f"{base}/log", max_files_per_trigger=3)
    q = (build(raw).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def q_stream_denoised(spark, sf_dir):
    """Streaming cursor filter (typed keyed state, timers) over the command log."""
    from sessionlog.streaming.processors import denoise_stream
    out = _stream_to_table(spark, sf_dir, lambda raw: denoise_stream(raw, ADAPTER_FILTER), "stream-denoise")
    return _as_double(out.select("session_id", "seq", "type", "ts_us", "changed_tick"), ["changed_tick"])


def q_stream_live_blocks(spark, sf_dir):
    """Streaming activity blocks (keyed state) over a command log whose sessions end and resume."""
    from sessionlog.streaming.processors import latest_blocks, live_blocks
    out = latest_blocks(_stream_to_table(spark, sf_dir, lambda raw: live_blocks(raw, ADAPTER_AGG), "stream-blocks", resumed=True))
    return out.select("session_id", "block_no", "filename", "start_us", "end_us", "event_count", "start_tick",
                      "end_tick", "delta_tick", "velocity", "closed_by")


def q_session_catalogue(spark, sf_dir):
    """Catalogue over the file names a save folder would hold (raw, legacy, export)."""
    from sessionlog.plans.standins import document_names
    from sessionlog.sources.documents import catalogue
    return catalogue(document_names(_ev(spark, sf_dir)))


def q_recorder_ids(spark, sf_dir):
    """``<epoch seconds>_<project>`` session ids parsed back into their parts."""
    from sessionlog.functions.scalar import parse_session_id
    from sessionlog.plans.standins import session_names
    n = session_names(_ev(spark, sf_dir))
    return n.select("session_id", "recorder_id", parse_session_id(F.col("recorder_id")).alias("p")).select(
        "session_id", "recorder_id", "p.started_at_s", "p.project")


def q_diagnostics_flat(spark, sf_dir):
    """One diagnostic event per diagnostic on an editor line, re-sequenced per session."""
    from sessionlog.plans.standins import diagnostic_lines
    from sessionlog.sources.documents import flatten_diagnostics
    d = flatten_diagnostics(diagnostic_lines(_ev(spark, sf_dir)))
    return d.select("session_id", "seq", "type", "ts_us", "line", "message", "level")


def q_store_roundtrip(spark, sf_dir):
    """Relational store written (bucketed by session) and scanned back."""
    import uuid

    from sessionlog.operators.stats import session_state
    from sessionlog.sinks.store import read_store, store_events, store_sessions, write_store
    from sessionlog.spark import ensure_checkpoint_dir
    src = _ev(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    meta = session_state(src).select("session_id", F.lit("/p").alias("project_path"), F.lit("/logs").alias("save_path"),
                                     F.lit("sqlite").alias("output_format"), "start_us", "end_us", "active")
    write_store(store_sessions(meta), store_events(src), path)
    _, e = read_store(spark, path)
    return _as_double(e.select("session_id", "seq", "type", "ts_us", "filename", "line", "changed_tick", "note"),
                      ["line", "changed_tick"])


def q_json_export(spark, sf_dir):
    """Per-session JSON-lines export written and read back (type, timestamp, payload)."""
    import uuid

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from sessionlog.operators.stats import session_state
    from sessionlog.sinks.writers import export_json
    from sessionlog.spark import ensure_checkpoint_dir
    src = _ev(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    meta = session_state(src).select("session_id", F.lit("/p").alias("project_path"), F.lit("/logs").alias("save_path"),
                                     F.lit("json").alias("output_format"), "start_us", "end_us", "active")
    export_json(src, meta, path)
    data = StructType([StructField("filename", StringType()), StructField("line", LongType()),
                       StructField("changed_tick", LongType()), StructField("note", StringType())])
    schema = StructType([StructField("session_id", StringType()), StructField("seq", LongType()),
                         StructField("type", StringType()), StructField("timestamp", StringType()),
                         StructField("data", data)])
    back = spark.read.schema(schema).json(f"{path}/events")
    return _as_double(back.select("session_id", "seq", "type", "timestamp", "data.filename", "data.line",
                                  "data.changed_tick", "data.note"), ["line", "changed_tick"])


def q_store_growth(spark, sf_dir):
    """Relational store that begins with two buckets and splits them as three upserts, by thirds of the sessions, make it grow."""
    import uuid

    from sessionlog.sinks.store import read_store, store_events, store_sessions, upsert_store
    from sessionlog.spark import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/growth-{uuid.uuid4().hex}"
    src = materialize(_ev(spark, sf_dir).withColumn("third", F.pmod(F.xxhash64("session_id"), F.lit(3))), "growth-source")
    for third in range(3):
        part = src.filter(F.col("third") == third)
        meta = session_state(part).select("session_id", F.lit("/p").alias("project_path"), F.lit("/logs").alias("save_path"),
                                          F.lit("sqlite").alias("output_format"), "start_us", "end_us", "active")
        upsert_store(store_sessions(meta), store_events(part), path, buckets=2, bucket_bytes=1 << 15)
    _, e = read_store(spark, path)
    return _as_double(e.select("session_id", "seq", "type", "ts_us", "filename", "line", "changed_tick", "note"), ["line", "changed_tick"])


def _documents(spark, sf_dir):
    """The events table written as one document a session, in pieces."""
    import uuid

    from sessionlog.sources.pieces import write_documents
    from sessionlog.spark import ensure_checkpoint_dir
    src = _ev(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    meta = session_state(src).select("session_id", F.concat(F.lit("/work/proj-"), "session_id").alias("project_path"),
                                     F.lit("/logs").alias("save_path"), F.lit("json").alias("output_format"), "start_us", "end_us", "active")
    write_documents(meta, src, path)
    return path


def q_document_sessions(spark, sf_dir):
    """Session rows of a folder of documents, read in bounded pieces."""
    from sessionlog.sources.pieces import read_sessions_in_pieces
    return read_sessions_in_pieces(spark, _documents(spark, sf_dir))[0]


def q_document_events(spark, sf_dir):
    """Events of a folder of documents with their places in the arrays, read in bounded pieces."""
    from sessionlog.sources.pieces import read_sessions_in_pieces
    events = read_sessions_in_pieces(spark, _documents(spark, sf_dir))[1]
    return _as_double(events.select("session_id", "seq", "type", "ts_us", "filename", "line", "changed_tick", "note"), ["line", "changed_tick"])


def q_document_stats(spark, sf_dir):
    """Statistics of every session with a document."""
    from sessionlog.sources.pieces import all_session_stats
    return all_session_stats(spark, _documents(spark, sf_dir))


def q_stream_summaries(spark, sf_dir):
    """Live path end to end: command stream -> cursor filter -> append-only event log
    (bucket-partitioned); the summary stream over that log runs once while the log is
    half written and once at the end; each session's summary row."""
    import uuid

    from sessionlog.plans.standins import write_command_log
    from sessionlog.spark import ensure_checkpoint_dir
    from sessionlog.streaming.pipelines import append_event_log, command_stream, latest_summaries, summary_refresh_query
    from sessionlog.streaming.processors import denoise_stream

    tag = uuid.uuid4().hex
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/live-{tag}"
    src = _ev(spark, sf_dir)
    middle = src.agg(F.expr("percentile_approx(ts_us, 0.5)")).first()[0] or 0
    drain = {"availableNow": True}
    # first the sessions that began early, then the others: the refresh in between sees part of the log
    early = F.min("ts_us").over(Window.partitionBy("session_id")) <= middle
    marked = materialize(src.withColumn("early", early), "live-source")
    for half in (F.col("early"), ~F.col("early")):
        write_command_log(marked.filter(half).drop("early"), f"{base}/cmd", rounds=2)
        raw, _ = command_stream(spark, f"{base}/cmd", max_files_per_trigger=4)
        append_event_log(denoise_stream(raw, ADAPTER_FILTER), f"{base}/log", name=f"log-{tag}", trigger=drain).awaitTermination()
        summary_refresh_query(spark, f"{base}/log", f"{base}/summaries", ADAPTER_AGG, EXE, name=f"sum-{tag}",
                              trigger=drain).awaitTermination()
    s = latest_summaries(spark, f"{base}/summaries")
    return s.select("session_id", "total_events", "activity_blocks", F.round("avg_velocity", 9).alias("avg_velocity"),
                    "peak_velocity", "focus_ratio", "distraction_seconds", "flow_blocks", "idle_gaps", "idle_total_us",
                    "error_corrections", "start_us", "end_us", "active")


def q_event_log(spark, sf_dir):
    """Canonical log persisted (bucket-partitioned parquet) and read back."""
    import uuid

    from sessionlog.sinks.writers import write_event_log
    from sessionlog.spark import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/event-log-{uuid.uuid4().hex}"
    write_event_log(_ev(spark, sf_dir), path, mode="overwrite")
    back = spark.read.parquet(path)
    return back.select("session_id", "seq", "type", "ts_us", "filename", "changed_tick", "note")


def q_error_corrections_intent(spark, sf_dir):
    """Corrections with the documented intent: the annotation's file is the last file
    active before it, and ticks count real reversals (later tick below an earlier one)."""
    from dataclasses import replace
    agg = replace(ADAPTER_AGG, annotation_file="last_active", true_reversals=True)
    return error_corrections(_ev(spark, sf_dir), agg, EXE)


def q_main_files_map(spark, sf_dir):
    """``file -> seconds`` map per session."""
    from sessionlog.operators.topk import main_files_map
    return main_files_map(file_focus(_ev(spark, sf_dir), ADAPTER_AGG, EXE))


def q_summary_report(spark, sf_dir):
    """Summary report line table."""
    from sessionlog.sinks.reports import summary_report
    return summary_report(_ev(spark, sf_dir), None, ADAPTER_AGG, EXE)


def q_timeline_report(spark, sf_dir):
    """Timeline report line table."""
    from sessionlog.sinks.reports import timeline_report
    return timeline_report(_ev(spark, sf_dir), None, ADAPTER_AGG, EXE)


def q_command_rejects(spark, sf_dir):
    """Command-log lines that are turned down, with the reason: some events of the log
    are followed by a broken line, an unknown command or a short one."""
    from sessionlog.plans.standins import bad_lines, command_lines
    from sessionlog.sources.command_log import parse_commands, rejects
    src = _ev(spark, sf_dir)
    log = command_lines(src).unionByName(bad_lines(src))
    return rejects(parse_commands(log)).select("line", "error")


def q_logged_session_state(spark, sf_dir):
    """Session start, end and liveness of the logged sessions (with lifecycle events)."""
    from sessionlog.plans.standins import command_lines, lifecycle_lines
    from sessionlog.sources.command_log import read_command_log
    src = _ev(spark, sf_dir)
    ev, _, _ = read_command_log(command_lines(src).unionByName(lifecycle_lines(src)))
    return session_state(ev)


def q_main_files_text(spark, sf_dir):
    """The main-files map of each session as ``file=seconds`` entries in file order."""
    from sessionlog.operators.topk import main_files_map
    entries = F.transform(F.map_entries("main_files"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    files = main_files_map(file_focus(_ev(spark, sf_dir), ADAPTER_AGG, EXE))
    return files.select("session_id", F.array_join(entries, ";").alias("main_files"))


def q_session_lookup(spark, sf_dir):
    """All events of one session, by its id (the smallest one as a text)."""
    from sessionlog.sinks.store import session_lookup
    ev = _ev(spark, sf_dir)
    return session_lookup(ev, ev.agg(F.min("session_id")).first()[0]).select("session_id", "seq", "type", "ts_us")


def q_type_filter(spark, sf_dir):
    """Events of kept types, and events but those of dropped types."""
    from sessionlog.operators.search import filter_types
    ev = _ev(spark, sf_dir)
    kept = filter_types(ev, keep=["file_edit", "annotation"]).withColumn("how", F.lit("keep"))
    return kept.unionByName(filter_types(ev, drop=["cursor_move", "file_edit"]).withColumn("how", F.lit("drop"))).select(
        "session_id", "seq", "type", "how")


def q_block_events(spark, sf_dir):
    """Edits with their block number (long form of each block's event list)."""
    from sessionlog.operators.blocks import block_events
    return block_events(_ev(spark, sf_dir), ADAPTER_AGG, EXE).select("session_id", "seq", "block_no", "changed_tick")


def q_session_search(spark, sf_dir):
    """Sessions that touched a file whose name matches a pattern."""
    from sessionlog.operators.search import search_sessions
    return search_sessions(_ev(spark, sf_dir), "NvimTree|mod_1")


def q_stats_report(spark, sf_dir):
    """Statistics text line table."""
    from sessionlog.sinks.reports import stats_report
    return stats_report(session_stats(_ev(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "activity_blocks": q_activity_blocks,
    "velocity_metrics": q_velocity_metrics,
    "flow_blocks": q_flow_blocks,
    "idle_gaps": q_idle_gaps,
    "idle_totals": q_idle_totals,
    "file_focus": q_file_focus,
    "focus_summary": q_focus_summary,
    "error_corrections": q_error_corrections,
    "timeline": q_timeline,
    "event_counts": q_event_counts,
    "session_state": q_session_state,
    "session_stats": q_session_stats,
    "session_analytics": q_session_analytics,
    "cursor_filter": q_cursor_filter,
    "cursor_filter_tight": q_cursor_filter_tight,
    "cursor_filter_drop": q_cursor_filter_drop,
    "denoised_log": q_denoised_log,
    "top_files": q_top_files,
    "report_blocks": q_report_blocks,
    "flow_block_ordinals": q_flow_block_ordinals,
    "idle_gap_ordinals": q_idle_gap_ordinals,
    "correction_ordinals": q_correction_ordinals,
    "timeline_counts": q_timeline_counts,
    "store_events": q_store_events,
    "captured_events": q_captured_events,
    "note_search": q_note_search,
    "conversation_notes": q_conversation_notes,
    "cursor_cap": q_cursor_cap,
    "command_log": q_command_log,
    "command_log_sessions": q_command_log_sessions,
    "export_routes": q_export_routes,
    "store_upsert": q_store_upsert,
    "stream_denoised": q_stream_denoised,
    "stream_live_blocks": q_stream_live_blocks,
    "session_catalogue": q_session_catalogue,
    "recorder_ids": q_recorder_ids,
    "diagnostics_flat": q_diagnostics_flat,
    "store_roundtrip": q_store_roundtrip,
    "json_export": q_json_export,
    "store_growth": q_store_growth,
    "document_sessions": q_document_sessions,
    "document_events": q_document_events,
    "document_stats": q_document_stats,
    "stream_summaries": q_stream_summaries,
    "event_log": q_event_log,
    "error_corrections_intent": q_error_corrections_intent,
    "main_files_map": q_main_files_map,
    "summary_report": q_summary_report,
    "timeline_report": q_timeline_report,
    "stats_report": q_stats_report,
    "command_rejects": q_command_rejects,
    "logged_session_state": q_logged_session_state,
    "main_files_text": q_main_files_text,
    "session_lookup": q_session_lookup,
    "type_filter": q_type_filter,
    "block_events": q_block_events,
    "session_search": q_session_search,
}
