"""Session documents (one JSON file per session) -> ``sessions`` and ``events``.

File naming: ``{id}_raw.json`` (current), ``{id}.json`` (legacy) and
``{id}_export.json`` (an export, never a source).  For each id the ``_raw``
file wins over the legacy one.  Nothing is listed or collected on the driver:
the catalogue is a DataFrame built from file metadata, and the choice of file
per id is a semi-join against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.functions.scalar import epoch_us, strip_session_suffix
from sessionlog.schema import EVENT_COLUMNS, SESSION_DOC_SCHEMA

RAW_SUFFIX = "_raw.json"
EXPORT_SUFFIX = "_export.json"


def _name_table(names: DataFrame, name_col: str = "file_name") -> DataFrame:
    """file name -> (session_id, generation); export files and non-JSON names dropped."""
    n = F.col(name_col)
    gen = F.when(n.endswith(RAW_SUFFIX), F.lit(0)).when(n.endswith(EXPORT_SUFFIX), F.lit(None)) \
        .when(n.endswith(".json"), F.lit(1))
    return names.select("*", strip_session_suffix(n).alias("session_id"), gen.alias("generation")) \
        .filter(F.col("generation").isNotNull())


def catalogue(names: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Catalogue over a table of file names: ``X_raw.json`` -> X; ``X.json`` -> X
    unless it is an export; every id once (``_raw`` preferred), in file-name order."""
    return pick_generation(_name_table(names, name_col)).orderBy(name_col)


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of the session documents in a folder (see :func:`catalogue`).
    File contents are not read (binary-file source without the content column)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
             .select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name")))
    return catalogue(files)


def pick_generation(named: DataFrame) -> DataFrame:
    """One row per ``session_id``: the ``_raw`` file if present, else the legacy one."""
    return named.groupBy("session_id").agg(
        F.min_by(F.struct(*[c for c in named.columns if c != "session_id"]), "generation").alias("f")
    ).select("session_id", "f.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents (one row per chosen file), with the file name kept.

    Unreadable files come back with a NULL ``id`` (PERMISSIVE) and are dropped,
    like the statistics command skipping sessions it cannot load."""
    docs = (spark.read.schema(SESSION_DOC_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("pathGlobFilter", "*.json").json(path)
            .withColumn("file_name", F.col("_metadata.file_name")))
    named = _name_table(docs)
    chosen = pick_generation(named.select("session_id", "file_name", "generation")).select("session_id", "file_name")
    return named.join(chosen, ["session_id", "file_name"], "left_semi").filter(F.col("id").isNotNull())


def _year1_null(c):
    return F.when(F.year(c) == 1, F.lit(None)).otherwise(c)


def sessions_table(docs: DataFrame) -> DataFrame:
    """``sessions(session_id, project_path, save_path, output_format, start_us, end_us, active)``;
    the zero end time of an unfinished session (year 1) becomes NULL."""
    ts_t = docs.schema["start_time"].dataType
    return docs.select(
        F.col("id").alias("session_id"), "project_path", "save_path", "output_format",
        epoch_us(_year1_null(F.col("start_time")), ts_t).alias("start_us"),
        epoch_us(_year1_null(F.col("end_time")), ts_t).alias("end_us"),
        F.coalesce(F.col("active"), F.lit(False)).alias("active"),
    )


def explode_events(docs: DataFrame) -> DataFrame:
    """Document -> canonical event rows; ``seq`` is the position in the array."""
    return event_columns(docs.select(F.col("id").alias("session_id"), F.posexplode("events").alias("seq", "e")))


def event_columns(x: DataFrame) -> DataFrame:
    """``(session_id, seq, e)``, ``e`` an event object of a document -> canonical event rows."""
    ts_t = x.schema["e"].dataType["timestamp"].dataType
    d = x.select(
        "session_id", F.col("seq").cast("bigint").alias("seq"), F.col("e.type").alias("type"),
        F.col("e.timestamp").alias("ts"), epoch_us(F.col("e.timestamp"), ts_t).alias("ts_us"),
        *[F.col(f"e.data.{c}").alias(c) for c in
          ["filename", "line", "column", "line_count", "changed_tick", "line_text", "file_type", "message", "level",
           "command", "note", "prev_line", "prev_column"]],
    )
    return d.select(*EVENT_COLUMNS)


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(sessions, events)`` from a folder of session documents."""
    docs = read_documents(spark, path)
    return sessions_table(docs), explode_events(docs)


def flatten_diagnostics(lines: DataFrame, materialize: bool = True) -> DataFrame:
    """One ``lsp_diagnostic`` event per diagnostic on a line; a line without
    diagnostics gives no event.  Input: ``session_id, seq, ts, ts_us, filename,
    line, column, diagnostics array<struct<message, severity>>``.  Output rows
    are re-sequenced per session by ``(line seq, position on the line)``."""
    from sessionlog.operators.sequence import assign_seq

    x = lines.select("*", F.posexplode("diagnostics").alias("i", "d"))
    d = x.select(
        "session_id", F.col("seq").alias("_line_seq"), "i", F.lit("lsp_diagnostic").alias("type"), "ts", "ts_us",
        "filename", "line", "column",
        F.lit(None).cast("bigint").alias("line_count"), F.lit(None).cast("bigint").alias("changed_tick"),
        F.lit(None).cast("string").alias("line_text"), F.lit(None).cast("string").alias("file_type"),
        F.col("d.message").alias("message"), F.col("d.severity").alias("level"),
        F.lit(None).cast("string").alias("command"), F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("bigint").alias("prev_line"), F.lit(None).cast("bigint").alias("prev_column"),
    )
    return assign_seq(d, "session_id", ["_line_seq", "i"], materialize=materialize).select(*EVENT_COLUMNS)
