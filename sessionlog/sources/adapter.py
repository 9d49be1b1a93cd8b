"""Map the driver's generic ``events`` table onto canonical editor events.

Driver schema: ``event_id, ts, user_id, event_type, value, props`` with
``props = {"k": 0..99}``.  The mapping is a fixed convention (the same one the
DuckDB oracle uses), so every operator can be checked at scale on real rows:

* ``session_id`` = ``user_id`` as text; ``seq`` = position by ``(ts, event_id)``
* click / view / purchase -> ``file_edit``; signup -> ``cursor_move`` (k<50),
  ``terminal_command`` (k<75) else ``file_open``; error -> ``annotation`` (k<50)
  else ``lsp_diagnostic``
* ``filename``: NULL for terminal commands, ``NvimTree_1`` when k%5=0, else
  ``src/mod_{k%2}.lua``; ``changed_tick`` = ``event_id``
* annotation notes: k%3=0 ``Fix bug k``, 1 ``note k``, 2 ``Debug issue k``
* payload of the other fields (our convention): ``line`` = k+1,
  ``column`` = k%8, ``line_count`` = 100+k, ``line_text`` = ``local v{k} = {event_id}``,
  ``command`` = ``make test-{k}``, ``file_type`` = ``lua``,
  ``message`` = ``undefined global v{k}``, ``level`` = ERROR (even k) / WARN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.functions.scalar import epoch_us
from sessionlog.operators.sequence import assign_seq
from sessionlog.schema import EVENT_COLUMNS


def canonical_from_driver(raw: DataFrame, materialize: bool = True, max_group_rows: int = 1 << 20) -> DataFrame:
    """Driver ``events`` rows -> canonical events, sequenced per session."""
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    typ = (
        F.when(et.isin("click", "view", "purchase"), F.lit("file_edit"))
        .when(et == "signup", F.when(k < 50, "cursor_move").when(k < 75, "terminal_command").otherwise("file_open"))
        .when(et == "error", F.when(k < 50, "annotation").otherwise("lsp_diagnostic"))
        .otherwise(et)
    )
    d = raw.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id"),
        F.col("ts"),
        epoch_us(F.col("ts"), raw.schema["ts"].dataType).alias("ts_us"),
        typ.alias("type"),
        k.alias("_k"),
        F.col("value"),
    )
    t, kk = F.col("type"), F.col("_k")
    has_pos = t.isin("file_edit", "cursor_move", "lsp_diagnostic")
    d = d.select(
        "session_id", "event_id", "type", "ts", "ts_us",
        F.when(t == "terminal_command", F.lit(None).cast("string"))
        .when(kk % 5 == 0, F.lit("NvimTree_1"))
        .otherwise(F.concat(F.lit("src/mod_"), (kk % 2).cast("string"), F.lit(".lua"))).alias("filename"),
        F.when(has_pos, kk + 1).cast("bigint").alias("line"),
        F.when(has_pos, kk % 8).cast("bigint").alias("column"),
        F.when(t == "file_edit", kk + 100).cast("bigint").alias("line_count"),
        F.col("event_id").cast("bigint").alias("changed_tick"),
        F.when(t == "file_edit", F.format_string("local v%d = %d", kk, F.col("event_id"))).alias("line_text"),
        F.when(t == "file_open", F.lit("lua")).alias("file_type"),
        F.when(t == "lsp_diagnostic", F.format_string("undefined global v%d", kk)).alias("message"),
        F.when(t == "lsp_diagnostic", F.when(kk % 2 == 0, "ERROR").otherwise("WARN")).alias("level"),
        F.when(t == "terminal_command", F.format_string("make test-%d", kk)).alias("command"),
        F.when(t == "annotation",
               F.when(kk % 3 == 0, F.format_string("Fix bug %d", kk))
               .when(kk % 3 == 1, F.format_string("note %d", kk))
               .otherwise(F.format_string("Debug issue %d", kk))).alias("note"),
        F.lit(None).cast("bigint").alias("prev_line"),
        F.lit(None).cast("bigint").alias("prev_column"),
    )
    d = assign_seq(d, "session_id", ["ts_us", "event_id"], materialize=materialize, max_group_rows=max_group_rows)
    return d.select(*EVENT_COLUMNS)


def load_driver_events(spark: SparkSession, sf_dir: str, materialize: bool = True,
                       max_group_rows: int = 1 << 20) -> DataFrame:
    """Read ``events.parquet`` of a test-data folder and map it."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return canonical_from_driver(raw, materialize=materialize, max_group_rows=max_group_rows)


# The same mapping as a DuckDB/ANSI SQL view, for the oracle side.
ORACLE_EVENTS_CTE = """
ev0 AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, ts,
         CAST(epoch_us(ts) AS BIGINT) AS ts_us, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type IN ('click','view','purchase') THEN 'file_edit'
              WHEN event_type = 'signup' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'cursor_move'
                                                   WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 75 THEN 'terminal_command'
                                                   ELSE 'file_open' END
              WHEN event_type = 'error' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'annotation'
                                                  ELSE 'lsp_diagnostic' END
              ELSE event_type END AS type
  FROM events
),
ev AS (
  SELECT session_id,
         CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts_us, event_id) - 1 AS BIGINT) AS seq,
         type, ts, ts_us,
         CASE WHEN type = 'terminal_command' THEN NULL
              WHEN k % 5 = 0 THEN 'NvimTree_1'
              ELSE 'src/mod_' || CAST(k % 2 AS VARCHAR) || '.lua' END AS filename,
         CASE WHEN type IN ('file_edit','cursor_move','lsp_diagnostic') THEN CAST(k + 1 AS BIGINT) END AS line,
         CASE WHEN type IN ('file_edit','cursor_move','lsp_diagnostic') THEN CAST(k % 8 AS BIGINT) END AS "column",
         CASE WHEN type = 'file_edit' THEN CAST(k + 100 AS BIGINT) END AS line_count,
         CAST(event_id AS BIGINT) AS changed_tick,
         CASE WHEN type = 'annotation' THEN CASE WHEN k % 3 = 0 THEN 'Fix bug ' || CAST(k AS VARCHAR)
                                                 WHEN k % 3 = 1 THEN 'note ' || CAST(k AS VARCHAR)
                                                 ELSE 'Debug issue ' || CAST(k AS VARCHAR) END END AS note,
         CASE WHEN type = 'terminal_command' THEN 'make test-' || CAST(k AS VARCHAR) END AS command,
         CASE WHEN type = 'file_edit' THEN 'local v' || CAST(k AS VARCHAR) || ' = ' || CAST(event_id AS VARCHAR) END AS line_text,
         CASE WHEN type = 'file_open' THEN 'lua' END AS file_type,
         CASE WHEN type = 'lsp_diagnostic' THEN 'undefined global v' || CAST(k AS VARCHAR) END AS message,
         CASE WHEN type = 'lsp_diagnostic' THEN CASE WHEN k % 2 = 0 THEN 'ERROR' ELSE 'WARN' END END AS level,
         CAST(NULL AS BIGINT) AS prev_line, CAST(NULL AS BIGINT) AS prev_column
  FROM ev0
)"""
