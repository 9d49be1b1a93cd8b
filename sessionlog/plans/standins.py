"""Stand-in inputs built from the driver tables (input shape only, no job logic).

``command_lines`` renders canonical events as the JSON-lines command log a
recorder would have written (``record-*`` / ``annotate`` commands, arrival time
``ts``), so the command-log reader can be exercised on every row of the
driver's ``events`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.scalar import us_to_ts

_CMD = {
    "file_edit": "record-edit", "terminal_command": "record-terminal", "cursor_move": "record-cursor",
    "file_open": "record-file-open", "lsp_diagnostic": "record-lsp-diagnostic", "annotation": "annotate",
}


# stand-in session metadata: project folder per session and one of the three output formats
FORMATS = ("markdown", "json", "sqlite")


def lifecycle_lines(events: DataFrame, save_path: str = "/logs") -> DataFrame:
    """``start`` one microsecond before a session's first event and ``end`` one
    microsecond after its last, as the recorder's CLI would have logged them."""
    span = events.groupBy("session_id").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    # format: code of the id's last character, modulo 3 (a rule SQL engines share)
    fmt = F.element_at(F.array(*[F.lit(f) for f in FORMATS]),
                       (F.pmod(F.ascii(F.substring("session_id", -1, 1)), F.lit(len(FORMATS))) + 1).cast("int"))
    ts = lambda c: F.date_format(us_to_ts(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    start = span.select("session_id", F.to_json(F.struct(
        F.lit(-1).cast("bigint").alias("id"), F.lit("start").alias("command"),
        F.array("session_id", F.concat(F.lit("/work/proj-"), "session_id"), F.lit(save_path), fmt).alias("args"),
        ts(F.col("a") - 1).alias("ts"))).alias("value"))
    end = span.select("session_id", F.to_json(F.struct(
        F.lit(-2).cast("bigint").alias("id"), F.lit("end").alias("command"),
        F.array("session_id", F.lit(save_path)).alias("args"), ts(F.col("z") + 1).alias("ts"))).alias("value"))
    return start.unionByName(end)


def command_lines(events: DataFrame, save_path: str = "/logs") -> DataFrame:
    """Events as ``record-*`` / ``annotate`` command lines (JSON, arrival time ``ts``)."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sid, sp = F.col("session_id"), F.lit(save_path)
    t = F.col("type")
    args = (
        F.when(t == "file_edit", F.array(sid, sp, s("filename"), s("line"), s("column"), s("line_count"),
                                         s("changed_tick"), s("line_text")))
        .when(t == "terminal_command", F.array(sid, sp, s("command")))
        .when(t == "cursor_move", F.array(sid, sp, s("filename"), s("line"), s("column")))
        .when(t == "file_open", F.array(sid, sp, s("filename"), s("file_type")))
        .when(t == "lsp_diagnostic", F.array(sid, sp, s("filename"), s("line"), s("column"), s("message"), s("level")))
        .when(t == "annotation", F.array(sid, sp, s("note")))
    )
    cmd = None
    for k, v in _CMD.items():
        cmd = F.when(t == k, F.lit(v)) if cmd is None else cmd.when(t == k, F.lit(v))
    rec = F.struct(F.col("changed_tick").alias("id"), cmd.alias("command"), args.alias("args"),
                   F.date_format(us_to_ts(F.col("ts_us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"))
    return events.filter(t.isin(*_CMD)).select("session_id", F.to_json(rec).alias("value"))


def bad_lines(events: DataFrame) -> DataFrame:
    """Lines no recorder accepts: broken JSON, an unknown command, too few arguments."""
    tick = F.col("changed_tick").cast("string")
    rest = lambda name: F.concat(F.lit('{"id": '), tick, F.lit(f', "command": "{name}", "args": ["'), "session_id", F.lit('"]}'))
    line = (F.when(F.col("type") == "file_open", F.concat(F.lit("{broken "), tick))
            .when(F.col("type") == "lsp_diagnostic", rest("nope"))
            .when(F.col("type") == "terminal_command", rest("record-edit"))
            .when(F.col("type") == "annotation", rest("resume")))
    return events.select("session_id", line.alias("value")).filter(F.col("value").isNotNull())


def resume_lines(rows: DataFrame, save_path: str = "/logs") -> DataFrame:
    """``end`` and ``resume`` one and two microseconds after the last of a session's ``rows``."""
    last = rows.groupBy("session_id").agg(F.max("ts_us").alias("z"))
    line = lambda number, command, after: F.to_json(F.struct(
        F.lit(number).cast("bigint").alias("id"), F.lit(command).alias("command"), F.array("session_id", F.lit(save_path)).alias("args"),
        F.date_format(us_to_ts(F.col("z") + after), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")))
    return last.select("session_id", F.explode(F.array(line(-3, "end", 1), line(-4, "resume", 2))).alias("value"))


def write_command_log(events: DataFrame, path: str, rounds: int = 3, files: int = 4, resumed: bool = False) -> None:
    """Command-log files in write order: each round appends the next part of every
    session's time (its start in the first, its end in the last), a session's lines
    in one file a round.  Sessions lie anywhere in time, so no round is ordered by time.
    With ``resumed``, each session also ends and resumes between its rounds."""
    span = events.groupBy("session_id").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    part = F.least(F.floor((F.col("ts_us") - F.col("a")) * rounds / (F.col("z") - F.col("a") + 1)), F.lit(rounds - 1))
    placed = events.join(span, "session_id").withColumn("part", part).drop("a", "z")
    life = lifecycle_lines(events)
    is_start = F.get_json_object("value", "$.command") == "start"
    for r in range(rounds):
        lines = command_lines(placed.filter(F.col("part") == r).drop("part"))
        if r == 0:
            lines = lines.unionByName(life.filter(is_start))
        if resumed and r < rounds - 1:
            later = placed.filter(F.col("part") > r).select("session_id").distinct()
            lines = lines.unionByName(resume_lines(placed.filter(F.col("part") == r).join(later, "session_id", "left_semi")))
        if r == rounds - 1:
            lines = lines.unionByName(life.filter(~is_start))
        lines.repartition(files, "session_id").select("value").write.mode("append").text(path)


def document_names(events: DataFrame) -> DataFrame:
    """File names a save folder would hold for the sessions of ``events``: every
    session has ``{id}_raw.json``; by the id's last digit some also keep a legacy
    ``{id}.json``, some only the legacy file, some an ``{id}_export.json``."""
    ids = events.select("session_id").distinct()
    d = F.pmod(F.ascii(F.substring("session_id", -1, 1)), F.lit(4))
    names = F.when(d == 0, F.array(F.concat("session_id", F.lit("_raw.json"))))
    names = (names.when(d == 1, F.array(F.concat("session_id", F.lit("_raw.json")), F.concat("session_id", F.lit(".json"))))
             .when(d == 2, F.array(F.concat("session_id", F.lit(".json"))))
             .otherwise(F.array(F.concat("session_id", F.lit(".json")), F.concat("session_id", F.lit("_export.json")))))
    return ids.select(F.explode(names).alias("file_name"))


def session_names(events: DataFrame) -> DataFrame:
    """Recorder-style ids ``<epoch seconds>_<project>`` for the sessions of ``events``
    (epoch of the first event, project ``proj<id>``)."""
    return events.groupBy("session_id").agg(F.min("ts_us").alias("a")).select(
        "session_id", F.concat(F.floor(F.col("a") / 1_000_000).cast("bigint").cast("string"),
                               F.lit("_proj"), F.col("session_id")).alias("recorder_id"))


def diagnostic_lines(events: DataFrame) -> DataFrame:
    """Editor lines carrying diagnostics: each ``lsp_diagnostic`` event becomes a
    line with its message plus, on even lines, a second hint diagnostic."""
    lsp = events.filter(F.col("type") == "lsp_diagnostic")
    first = F.struct(F.col("message").alias("message"), F.col("level").alias("severity"))
    hint = F.struct(F.concat(F.col("message"), F.lit(" (hint)")).alias("message"), F.lit("HINT").alias("severity"))
    diags = F.when(F.col("line") % 2 == 0, F.array(first, hint)).otherwise(F.array(first))
    return lsp.select("session_id", "seq", "ts", "ts_us", "filename", "line", "column", diags.alias("diagnostics"))
