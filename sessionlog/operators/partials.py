"""Summaries that grow with the log: what a session's rows so far leave behind for the rows to come.

``extend`` puts new rows onto the parts of the rows before them and returns the
parts of all; ``summary`` turns parts into the numbers of
:func:`~sessionlog.operators.analytics.session_analytics` and
:func:`~sessionlog.operators.stats.session_state`.  Any cut of a session into
consecutive pieces gives the same parts, so a refresh reads the new rows and the
touched sessions' parts, never the log.

Parts are rows ``(session_id, kind, upto, rules, ...)``:

``head``  one a session: totals, the carry of the ordered pass (as a chunk summary), the
          open block and the sums over the closed ones, lifecycle
``file``  one a focused file: whole seconds
``tail``  the last ``lookback_events`` rows, which later annotations look back on

``upto`` is the last ``seq`` that the parts hold, ``rules`` a mark of the rules
they were made by.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.functions.scalar import is_distraction, secs_trunc, velocity
from sessionlog.operators.corrections import error_corrections
from sessionlog.operators.focus import focus_summary
from sessionlog.operators.scan import SCAN_INPUT, scan
from sessionlog.operators.sequence import join_on
from sessionlog.operators.stats import LIFECYCLE

#: The columns of events that parts are made from.
INPUT = [*SCAN_INPUT, "note"]

_POINT = "struct<seq: bigint, ts_us: bigint, tick: bigint>"
_AT = "struct<seq: bigint, ts_us: bigint>"
_HEAD = {
    "total_events": "bigint", "idle_gaps": "bigint", "idle_total_us": "bigint", "corrections": "bigint",
    # the ordered pass goes on from here (names of a chunk summary)
    "n_trig": "bigint", "last_ts": "bigint", "last_edit": "struct<t: bigint, f: string>", "n_lstarts": "bigint",
    "last_file": "string", "last_nc": "struct<e: boolean, f: string>", "n_lruns": "bigint",
    # blocks: the open one, and sums over those that have an end
    "open": f"struct<block_no: bigint, first: {_POINT}, last: {_POINT}>",
    "blocks": "bigint", "flow": "bigint", "moving": "bigint", "velocity_sum": "double", "velocity_max": "double",
    # lifecycle
    "first": _AT, "last": _AT, "start": _AT, "end": _AT, "life": "string",
}
_TAIL = "struct<seq: bigint, type: string, ts_us: bigint, filename: string, changed_tick: bigint>"
PARTS = ("session_id string, kind string, upto bigint, rules bigint, head struct<"
         + ", ".join(f"`{k}`: {t}" for k, t in _HEAD.items()) + f">, filename string, seconds bigint, tail {_TAIL}")


def rules_mark(agg: AggregationConfig) -> int:
    """Parts made by other rules can't be extended: this tells them apart."""
    return zlib.crc32(repr(agg).encode())


def no_parts(spark) -> DataFrame:
    return spark.createDataFrame([], PARTS)


def heads(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("kind") == "head").select("session_id", "upto", "head.*")


def _speed(first, last):
    return velocity(last["tick"] - first["tick"], last["ts_us"] - first["ts_us"])


def _block_sums(s: DataFrame, old: DataFrame, agg: AggregationConfig) -> DataFrame:
    """Per session: the open block and sums over the blocks that ended in these rows."""
    edits = s.filter(F.col("type") == "file_edit")
    point = F.struct("seq", "ts_us", F.coalesce("changed_tick", F.lit(0)).cast("bigint").alias("tick"))
    # A block's first edit tells the block before it that it has ended.
    ended = F.when(F.col("block_reason").isNotNull() & (F.col("block_no") > 1), F.struct((F.col("block_no") - 1).alias("k"), F.lit(None).cast(_POINT).alias("p")))
    member = F.struct(F.col("block_no").alias("k"), point.alias("p"))
    rows = edits.select("session_id", F.explode(F.filter(F.array(member, ended), lambda e: e.isNotNull())).alias("e"))
    rows = rows.select("session_id", F.col("e.k").alias("block_no"), F.col("e.p").alias("first"), F.col("e.p").alias("last"), F.col("e.p").isNull().alias("ended"))
    opened = old.filter(F.col("open").isNotNull()).select("session_id", "open.*", F.lit(False).alias("ended"))
    blocks = rows.unionByName(opened).groupBy("session_id", "block_no").agg(
        F.min_by("first", F.col("first.seq")).alias("first"), F.max_by("last", F.col("last.seq")).alias("last"), F.max("ended").alias("ended"))
    blocks = blocks.withColumn("v", _speed(F.col("first"), F.col("last")))
    pos = F.when(F.col("ended") & (F.col("v") > 0), F.col("v"))
    return blocks.groupBy("session_id").agg(
        F.max_by(F.struct("block_no", "first", "last"), F.when(~F.col("ended"), F.col("block_no"))).alias("open"),
        F.count_if("ended").alias("blocks"), F.count_if(pos >= F.lit(agg.flow_velocity)).alias("flow"),
        F.count(pos).alias("moving"), F.sum(pos).alias("velocity_sum"), F.max(pos).alias("velocity_max"))


def extend(parts: DataFrame, rows: DataFrame, agg: AggregationConfig = AggregationConfig(),
           exe: ExecConfig = ExecConfig()) -> DataFrame:
    """The parts of the sessions in ``rows``, their old parts put together with the rows.

    ``rows`` go on where the old parts end: the first ``seq`` of a session is its
    ``upto + 1`` (0 without parts).  Sessions without rows aren't returned.
    """
    ids = rows.select("session_id").distinct()
    old = heads(parts)
    s = scan(rows.select(*SCAN_INPUT), agg, exe, materialize=True, seed=old.drop("upto"))
    t, seq = F.col("type"), F.col("seq")
    file = F.coalesce("filename", F.lit(""))
    edit, move = t == "file_edit", t == "cursor_move"
    idle = F.col("gap_us") > F.lit(agg.idle_threshold_us)
    at = F.struct("seq", "ts_us")
    new = s.groupBy("session_id").agg(
        F.max("seq").alias("upto"), F.count(F.lit(1)).alias("total_events"), F.count_if(idle).alias("idle_gaps"),
        F.sum(F.when(idle, F.col("gap_us"))).alias("idle_total_us"),
        F.max("trig").alias("n_trig"), F.max("block_no").alias("n_lstarts"), F.max("run_no").alias("n_lruns"),
        F.max_by("ts_us", "seq").alias("last_ts"),
        F.max_by(F.struct(F.col("trig").alias("t"), file.alias("f")), F.when(edit, seq)).alias("last_edit"),
        F.max_by("filename", F.when(file != "", seq)).alias("last_file"),
        F.max_by(F.struct(edit.alias("e"), file.alias("f")), F.when(~move, seq)).alias("last_nc"),
        F.min_by(at, "seq").alias("first"), F.max_by(at, "seq").alias("last"),
        F.min_by(at, F.when(t == "session_start", seq)).alias("start"), F.max_by(at, F.when(t == "session_end", seq)).alias("end"),
        F.max_by("type", F.when(t.isin(*LIFECYCLE), seq)).alias("life"),
    )
    new = join_on(new, _block_sums(s, join_on(old, ids, ["session_id"], "left_semi"), agg), ["session_id"], "left")

    # Corrections of the new annotations, with the old tail to look back on.
    tail = parts.filter(F.col("kind") == "tail").select("session_id", "tail.*", F.lit(None).cast("string").alias("note"))
    tail = join_on(tail, ids, ["session_id"], "left_semi")
    seen = tail.unionByName(rows.select(*INPUT))
    found = join_on(error_corrections(seen, agg, exe, old.select("session_id", F.col("last_file").alias("file_before"))),
                    old.select("session_id", "upto"), ["session_id"], "left").filter(seq > F.coalesce("upto", F.lit(-1)))
    new = join_on(new, found.groupBy("session_id").agg(F.count(F.lit(1)).alias("corrections")), ["session_id"], "left")

    both = join_on(new, old.withColumnsRenamed({c: f"o_{c}" for c in old.columns if c != "session_id"}), ["session_id"], "left")
    zero = F.lit(0)
    merged = {c: F.coalesce(c, zero) + F.coalesce(f"o_{c}", zero) for c in
              ("total_events", "idle_gaps", "idle_total_us", "corrections", "blocks", "flow", "moving", "velocity_sum")}
    merged |= {c: F.greatest(c, f"o_{c}") for c in ("n_trig", "n_lstarts", "n_lruns", "velocity_max")}  # running numbers; nulls are skipped
    merged |= {c: F.coalesce(c, f"o_{c}") for c in ("last_ts", "last_edit", "last_file", "last_nc", "open", "last", "end", "life")}
    merged |= {c: F.coalesce(f"o_{c}", c) for c in ("first", "start")}
    head = F.struct(*[merged[c].cast(k).alias(c) for c, k in _HEAD.items()])
    none = F.lit(None)
    mark = F.lit(rules_mark(agg)).cast("bigint").alias("rules")

    def part(kind, upto, head=none, filename=none, seconds=none, tail=none):
        head_type = "struct<" + ", ".join(f"`{k}`: {v}" for k, v in _HEAD.items()) + ">"
        return ["session_id", F.lit(kind).alias("kind"), upto.alias("upto"), mark, head.cast(head_type).alias("head"),
                filename.cast("string").alias("filename"), seconds.cast("bigint").alias("seconds"), tail.cast(_TAIL).alias("tail")]

    ends = new.select("session_id", "upto")
    files = s.filter(F.col("prev_ts_us").isNotNull() & F.col("active_file").isNotNull()).select(
        "session_id", F.col("active_file").alias("filename"), secs_trunc(F.col("gap_us")).alias("seconds"))
    held = join_on(parts.filter(F.col("kind") == "file").select("session_id", "filename", "seconds"), ids, ["session_id"], "left_semi")
    files = files.unionByName(held).groupBy("session_id", "filename").agg(F.sum("seconds").alias("seconds"))
    last = Window.partitionBy("session_id").orderBy(F.desc("seq"))  # a rank limit: Spark drops the other rows before the shuffle
    tail = seen.drop("note").withColumn("nth", F.row_number().over(last)).filter(F.col("nth") <= max(agg.lookback_events, 1))
    upto = F.col("upto")
    return (both.select(*part("head", upto, head=head))
            .unionByName(join_on(files, ends, ["session_id"]).select(*part("file", upto, filename=F.col("filename"), seconds=F.col("seconds"))))
            .unionByName(join_on(tail, ends, ["session_id"]).select(
                *part("tail", upto, tail=F.struct("seq", "type", "ts_us", "filename", F.col("changed_tick").cast("bigint"))))))


def summary(parts: DataFrame, agg: AggregationConfig = AggregationConfig()) -> DataFrame:
    """One row a session: its analytics and its state, from the parts."""
    h = heads(parts)
    v = F.when(F.col("open").isNotNull(), _speed(F.col("open.first"), F.col("open.last")))
    pos = F.when(v > 0, v)
    foc = focus_summary(parts.filter(F.col("kind") == "file").withColumn("distraction", is_distraction(F.col("filename"), agg.distraction_patterns)))
    h = join_on(h.withColumn("pos", pos), foc, ["session_id"], "left")
    zero = F.lit(0).cast("bigint")
    moving = F.col("moving") + F.col("pos").isNotNull().cast("int")
    no_life = F.col("life").isNull()
    return h.select(
        "session_id", "total_events", (F.col("blocks") + F.col("open").isNotNull().cast("int")).alias("activity_blocks"),
        F.when(moving > 0, (F.col("velocity_sum") + F.coalesce("pos", F.lit(0.0))) / moving).otherwise(F.lit(0.0)).alias("avg_velocity"),
        F.coalesce(F.greatest("velocity_max", "pos"), F.lit(0.0)).alias("peak_velocity"),
        F.coalesce("focus_ratio", F.lit(0.0)).alias("focus_ratio"), F.coalesce("distraction_seconds", zero).alias("distraction_seconds"),
        (F.col("flow") + F.coalesce((F.col("pos") >= F.lit(agg.flow_velocity)).cast("int"), zero)).alias("flow_blocks"),
        "idle_gaps", "idle_total_us", F.col("corrections").alias("error_corrections"),
        F.coalesce("start", "first")["ts_us"].alias("start_us"),
        F.when(no_life, F.col("last.ts_us")).otherwise(F.col("end.ts_us")).alias("end_us"),
        F.when(no_life, F.lit(False)).otherwise(F.col("life") != "session_end").alias("active"),
    )
