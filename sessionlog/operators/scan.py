"""The shared ordered pass over a session's events, split into bounded chunks.

Every order-dependent rule (gap to the previous event, block boundaries,
forward-filled active file, timeline runs) needs state that flows along
``seq``.  A window over a whole session would put a hot session into one task,
so the pass works on chunks ``(session_id, seq div chunk_rows)``:

1. *local pass* - one exchange on ``(session_id, _chunk)``, one sort by
   ``seq``; every window below shares that partitioning and order;
2. *chunk summary* - ``groupBy(session_id, _chunk)`` on the same partitioning
   (no new exchange of rows) keeps a handful of values per chunk;
3. *carry table* - running windows over the chunk summaries (one row per
   chunk, so tiny) give each chunk what flows in from its predecessors;
   When carries are needed the local pass is persisted for steps 2-4 and the
   result is written once to the shared checkpoint folder, so all consumers
   read it without another exchange of events.
4. *fix-up* - carries are joined back on ``(session_id, _chunk)``.  Only
   chunks after the first have a carry row, so the table holds at most
   ``rows / chunk_rows`` rows; AQE turns the join into a broadcast when its
   measured size is small and keeps a co-partitioned join otherwise.

Columns added (all global over the session, whatever the chunking):

``prev_ts_us``  time of the previous event of any type (NULL for seq 0)
``gap_us``      ``ts_us - prev_ts_us``
``trig``        running count of block closers up to and including the row
``block_reason`` for edits: why this edit starts a block (``first``,
                ``context_switch``, ``timeout``) or NULL when it merges
``block_no``    number of block starts at or before the row (0 before any edit)
``active_file`` last non-empty file name strictly before the row
``run_no``      number of timeline runs started at or before the row
                (cursor moves never start or break a run)
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.operators.boundary import boundaries
from sessionlog.operators.sequence import join_on
from sessionlog.spark import materialize as materialize_df

UNB = Window.unboundedPreceding

# columns the ordered pass and the block / gap / focus consumers read
SCAN_INPUT = ["session_id", "seq", "type", "ts_us", "filename", "changed_tick"]


def spans_chunks(events: DataFrame, chunk_rows: int) -> bool:
    """True when some session reaches past its first chunk (one scalar aggregate)."""
    top = events.agg(F.max("seq")).first()[0]
    return top is not None and top >= chunk_rows


def with_chunk(events: DataFrame, chunk_rows: int) -> DataFrame:
    """Add ``_chunk = seq div chunk_rows``."""
    return events.withColumn("_chunk", F.expr(f"CAST(`seq` AS BIGINT) div {int(chunk_rows)}"))


def _reason(closer: Column, other_file: Column, gap_us: Column, merge_us: Column) -> Column:
    """Why an edit starts a block after the edit before it; NULL if it doesn't."""
    out = F
    for reason, hit in boundaries(closer, other_file, gap_us, merge_us):
        out = out.when(hit, F.lit(reason))
    return out


def scan(events: DataFrame, agg: AggregationConfig = AggregationConfig(),
         exe: ExecConfig = ExecConfig(), materialize: bool | None = None, seed: DataFrame | None = None) -> DataFrame:
    """Run the chunked pass.

    ``seed``: what the rows before ``events`` leave behind, a row a session in the form of
    a chunk summary (:mod:`sessionlog.operators.partials`); the pass goes on from there.

    ``materialize=True``: the result is written once as parquet in the shared
    checkpoint folder (callers that read it several times).  ``None`` (auto):
    written only when chunks need carries - then the local pass is persisted
    while the write runs so it is computed once - and returned lazily when
    every session fits in one chunk (one exchange, nothing computed twice)."""
    merge = F.lit(agg.merge_window_us)
    d = with_chunk(events, exe.chunk_rows)
    is_edit = F.col("type") == "file_edit"
    is_trig = F.col("type").isin(*agg.block_closers)
    is_nc = F.col("type") != "cursor_move"
    file = F.coalesce(F.col("filename"), F.lit(""))

    w = Window.partitionBy("session_id", "_chunk").orderBy("seq")
    run = w.rowsBetween(UNB, Window.currentRow)
    before = w.rowsBetween(UNB, -1)
    whole = Window.partitionBy("session_id", "_chunk")

    # 1. local pass -------------------------------------------------------
    d = d.select(
        "*",
        F.lag("ts_us").over(w).alias("_prev_ts_l"),
        F.sum(is_trig.cast("int")).over(run).alias("_trig_l"),
        F.last(F.when(file != "", F.col("filename")), ignorenulls=True).over(before).alias("_ff_l"),
        F.min(F.when(is_edit, F.col("seq"))).over(whole).alias("_fe_seq"),
        F.min(F.when(is_nc, F.col("seq"))).over(whole).alias("_fnc_seq"),
    )
    d = d.select(
        "*",
        F.last(F.when(is_edit, F.struct(F.col("_trig_l").alias("t"), file.alias("f"))), ignorenulls=True)
        .over(before).alias("_pe_l"),
        F.last(F.when(is_nc, F.struct(is_edit.alias("e"), file.alias("f"))), ignorenulls=True)
        .over(before).alias("_pnc_l"),
    )
    pe, pnc = F.col("_pe_l"), F.col("_pnc_l")
    d = d.withColumn(
        "_reason_l",
        F.when(
            is_edit & pe.isNotNull(),
            _reason(F.col("_trig_l") != pe["t"], file != pe["f"], F.col("ts_us") - F.col("_prev_ts_l"), merge),
        ),
    ).withColumn(
        "_rstart_l",
        F.when(is_nc & pnc.isNotNull(), ~(is_edit & pnc["e"] & (file == pnc["f"]))),
    )
    d = d.select(
        "*",
        F.sum(F.col("_reason_l").isNotNull().cast("int")).over(run).alias("_starts_l"),
        F.sum(F.coalesce(F.col("_rstart_l"), F.lit(False)).cast("int")).over(run).alias("_runs_l"),
    )

    if seed is None and not spans_chunks(events, exe.chunk_rows):
        # every session fits in its first chunk: nothing flows between chunks
        out = _fixup(d, None, events.columns, is_edit)
        return materialize_df(out, "scan") if materialize else out

    materialize = True if materialize is None else materialize
    if materialize:
        # the local pass feeds both the chunk summaries and the fix-up join:
        # keep it for the duration of the write below instead of shuffling twice
        d = d.persist(StorageLevel.MEMORY_AND_DISK)

    # 2. chunk summaries --------------------------------------------------
    summ = d.groupBy("session_id", "_chunk").agg(
        F.sum(is_trig.cast("int")).alias("n_trig"),
        F.max_by("ts_us", "seq").alias("last_ts"),
        F.max_by(F.struct(F.col("_trig_l").alias("t"), file.alias("f")), F.when(is_edit, F.col("seq"))).alias("last_edit"),
        F.min_by(
            F.struct(F.col("_trig_l").alias("t"), file.alias("f"), F.col("ts_us").alias("ts"),
                     F.col("_prev_ts_l").alias("pts")),
            F.when(is_edit, F.col("seq")),
        ).alias("fe"),
        F.sum(F.col("_reason_l").isNotNull().cast("int")).alias("n_lstarts"),
        F.max_by(F.col("filename"), F.when(file != "", F.col("seq"))).alias("last_file"),
        F.max_by(F.struct(is_edit.alias("e"), file.alias("f")), F.when(is_nc, F.col("seq"))).alias("last_nc"),
        F.min_by(F.struct(is_edit.alias("e"), file.alias("f")), F.when(is_nc, F.col("seq"))).alias("fnc"),
        F.sum(F.coalesce(F.col("_rstart_l"), F.lit(False)).cast("int")).alias("n_lruns"),
    )

    if seed is not None:
        none = {f.name: F.lit(None).cast(f.dataType.simpleString()) for f in summ.schema if f.name not in {*seed.columns, "_chunk"}}
        summ = summ.unionByName(seed.withColumn("_chunk", F.lit(-1).cast("bigint")).withColumns(none).select(*summ.columns))

    # 3. carry table over chunk summaries ----------------------------------
    cw = Window.partitionBy("session_id").orderBy("_chunk")
    cb = cw.rowsBetween(UNB, -1)
    c = summ.select(
        "*",
        F.coalesce(F.sum("n_trig").over(cb), F.lit(0)).alias("trig_off"),
        F.lag("_chunk").over(cw).alias("chunk_before"),
        F.lag("last_ts").over(cw).alias("carry_ts"),
        F.last("last_file", ignorenulls=True).over(cb).alias("carry_file"),
        F.last("last_nc", ignorenulls=True).over(cb).alias("carry_nc"),
    )
    c = c.withColumn(
        "last_edit_g",
        F.when(F.col("last_edit").isNotNull(),
               F.struct((F.col("last_edit.t") + F.col("trig_off")).alias("t"), F.col("last_edit.f").alias("f"))),
    )
    c = c.select("*", F.last("last_edit_g", ignorenulls=True).over(cb).alias("carry_edit"))
    fe, ce, fnc, cnc = F.col("fe"), F.col("carry_edit"), F.col("fnc"), F.col("carry_nc")
    c = c.withColumn(
        "fe_reason",
        F.when(
            fe.isNotNull(),
            F.when(ce.isNull(), F.lit("first")).otherwise(
                _reason(fe["t"] + F.col("trig_off") != ce["t"], fe["f"] != ce["f"],
                        fe["ts"] - F.coalesce(fe["pts"], F.col("carry_ts")), merge)),
        ),
    ).withColumn(
        "fnc_start",
        F.when(fnc.isNotNull(),
               F.when(cnc.isNull(), F.lit(True)).otherwise(~(fnc["e"] & cnc["e"] & (fnc["f"] == cnc["f"])))),
    )
    c = c.withColumn("n_starts", F.col("n_lstarts") + F.col("fe_reason").isNotNull().cast("int")).withColumn(
        "n_runs", F.col("n_lruns") + F.coalesce(F.col("fnc_start"), F.lit(False)).cast("int")
    )
    c = c.select(
        "*",
        F.coalesce(F.sum("n_starts").over(cb), F.lit(0)).alias("starts_off"),
        F.coalesce(F.sum("n_runs").over(cb), F.lit(0)).alias("runs_off"),
    )
    carry = c.filter(F.col("chunk_before").isNotNull()).select(
        "session_id", "_chunk", F.lit(True).alias("_has_carry"), "trig_off", "carry_ts", "carry_file",
        "fe_reason", "fnc_start", "starts_off", "runs_off",
    )

    out = _fixup(d, carry, events.columns, is_edit)
    if materialize:
        out = materialize_df(out, "scan")
        d.unpersist()
    return out


def _fixup(d: DataFrame, carry: DataFrame | None, columns, is_edit) -> DataFrame:
    """Step 4: add the carries (absent when every session fits in one chunk)."""
    if carry is None:
        carry_cols = {"_has_carry": "boolean", "trig_off": "bigint", "carry_ts": "bigint", "carry_file": "string",
                      "fe_reason": "string", "fnc_start": "boolean", "starts_off": "bigint", "runs_off": "bigint"}
        j = d.select("*", *[F.lit(None).cast(t).alias(c) for c, t in carry_cols.items()])
    else:
        j = join_on(d, carry, ["session_id", "_chunk"], "left")
    has = F.col("_has_carry").isNotNull()
    fe_start = F.when(has, F.col("fe_reason").isNotNull()).otherwise(F.lit(True))
    fnc_start = F.when(has, F.coalesce(F.col("fnc_start"), F.lit(False))).otherwise(F.lit(True))
    prev_ts = F.coalesce(F.col("_prev_ts_l"), F.col("carry_ts"))
    out = j.select(
        *columns,
        prev_ts.alias("prev_ts_us"),
        (F.col("ts_us") - prev_ts).alias("gap_us"),
        (F.col("_trig_l") + F.coalesce(F.col("trig_off"), F.lit(0))).cast("bigint").alias("trig"),
        F.when(is_edit & (F.col("seq") == F.col("_fe_seq")),
               F.when(has, F.col("fe_reason")).otherwise(F.lit("first")))
        .otherwise(F.col("_reason_l")).alias("block_reason"),
        (F.coalesce(F.col("starts_off"), F.lit(0)) + F.col("_starts_l")
         + F.when(fe_start & (F.col("seq") >= F.col("_fe_seq")), F.lit(1)).otherwise(F.lit(0)))
        .cast("bigint").alias("block_no"),
        F.coalesce(F.col("_ff_l"), F.col("carry_file")).alias("active_file"),
        (F.coalesce(F.col("runs_off"), F.lit(0)) + F.col("_runs_l")
         + F.when(fnc_start & (F.col("seq") >= F.col("_fnc_seq")), F.lit(1)).otherwise(F.lit(0)))
        .cast("bigint").alias("run_no"),
    )
    return out
