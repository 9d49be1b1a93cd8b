"""Keyed streaming state machines (``transformWithState``), typed state of one session each.

State is a few values per session in the RocksDB store.  Each micro-batch of a
session is sorted by arrival ``(ts_us, cmd_id)``.  Sessions may come in any time
order and however late, and no row is dropped.  Only the files of one session must
come in write order.  Both processors use the rules of the batch operators, so
their output equals these on the same log:

* :func:`denoise_stream` - the cursor walk of ``operators.denoise``; emits the
  recorded log (non-cursor events as they come, surviving moves where they are
  committed) with a per-session ``seq``.  A pending move whose deadline is open is
  also committed by the session's own timer, when it has sent nothing for
  ``quiet_s`` seconds.  Timers run on the time of arrival here, which no row is
  behind, so a drained stream ends (timers on the machine's clock would keep it
  going).  An ended session leaves its counter (a resumed one counts on).
* :func:`live_blocks` - activity blocks by the boundaries of ``operators.boundary``,
  emitted when the next event closes them.  A ``session_end`` closes nothing, as in
  batch: the open block is told as it is then, and told again, with the next
  ``revision``, if a resumed session goes on with it.  :func:`latest_blocks` keeps
  each block's last revision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sessionlog.config import AggregationConfig, FilterConfig
from sessionlog.operators.boundary import boundaries
from sessionlog.operators.denoise import END, MOVE, OTHER, TRIGGER, walk
from sessionlog.schema import EVENT_COLUMNS, EVENT_SCHEMA

_PAYLOAD = [c for c in EVENT_COLUMNS if c not in ("session_id", "seq")]
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(events: DataFrame, processor: StatefulProcessor, schema: StructType, time_mode: str) -> DataFrame:
    """``transformWithState`` by session; its typed state needs the RocksDB store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, _ROCKSDB)
    return events.groupBy("session_id").transformWithState(processor, schema, "append", time_mode)


def _arrival(r: Row) -> tuple:
    """Order of a session's rows: by time, then by number (none last)."""
    return r.ts_us, r.cmd_id is None, r.cmd_id or 0


class Denoise(StatefulProcessor):
    """State: the walk's anchor and deadline, the next ``seq``, the timer set; the pending move as a row."""

    def __init__(self, cfg: FilterConfig, quiet_ms: int):
        self.cfg, self.quiet_ms = cfg, quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "anchor long, due long, next_seq long, timer long")
        self.pending = handle.getValueState("pending", StructType([f for f in EVENT_SCHEMA.fields if f.name in _PAYLOAD]))
        self.event = Row(*EVENT_COLUMNS)

    def _kind(self, type_: str) -> int:
        if type_ == "cursor_move":
            return MOVE
        return OTHER if type_ not in self.cfg.triggers else END if type_ == "session_end" else TRIGGER

    def _emit(self, session_id: str, seq: int, r: Any) -> Row:
        own = dict(zip(_PAYLOAD, r)) if isinstance(r, tuple) and not isinstance(r, Row) else r
        return self.event(*[session_id if c == "session_id" else seq if c == "seq" else own[c] for c in EVENT_COLUMNS])

    def _remember(self, anchor, due, seq: int, move: tuple | None, timer: int | None) -> None:
        self.clock.update((anchor, due, seq, timer))
        if move is None:
            self.pending.clear()
        else:
            self.pending.update(move)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        anchor, due, seq, timer = self.clock.get() if self.clock.exists() else (None, None, 0, None)
        held = tuple(self.pending.get()) if self.pending.exists() else None
        own = sorted(rows, key=_arrival)
        decided: list = []
        # moves go by their place among the rows; the one held from before by -1
        anchor, due, move = walk((anchor, due, None if held is None else -1), list(range(len(own))), [r.ts_us for r in own],
                                 [self._kind(r.type) for r in own], self.cfg, decided)
        kept = {at: m for m, reason, at in decided if reason is not None and (reason != "idle" or self.cfg.idle_commit == "record")}
        out = []
        for i, r in enumerate(own):
            if i in kept:
                out.append(self._emit(key[0], seq + len(out), held if kept[i] < 0 else own[kept[i]]))
            if r.type != "cursor_move":
                out.append(self._emit(key[0], seq + len(out), r))
        left = None if move is None else held if move < 0 else tuple(own[move][c] for c in _PAYLOAD)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None
        if due is not None:
            timer = max(r.arrived_ms for r in own) + self.quiet_ms
            self.handle.registerTimer(timer)
        self._remember(anchor, due, seq + len(out), left, timer)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        anchor, due, seq, _ = self.clock.get()
        if due is not None and self.pending.exists():
            keep = self.cfg.idle_commit == "record"
            move = tuple(self.pending.get())
            self._remember(anchor, None, seq + keep, None, None)
            if keep:
                yield self._emit(key[0], seq, move)

    def close(self) -> None:
        pass


def denoise_stream(events: DataFrame, cfg: FilterConfig = FilterConfig(), quiet_s: int = 600) -> DataFrame:
    """Streaming cursor filter over raw command-log events (``session_id, cmd_id,
    type, ts, ts_us, payload...``); output has the canonical event schema."""
    rows = events.select("session_id", "cmd_id", *_PAYLOAD, F.current_timestamp().alias("arrived"))
    rows = rows.withColumn("arrived_ms", F.unix_millis("arrived")).withWatermark("arrived", "1 second")
    return _keyed(rows, Denoise(cfg, quiet_s * 1000), EVENT_SCHEMA, "eventTime")


LIVE_BLOCK_SCHEMA = StructType([
    StructField("session_id", StringType()), StructField("block_no", LongType()), StructField("filename", StringType()),
    StructField("start_us", LongType()), StructField("end_us", LongType()), StructField("duration_us", LongType()),
    StructField("event_count", LongType()), StructField("start_tick", LongType()), StructField("end_tick", LongType()),
    StructField("delta_tick", LongType()), StructField("velocity", DoubleType()), StructField("closed_by", StringType()),
    StructField("revision", LongType()),
])


class LiveBlocks(StatefulProcessor):
    """State: the last event's time and the blocks so far; the open block with its number of revisions told."""

    def __init__(self, agg: AggregationConfig):
        self.agg = agg

    def init(self, handle) -> None:
        self.past = handle.getValueState("past", "last_us long, blocks long")
        self.block = handle.getValueState("block", "file string, start long, end long, n long, first_tick long, last_tick long, revision long")
        self.row = Row(*LIVE_BLOCK_SCHEMA.names)

    def _told(self, session_id: str, number: int, block: tuple, closed_by: str) -> Row:
        file, start, end, n, first_tick, last_tick, revision = block
        span, gain = end - start, last_tick - first_tick
        return self.row(session_id, number, file or None, start, end, span, n, first_tick, last_tick, gain,
                        gain / (span / 1e6) if span > 0 else 0.0, closed_by, revision)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, blocks = self.past.get() if self.past.exists() else (None, 0)
        block = tuple(self.block.get()) if self.block.exists() else None
        out = []
        for r in sorted(rows, key=_arrival):
            if r.type == "file_edit":
                file, tick = r.filename or "", r.changed_tick or 0
                if block is not None:
                    rules = boundaries(False, file != block[0], r.ts_us - last, self.agg.merge_window_us)
                    reason = next((reason for reason, hit in rules if hit), None)
                    if reason:
                        out.append(self._told(key[0], blocks, block, reason))
                        block = None
                if block is None:
                    blocks, block = blocks + 1, (file, r.ts_us, r.ts_us, 1, tick, tick, 0)
                else:
                    block = (*block[:2], r.ts_us, block[3] + 1, block[4], tick, block[6])
            elif block is not None and r.type in self.agg.block_closers:
                out.append(self._told(key[0], blocks, block, boundaries(True, False, 0, 0)[0][0]))
                block = None
            elif block is not None and r.type == "session_end":
                out.append(self._told(key[0], blocks, block, "session_end"))
                block = (*block[:6], block[6] + 1)
            last = r.ts_us
        self.past.update((last, blocks))
        if block is None:
            self.block.clear()
        else:
            self.block.update(block)
        yield from out

    def close(self) -> None:
        pass


def live_blocks(events: DataFrame, agg: AggregationConfig = AggregationConfig()) -> DataFrame:
    """Streaming activity blocks: a row when a block closes, and one for the open block at a ``session_end``."""
    rows = events.select("session_id", "cmd_id", "type", "ts_us", "filename", "changed_tick")
    return _keyed(rows, LiveBlocks(agg), LIVE_BLOCK_SCHEMA, "none")


def latest_blocks(blocks: DataFrame) -> DataFrame:
    """Each block's last revision."""
    rest = [c for c in LIVE_BLOCK_SCHEMA.names if c not in ("session_id", "block_no")]
    last = blocks.groupBy("session_id", "block_no").agg(F.max_by(F.struct(*rest), "revision").alias("b"))
    return last.select("session_id", "block_no", "b.*")
