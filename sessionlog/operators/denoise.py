"""Cursor debounce and idle commit over a raw (pre-filter) event log.

Rules of the recorder's filter, per session in ``seq`` order, seen only by
cursor moves and trigger events (file edits, terminal commands, session end):

* trigger: flush the pending move, re-anchor at the trigger, cancel the timer
  (a session end leaves no anchor: a resumed session starts afresh);
* move less than ``debounce`` after the anchor: becomes pending, nothing else;
* other move: becomes pending, re-anchors, (re)arms a timer at anchor + ``idle``;
* timer: commits the pending move; it runs out before the first event of any
  type that is later than it.

Any ``debounce`` and ``idle`` are allowed, and times may go back.

The rules are a walk with three values to remember (anchor, deadline, pending
move), done in Arrow batches over rows dealt by ``(session_id, seq div
chunk_rows)`` and sorted by ``seq``.  A session of one chunk is walked at once.  The
chunks of a longer one are walked side by side:

1. *Transition functions.*  Whatever comes in, a chunk with a trigger leaves what
   the walk from its first trigger leaves.  Without one, the anchor ``a`` that comes
   in leads to the first move at or after ``a + debounce``; such a move has the
   latest time so far, and so has each next anchor after it.  These moves (only
   those that an anchor from before the chunk can lead to) and the state that
   each leaves are the chunk's function.
2. *Composition.*  Along the chunks of a session, a row each, the functions give
   the state that comes into each chunk.
3. *Walk* of every chunk from its state.  A move that is pending over a chunk's end
   is decided in the chunk that commits or replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.config import ExecConfig, FilterConfig
from sessionlog.operators.scan import spans_chunks
from sessionlog.operators.sequence import join_on, ordinal_within
from sessionlog.spark import materialize as materialize_df

# ``flush_seq`` of a move committed after the last event of the log
END_OF_LOG = 1 << 60

OTHER, MOVE, TRIGGER, END = range(4)
KEY = ["session_id", "_chunk"]
NOTHING = (None, None, None)  # anchor, deadline, pending move


def walk(state: tuple, seqs: list, times: list, kinds: list, cfg: FilterConfig, decided: list) -> tuple:
    """The state after the rows; ``decided`` gets (seq, reason, flush_seq) of each move whose fate is known."""
    anchor, due, move = state
    for seq, t, kind in zip(seqs, times, kinds):
        if due is not None and t > due:  # the timer has run out, whatever comes
            decided.append((move, "idle", seq))
            due = move = None
        if kind == MOVE:
            if move is not None:
                decided.append((move, None, None))
            move = seq
            if anchor is None or t - anchor >= cfg.debounce_us:
                anchor, due = t, t + cfg.idle_us
        elif kind != OTHER:
            if move is not None:
                decided.append((move, "end" if kind == END else "trigger", seq))
            anchor, due, move = None if kind == END else t, None, None
    return anchor, due, move


def _ended(state: tuple, decided: list) -> None:
    """What the end of the log does to a pending move."""
    if state[2] is not None:
        decided.append((state[2], "end", None) if state[1] is None else (state[2], "idle", END_OF_LOG))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict]]:
    """(key values, columns as lists) of each run of equal keys inside a batch."""
    for batch in batches:
        columns = {c: batch[c].to_pylist() for c in batch.schema.names}
        key = list(zip(*[columns[k] for k in keys]))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                yield key[a], {c: x[a:b] for c, x in columns.items()}


_DECIDED = pa.schema([("session_id", pa.string()), ("seq", pa.int64()), ("reason", pa.string()), ("flush_seq", pa.int64())])


def _decide(cfg: FilterConfig, keys: list[str]):
    """Walk each run of ``keys`` from its state (columns anchor, due and move if given) and emit the decisions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last, out = None, NOTHING, True, []

        def close():
            if now is not None and last:
                decided: list = []
                _ended(state, decided)
                out.extend((now[0], *d) for d in decided)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, _DECIDED)], schema=_DECIDED)

        for key, c in _runs(batches, keys):
            if key != now:
                close()
                now = key
                state, last = ((c["anchor"][0], c["due"][0], c["move"][0]), c["last"][0]) if "last" in c else (NOTHING, True)
            decided: list = []
            state = walk(state, c["seq"], c["ts_us"], c["kind"], cfg, decided)
            out.extend((key[0], *d) for d in decided)
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    return run


def chunk_function(seqs: list, times: list, kinds: list, top: int | None, cfg: FilterConfig) -> dict:
    """A chunk's function from the state that comes in to the state that goes out; ``top``: the latest time of a move or trigger before it."""
    first = next((i for i, k in enumerate(kinds) if k in (TRIGGER, END)), None)
    if first is not None:
        return {"fixed": True, "out": walk(NOTHING, seqs[first:], times[first:], kinds[first:], cfg, [])}
    t = np.array(times, np.int64)
    moves = np.flatnonzero(np.array(kinds) == MOVE)
    out = {"fixed": False, "all_top": int(t.max())}
    if not len(moves):
        return out | {"last_move": None, "move_top": None, "at": [], "after": []}
    last = int(moves[-1])
    out |= {"last_move": seqs[last], "move_top": int(t[: last + 1].max())}
    high = np.maximum.accumulate(t[moves])
    records = moves[np.append(True, high[1:] > high[:-1])]  # later than all moves before them
    at = t[records]
    after = np.searchsorted(at, at + cfg.debounce_us)  # the next anchor; beyond the end: none
    final = np.append(np.where(after < len(at), after, np.arange(len(at))), len(at))[: len(at)]
    while True:
        further = final[final]
        if (further == final).all():
            break
        final = further
    reach = 1 if top is None else min(len(at), int(np.searchsorted(at, top + cfg.debounce_us)) + 1)
    states = {}
    for k in np.unique(final[:reach]).tolist():
        i, due = int(records[k]), int(at[k]) + cfg.idle_us
        if (t[i + 1 : last + 1] > due).any():
            states[k] = (int(at[k]), None, seqs[last])
        elif (t[last + 1 :] > due).any():
            states[k] = (int(at[k]), None, None)
        else:
            states[k] = (int(at[k]), due, seqs[last])
    return out | {"at": at[:reach].tolist(), "after": [states[k] for k in final[:reach].tolist()]}


def apply_function(f: dict, state: tuple, cfg: FilterConfig) -> tuple:
    """The state after a chunk."""
    if f["fixed"]:
        return f["out"]
    anchor, due, move = state
    k = 0 if anchor is None else int(np.searchsorted(np.array(f["at"], np.int64), anchor + cfg.debounce_us))
    if k < len(f["at"]):
        return f["after"][k]
    # no new anchor: moves replace one another, and an open timer may run out among or after them
    if due is not None and f["move_top"] is not None and f["move_top"] > due:
        return anchor, None, f["last_move"]
    if due is not None and f["all_top"] > due:
        return anchor, None, None
    return anchor, due, move if f["last_move"] is None else f["last_move"]


_STATE = "struct<anchor: bigint, due: bigint, move: bigint>"
_FUNCTION = (f"session_id string, _chunk bigint, fixed boolean, `out` {_STATE}, all_top bigint, last_move bigint, move_top bigint, "
             f"at array<bigint>, after array<{_STATE}>")


def _functions(cfg: FilterConfig):
    names = ("anchor", "due", "move")
    state = pa.struct([(n, pa.int64()) for n in names])
    schema = pa.schema([("session_id", pa.string()), ("_chunk", pa.int64()), ("fixed", pa.bool_()), ("out", state), ("all_top", pa.int64()),
                        ("last_move", pa.int64()), ("move_top", pa.int64()), ("at", pa.list_(pa.int64())), ("after", pa.list_(state))])

    def named(s):
        return dict(zip(names, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def close():
            f = chunk_function(held["seq"], held["ts_us"], held["kind"], held["top"][0], cfg)
            f = {k: named(v) if k == "out" else [named(x) for x in v] if k == "after" else v for k, v in f.items()}
            return pa.RecordBatch.from_pylist([{"session_id": now[0], "_chunk": now[1], **f}], schema)

        for key, c in _runs(batches, KEY):
            if key != now:
                if now is not None:
                    yield close()
                now, held = key, c
            else:
                for name in ("seq", "ts_us", "kind"):
                    held[name] += c[name]
        if now is not None:
            yield close()

    return run


def _compose(cfg: FilterConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, NOTHING
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if now is None or r["session_id"] != now[0]:
                    now, state = (r["session_id"],), NOTHING
                rows.append((*now, r["_chunk"], *state))
                f = r | {"out": r["out"] and tuple(r["out"].values()), "after": [tuple(x.values()) for x in r["after"] or []], "at": r["at"] or []}
                state = apply_function(f, state, cfg)
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEY, "anchor", "due", "move"])

    return run


def _by_chunk(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "seq")


def cursor_decisions(events: DataFrame, cfg: FilterConfig = FilterConfig(), exe: ExecConfig = ExecConfig(),
                     single: bool | None = None) -> DataFrame:
    """Every cursor move with ``kept``, ``reason`` (idle / trigger / end / NULL
    when superseded) and ``flush_seq``: the event the move is recorded just
    before (the flushing trigger, or for an idle commit the first later event
    past the timer; ``END_OF_LOG`` when none follows)."""
    if single is None:  # every session within one chunk (one scalar check)
        single = not spans_chunks(events, exe.chunk_rows)
    is_move = F.col("type") == "cursor_move"
    is_trigger = F.col("type").isin(*cfg.triggers)
    kind = F.when(is_move, MOVE).when(is_trigger & (F.col("type") == "session_end"), END).when(is_trigger, TRIGGER).otherwise(OTHER)
    rows = events.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("bigint").alias("seq"),
                         F.col("ts_us").cast("bigint").alias("ts_us"), kind.alias("kind"))
    schema = "session_id string, seq bigint, reason string, flush_seq bigint"
    if single:
        dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "seq")
        found = dealt.mapInArrow(_decide(cfg, ["session_id"]), schema)
    else:
        rows = rows.withColumn("_chunk", F.expr(f"seq div {int(exe.chunk_rows)}"))
        tops = rows.groupBy(*KEY).agg(F.max(F.when(F.col("kind") != OTHER, F.col("ts_us"))).alias("own_top"))
        along = Window.partitionBy("session_id").orderBy("_chunk")
        tops = tops.select(*KEY, F.max("own_top").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("top"))
        functions = materialize_df(_by_chunk(join_on(rows, tops, KEY)).mapInArrow(_functions(cfg), _FUNCTION), "cursor-functions")
        states = functions.repartition("session_id").sortWithinPartitions(*KEY).mapInArrow(
            _compose(cfg), "session_id string, _chunk bigint, anchor bigint, due bigint, move bigint")
        ends = functions.groupBy("session_id").agg(F.max("_chunk").alias("z"))
        states = materialize_df(join_on(states, ends, ["session_id"]).withColumn("last", F.col("_chunk") == F.col("z")).drop("z"), "cursor-states")
        found = _by_chunk(join_on(rows, states, KEY)).mapInArrow(_decide(cfg, KEY), schema)
    if cfg.idle_commit == "drop":
        idle = F.col("reason") == "idle"
        found = found.select("session_id", "seq", *[F.when(idle, None).otherwise(F.col(c)).alias(c) for c in ("reason", "flush_seq")])
    return found.select(F.col("session_id").cast(events.schema["session_id"].dataType).alias("session_id"), "seq",
                        F.col("reason").isNotNull().alias("kept"), "reason", "flush_seq")


def cursor_filter(events: DataFrame, cfg: FilterConfig = FilterConfig(), exe: ExecConfig = ExecConfig()) -> DataFrame:
    """The denoised log: all non-cursor events plus surviving moves, re-sequenced.

    A kept move is placed just before its ``flush_seq`` event (where the recorder
    appends it; idle commits where the timer fires), or at its own position
    when it is flushed at the end of a log without a session end.  ``seq`` is
    renumbered densely from 0.
    """
    bounded = not spans_chunks(events, exe.chunk_rows)  # every session under chunk_rows rows
    dec = cursor_decisions(events, cfg, exe, single=bounded).filter(F.col("kept")).select(
        "session_id", "seq", "flush_seq")
    cols = events.columns
    others = events.filter(F.col("type") != "cursor_move").withColumn("_pos", F.col("seq") * 2 + 1)
    moves = (join_on(events.filter(F.col("type") == "cursor_move"), dec, ["session_id", "seq"])
             .withColumn("_pos", F.coalesce(F.col("flush_seq") * 2, F.col("seq") * 2 + 1)).drop("flush_seq"))
    allr = others.unionByName(moves)
    # _pos is unique: an event flushes at most one move, placed at 2*flush_seq
    r = ordinal_within(allr, ["session_id"], "_pos", "_new", 2 * exe.chunk_rows, bounded=bounded)
    return r.withColumn("seq", F.col("_new") - 1).select(*cols)
