"""Operator 11: the cheapest repair of damaged conversations, and its least audit, by prefix doubling.

A conversation's rows, by turn (nulls first; equal turns by role and text), are
edited until its role initials read ``(s?(ua)+)?``: Keep (0), Rerole to user or
assistant (1), Delete (2, required for blank and duplicate rows), Insert an
empty-text user or assistant (5); a truncated row that isn't deleted adds 5.

* Cost DP: for each row and each state of the pattern (nothing yet, after s, after
  u, after a) the least cost from there to the end, backwards, side by side for
  all conversations of about the same length.  Arcs on a cheapest way are optimal.
* Ranking: optimal arcs are nodes ranked by their edit's initial; ranks of 2, 4, 8
  ... initials come from an arc's rank and the rank of the best arc at the end of
  its so many edits.  The arc of the least rank goes first at each place, and
  pointers to it, doubled, lay the whole least path out.

Conversations of at most ``chunk_rows`` rows (and ``chunk_bytes`` bytes) are
solved whole, many in a task, after one exchange.  Longer ones are cut into chunks
of as many rows: each chunk gives the least costs from each state before it to
each state after it, these are put together from the end on, each chunk then
finds its least path from each state, and the states are followed from the start.
Only the result itself, one audit and one digest a conversation, is put together
in a single task, as a stream in bounded memory but for the audit.

Nulls: a null conv_id is a conversation; null conv_id, turn, role and text read as
one space, but null turns are left out of ``gaps``.  Empty texts are blank.
Repeated rows are duplicates.  An empty table gives no rows.  Other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.llm.shared import pick
from sessionlog.operators.sequence import assign_seq, join_on
from sessionlog.spark import materialize

_SPACE = " \t\n\x0b\x0c\r"
_FAR = np.int64(1) << 50
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  A row of role initial (other, s, u, a) that is kept leads on to:
_STEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: An inserted or reroled row can only be what the pattern asks for.
_NEXT = np.array([2, 2, 3, 2])
_NEW_ROLE = {2: "user", 3: "assistant"}
_INITIALS = b"\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
_COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
_LONG = 2**63 - 1


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``gone`` after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (``gone``), 1 empties its text, 2 takes ``[.!?]`` out of it, 3
    repeats it, 4 makes it the user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = pick(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    r = r.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code.alias("code"))
    return r.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("gone"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """The rows with ``kind`` (role initial: 1 s, 2 u, 3 a, 0 other), ``blank`` and ``cut`` (the text ends in no ``[.!?]``)."""
    body = F.rtrim("text", F.lit(_SPACE))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return rows.select("*", kind.alias("kind"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"))


def least_costs(kind: np.ndarray, must: np.ndarray, cut: np.ndarray, ends: np.ndarray, last: bool) -> np.ndarray:
    """Least cost to the end from before each row (axis 1, one more for the end) in each state (axis 2).

    Rows stand at the right end of ``kind``, ``must`` (be deleted) and ``cut``
    (conversations x rows); ``ends`` are the costs after them, where rows may be
    inserted if these are the ``last``.
    """
    many, long = kind.shape
    out = np.full((long + 1, many, 4), _FAR)
    out[long] = _inserted(ends) if last else ends
    for t in range(long - 1, -1, -1):
        then, extra = out[t + 1], np.where(must[:, t], _FAR, 5 * cut[:, t])[:, None]
        step = _STEP[:, kind[:, t]].T
        kept = np.where(step >= 0, np.take_along_axis(then, np.maximum(step, 0), 1) + extra, _FAR)
        out[t] = np.minimum(_inserted(np.minimum(np.minimum(then + 2, kept), then[:, _NEXT] + 1 + extra)), _FAR)
    return out


def _inserted(costs: np.ndarray) -> np.ndarray:
    """With rows put in first: after a comes u and after u comes a, so two at most are of use."""
    out = costs.copy()
    out[:, 2] = np.minimum(costs[:, 2], costs[:, 3] + 5)
    out[:, 3] = np.minimum(costs[:, 3], costs[:, 2] + 5)
    for q in (0, 1):
        out[:, q] = np.minimum(costs[:, q], out[:, 2] + 5)
    return out


def optimal_arcs(best: np.ndarray, kind: np.ndarray, must: np.ndarray, cut: np.ndarray, sizes: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From-node, edit and to-node of each arc on a cheapest way, in order; nodes are numbered as ``best`` is laid out.

    A node without an edit to come has an arc of edit 0 to itself.
    """
    long, (many, _) = len(best) - 1, best.shape[1:]
    number = np.arange(best.size).reshape(best.shape)
    extra = np.where(must, _FAR, 5 * cut).T[:, :, None]
    step = np.moveaxis(_STEP[:, kind], 0, 2).transpose(1, 0, 2)
    to = {DELETE: number[1:], REROLE: number[1:][:, :, _NEXT], INSERT: number[:, :, _NEXT], KEEP: np.take_along_axis(number[1:], np.maximum(step, 0), 2)}
    extra = {DELETE: 0, INSERT: 0, KEEP: np.where(step >= 0, extra, _FAR), REROLE: extra}
    flat = best.reshape(-1)
    finite = best < _FAR
    finite[np.arange(long + 1)[:, None] < long - sizes] = False  # before the first row
    if not last:
        to[INSERT] = to[INSERT][:long]
    arcs = []
    for edit, there in to.items():
        own = best[: len(there)]
        at = np.flatnonzero((own == flat[there] + _COST[edit] + extra[edit]) & finite[: len(there)])
        arcs.append((at, np.full(len(at), edit), there.reshape(-1)[at]))
    node, edit, there = (np.concatenate(x) for x in zip(*arcs, strict=True))
    done = number[long].reshape(-1)
    done = done[finite[long].reshape(-1) & ~np.isin(done, node)]
    node, edit, there = np.concatenate([node, done]), np.concatenate([edit, np.zeros(len(done), int)]), np.concatenate([there, done])
    order = np.lexsort((edit, node))
    return node[order], edit[order], there[order]


def least_paths(node: np.ndarray, edit: np.ndarray, there: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The edits of the least path from each start (0 after its end) and the node where it ends."""
    places, place = np.unique(node, return_inverse=True)
    there, starts = np.searchsorted(places, there), np.searchsorted(places, starts)
    rounds, rank, end = max(1, int(longest).bit_length()), edit.astype(np.int64), there
    for _ in range(rounds):
        best = _least(place, rank)
        then = best[end]
        rank = np.unique(rank * (rank.max() + 1) + rank[then], return_inverse=True)[1]
        end = end[then]
    best = _least(place, rank)
    follow, path = best[there], best[starts][:, None]
    for _ in range(rounds):
        path = np.concatenate([path, follow[path]], 1)
        follow = follow[follow]
    return edit[path], places[place[path[:, -1]]]


def _least(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The arc of the least rank at each place."""
    order = np.lexsort((rank, place))
    return order[np.append(True, place[order][1:] != place[order][:-1])]


def solve(kind: list[np.ndarray], must: list[np.ndarray], cut: list[np.ndarray], ends: np.ndarray, last: bool, entries: tuple[int, ...] = (0,)) -> list[list[tuple[int, bytes, int]]]:
    """For each conversation (or chunk) and each entry state: least cost, audit and the state that it ends in.

    Conversations are laid out by powers of two of their lengths; an entry state from
    which there is no way has an empty audit and the state -1.
    """
    sizes = np.array([len(x) for x in kind], np.int64)
    out: list = [None] * len(sizes)
    level = np.array([int(n).bit_length() for n in sizes])
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        long, n = int(sizes[own].max()), sizes[own]
        laid = []
        for parts, dtype in ((kind, np.int64), (must, bool), (cut, bool)):
            x = np.zeros((len(own), long), dtype)
            x[np.arange(long) >= (long - n)[:, None]] = np.concatenate([parts[i] for i in own])
            laid.append(x)
        best = least_costs(*laid, ends[own], last)
        arcs = optimal_arcs(best, *laid, n, last)
        at = (long - n)[:, None], np.arange(len(own))[:, None], np.array(entries)[None, :]
        cost = best[at]
        starts = (at[0] * len(own) + at[1]) * 4 + at[2]
        able = cost < _FAR
        edits, final = least_paths(*arcs, starts[able], 2 * long + 2) if able.any() else (np.zeros((0, 0), int), np.empty(0, int))
        audits, final = np.frombuffer(_INITIALS, np.uint8)[edits], iter((final % 4).tolist())
        rows = iter(audits)
        for i, a, c in zip(own, able, cost, strict=True):
            out[i] = [(int(x), next(rows).tobytes().rstrip(b"\0"), next(final)) if ok else (int(_FAR), b"", -1) for ok, x in zip(a, c, strict=True)]
    return out


def repaired(audit: bytes, state: int, roles: list[str], texts: list[str], kinds) -> tuple[list[str], int]:
    """``role:text`` of each row that the audit leaves, and the state after them."""
    out, at = [], 0
    for edit in audit.decode():
        if edit == "D":
            at += 1
            continue
        state = int(_STEP[state, kinds[at]]) if edit == "K" else int(_NEXT[state])
        role = roles[at] if edit == "K" else _NEW_ROLE[state]
        out.append(f"{role}:{'' if edit == 'I' else texts[at]}")
        at += edit != "I"
    return out, state


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _illegal(kind: np.ndarray) -> int:
    a, b = kind[:-1], kind[1:]
    return int((~(((a == 1) | (a == 3)) & (b == 2) | (a == 2) & (b == 3))).sum())


def _gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return min(max(known) - min(known) + 1 - len(set(known)), _LONG) if known else 0


def whole(rows: DataFrame) -> DataFrame:
    """The result of conversations that one task can hold: ``marked`` rows, dealt and sorted by conversation."""
    kind_of = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def finished(table: pa.Table) -> pa.RecordBatch:
        ids, turns, roles, texts = (table[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))
        gone, kinds, blank, cut = (table[c].to_numpy() for c in ("gone", "kind", "blank", "cut"))
        first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        own, twice = [], np.zeros(len(ids), bool)
        for a, b in zip(first, [*first[1:], len(ids)], strict=True):
            keep, seen = [i for i in range(a, b) if not gone[i]], set()
            for i in keep:
                twice[i] = (roles[i], texts[i]) in seen
                seen.add((roles[i], texts[i]))
            own.append(np.array(keep, np.int64))
        twice &= ~blank
        cut = cut & ~blank & ~twice
        must = blank | twice
        ends = np.tile(np.array([0, _FAR, _FAR, 0]), (len(own), 1))
        found = solve([kinds[k] for k in own], [must[k] for k in own], [cut[k] for k in own], ends, True)
        out = []
        for a, k, ((cost, audit, _),) in zip(first, own, found, strict=True):
            rows_, _ = repaired(audit, 0, [roles[i] for i in k], [texts[i] for i in k], kinds[k])
            digest = hashlib.sha256("\n".join(rows_).encode()).hexdigest()
            out.append((ids[a], _gaps([turns[i] for i in k]), int(blank[k].sum()), int(twice[k].sum()), int(cut[k].sum()), _illegal(kinds[k]), cost, audit.decode(), digest))
        columns = list(zip(*out, strict=True))
        kinds_ = [table.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < 4096 and held.nbytes < 1 << 24:
                continue
            ids = held["conv_id"].to_pylist()
            to = len(ids) - 1
            while to and ids[to - 1] == ids[-1]:  # the last conversation may go on
                to -= 1
            if to:
                yield finished(held.slice(0, to).combine_chunks())
                held = held.slice(to)
        if held is not None:
            yield finished(held.combine_chunks())

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind_of}, {_RESULT}")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, one after another."""
    held: list[pa.Table] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        rows = list(zip(*[batch[k].to_pylist() for k in keys], strict=True))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and rows[a] != now:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            now = rows[a]
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def in_chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """The result of conversations of any length, from ``marked`` rows."""
    kind_of = rows.schema["conv_id"].dataType.simpleString()
    key = ["conv_id"]
    # A number for each row keeps equal rows apart, which may be many, when rows are dealt by ranges.
    numbered = materialize(rows.filter("NOT gone").withColumn("nth", F.monotonically_increasing_id()), "turns-rows")
    r = assign_seq(numbered, "conv_id", ["turn", "role", "text", "nth"], out="pos", max_group_rows=chunk_rows).drop("nth")
    r = r.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit("second"), "text", "role"))
    seen = r.groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("first_pos"))
    r = join_on(r, seen, ["conv_id", "h1", "h2"]).drop("h1", "h2")
    twice = ~F.col("blank") & (F.col("pos") > F.col("first_pos"))
    r = r.withColumn("twice", twice).withColumn("cut", F.col("cut") & ~F.col("blank") & ~F.col("twice")).withColumn("must", F.col("blank") | F.col("twice"))
    chunk = F.expr(f"pos div {int(chunk_rows)}")
    r = materialize(r.withColumn("chunk", chunk).drop("first_pos").repartition("conv_id", chunk.alias("chunk")).sortWithinPartitions("conv_id", "chunk", "pos"), "turns-chunks")

    def sorted_chunks(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos")

    # 1. Each chunk's least costs from each state before it to each state after it, and what adjacent rows tell.
    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ["conv_id", "chunk"]):
            kind, must, cut = (np.tile(t[c].to_numpy()[None], (4, 1)) for c in ("kind", "must", "cut"))
            between = least_costs(kind, must, cut, np.where(np.eye(4, dtype=bool), 0, _FAR), False)[0]  # [after, before]
            kinds = t["kind"].to_numpy()
            yield pa.RecordBatch.from_arrays([t["conv_id"].combine_chunks().slice(0, 1), t["chunk"].combine_chunks().slice(0, 1), pa.array([between.reshape(-1).tolist()]), pa.array([int(kinds[0])]), pa.array([int(kinds[-1])]), pa.array([_illegal(kinds)])], ["conv_id", "chunk", "costs", "head", "tail", "illegal"])

    slim = r.select("conv_id", "chunk", "pos", "kind", "must", "cut")
    parts = materialize(sorted_chunks(slim).mapInArrow(costs, f"conv_id {kind_of}, chunk long, costs array<long>, head long, tail long, illegal long"), "turns-costs")

    # 2. From the last chunk back: the least cost to the end after each chunk.
    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after = None, None
        for batch in batches:
            out = []
            for conv, table in zip(batch["conv_id"].to_pylist(), batch["costs"].to_pylist(), strict=True):
                if after is None or conv != now[0]:
                    now, after, last = (conv,), np.array([0, _FAR, _FAR, 0]), True
                out.append((after.tolist(), last))
                ends = _inserted(after[None])[0] if last else after
                # Rows may be put in at the end; a chunk's own costs hold those before each of its rows.
                after, last = np.minimum((np.array(table).reshape(4, 4) + ends[:, None]).min(0), _FAR), False
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["chunk"], pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.bool_())], ["conv_id", "chunk", "ends", "last"])

    back = parts.select("conv_id", "chunk", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
    ends = back.mapInArrow(backwards, f"conv_id {kind_of}, chunk long, ends array<long>, last boolean")

    # 3. Each chunk's least path from each state.
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ["conv_id", "chunk"]):
            one = t.slice(0, 1)
            found = solve([t["kind"].to_numpy()], [t["must"].to_numpy()], [t["cut"].to_numpy()], np.array(one["ends"].to_pylist()), one["last"][0].as_py(), (0, 1, 2, 3))[0]
            yield pa.RecordBatch.from_arrays([one["conv_id"].combine_chunks(), one["chunk"].combine_chunks(), *[pa.array([[x[i] for x in found]]) for i in (0, 1, 2)]], ["conv_id", "chunk", "cost", "audits", "exits"])

    solved = sorted_chunks(join_on(slim, ends, ["conv_id", "chunk"])).mapInArrow(paths, f"conv_id {kind_of}, chunk long, cost array<long>, audits array<binary>, exits array<long>")
    solved = materialize(solved, "turns-paths")

    # 4. From the first chunk on: the state that each chunk is entered in.
    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for batch in batches:
            entry = []
            for conv, exits in zip(batch["conv_id"].to_pylist(), batch["exits"].to_pylist(), strict=True):
                if now is None or conv != now[0]:
                    now, state = (conv,), 0
                entry.append(state)
                state = exits[state]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["chunk"], pa.array(entry, pa.int64())], ["conv_id", "chunk", "entry"])

    entries = solved.select("conv_id", "chunk", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(forwards, f"conv_id {kind_of}, chunk long, entry long")
    pieces = materialize(join_on(solved.drop("exits"), entries, ["conv_id", "chunk"]).selectExpr("conv_id", "chunk", "entry", "audits[entry] AS audit", "cost[entry] AS cost"), "turns-audits")

    # 5. The repaired rows of each chunk; then audits and digests as one stream a conversation.
    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ["conv_id", "chunk"]):
            one = t.slice(0, 1)
            rows_, _ = repaired(one["audit"][0].as_py(), one["entry"][0].as_py(), t["role"].to_pylist(), t["text"].to_pylist(), t["kind"].to_numpy())
            body = None if not rows_ else "\n".join(rows_).encode()
            yield pa.RecordBatch.from_arrays([*[one[c].combine_chunks() for c in ("conv_id", "chunk", "audit", "cost")], pa.array([body], pa.binary())], ["conv_id", "chunk", "audit", "cost", "body"])

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close():
            out.append((now[0], now[1], b"".join(now[2]).decode(), now[3].hexdigest()))

        for batch in batches:
            for conv, audit, cost, body in zip(*[batch[c].to_pylist() for c in ("conv_id", "audit", "cost", "body")], strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        close()
                    now = (conv, cost, [], hashlib.sha256(), [])
                now[2].append(audit)
                if body is not None:
                    now[3].update(b"\n" + body if now[4] else body)
                    now[4][:] = [True]
        if now is not None:
            close()
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])], ["conv_id", "cost", "audit", "repaired_sha256"])

    full = join_on(r.select("conv_id", "chunk", "pos", "role", "text", "kind"), pieces, ["conv_id", "chunk"])
    written = materialize(sorted_chunks(full).mapInArrow(bodies, f"conv_id {kind_of}, chunk long, audit binary, cost long, body binary"), "turns-bodies")
    texts = written.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(ends_of, f"conv_id {kind_of}, cost long, audit string, repaired_sha256 string")

    counts = r.groupBy(*key).agg(*[F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("twice", "duplicate"), ("cut", "truncated"))])
    turns = r.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(*key)
    wide = lambda c: c.cast("decimal(38, 0)")
    turns = turns.agg(F.least(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("one"), F.lit(_LONG).cast("decimal(38, 0)")).cast("long").alias("gaps"))
    before = F.lag("tail").over(Window.partitionBy("conv_id").orderBy("chunk"))  # a row for each chunk
    legal = (before.isin(1, 3) & (F.col("head") == 2)) | ((before == 2) & (F.col("head") == 3))
    illegal = parts.select("conv_id", (F.col("illegal") + F.when(before.isNotNull() & ~legal, 1).otherwise(0)).alias("illegal")).groupBy(*key).agg(F.sum("illegal").alias("illegal"))
    out = join_on(join_on(join_on(texts, counts, key), illegal, key), turns, key, "left")
    found = join_on(rows.select("conv_id").distinct(), out, key, "left")
    none = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def repair(rows: DataFrame, chunk_rows: int = 4096, chunk_bytes: int = 1 << 26) -> DataFrame:
    """A row for each conv_id of ``damaged`` rows: gaps, faults, cost, audit and digest of the cheapest repair."""
    m = marked(rows)
    sizes = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    large = sizes.filter((F.col("n") > chunk_rows) | (F.col("b") > chunk_bytes)).select("conv_id", F.lit(True).alias("large"))
    if large.isEmpty():
        return whole(m)
    large = materialize(large, "turns-large")
    tagged = join_on(m, large, ["conv_id"], "left")
    return whole(tagged.filter("large IS NULL").drop("large")).unionByName(in_chunks(tagged.filter("large").drop("large"), chunk_rows))
