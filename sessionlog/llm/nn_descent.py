"""Operator 8: approximate nearest neighbours by cosine, on a graph built by NN-descent.

Nodes are the distinct vectors; of rows with equal vectors, a node keeps the
smallest ids (as many as any answer can name), so many copies of one vector are
one node.  A neighbour list holds the ``degree`` nearest nodes known.

* First lists: random hyperplanes order the nodes, ``trees`` times, and each
  node looks at its block of neighbours in that order.
* NN-descent: in each round, lists are joined on the node in the middle; it
  compares the nodes that list it with those that it lists (pairs with at least
  one new entry), and those better than a list's last entry go to that list.
  Rounds end when at most ``still`` of all entries change, however many that takes:
  lists only get better, so they do end.  Each round's changes are logged.
* Search: each query walks the graph greedily from its own node: it keeps the
  ``beam`` best nodes met and joins the lists of the best ones not yet visited,
  until all in the beam are visited.  Those are scored on the original vectors.

Lists and walks rank by the squared distance of unit vectors of four bytes a
component, so near copies are told apart; scores that are returned use double
precision.

Vectors that are null or zero, or hold a null or non-finite component, take no
part.  A null id takes no part.  Shorter vectors count as padded with zeros.
Ties go to the smaller id.  Repeated (id, vector) rows count once.  Other
columns of the input are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.llm.shared import pick
from sessionlog.spark import materialize

_LOG = logging.getLogger(__name__)
#: Below the similarity of any two unit vectors.
_NONE = -5.0
_GRAPH = "node long, code binary, ids array<long>, sims array<float>, fresh array<boolean>"


def _codes(x: np.ndarray) -> list[bytes]:
    """Unit vectors, four bytes a component."""
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    return [r.tobytes() for r in x]


def _vectors(codes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), "<f4").reshape(len(codes), -1).astype(np.float64)


def _sims(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, negative: small ones keep their digits where cosines near one would not."""
    return np.minimum(2 * (x @ y.T) - (x * x).sum(1)[:, None] - (y * y).sum(1), 0)


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        v = np.asarray(r.values, np.float64)
        out[i, : len(v)] = v
    return out


def _lists(target: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> pa.RecordBatch:
    """One row for each target: its ``most`` best distinct ids."""
    order = np.lexsort((sims, ids, target))
    target, ids, sims = target[order], ids[order], sims[order]
    last = np.append((target[1:] != target[:-1]) | (ids[1:] != ids[:-1]), True)[: len(ids)]
    target, ids, sims = target[last], ids[last], sims[last]
    order = np.lexsort((ids, -sims, target))
    target, ids, sims = target[order], ids[order], sims[order]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1])[: len(target)])
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    target, ids, sims = target[rank < most], ids[rank < most], sims[rank < most]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1])[: len(target)])
    at = pa.array(np.append(first, len(target)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(target[first]), pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(sims.astype(np.float32)))], ["node", "ids", "sims"])


_LISTS = "node long, ids array<long>, sims array<float>"


def _first_lists(nodes: DataFrame, n: int, dim: int, degree: int, trees: int, block: int) -> DataFrame:
    bits = max(0, int(np.log2(max(1, n / block))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch["code"])
            for tree in range(trees):
                planes = np.random.default_rng([7, tree]).normal(size=(dim, 33)).astype(np.float32)
                y = x @ planes
                key = np.zeros(len(x), np.int64)
                for b in range(min(bits, 32)):
                    key = key << 1 | (y[:, b] > 0)
                key = (key << 30) + np.clip((y[:, 32] + 8) * (1 << 26), 0, (1 << 30) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(key), batch["node"], batch["code"]], ["tree", "key", "node", "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            while len(held) >= 2 * block:
                yield from inside(held.slice(0, block))
                held = held.slice(block)
        if held is not None and len(held):
            yield from inside(held)

    def inside(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, x = rows["node"].to_numpy(), _vectors(rows["code"])
        sims = _sims(x, x)
        np.fill_diagonal(sims, _NONE)
        most = min(degree, len(node) - 1)
        if most > 0:
            best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            yield _lists(np.repeat(node, most), node[best.reshape(-1)], np.take_along_axis(sims, best, 1).reshape(-1), degree)

    # Where a tree ends inside a block, nodes of two trees meet: a node then may meet itself, which _merge drops.
    ordered = nodes.mapInArrow(keys, "tree int, key long, node long, code binary").repartitionByRange(max(1, trees * n // 8192), "tree", "key").sortWithinPartitions("tree", "key")
    return ordered.mapInArrow(near, _LISTS)


def _merge(old: DataFrame, new: DataFrame, degree: int) -> DataFrame:
    """The graph with each list's best entries of both; ``fresh`` marks those that weren't in it."""
    rows = old.select("node", F.lit(0).alias("kind"), "code", "ids", "sims").unionByName(new.select("node", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("code"), "ids", "sims"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close():
            code, parts, known = now[1:]
            ids, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = ids != now[0]
            ids, sims = ids[keep], sims[keep]
            ids, at = np.unique(ids, return_index=True)
            best = np.lexsort((ids, -sims[at]))[:degree]
            return {"node": now[0], "code": code, "ids": ids[best], "sims": sims[at][best], "fresh": [i not in known for i in ids[best].tolist()]}

        schema = pa.schema([("node", pa.int64()), ("code", pa.binary()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_()))])
        for batch in batches:
            nodes, kinds = batch["node"].to_pylist(), batch["kind"].to_pylist()
            for i, (node, kind) in enumerate(zip(nodes, kinds, strict=True)):
                ids, sims = np.asarray(batch["ids"][i].values, np.int64), np.asarray(batch["sims"][i].values, np.float32)
                if kind == 0:
                    if now is not None:
                        out.append(close())
                    now = (node, batch["code"][i].as_py(), [(ids, sims)], set(ids.tolist()))
                elif now is not None and node == now[0]:
                    now[2].append((ids, sims))
                    if len(now[2]) >= 64:  # a node that very many name
                        ids, sims = (np.concatenate(x) for x in zip(*now[2], strict=True))
                        ids, at = np.unique(ids, return_index=True)
                        best = np.lexsort((ids, -sims[at]))[: degree + 1]
                        now[2][:] = [(ids[best], sims[at][best])]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            out.append(close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(run, _GRAPH)


def _compare(graph: DataFrame, degree: int) -> DataFrame:
    """Better entries for lists, from the node in the middle of two list entries."""
    info = graph.select("node", "code", F.when(F.size("sims") < degree, F.lit(_NONE)).otherwise(F.array_min("sims")).cast("float").alias("worst"), "ids", "fresh")
    edges = info.select("node", "code", "worst", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", "code", "worst", F.col("e.ids").alias("other"), F.col("e.fresh").alias("fresh"))
    listed = edges.select(F.col("node").alias("middle"), "other", "fresh").join(info.select(F.col("node").alias("other"), "code", "worst"), "other")
    listed = listed.select("middle", F.lit(0).alias("kind"), F.col("other").alias("id"), "code", "worst", "fresh")
    listing = edges.select(F.col("other").alias("middle"), F.lit(1).alias("kind"), F.col("node").alias("id"), "code", "worst", "fresh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None  # the middle node and what it lists
        for batch in batches:
            if not len(batch):
                continue
            found: list = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
            middle, kind, ids = (batch[c].to_numpy() for c in ("middle", "kind", "id"))
            x, worst, fresh = _vectors(batch["code"]), batch["worst"].to_numpy(), batch["fresh"].to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, (middle[1:] != middle[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(middle)), strict=True):
                rows = (ids[a:b], x[a:b], worst[a:b], fresh[a:b])
                if kind[a] == 0:
                    same = now == middle[a]
                    if same:  # the list goes on from the batch before
                        _pairs(own, rows, found)
                    _pairs(rows, rows, found, both=False)
                    own = tuple(np.concatenate(z) for z in zip(own, rows, strict=True)) if same else rows
                    now = middle[a]
                elif now == middle[a]:
                    _pairs(rows, own, found)
            yield _lists(*(np.concatenate(z) for z in zip(*found, strict=True)), degree)

    def _pairs(p, q, found: list, both: bool = True) -> None:
        sims = _sims(p[1], q[1])
        able = (p[3][:, None] | q[3]) & (p[0][:, None] != q[0])
        i, j = np.nonzero(able & (sims > p[2][:, None]))
        found.append((p[0][i], q[0][j], sims[i, j]))
        if both:
            i, j = np.nonzero(able & (sims > q[2]))
            found.append((q[0][j], p[0][i], sims[i, j]))

    return listed.unionByName(listing).repartition("middle").sortWithinPartitions("middle", "kind").mapInArrow(run, _LISTS)


def build_graph(nodes: DataFrame, dim: int, degree: int, trees: int, block: int, still: float) -> DataFrame:
    """Neighbour lists (node, code, ids, sims, fresh) of all nodes (node, code)."""
    n = nodes.count()
    empty = nodes.select("node", "code", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"))
    graph = materialize(_merge(empty, _first_lists(nodes, n, dim, degree, trees, block), degree), "nn-graph")
    changed, rounds = n * degree, 0
    while changed > still * n * degree:
        graph = materialize(_merge(graph, _compare(graph, degree), degree), "nn-graph")
        changed, rounds = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0, rounds + 1
        _LOG.info("round %d: %d of %d entries changed", rounds, changed, n * degree)
    return graph


def _walk(graph: DataFrame, starts: DataFrame, beam: int, step: int) -> DataFrame:
    """(node, ids): the beam of each start node after a greedy walk."""
    entries = graph.select("node", F.explode("ids").alias("other")).join(graph.select(F.col("node").alias("other"), "code"), "other")
    lists = materialize(entries.groupBy("node").agg(F.collect_list("other").alias("ids"), F.collect_list("code").alias("codes")), "nn-lists")  # at most ``degree`` each
    state_schema = "node long, code binary, ids array<long>, sims array<float>, seen array<boolean>, todo array<long>"
    state_arrow = pa.schema([("node", pa.int64()), ("code", pa.binary()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("seen", pa.list_(pa.bool_())), ("todo", pa.list_(pa.int64()))])

    def advance(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def close():
            node, code, seen, parts = now
            ids, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, at = np.unique(ids, return_index=True)
            sims = sims[at]
            best = np.lexsort((ids, -sims))[:beam]
            ids, sims = ids[best], sims[best]
            todo = [i for i in ids.tolist() if i not in seen][:step]
            seen |= set(todo)
            return pa.RecordBatch.from_pylist([{"node": node, "code": code, "ids": ids, "sims": sims, "seen": [i in seen for i in ids.tolist()], "todo": todo}], state_arrow)

        for batch in rows:
            for i in range(len(batch)):
                ids, sims = np.asarray(batch["ids"][i].values, np.int64), np.asarray(batch["sims"][i].values, np.float32)
                if batch["kind"][i].as_py() == 0:
                    if now is not None:
                        yield close()
                    seen = {j for j, s in zip(ids.tolist(), batch["seen"][i].as_py(), strict=True) if s}
                    now = (batch["node"][i].as_py(), batch["code"][i].as_py(), seen, [(ids, sims)])
                else:
                    now[3].append((ids, sims))
        if now is not None:
            yield close()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sizes = pc.list_value_length(part["ids"]).to_numpy()
                sims = -((_vectors(part["codes"].flatten()) - np.repeat(_vectors(part["code"]), sizes, 0)) ** 2).sum(1)
                node, ids = np.repeat(part["node"].to_numpy(), sizes), part["ids"].flatten().to_numpy()
                able = node != ids
                yield _lists(node[able], ids[able], sims[able], beam)

    def moved(state: DataFrame, new: DataFrame | None) -> DataFrame:
        rows = state.select("node", F.lit(0).alias("kind"), "code", "ids", "sims", "seen")
        if new is not None:
            none = F.lit(None)
            rows = rows.unionByName(new.select("node", F.lit(1).alias("kind"), none.cast("binary").alias("code"), "ids", "sims", none.cast("array<boolean>").alias("seen")))
        return materialize(rows.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(advance, state_schema), "nn-walk")

    first = graph.join(starts, "node", "left_semi").select("node", "code", "ids", "sims", F.transform("ids", lambda i: F.lit(False)).alias("seen"))
    state = moved(first, None)
    while not state.filter(F.size("todo") > 0).isEmpty():
        asked = state.select("node", "code", F.explode("todo").alias("other")).join(lists.select(F.col("node").alias("other"), "ids", "codes"), "other")
        state = moved(state, asked.select("node", "code", "ids", "codes").mapInArrow(meet, _LISTS))
    return state.select("node", "ids")


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, degree: int = 24, beam: int = 128, step: int = 32, trees: int = 3, block: int = 128, still: float = 0.02, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of each query row (``is_query``, on column vec_id)."""
    v = F.col("v")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    raw = pick(rows, vec_id=vec_id, v=vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).filter(usable)
    keyed = materialize(raw.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")).distinct(), "nn-rows")
    dim = keyed.agg(F.max(F.size("v"))).first()[0] or 1
    # The k + 1 smallest ids of each distinct vector; Spark drops the others before the shuffle.
    by_vector = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = keyed.withColumn("nth", F.row_number().over(by_vector)).filter(F.col("nth") <= k + 1)
    few = materialize(few.withColumn("node", F.min("vec_id").over(Window.partitionBy("h1", "h2"))).select("node", "vec_id", "v", "h1", "h2", "nth"), "nn-members")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(_codes(_matrix(batch["v"], dim)), pa.binary())], ["node", "code"])

    heads = few.filter("nth = 1")
    nodes = materialize(heads.select("node", "v").mapInArrow(code, "node long, code binary"), "nn-nodes")
    graph = build_graph(nodes, dim, degree, trees, block, still)
    queries = keyed.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "h1", "h2").join(heads.select("node", "h1", "h2"), ["h1", "h2"]).select("query_id", "q", "node")
    walked = _walk(graph, queries.select("node").distinct(), beam, step)
    met = walked.select("node", F.explode(F.array_union("ids", F.array("node"))).alias("other"))
    pairs = queries.join(met, "node").select("query_id", "q", F.col("other").alias("node"))
    # Vectors come from the members' own rows, for scores in double precision.
    scored = pairs.join(few.select("node", "vec_id", "v"), "node").filter("vec_id <> query_id").select("query_id", "vec_id", "q", "v")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x = _matrix(batch["q"], dim), _matrix(batch["v"], dim)
            score = (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["vec_id"], pa.array(score)], ["query_id", "vec_id", "score"])

    result = scored.mapInArrow(cosine, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
