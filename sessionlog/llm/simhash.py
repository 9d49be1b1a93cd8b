"""Operator 3: near-duplicate documents by SimHash fingerprints and pivot distance tables.

A fingerprint's table holds its Hamming distances to many reference
fingerprints (pivots).  By the triangle inequality the distances of two
fingerprints to any pivot differ by no more than the fingerprints do, so a pair
whose tables differ by more than ``max_bits`` in any coordinate is discarded;
survivors are verified bit by bit.  Distances of 64-bit fingerprints crowd
around 32, so tables alone leave too many pairs to look at (about half for each
pivot).  Pairs are therefore only formed in buckets: of ``max_bits + 2`` bit
blocks, two fingerprints in reach agree in at least two, and each pair of
blocks is a bucket key.  Nothing within reach is lost.

Equal fingerprints are one node.  A bucket's members are linked by a spanning
forest instead of all pairs; a bucket of more than ``bucket_rows`` members is
split by pivot distance and hash into tiles, and neighbouring tiles are paired.

Words are taken after A-Z to lower case.  Fewer words than ``shingle`` make one
shingle; no words (null, empty, blank texts) give fingerprint zero, which links
like any other.  Rows with a null doc_id take part; component_id is the
smallest doc_id that isn't null.  Repeated rows fall into one component.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.llm.components import components
from sessionlog.llm.perfect_hash import mixed
from sessionlog.llm.shared import pick
from sessionlog.spark import materialize

#: Reference fingerprints: fixed, spread over the space, the first one zero.
PIVOTS = np.concatenate([np.zeros(1, np.uint64), mixed(np.arange(31, dtype=np.uint64), 42)])


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and fp (the 64 bits as a signed integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array([fingerprint(x.as_py(), shingle) for x in batch["text"]], pa.int64())], ["doc_id", "text_hash", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def distance_table(fps: np.ndarray) -> np.ndarray:
    """A row of distances to the pivots for each fingerprint."""
    return np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS], 1)


def _within(a: np.ndarray, b: np.ndarray, table_a: np.ndarray, table_b: np.ndarray, bits: int) -> np.ndarray:
    """Which of the paired fingerprints are within ``bits``: tables first, then the bits of survivors."""
    left = np.flatnonzero((np.abs(table_a.astype(np.int8) - table_b.astype(np.int8)) <= bits).all(-1))
    return left[np.bitwise_count(a[left] ^ b[left]) <= bits]


def _short_runs(fps: np.ndarray, runs: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All links inside runs of equal number (of a few rows each), by comparing rows at each lag."""
    table, out, at = distance_table(fps), [], np.arange(len(fps))
    for lag in range(1, len(fps)):
        at = at[at + lag < len(fps)]
        at = at[runs[at] == runs[at + lag]]
        if not len(at):
            break
        hit = at[_within(fps[at], fps[at + lag], table[at], table[at + lag], bits)]
        out.append((fps[hit], fps[hit + lag]))
    return out


def _forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among the fingerprints: one less than members of each part."""
    table = distance_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left, out = np.arange(len(fps)), []  # still sorted by the distance to the first pivot
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            first = table[left, 0].astype(np.int64)
            a, b = np.searchsorted(first, [int(table[x, 0]) - bits, int(table[x, 0]) + bits + 1])
            near = left[a:b]
            hit = _within(np.full(len(near), fps[x]), fps[near], np.broadcast_to(table[x], (len(near), table.shape[1])), table[near], bits)
            if len(hit):
                found = near[hit]
                out.append((np.full(len(found), fps[x]), fps[found]))
                queue.extend(found.tolist())
                left = np.delete(left, a + hit)
    return out


def _linker(bits: int, bucket_rows: int):
    """Arrow batches sorted by bucket to links (hot false) and members of oversized buckets (hot true)."""

    def rows(hot: bool, bucket, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(bucket), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["hot", "bucket", "a", "b"])

    def solve(bucket: np.ndarray, fps: np.ndarray):
        """Whole buckets of at most bucket_rows members each."""
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(starts, len(bucket)))
        number = np.repeat(np.arange(len(starts)), sizes)
        few = (sizes >= 2) & (sizes <= 32)
        mine = few[number]
        links = _short_runs(fps[mine], number[mine], bits)
        for k in np.flatnonzero(sizes > 32):
            links += _forest(fps[starts[k] : starts[k] + sizes[k]], bits)
        if links:
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            yield rows(False, np.zeros(len(a), np.int64), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        over = None  # the bucket that has already proved too large
        for batch in batches:
            held_b = np.concatenate([held_b, batch["bucket"].to_numpy(zero_copy_only=False)])
            held_f = np.concatenate([held_f, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(held_b):
                continue
            if over is not None:
                same = held_b == over
                if same.any():
                    yield rows(True, held_b[same], held_f[same], held_f[same])
                held_b, held_f = held_b[~same], held_f[~same]
                if not len(held_b):
                    continue
                over = None
            last = held_b == held_b[-1]
            done = ~last
            yield from split(held_b[done], held_f[done])
            held_b, held_f = held_b[last], held_f[last]
            if len(held_b) > bucket_rows:
                over = held_b[0]
                yield rows(True, held_b, held_f, held_f)
                held_b, held_f = held_b[:0], held_f[:0]
        yield from split(held_b, held_f)

    def split(bucket, fps):
        if len(bucket):
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            large = np.repeat(np.diff(np.append(starts, len(bucket))) > bucket_rows, np.diff(np.append(starts, len(bucket))))
            if large.any():
                yield rows(True, bucket[large], fps[large], fps[large])
            if not large.all():
                yield from solve(bucket[~large], fps[~large])

    return run


_LINKS = "hot boolean, bucket long, a long, b long"


def links(fps: DataFrame, max_bits: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within ``max_bits``."""
    n = max_bits + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j])).cast("long"))) for k, (i, j) in enumerate(combinations(range(n), 2))])
    buckets = fps.select("fp", F.explode(keys).alias("bucket"))
    dealt = buckets.repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(dealt.mapInArrow(_linker(max_bits, bucket_rows), _LINKS), "simhash-links")
    near = found.filter("not hot").select("a", "b")
    if found.filter("hot").isEmpty():
        return near.distinct()
    return near.unionByName(_tiles(found.filter("hot").select("bucket", F.col("a").alias("fp")), max_bits, bucket_rows)).distinct()


def _tiles(hot: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """Links inside oversized buckets: cells of pivot distance, split by hash, each paired with those in reach."""
    half = max(1, bucket_rows // 2)
    cell = F.floor(F.bit_count("fp") / (max_bits + 1)).cast("int")  # the distance to the first pivot, zero
    rows = hot.select("bucket", "fp", cell.alias("cell"))
    parts = rows.groupBy("bucket", "cell").agg(F.ceil(F.count("*") / half).cast("int").alias("parts"))
    other = parts.select("bucket", F.col("cell").alias("cell2"), F.col("parts").alias("parts2"))
    reach = parts.withColumn("cell2", F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)]))).join(other, ["bucket", "cell2"])
    placed = rows.join(reach, ["bucket", "cell"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    placed = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    # Each unordered pair of tiles has one name; a tile's own pair takes its rows once.
    mine, theirs = F.struct("cell", F.col("own").alias("part")), F.struct(F.col("cell2").alias("cell"), F.col("salt").alias("part"))
    tile = F.xxhash64("bucket", F.least(mine, theirs), F.greatest(mine, theirs))
    tiles = placed.select(tile.alias("bucket"), "fp").distinct()
    dealt = tiles.repartition("bucket").sortWithinPartitions("bucket")
    # Tiles are about bucket_rows at most by construction; none is set aside again.
    return dealt.mapInArrow(_linker(max_bits, 1 << 62), _LINKS).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, bucket_rows: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach), text_hash and root of every document.

    Rows of one component have the same ``root``, its smallest fingerprint, whatever their ids.
    """
    own = materialize(fingerprints(docs, shingle, doc_id, text), "simhash-docs")
    groups = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-groups")
    linked = materialize(components(links(groups.select("fp"), max_bits, bucket_rows)), "simhash-components")
    rooted = groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    # One row for each fingerprint: Spark splits a fingerprint that very many documents share.
    classes = materialize(rooted.join(first, "root").select("fp", "component_id", "root"), "simhash-classes")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id", "text_hash", "root")
