"""Operator 2: shards of near-equal bytes, groups kept together, by longest-processing-time scheduling.

Sorted by size, largest first, each unit goes to the least-loaded shard (a
heap).  A unit is a group of equal texts whose bytes are at least
``1 / (shards * fine)`` of all, of which there are at most ``shards * fine``;
the other, smaller groups are first put by hash into ``bundles`` units.  So the
heap sees at most ``shards * fine + bundles`` units however many groups there
are, no group is ever split, and loads differ by at most one unit.

Nulls: a null text has no bytes (size 1, crc32 0) and is in the group of the
empty text; a null doc_id is a document like any other.  Ties and repeated rows
are ordered by doc_id and text hash; rows equal in both may swap slots.  An
empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.llm.shared import pick
from sessionlog.spark import materialize


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit: largest first, each to the least-loaded shard (ties: lowest number)."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for unit in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + sizes[unit], shard))
        out[unit] = shard
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, fine: int = 1024, bundles: int = 8192, slot_rows: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... in each shard) of every document."""
    spark, body = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        pick(docs, doc_id=doc_id, text=text).select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h1"),
            F.xxhash64(F.lit("second"), body).alias("h2"),
        ),
        "shard-rows",
    )
    bundle = F.pmod("h1", F.lit(bundles)).cast("int")
    groups = materialize(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")).withColumn("bundle", bundle), "shard-groups")
    total, n_rows = groups.agg(F.sum("bytes")).first()[0] or 0, rows.count()
    large = F.col("bytes") * (shards * fine) >= F.lit(total)
    # Both lists are bounded by parameters, not by the data.
    big = groups.filter(large).orderBy(F.desc("bytes"), "h1", "h2").select("h1", "h2", "bytes").collect()
    small = groups.filter(~large).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()
    at = longest_first([r.bytes for r in big] + [r.bytes for r in small], shards)
    big_at = spark.createDataFrame([(r.h1, r.h2, s) for r, s in zip(big, at, strict=False)], "h1 long, h2 long, big_shard int")
    small_at = spark.createDataFrame([(r.bundle, s) for r, s in zip(small, at[len(big) :], strict=True)], "bundle int, small_shard int")

    parts = max(1, -(-n_rows // slot_rows))
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(big_at), ["h1", "h2"], "left")
        .join(F.broadcast(small_at), "bundle", "left")
        .select("doc_id", "size", "text_crc32", "h1", F.coalesce("big_shard", "small_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "h1"), F.lit(parts)).alias("part"))
    )
    placed = materialize(placed, "shard-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "part").orderBy("doc_id", "h1")
    return (
        placed.withColumn("nth", F.row_number().over(inner))
        .join(bases, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
    )
