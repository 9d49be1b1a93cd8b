"""Skew-safe ordering helpers: sequence numbers, ordinals and top-k per group.

None of these put one group into one task: a hot key is split either by a
range exchange over the full sort key or by bounded chunks of the order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.spark import materialize as materialize_df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches NULL keys with NULL keys; the keys appear once, from ``left``."""
    right = right.withColumnsRenamed({k: f"_rk_{k}" for k in keys})
    cond = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"_rk_{k}"])
        cond = same if cond is None else cond & same
    return left.join(right, cond, how).drop(*[f"_rk_{k}" for k in keys])


def assign_seq(df: DataFrame, key: str, order_cols: Sequence[str], out: str = "seq",
               materialize: bool = True, max_group_rows: int = 1 << 20) -> DataFrame:
    """0-based position of each row inside its ``key`` group in ``order_cols`` order.

    Equal to ``row_number() over (partition by key order by order_cols) - 1``
    when ``(key, order_cols)`` is unique, but computed without a window over the
    whole group: a range exchange on the full sort key spreads a hot group over
    many partitions, each partition counts its share of every group, and a small
    per-(group, partition) offset table (broadcast by AQE when small) stitches
    the counts together.

    The partition-tagged rows are written under the shared checkpoint folder, so
    the offset table and the final join read the same tags whatever executors
    are lost; with ``materialize`` so is the sequenced table (lineage cut).

    Rows with a NULL key form one group like any other.

    When no group exceeds ``max_group_rows`` (checked with one partial-aggregated
    count) a plain ``row_number`` window is used: every window partition is then
    bounded, and it saves the sampling job and the offset join.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [key, *order_cols]
    biggest = df.groupBy(key).count().agg(F.max("count")).first()[0]
    if biggest is None or biggest <= max_group_rows:
        w = Window.partitionBy(key).orderBy(*order_cols)
        res = df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
        return materialize_df(res, "seq") if materialize else res
    # explicit partition count: AQE never coalesces this exchange, so tags are stable
    tagged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    # both consumers below must see the same tags: a recomputed partition might get others
    tagged = materialize_df(tagged, "seq-tagged")
    spans = tagged.groupBy(key, "_part").agg(F.min("_mono").alias("_mono0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    res = (
        join_on(tagged, spans.select(key, "_part", "_mono0", "_off"), [key, "_part"])
        .withColumn(out, (F.col("_mono") - F.col("_mono0") + F.col("_off")).cast("bigint"))
        .drop("_part", "_mono", "_mono0", "_off")
    )
    return materialize_df(res, "seq") if materialize else res


def ordinal_within(df: DataFrame, keys: Sequence[str], order_col: str, out: str, chunk_rows: int,
                   bounded: bool = False) -> DataFrame:
    """1-based rank of rows inside ``keys`` by a unique, roughly dense ``order_col``.

    Rows are windowed per ``(keys, order_col div chunk_rows)`` (bounded), and a
    per-chunk count table gives each chunk its offset.  ``bounded=True`` (the
    caller knows every group is under ``chunk_rows`` rows) ranks in one window.
    """
    if bounded:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order_col)).cast("bigint"))
    ch = F.expr(f"CAST(`{order_col}` AS BIGINT) div {int(chunk_rows)}")
    d = df.withColumn("_och", ch)
    local = Window.partitionBy(*keys, "_och").orderBy(order_col)
    d = d.withColumn("_ord_l", F.row_number().over(local))
    counts = d.groupBy(*keys, "_och").agg(F.count(F.lit(1)).alias("_cn"))
    before = Window.partitionBy(*keys).orderBy("_och").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_coff", F.coalesce(F.sum("_cn").over(before), F.lit(0))).drop("_cn")
    return (
        join_on(d, offs, [*keys, "_och"])
        .withColumn(out, (F.col("_ord_l") + F.col("_coff")).cast("bigint"))
        .drop("_och", "_ord_l", "_coff")
    )


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread_col: str,
                    fanout: int = 64, rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per ``keys`` in ``order`` (a total order), two-phase.

    Phase one keeps the top ``k`` inside ``(keys, hash(spread_col) % fanout)``;
    phase two ranks the at most ``k * fanout`` survivors per group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_col)), F.lit(fanout)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
