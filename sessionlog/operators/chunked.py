"""Generic ordered scans over bounded chunks: previous-row values and running sums.

Both helpers window over ``(key, order_col div chunk_rows)`` (bounded because
``order_col`` is unique per key) and stitch chunks with a small carry table
(one row per non-empty chunk).  Chunks may be empty; carries always come from
the nearest earlier non-empty chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.operators.sequence import join_on

UNB = Window.unboundedPreceding


def _chunk(order_col: str, chunk_rows: int):
    """Exact integer chunk number of a BIGINT order column."""
    return F.expr(f"CAST(`{order_col}` AS BIGINT) div {int(chunk_rows)}")


def lag_across(df: DataFrame, key: str, order_col: str, cols: Sequence[str], chunk_rows: int,
               prefix: str = "prev_", single_chunk: bool = False) -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` on the previous row of the same key.

    ``single_chunk=True`` (caller checked ``max(order_col) < chunk_rows``) skips the carries.
    """
    d = df.withColumn("_lc", _chunk(order_col, chunk_rows))
    w = Window.partitionBy(key, "_lc").orderBy(order_col)
    if single_chunk:
        return d.select(*df.columns, *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in cols])
    d = d.select("*", F.row_number().over(w).alias("_lrn"),
                 *[F.lag(c).over(w).alias(f"_l_{c}") for c in cols])
    last = d.groupBy(key, "_lc").agg(*[F.max_by(c, order_col).alias(f"_z_{c}") for c in cols])
    cw = Window.partitionBy(key).orderBy("_lc")
    carry = last.select(key, "_lc", *[F.lag(f"_z_{c}").over(cw).alias(f"_c_{c}") for c in cols],
                        F.lag("_lc").over(cw).alias("_pc")).filter(F.col("_pc").isNotNull()).drop("_pc")
    j = join_on(d, carry, [key, "_lc"], "left")
    out = j.select(
        *df.columns,
        *[F.when(F.col("_lrn") == 1, F.col(f"_c_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"{prefix}{c}")
          for c in cols],
    )
    return out


def cumsum_across(df: DataFrame, key: str, order_col: str, value_col: str, out: str, chunk_rows: int,
                  single_chunk: bool = False) -> DataFrame:
    """Add ``out`` = running sum of ``value_col`` (inclusive) along ``order_col``."""
    total = running_across(df, key, order_col, value_col, "_run", F.sum, lambda a, b: a + b, chunk_rows, single_chunk)
    return total.select(*df.columns, F.col("_run").cast("bigint").alias(out))


def running_across(df: DataFrame, key: str, order_col: str, value_col: str, out: str, agg, both, chunk_rows: int,
                   single_chunk: bool = False) -> DataFrame:
    """Add ``out`` = ``agg`` (sum, max, ...) of ``value_col`` over the rows up to and including this one.

    ``both`` combines a chunk's running value with that of all chunks before it.
    """
    d = df.withColumn("_sc", _chunk(order_col, chunk_rows))
    w = Window.partitionBy(key, "_sc").orderBy(order_col).rowsBetween(UNB, Window.currentRow)
    d = d.withColumn("_sl", agg(value_col).over(w))
    if single_chunk:
        return d.select(*df.columns, F.col("_sl").alias(out))
    tot = d.groupBy(key, "_sc").agg(agg(value_col).alias("_st"))
    cw = Window.partitionBy(key).orderBy("_sc").rowsBetween(UNB, -1)
    offs = tot.select(key, "_sc", agg("_st").over(cw).alias("_so")).filter(F.col("_so").isNotNull())
    j = join_on(d, offs, [key, "_sc"], "left")
    value = F.when(F.col("_so").isNull(), F.col("_sl")).when(F.col("_sl").isNull(), F.col("_so"))
    return j.select(*df.columns, value.otherwise(both(F.col("_sl"), F.col("_so"))).alias(out))
