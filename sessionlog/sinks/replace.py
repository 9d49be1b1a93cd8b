"""Replace sessions in a stored table: only the hash buckets that hold them are rewritten.

The number of buckets is kept with the table (folders ``_buckets/n-<number>``) and
grows with it by linear hashing: with ``n`` buckets and ``m`` the largest power of two
up to ``n``, bucket ``n`` is split off bucket ``n - m``; no other rows move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.operators.sequence import join_on
from sessionlog.spark import materialize

BUCKETS = 64
#: A table gets more buckets when theirs are larger than this on average.
BUCKET_BYTES = 256 << 20


def _low(buckets: int) -> int:
    """The largest power of two up to ``buckets``."""
    return 1 << (buckets.bit_length() - 1)


def bucket_of(key: str = "session_id", buckets: int = BUCKETS):
    """Hash bucket of a session id: the partition column of stored tables."""
    h, low = F.xxhash64(key), _low(buckets)
    fine = F.pmod(h, F.lit(2 * low))
    return F.when(fine < buckets, fine).otherwise(F.pmod(h, F.lit(low)))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(p))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    fs, p = _path(spark, f"{path}/_buckets")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.removeprefix(f"{kind}-")) for n in names if n.startswith(f"{kind}-")]


def _mark(spark: SparkSession, path: str, kind: str, number: int) -> None:
    fs, p = _path(spark, f"{path}/_buckets/{kind}-{number}")
    fs.mkdirs(p)


def table_buckets(spark: SparkSession, path: str, default: int = BUCKETS) -> int:
    """The table's number of buckets; ``default`` for one that has grown never."""
    return max(_numbers(spark, path, "n"), default=default)


def table_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _stored(spark: SparkSession, path: str, fmt: str, read, buckets: Sequence[int]) -> DataFrame:
    old = spark.read.format(fmt).load(path).filter(F.col("bucket").isin(list(buckets)))
    return (read(old) if read else old).withColumn("bucket", F.col("bucket").cast("bigint"))


def _overwrite(staged: DataFrame, path: str, keys: Sequence[str], fmt: str, write, expected: Sequence[int]) -> None:
    """Put the staged rows in place of their buckets' rows; a bucket of ``expected`` without rows goes."""
    spark = staged.sparkSession
    out = staged.repartitionByRange("bucket", *keys).sortWithinPartitions("bucket", *keys)
    out = write(out) if write else out
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").format(fmt).save(path)
    left = {r.bucket for r in staged.select("bucket").distinct().collect()}
    for b in set(expected) - left:
        fs, p = _path(spark, f"{path}/bucket={b}")
        fs.delete(p, True)


def grow(spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES, order: Sequence[str] = (), key: str = "session_id",
         fmt: str = "parquet", read: Callable[[DataFrame], DataFrame] | None = None,
         write: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> int:
    """Split buckets, in the order of linear hashing, until they hold at most ``bucket_bytes`` on average.

    The buckets split off are written first, then the new number is recorded, then the moved
    rows leave their old buckets.  A call that is cut off is made good by the next one: an
    unrecorded split is done again, a recorded one is cleaned.  Until then a plain reader may see
    moved rows in both buckets.  Returns the number of buckets.
    """
    keys = list(order) or [key]
    now = table_buckets(spark, path, buckets)
    clean = max(_numbers(spark, path, "clean"), default=buckets)
    want = max(now, -(-table_bytes(spark, path) // bucket_bytes))
    if clean < now:  # cut off after recording
        _leave(spark, path, keys, key, fmt, read, write, clean, now)
    if want > now:
        sources = {_source(b, now) for b in range(now, want)}
        moved = _stored(spark, path, fmt, read, sources).withColumn("bucket", bucket_of(key, want)).filter(F.col("bucket") >= now)
        _overwrite(materialize(moved, "split"), path, keys, fmt, write, range(now, want))
        _mark(spark, path, "n", want)
        _leave(spark, path, keys, key, fmt, read, write, now, want)
    return want


def _source(bucket: int, now: int) -> int:
    """The bucket, of ``now``, whose rows a later bucket gets."""
    while bucket >= now:
        bucket -= _low(bucket)
    return bucket


def _leave(spark, path, keys, key, fmt, read, write, before: int, after: int) -> None:
    sources = {_source(b, before) for b in range(before, after)}
    stay = _stored(spark, path, fmt, read, sources)
    stay = stay.filter(F.col("bucket") == bucket_of(key, after))
    _overwrite(materialize(stay, "split"), path, keys, fmt, write, sources)
    _mark(spark, path, "clean", after)


def stored_sessions(spark: SparkSession, ids: DataFrame, path: str, schema: str, key: str = "session_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows that a stored table holds of the sessions in ``ids``; only their buckets are read."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    ids, now = ids.select(key).distinct(), table_buckets(spark, path, buckets)
    touched = [r.bucket for r in ids.select(bucket_of(key, now).alias("bucket")).distinct().collect()]  # at most ``now``
    rows = spark.read.schema(f"{schema}, bucket bigint").parquet(path).filter(F.col("bucket").isin(touched) & (F.col("bucket") == bucket_of(key, now)))
    return join_on(rows.drop("bucket"), ids, [key], "left_semi")


def replace_sessions(new: DataFrame, ids: DataFrame, path: str, order: Sequence[str] = (), key: str = "session_id",
                     fmt: str = "parquet", read: Callable[[DataFrame], DataFrame] | None = None,
                     write: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS,
                     bucket_bytes: int = BUCKET_BYTES) -> None:
    """Rows of the sessions in ``ids`` become those of ``new``; all other sessions stay.

    Only the touched buckets are read; what they will hold is staged in the
    shared folder first and then overwrites just these buckets, so running the
    call again after a failure gives the same table.  ``order`` sorts rows in
    each bucket, over part files in name order.  For formats that don't keep
    columns, ``read`` and ``write`` turn stored rows into rows and back.  ``buckets`` is the number
    that a table begins with, the same in each call; it grows as the table does (:func:`grow`),
    so that a call rewrites folders of a bounded size.
    """
    spark = new.sparkSession
    ids = ids.select(key).distinct()
    held = table_exists(spark, path)
    if held and max(_numbers(spark, path, "clean"), default=buckets) < table_buckets(spark, path, buckets):
        grow(spark, path, bucket_bytes, order, key, fmt, read, write, buckets)
    now = table_buckets(spark, path, buckets)
    rows = new.withColumn("bucket", bucket_of(key, now))
    touched = [r.bucket for r in ids.select(bucket_of(key, now).alias("bucket")).distinct().collect()]  # at most ``now``
    if not touched:
        return
    if held:
        rows = rows.unionByName(join_on(_stored(spark, path, fmt, read, touched), ids, [key], "left_anti"))
    _overwrite(materialize(rows, "replace"), path, list(order) or [key], fmt, write, touched)
    grow(spark, path, bucket_bytes, order, key, fmt, read, write, buckets)
