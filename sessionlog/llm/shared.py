"""Files and columns that the operators share: shared-folder binary files, document columns, bounded caches."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.spark import ensure_checkpoint_dir

#: Stands for a null doc_id where an integer is needed: nulls sort first, as in Spark.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; other columns, clashing names included, stay behind."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared checkpoint folder that no other run uses."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver's collectors run: Spark then deletes the shuffle files of tables that nobody holds any more.

    Without it they lie on the executors' disks until the driver happens to run short of memory.
    """
    import gc

    gc.collect()
    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)  # none with Spark Connect
    if jvm is not None:
        jvm.System.gc()


def _resolve(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, buffers) -> str:
    """Write the buffers to a new file of the shared folder and return its name.

    The name is unique to this attempt.  Only names that a task returns are
    ever read, so a lost or repeated attempt leaves a file that nobody uses.
    """
    name = f"{stem}-{uuid.uuid4().hex}.bin"
    system, path = _resolve(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        for part in buffers:
            out.write(part)
    return name


def map_file(folder: str, name: str) -> np.ndarray:
    """The file's bytes: memory-mapped from a mounted folder, else read once."""
    from pyarrow import fs

    system, path = _resolve(folder)
    path = f"{path}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if system.get_file_info(path).size else np.empty(0, np.uint8)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def write_batches(folder: str, stem: str, batches) -> str | None:
    """Write Arrow batches, compressed, to a new file as ``write_file`` does; its name, or None if there are none."""
    import itertools

    import pyarrow as pa

    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return None
    name = f"{stem}-{uuid.uuid4().hex}.bin"
    system, path = _resolve(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_stream(out, first.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in itertools.chain([first], batches):
            writer.write_batch(batch)
    return name


def read_batches(folder: str, name: str):
    """The batches of a file one by one, without the others in memory."""
    import pyarrow as pa

    system, path = _resolve(folder)
    with system.open_input_stream(f"{path}/{name}") as f:
        yield from pa.ipc.open_stream(f)


#: What a task keeps of computed values, unless it is told otherwise.
CACHE_BYTES = 160 << 20


class Recent:
    """A map of computed values in at most ``most`` bytes; the half that was longer unused goes when it is full."""

    def __init__(self, compute, most: int = CACHE_BYTES):
        self.compute, self.most, self.size, self.new, self.old = compute, most // 2, 0, {}, {}

    def __call__(self, keys: list) -> list:
        get, miss = self.new.get, self._miss
        return [v if (v := get(k)) is not None else miss(k) for k in keys]

    def _miss(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:  # long keys hardly repeat
            size = 250 + 4 * len(key) + len(value)  # both objects and their place in the map
            if self.size + size > self.most:
                self.old, self.size = self.new.copy(), 0
                self.new.clear()
            self.new[key], self.size = value, self.size + size
        return value


def by_bytes(batches, column: str, most: int = 1 << 23):
    """The batches in pieces whose texts hold about ``most`` bytes; a longer text makes a piece of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, sums = 0, np.concatenate([[0], np.cumsum(sizes)])
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
