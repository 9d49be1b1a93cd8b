"""Operator 4: drop lines that an earlier document already has.

A line's key is the line without surrounding white space, A-Z in lower case.  A
key of at least ``min_chars`` code points that two or more documents hold keeps
its lines only in the document of the smallest doc_id.

Distinct line hashes (128 bits) are counted with map-side aggregation and dealt
to shards by hash.  Each shard's task builds a minimal perfect hash over its
hashes, which indexes arrays of fingerprints (32 bits), document counts and
first documents, in one file of the shared folder.  Documents then probe these
arrays, memory-mapped, and lines are never joined.  If all arrays together
exceed ``direct_bytes``, tasks don't read them all: the documents' line hashes
are dealt to the shards, each shard answers for its own, and only hashes to
drop go back to their documents.  Both ways give the same rows.

Nulls: a null or empty text is one empty line and comes back as an empty text.
A null doc_id counts as smaller than all others; rows of the same doc_id are
one document, none of which loses a line to another.  An empty table gives no
rows.  Other columns of the input come back unchanged from ``drop_repeated_lines``,
but for columns named as those that it adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.llm import perfect_hash
from sessionlog.llm.shared import NULL_ID, map_file, new_folder, write_file
from sessionlog.spark import materialize

_ARRAYS = (("bits", "<u8"), ("starts", "<i8"), ("before", "<u4"), ("prints", "<u4"), ("counts", "<u4"), ("owners", "<i8"))


def split_lines(text: str | None, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """The text's lines with their 128-bit key hashes (None: the key is too short to count)."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append((line, xxhash.xxh3_128_digest(key) if long else None))
    return out


def _shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key from both halves for the perfect hash of a shard (build fails on a clash)."""
    return low ^ perfect_hash.mixed(high, 7)


class LineIndex:
    """The shards' arrays: ``probe`` tells which hashes a document must drop."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.maps = folder, names, lru_cache(maxsize=256)(self._open)

    def _open(self, shard: int) -> dict[str, np.ndarray]:
        raw = map_file(self.folder, self.names[shard])
        sizes, at, out = raw[:48].view("<i8"), 48, {}
        for (name, kind), size in zip(_ARRAYS, sizes, strict=True):
            out[name] = raw[at : at + size].view(kind)  # padded to 8 bytes: the last entries may stand for nothing
            at += int(size)
        return out

    def probe(self, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each hash: do two or more documents hold it, and is ``doc`` not the first of them?"""
        drop, shard = np.zeros(len(low), bool), _shard_of(high, len(self.names))
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if not len(own):
                continue
            t = self.maps(int(shard[own[0]]))
            at = perfect_hash.index((t["bits"], t["starts"], t["before"]), _key(low[own], high[own]))
            known = at >= 0
            known[known] = t["prints"][at[known]] == (high[own][known] >> np.uint64(32)).astype("<u4")
            at = at[known]
            drop[own[known]] = (t["counts"][at] > 1) & (t["owners"][at] != doc[own[known]])
        return drop


def build_index(docs: DataFrame, min_chars: int, shard_keys: int = 1 << 20, least_shards: int = 64, doc_id: str = "doc_id", text: str = "text") -> tuple[str, DataFrame, int]:
    """Build the shards; their folder, manifest (shard, name, bytes) and number."""
    spark = docs.sparkSession

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for key, x in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
                own = {h for _, h in split_lines(x.as_py(), min_chars) if h}
                found.extend(own)
                owner.extend([key] * len(own))
            low, high = _halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(low.view("<i8")), pa.array(high.view("<i8")), pa.array(owner, pa.int64())], ["low", "high", "doc"])

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(f"`{text}`").alias("text"))
    lines = materialize(
        rows.mapInArrow(hashes, "low long, high long, doc long")
        .groupBy("low", "high")
        # Two different documents hold the line just when the smallest and the largest differ.
        .agg(F.min("doc").alias("owner"), F.when(F.min("doc") == F.max("doc"), F.lit(1)).otherwise(F.greatest(F.count("*"), F.lit(2))).alias("n")),
        "line-hashes",
    )
    shards = max(least_shards, -(-lines.count() // shard_keys))
    folder = new_folder(spark, "line-index")

    def build(table: pa.Table) -> pa.Table:
        low, high = (table[c].to_numpy().astype("<i8").view("<u8") for c in ("low", "high"))
        tables = perfect_hash.build(_key(low, high))
        at = perfect_hash.index(tables, _key(low, high))
        arrays = dict(zip(("bits", "starts", "before"), tables, strict=True)) | {"prints": np.empty(len(at), "<u4"), "counts": np.empty(len(at), "<u4"), "owners": np.empty(len(at), "<i8")}
        arrays["prints"][at] = (high >> np.uint64(32)).astype("<u4")
        arrays["counts"][at] = np.minimum(table["n"].to_numpy(), 2**32 - 1)
        arrays["owners"][at] = table["owner"].to_numpy()
        parts = [np.ascontiguousarray(arrays[n], k).tobytes() for n, k in _ARRAYS]
        parts = [p + b"\0" * (-len(p) % 8) for p in parts]  # each array starts at a multiple of 8 bytes
        shard = int(_shard_of(high[:1], shards)[0])
        name = write_file(folder, f"shard-{shard:08d}", [np.array([len(p) for p in parts], "<i8").tobytes(), *parts])
        return pa.table({"shard": pa.array([shard], pa.int64()), "name": [name], "bytes": pa.array([sum(map(len, parts))], pa.int64())})

    dealt = lines.withColumn("shard", F.pmod(F.shiftrightunsigned("high", 16), F.lit(shards)))
    dealt.groupBy("shard").applyInArrow(build, "shard long, name string, bytes long").write.parquet(f"{folder}/manifest")
    return folder, spark.read.parquet(f"{folder}/manifest"), shards


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, direct_bytes: int = 1 << 30, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``text`` of the lines that stay, ``n_lines`` (before) and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped", "__doc", "__gone")
    folder, manifest, shards = build_index(docs, min_chars, doc_id=doc_id, text=text)
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    routed = total > direct_bytes
    source = docs.withColumns({"__doc": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID))})
    if not routed:
        names = [""] * shards  # of files of at least a few hundred KB each where there are more than the least number
        for r in manifest.select("shard", "name").toLocalIterator():
            names[r.shard] = r.name
    else:
        names = []
        source = source.join(_routed(docs, folder, manifest, shards, min_chars, doc_id, text), "__doc", "left")
    columns = docs.schema.names

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines_index = LineIndex(folder, names)
        for batch in batches:
            split = [split_lines(x.as_py(), min_chars) for x in batch[text]]
            if not routed:
                flat = [h for rows in split for _, h in rows if h]
                owner = np.repeat(np.asarray(batch["__doc"]), [sum(h is not None for _, h in rows) for rows in split])
                low, high = _halves(flat)
                drops = iter(lines_index.probe(low, high, owner).tolist())
                kept = [[x for x, h in rows if not (h and next(drops))] for rows in split]
            else:
                gone = [frozenset(g or ()) for g in batch["__gone"].to_pylist()]
                kept = [[x for x, h in rows if h not in g] for rows, g in zip(split, gone, strict=True)]
            texts = pa.array([b"\n".join(k).decode() for k in kept], pa.string())
            n = [len(rows) for rows in split]
            out = [texts if c == text else batch[c] for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], pa.int64())], [*columns, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return source.mapInArrow(clean, f"{schema}, n_lines long, n_dropped long")


def _routed(docs: DataFrame, folder: str, manifest: DataFrame, shards: int, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """(__doc, __gone): the hashes that a document must drop, answered shard by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for key, x in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
                own = {h for _, h in split_lines(x.as_py(), min_chars) if h}
                found.extend(own)
                owner.extend([key] * len(own))
            shard = _shard_of(_halves(found)[1], shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(owner, pa.int64()), pa.array(found, pa.binary())], ["shard", "doc", "hash"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["hash"].to_pylist()
            low, high = _halves(found)
            names = [""] * shards
            for shard, name in zip(batch["shard"].to_pylist(), batch["name"].to_pylist(), strict=True):
                names[shard] = name
            drop = LineIndex(folder, names).probe(low, high, np.asarray(batch["doc"]))
            yield pa.RecordBatch.from_arrays([batch["doc"].filter(pa.array(drop)), batch["hash"].filter(pa.array(drop))], ["doc", "hash"])

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(f"`{text}`").alias("text"))
    asked = rows.mapInArrow(ask, "shard long, doc long, hash binary").join(manifest.select("shard", "name"), "shard")
    # A line that very many documents hold is asked for in many tasks, each of which maps its shard.
    asked = asked.repartition("shard", F.pmod(F.xxhash64("doc"), F.lit(64))).sortWithinPartitions("shard")
    gone = asked.mapInArrow(answer, "doc long, hash binary")
    return gone.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("hash").alias("__gone"))
