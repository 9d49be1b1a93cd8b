"""Operator 5: token ids in flat binary files, with 64-bit document offsets, read back by memory mapping.

Format, for each part: ``ids`` holds the documents' ids one after another as
little-endian unsigned integers, of 16 bits if the vocabulary and the end id
fit, else of 32 (the manifest names the width); ``docs`` holds, for each document, its
doc_id and its global start (64-bit integers), then one closing start.  Parts
follow one another in ascending doc_id order; a part's base, the ids of all
parts before it, is a prefix sum over the manifest.

Nulls: a null text is encoded as an empty one (the end id alone).  A null
doc_id sorts first and is stored as the smallest 64-bit integer, which reads
back as null.  Rows of the same doc_id are ordered by text hash.  An empty
table gives no parts.  Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sessionlog.llm.shared import NULL_ID, map_file, new_folder, pick, write_file


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _plain_pieces(library) -> re.Pattern | None:
    """The tokenizer's own split rule for lower-cased words of printable ASCII, if it is of the form that allows this.

    Such a word is its own normal form but for the case, and its bytes stand for
    themselves, so its ids are those that the library's model gives for its pieces.
    """
    rules = json.loads(library.to_str())
    normal, split = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    if rules["post_processor"] or rules["model"].get("dropout"):
        return None
    if normal.get("normalizers") != [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]:
        return None
    first, *rest = split.get("pretokenizers", [{}])
    if (first.get("type"), first.get("behavior"), first.get("invert"), "Regex" in first.get("pattern", ())) != ("Split", "Removed", True, True):
        return None
    if [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in rest] != [("ByteLevel", False, False)]:
        return None
    rule = first["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
    return None if r"\p" in rule else re.compile(rule)


_PLAIN = re.compile(r"[!-~]*")


class _Encoder:
    """Ids of whole texts; words between plain spaces are encoded once and kept.

    The tokenizer drops white space and none of its rules reaches over a space,
    so the ids of a text are those of its words, one after another.  New words
    of printable ASCII are cut by the tokenizer's split rule and go to its model
    piece by piece.  Others are encoded many at a time, joined by spaces, and
    told apart by the positions that the library gives.
    """

    def __init__(self, path: str, width: str, most: int = 800_000):
        self.library, self.width, self.most = _library(path), width, most
        self.rule = _plain_pieces(self.library)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if self.rule and _PLAIN.fullmatch(w) and not any(x in w for x in self.special)]
        found = self._learn_plain(plain)
        words = [w for w in words if w not in found]
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            encoding = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(encoding.ids, self.width)
            first = np.cumsum([0] + [len(w) + 1 for w in part])
            cut = np.searchsorted(np.array([a for a, _ in encoding.offsets], np.int64), first)
            found.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        return found

    def _learn_plain(self, words: list[str]) -> dict[str, bytes]:
        ids, cut = [], [0]
        tokenize = self.library.model.tokenize
        for w in words:
            for piece in self.rule.findall(w.lower()):
                ids.extend([t.id for t in tokenize(piece)])
            cut.append(len(ids))
        size, flat = np.dtype(self.width).itemsize, np.array(ids, self.width).tobytes()
        return {w: flat[a * size : b * size] for w, a, b in zip(words, cut[:-1], cut[1:], strict=True)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        # Under the rule a line break counts as a space.
        split = [(t.replace("\n", " ") if self.rule else t).split(" ") for t in texts]
        new, old = self.new, self.old
        missing = set().union(*split).difference(new)
        own = {w: old[w] for w in missing if w in old}
        own |= self._learn([w for w in missing if w not in own])
        if len(new) + len(own) > self.most:
            own |= {w: new[w] for words in split for w in words if w in new}
            self.old, self.new = new, {}
            new = self.new
        new.update(own)
        out = [b"".join(map(new.__getitem__, words)) for words in split]
        for w in [w for w in own if len(w) > 64]:  # long words hardly repeat
            del new[w]
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, width: str) -> _Encoder:
    """One for all tasks of a Python worker, which then know the words of those before them."""
    return _Encoder(path, width)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, part_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Write the files to a new shared folder; the folder and its manifest (part, base, n_docs, n_ids, width, ids, docs)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast(LongType()).alias("doc_id"), "text")
    n = rows.count()
    width = "<u2" if max(_library(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = _encoder(tokenizer_path, width), np.array([end_id], width).tobytes()
        keys, sizes = [], []

        def body():
            for batch in batches:
                for at in range(0, len(batch), 64):
                    part = batch.slice(at, 64)
                    keys.extend(NULL_ID if k is None else k for k in part["doc_id"].to_pylist())
                    for ids in encode([x or "" for x in part["text"].to_pylist()]):
                        ids += end
                        sizes.append(len(ids) // len(end))
                        yield ids

        part = TaskContext.get().partitionId()
        name = write_file(folder, f"ids-{part:06d}", body())
        if keys:
            local = write_file(folder, f"sizes-{part:06d}", [np.array(keys, "<i8").tobytes(), np.array(sizes, "<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(keys)], "n_ids": [sum(sizes)], "ids": [name], "sizes": [local]}, _PARTS)

    # The manifest is written by Spark, which takes each part's row from one attempt only.
    ordered = rows.repartitionByRange(max(1, -(-n // part_rows)), F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ordered.mapInArrow(write, "part long, n_docs long, n_ids long, ids string, sizes string").write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    bases = parts.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per part

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                both = map_file(folder, r["sizes"]).view("<i8")
                starts = r["base"] + np.concatenate([[0], np.cumsum(both[r["n_docs"] :])])
                r["docs"] = write_file(folder, f"docs-{r['part']:06d}", [both[: r["n_docs"]].tobytes(), starts.astype("<i8").tobytes()])
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("part", "base", "n_docs", "n_ids", "ids", "docs")} | {"width": width}])

    bases.repartition(max(1, -(-n // part_rows)), "part").mapInArrow(offsets, "part long, base long, n_docs long, n_ids long, ids string, docs string, width string").write.parquet(f"{folder}/manifest")
    return folder, spark.read.parquet(f"{folder}/manifest")


_PARTS = pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.string()), ("sizes", pa.string())])


def read_token_files(folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the mapped files.

    The checksum is that of the ids as unsigned 32-bit integers, which ``ids`` holds if asked for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                docs, ids = map_file(folder, r["docs"]).view("<i8"), map_file(folder, r["ids"]).view(r["width"])
                keys, starts = docs[: r["n_docs"]], docs[r["n_docs"] :]
                for at in range(0, r["n_docs"], 256):
                    own = range(at, min(at + 256, r["n_docs"]))
                    bodies = [ids[starts[i] - r["base"] : starts[i + 1] - r["base"]].astype("<u4").tobytes() for i in own]
                    key = pa.array([None if keys[i] == NULL_ID else int(keys[i]) for i in own], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [key, pa.array(starts[own.start : own.stop]), pa.array([len(b) // 4 for b in bodies], pa.int64()), pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array(bodies if with_ids else [None] * len(bodies), pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    found = manifest.repartition(max(1, manifest.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found if with_ids else found.drop("ids")


