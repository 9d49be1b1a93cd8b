"""Operator 9: encoding to and decoding from the ids of a sentencepiece BPE model.

Encoding stores, for each prefix, the unique last token of its encoding (found
by automaton matches and tests of neighbouring tokens, ``piece_bpe``) and
recovers the ids backwards.  Decoding is the library's.

Nulls: a null text is encoded as an empty one, which has only the begin and end
ids; null ids decode to null.  Rows are handled one by one, so repeated rows
repeat, and other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionlog.llm.piece_bpe import model, runs
from sessionlog.llm.shared import CACHE_BYTES, Recent, by_bytes, pick


@lru_cache(maxsize=4)
def _library(path: str):
    """The bare library, without the tables that encoding takes."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _encoder(model_path: str, begin: bool, end: bool, cache_bytes: int = CACHE_BYTES) -> Callable[[pa.Array], list[bytes]]:
    """Ids of whole texts; what it keeps of words (at most ``cache_bytes``) goes with it, when its task ends."""
    bpe = model(model_path)
    run_ids = Recent(bpe.run_ids, cache_bytes)
    first = np.array([bpe.library.bos_id()] * begin, "<u4").tobytes()
    last = np.array([bpe.library.eos_id()] * end, "<u4").tobytes()
    return lambda texts: [first + b"".join(run_ids(runs(x.as_py() or ""))) + last for x in texts]


def _decoded(library, ids: list[bytes | None]) -> pa.Array:
    return pa.array([None if x is None else library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())


def _ids(ids: list[bytes]) -> list[pa.Array]:
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]


def encode(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(model_path, begin, end)
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *_ids(ids_of(batch["text"]))], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(_library(model_path), batch["ids"].to_pylist())], [*batch.schema.names, "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True, doc_id: str = "doc_id", text: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """``decode(encode(docs))`` in one pass: a task needs one worker for both.

    A worker never gives back all of the memory that its words took, so where other
    work comes after on the same workers, fewer ``cache_bytes`` leave it more room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, library = _encoder(model_path, begin, end, cache_bytes), model(model_path).library
        for batch in by_bytes(batches, "text"):
            ids = ids_of(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *_ids(ids), _decoded(library, ids)], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
