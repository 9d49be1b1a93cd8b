"""Operator 1: exact token counts of every prefix of a text, by dynamic programming over prefixes.

The count of a prefix is one more than the count of the prefix without its
last token (``piece_bpe``).  The table of all counts then answers how many
tokens a cut text has and how much of a text fits a budget, without encoding
anything again.

Nulls: a null text counts as empty.  An empty text has no tokens and the table
``[0]``.  Every row is answered on its own, so repeated rows give repeated
answers, and other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.llm.piece_bpe import model, runs
from sessionlog.llm.shared import Recent, by_bytes, pick


def prefix_counts(text: str, run_counts: Recent) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... len(text) characters."""
    parts = runs(text)
    if not parts:
        return np.zeros(1, np.int64)
    table = np.frombuffer(b"".join(run_counts(parts)), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    last = table[np.cumsum(sizes) - 1]
    table += np.repeat(np.cumsum(last) - last, sizes)
    table[0] = 0  # the leading space mark belongs to no empty text
    return table


def largest_prefix(table: np.ndarray, budget: int) -> int:
    """The longest prefix, in characters, such that it has at most ``budget`` tokens."""
    # Counts may fall when a character completes a longer token: look at all, not at the first excess.
    return int(np.flatnonzero(table <= budget)[-1])


def token_counts(
    docs: DataFrame, model_path: str, budgets: tuple[int, ...] = (), prefixes: tuple[int, ...] = (), tables: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and what was asked from its table.

    * ``budgets``: ``fits`` maps each budget to the longest prefix (characters) within it;
    * ``prefixes``: ``at`` maps each length (characters, cut at the text's) to its token count;
    * ``tables``: ``counts``, the whole table as little-endian unsigned 32-bit integers.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_counts = Recent(model(model_path).run_counts)
        for batch in by_bytes(batches, "text"):
            out = {"n_bytes": [], "n_tokens": [], "fits": [], "at": [], "counts": []}
            for x in batch["text"]:
                x = x.as_py() or ""
                table = prefix_counts(x, run_counts)
                out["n_bytes"].append(len(x.encode()))
                out["n_tokens"].append(int(table[-1]))
                out["fits"].append([(b, largest_prefix(table, b)) for b in budgets])
                out["at"].append([(p, int(table[min(p, len(table) - 1)])) for p in prefixes])
                out["counts"].append(table.astype("<u4").tobytes() if tables else None)
            pairs = pa.map_(pa.int64(), pa.int64())
            kinds = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "fits": pairs, "at": pairs, "counts": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(v, kinds[k]) for k, v in out.items())], ["doc_id", *out])

    schema = f"doc_id {kind}, n_bytes long, n_tokens long, fits map<long,long>, at map<long,long>, counts binary"
    found = pick(docs, doc_id=doc_id, text=text).mapInArrow(count, schema)
    return found.drop(*(c for c, used in (("fits", budgets), ("at", prefixes), ("counts", tables)) if not used))


def stored_answers(tables: DataFrame, budget: int) -> DataFrame:
    """From stored tables alone: doc_id, cut (characters within the budget) and its n_tokens."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), "<u4") for x in batch["counts"]]
            cut = [largest_prefix(t, budget) for t in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(cut, pa.int64()), pa.array([int(t[c]) for t, c in zip(found, cut, strict=True)], pa.int64())], ["doc_id", "cut", "n_tokens"])

    kind = tables.schema["doc_id"].dataType.simpleString()
    return tables.select("doc_id", "counts").mapInArrow(answer, f"doc_id {kind}, cut long, n_tokens long")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
