"""Session documents of any size, read and written in bounded pieces.

``read_documents`` gives each document to one JSON parser call, and so one row
holds a session's whole event array.  Here a document is read as text that is
split at ``}``, in any number of input splits, and gathered into chunks of
about ``piece_bytes``.  A chunk tells how it changes the reader's state
(inside a string or not, depth of nesting) for both states in which it can
begin.  Running sums over these summaries, one row a chunk, give every chunk
its true state; each is then cut into array elements by itself.  Only elements
that lie across a chunk's edge are put together by a shuffle.

A document is a file ``X.json`` or ``document=X.json``, or a folder ``document=X.json``
of part files which, in name order, make up the text (:func:`write_documents`).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlog.functions.scalar import us_to_ts
from sessionlog.operators.sequence import join_on
from sessionlog.operators.stats import session_stats
from sessionlog.schema import SESSION_DOC_SCHEMA
from sessionlog.sinks.writers import event_json_lines
from sessionlog.sources.documents import RAW_SUFFIX, _name_table, event_columns, pick_generation, sessions_table
from sessionlog.spark import materialize

PIECE_BYTES = 1 << 20
#: What opening a file counts for when files are dealt to tasks; most documents are short.
OPEN_BYTES = 1 << 16

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_EVENTS_KEY = re.compile(rb'"events"\s*:\s*$')
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_PLACE = ["path", "block", "no"]

_CHUNK = "path string, file_size long, block long, no long, text binary, n_bytes long, quotes long, d0 long, d1 long"
_PART = "doc string, path string, block long, no long, kind string, own boolean, nth long, text binary, left boolean, right boolean, opened long"

_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_CHUNK_SCHEMA, _PART_SCHEMA = (pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in names.split(", ")]) for names in (_CHUNK, _PART))


def _nesting(text: bytes) -> int:
    return text.count(b"{") + text.count(b"[") - text.count(b"}") - text.count(b"]")


def _summary(text: bytes) -> tuple[int, int, int]:
    """Quotes in the text, and the change of depth if it begins outside or inside a string."""
    between = _ESCAPE.sub(b"", text).split(b'"')
    return len(between) - 1, _nesting(b" ".join(between[0::2])), _nesting(b" ".join(between[1::2]))


def _several(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 4 MB of text (column ``text``) or 2,000 rows: a batch for each costs more than short rows do."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[text])
        if size >= 1 << 22 or len(kept) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)


def _gather(piece_bytes: int):
    """Rows of each input split, in order, as numbered chunks of ``piece_bytes`` or one piece more."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        split, buf, size, no = None, [], 0, 0

        def chunk() -> tuple:
            text = b"".join(buf)
            return *split, no, text, len(text), *_summary(text)

        for batch in batches:
            path, file_size, block, value = batch.columns
            n = len(batch)
            new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else [0]
            for a, z in zip(cuts, cuts[1:]):  # rows of one split
                where = (path[a].as_py(), file_size[a].as_py(), block[a].as_py())
                values = value[a:z].to_pylist()
                if buf and where != split:
                    yield chunk()
                    buf, size, no = [], 0, 0
                split = where
                for v in values:
                    if size >= piece_bytes:
                        yield chunk()
                        buf, size, no = [], 0, no + 1
                    buf += (v, b"}")
                    size += len(v) + 1
        if buf:
            yield chunk()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _several(chunks(batches), _CHUNK_SCHEMA, 4)

    return run


def _cut(text: bytes, in_string: int, depth: int) -> tuple[bytes, list[tuple], bool | None, int, int]:
    """A chunk's share of the document outside nested values, and of the elements of ``events``.

    Elements are ``(own, nth, text, left, right)``: ``own`` is None in an array that was
    open already, ``nth`` counts commas before it in this chunk's part of the array, ``left`` and
    ``right`` tell that it goes on beyond the chunk.  Then what is open at the end (None: as at the
    beginning), the commas counted in it and the number of ``events`` arrays begun here.
    """
    a = np.frombuffer(_ESCAPE.sub(b"__", text), np.uint8)
    outside = ((np.cumsum(a == ord('"')) + in_string) & 1) == 0
    step = np.where(outside, _STEP[a], 0)
    after = depth + np.cumsum(step, dtype=np.int64)
    head = np.frombuffer(text, np.uint8)[(after <= 1) | (after - step <= 1)].tobytes()
    marks = np.flatnonzero(outside & (((a == ord(",")) & (after == 2)) | ((step > 0) & (after == 2)) | ((step < 0) & (after == 1))))
    found, begin, left, nth, opened = [], 0, True, 0, 0
    own: bool | None = None if depth >= 2 else False
    for m in marks.tolist():
        if step[m] > 0:
            own = text[m:m + 1] == b"[" and _EVENTS_KEY.search(text[max(0, m - 4096):m]) is not None
            nth, opened = 0, opened + own
        elif own is not False:
            found.append((own, nth, text[begin:m], left, False))
            if step[m] < 0:
                own = False
            else:
                nth += 1
        begin, left = m + 1, False
    if own is not False:
        found.append((own, nth, text[begin:], left, True))
    return head, found, own, nth if own is not False else 0, opened


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for r in range(batch.num_rows):  # one row a chunk
            doc, path, block, no, text, in_string, depth, extra = (c[r].as_py() for c in batch.columns)
            head, found, own, nth, opened = _cut(text[:-1] if extra else text, in_string, depth)
            at = (doc, path, block, no)
            yield *at, "head", own, nth, head, None, None, opened
            for o, n, t, le, ri in found:
                yield *at, "element", o, n, t, le, ri, None


def _cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _several(_cut_rows(batches), _PART_SCHEMA, 7)


def _in_order():
    """The texts of a group in document order, as one string."""
    rows = F.array_sort(F.collect_list(F.struct(F.length("path").alias("a"), "path", "block", "no", F.col("text").cast("string").alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "")


@contextmanager
def _many_files(spark: SparkSession):
    """Spark puts about 30 files at most into a task by default; here about 2,000, of at most as many bytes as ever."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_pieces(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(heads, elements)``: each document without its events, and the text of each event with its position.

    Of a session's files the ``_raw`` one is taken, exports are never.  Documents that are cut off, not
    JSON, without an id, or have more than one ``events`` array are left out whole.
    """
    m = F.col("_metadata.file_path")
    lines = (spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
             .filter(m.contains(".json"))
             .select(m.alias("path"), F.col("_metadata.file_size").alias("file_size"),
                     F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")))
    chunks = lines.mapInArrow(_gather(piece_bytes), _CHUNK)
    steps = F.split("path", "/")
    own_file = F.element_at(steps, -1).endswith(".json")
    with _many_files(spark):
        chunks = materialize(chunks.select(
            "*", F.when(own_file, F.col("path")).otherwise(F.regexp_replace("path", "/[^/]*$", "")).alias("doc")), "chunks")

    names = chunks.select("doc").distinct().select("doc", F.regexp_replace(F.element_at(F.split("doc", "/"), -1), "^document=", "").alias("file_name"))
    chosen = pick_generation(_name_table(names)).select("doc")
    marks = chunks.drop("text").join(chosen, "doc", "left_semi")
    # The reader can't tell whether a file ends with its separator: one byte too many, and the last one is not the file's.
    files = marks.groupBy("path").agg(F.max(F.struct("block", "no")).alias("last"), (F.sum("n_bytes") > F.max("file_size")).alias("over"))
    odd = F.col("quotes") % 2
    extra = F.col("over") & (F.struct("block", "no") == F.col("last"))
    marks = marks.join(files, "path").select(
        "doc", *_PLACE, "quotes", extra.alias("extra"),
        (F.col("d0") + F.when(extra & (odd == 0), 1).otherwise(0)).alias("d0"), (F.col("d1") + F.when(extra & (odd == 1), 1).otherwise(0)).alias("d1"))
    order = Window.partitionBy("doc").orderBy(F.length("path"), *_PLACE)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    marks = marks.withColumn("delta", F.when(F.col("in_string") == 1, F.col("d1")).otherwise(F.col("d0")))
    marks = marks.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    marks = materialize(marks, "chunk-states")
    whole = marks.groupBy("doc").agg(F.sum("delta").alias("end"), (F.sum("quotes") % 2).alias("open")).filter("end = 0 and open = 0").select("doc")

    state = marks.join(whole, "doc", "left_semi").select(*_PLACE, "in_string", "depth", "extra")
    parts = materialize(chunks.join(state, _PLACE).select("doc", *_PLACE, "text", "in_string", "depth", "extra")
                        .mapInArrow(_cut_chunks, _PART), "document-parts")

    ends = parts.filter("kind = 'head'").select("doc", *_PLACE, "own", "nth", "opened")
    ends = ends.withColumn("carried", F.coalesce(F.last("own", ignorenulls=True).over(before), F.lit(False)))
    ends = ends.withColumn("base", F.coalesce(F.sum(F.when(F.coalesce("own", "carried"), F.col("nth"))).over(before), F.lit(0)))
    element = parts.filter("kind = 'element'").join(ends.select(*_PLACE, "carried", "base"), _PLACE)
    element = element.filter(F.coalesce("own", "carried")).withColumn("pos", F.when(F.col("own").isNull(), F.col("base")).otherwise(F.lit(0)) + F.col("nth"))
    inner = element.filter(~F.col("left") & ~F.col("right")).select("doc", "pos", F.col("text").cast("string").alias("text"))
    across = element.filter(F.col("left") | F.col("right")).groupBy("doc", "pos").agg(_in_order().alias("text"))
    elements = inner.unionByName(across).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    elements = materialize(elements.withColumn("good", F.expr("try_parse_json(text) is not null")), "elements")

    heads = parts.filter("kind = 'head'").groupBy("doc").agg(_in_order().alias("text"), F.sum("opened").alias("arrays"))
    heads = heads.filter("arrays <= 1").select("doc", F.from_json("text", SESSION_DOC_SCHEMA).alias("d"), F.expr("try_parse_json(text) is not null").alias("good"))
    heads = heads.filter(F.col("good") & F.col("d.id").isNotNull()).select("doc", "d.*").drop("events")
    heads = heads.join(elements.filter(~F.col("good")).select("doc").distinct(), "doc", "left_anti")
    heads = materialize(heads, "heads")
    return heads, elements.select("doc", "pos", "text").join(heads.select("doc", "id"), "doc")


def read_sessions_in_pieces(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(sessions, events)`` like ``read_sessions``, for documents of any size; ``seq`` is the place in the array."""
    heads, elements = read_pieces(spark, path, piece_bytes)
    e = elements.select(F.col("id").alias("session_id"), F.col("pos").alias("seq"),
                        F.from_json("text", SESSION_DOC_SCHEMA["events"].dataType.elementType).alias("e"))
    return sessions_table(heads), event_columns(e)


def all_session_stats(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Statistics of every session with a readable document in the folder."""
    sessions, events = read_sessions_in_pieces(spark, path, piece_bytes)
    return session_stats(events, sessions)


#: Characters of an id that a file name can't hold as they are.
_UNSAFE = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{}\[\]^]""")


def _folder(path: str):
    """The file system that holds the path, and its name there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _write_parts(path: str):
    """Write a task's rows ``(document, sec, value)``, in order: a document that begins and ends here as a file, else as a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = f"{TaskContext.get().partitionId():06d}"
        system, folder = _folder(path)
        system.create_dir(f"{folder}/tasks-{part}", recursive=True)
        name, out, draft, ends, n = None, None, None, [], 0

        def put() -> None:  # a file gets its name when it is whole; a repeated attempt puts the same in its place
            out.close()
            own = f"document={_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', name)}"
            if ends == [0, 2]:
                system.move(draft, f"{folder}/tasks-{part}/{own}")
            else:
                system.create_dir(f"{folder}/{own}", recursive=True)
                system.move(draft, f"{folder}/{own}/part-{part}")

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for document, own in groupby(rows, key=lambda r: r[0]):
                if document != name:
                    if out is not None:
                        put()
                    name, ends, n, draft = document, [], n + 1, f"{folder}/tasks-{part}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft)
                own = list(own)
                ends += [sec for _, sec, _ in own if sec != 1]
                out.write(b"".join([line for _, _, value in own for line in (value, b"\n")]))
        if out is not None:
            put()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return run


def write_documents(sessions: DataFrame, events: DataFrame, path: str) -> None:
    """Write each session's document, ``document=<id>_raw.json``, in pieces.

    Rows are dealt by range of (document, position), so a long session is written by
    many tasks: as a folder whose part files in name order make up the document.  One that
    lies in a task's range whole is one file, in that task's folder, so that a folder of many short
    documents costs neither a folder nor a commit for each.  Tasks write the files themselves: the
    path must be one that Arrow can open, such as a mounted folder.  Sessions without an id
    have no file name and are left out.
    """
    ts = lambda c: F.date_format(us_to_ts(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    s = sessions.filter(F.col("session_id").isNotNull())
    meta = F.to_json(F.struct(F.col("session_id").alias("id"), "project_path", "save_path", "output_format",
                              ts("start_us").alias("start_time"), F.coalesce(ts("end_us"), F.lit("0001-01-01T00:00:00Z")).alias("end_time"), "active"))
    head = s.select("session_id", meta.alias("meta")).select(
        "session_id", F.lit(0).alias("sec"), F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.expr("left(meta, length(meta) - 1)"), F.lit(',"events":[')).alias("value"))
    tail = s.select("session_id", F.lit(2).alias("sec"), F.lit(0).cast("bigint").alias("seq"), F.lit("]}").alias("value"))
    first = events.groupBy("session_id").agg(F.min("seq").alias("first"))
    rows = join_on(event_json_lines(events), first, ["session_id"])
    rows = join_on(rows, s.select("session_id"), ["session_id"], "left_semi").select(
        "session_id", F.lit(1).alias("sec"), "seq",
        F.concat(F.when(F.col("seq") > F.col("first"), F.lit(",")).otherwise(F.lit("")), "value").alias("value"))
    lines = head.unionByName(rows).unionByName(tail).withColumn("document", F.concat("session_id", F.lit(RAW_SUFFIX)))
    keys = ["document", "sec", "seq"]
    spark = events.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    rows = lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("document", "sec", F.col("value").cast("binary").alias("value"))
    rows.mapInArrow(_write_parts(path), "n long").agg(F.sum("n")).collect()
