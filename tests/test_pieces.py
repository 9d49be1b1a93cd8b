"""Documents read in pieces against Python's json, whatever the chunks and input splits."""

import json
import random

import pytest

from sessionlog.sources.documents import read_sessions
from sessionlog.sources.pieces import all_session_stats, read_pieces, read_sessions_in_pieces, write_documents

ODD = ['plain', 'a "quoted" } word', '{"events":[{', '\\', 'back\\\\"', ']},{[', 'é€😀 }', '\n\t}', '', '"events": [']


def _document(rng, sid, n):
    events = [{"type": rng.choice(["annotation", "file_edit"]), "timestamp": "2024-01-01T00:00:%02d.000001Z" % (i % 60),
               "data": {"note": rng.choice(ODD), "line": i + 1, "more": {"x": [1, {"y": rng.choice(ODD)}]}}} for i in range(n)]
    return {"id": sid, "project_path": rng.choice(ODD), "other": [1, [2], {"a": ","}], "start_time": "2024-01-01T00:00:00Z",
            "deep": {"events": [{"z": 1}]}, "events": events, "active": rng.random() < 0.5, "tail": {"q": [3, 4]}}


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(5)
    docs = {f"s{i}": _document(rng, f"s{i}", n) for i, n in enumerate([0, 1, 2, 40, 300])}
    for i, (sid, doc) in enumerate(docs.items()):
        text = json.dumps(doc, indent=(None, 2)[i % 2], ensure_ascii=bool(i % 3))
        (tmp_path / f"{sid}_raw.json").write_text(text + ("", "\n", "}\n"[1:])[i % 3], encoding="utf-8")
    return tmp_path, docs


@pytest.mark.parametrize("piece_bytes,split", [(1, 9000), (50, 5000), (1 << 20, 3000), (1 << 20, 1 << 27)])
def test_every_event_keeps_its_place(spark, folder, piece_bytes, split):
    path, docs = folder
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(name, split)
    try:
        heads, elements = read_pieces(spark, str(path), piece_bytes)
        got = {(r.id, r.pos): json.loads(r.text) for r in elements.collect()}
        meta = {r.id: (r.project_path, r.active) for r in heads.collect()}
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
    assert got == {(sid, i): e for sid, d in docs.items() for i, e in enumerate(d["events"])}
    assert meta == {sid: (d["project_path"], d["active"]) for sid, d in docs.items()}


def test_same_tables_as_whole_documents(spark, folder):
    path, _ = folder
    for a, b in zip(read_sessions(spark, str(path)), read_sessions_in_pieces(spark, str(path), 100)):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_unreadable_documents_are_left_out(spark, tmp_path):
    good = {"id": "ok", "events": [{"type": "annotation", "data": {"note": "n"}}, None, {"type": "file_edit"}], "active": True}
    text = json.dumps(good)
    files = {
        "ok_raw.json": text, "ok.json": text.replace("ok", "old"), "ok_export.json": text.replace("ok", "out"), "notes.txt": text,
        "cut_raw.json": text[:-1], "half_raw.json": text[:40], "string_raw.json": text[:35], "word_raw.json": text.replace("null", "nil"),
        "mixed_raw.json": text.replace('"n"}}', '"n"}]'), "noid_raw.json": json.dumps({"events": []}), "empty_raw.json": "",
        "twice_raw.json": text[:-1] + ',"events":[]}', "none_raw.json": json.dumps({"id": "none", "active": False}),
        "void_raw.json": json.dumps({"id": "void", "events": None}),
    }
    for name, t in files.items():
        (tmp_path / name).write_text(t)
    heads, elements = read_pieces(spark, str(tmp_path), 16)
    assert sorted(r.id for r in heads.collect()) == ["none", "ok", "void"]
    assert sorted((r.id, r.pos, json.loads(r.text)) for r in elements.select("id", "pos", "text").collect()) == [
        ("ok", i, e) for i, e in enumerate(good["events"])]
    stats = {r.session_id: (r.total_events, r.annotations, r.status) for r in all_session_stats(spark, str(tmp_path)).collect()}
    assert stats == {"ok": (3, 1, "Active"), "none": (0, 0, "Completed"), "void": (0, 0, "Completed")}


def test_written_documents_come_back(spark, folder, tmp_path_factory):
    path, docs = folder
    sessions, events = read_sessions_in_pieces(spark, str(path))
    out = str(tmp_path_factory.mktemp("documents"))
    write_documents(sessions, events, out)
    again_s, again_e = read_sessions_in_pieces(spark, out, 500)
    key = ["session_id", "seq", "type", "ts_us", "line"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(again_e) == rows(events)
    cols = ["session_id", "start_us", "end_us", "active"]
    assert sorted(map(tuple, again_s.select(*cols).collect())) == sorted(map(tuple, sessions.select(*cols).collect()))


def test_short_documents_are_files_and_long_ones_folders(spark, tmp_path):
    """Writing costs a folder for each task, not for each document; ids that file names can't hold come back."""
    from pyspark.sql import functions as F

    from sessionlog.schema import EVENT_SCHEMA

    odd = ["_a", ".b", "c/d", "e=f", "g%h", "i j", "é:", "k'l", ""]
    ids = [f"s{i:03d}" for i in range(100)] + odd
    short = spark.createDataFrame([(s, i) for s in ids for i in range(2)], "session_id string, seq long")
    long = spark.range(4000).select(F.lit("long").alias("session_id"), F.col("id").alias("seq"))
    rows = short.unionByName(long).withColumns({"type": F.lit("annotation"), "ts_us": F.col("seq") + 1_700_000_000_000_000, "note": F.repeat(F.lit("x}"), 20)})
    have = set(rows.columns)
    events = rows.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])
    sessions = rows.select("session_id").distinct().select(
        "session_id", F.lit("/p").alias("project_path"), F.lit("/s").alias("save_path"), F.lit("json").alias("output_format"),
        F.lit(1_700_000_000_000_000).alias("start_us"), F.lit(None).cast("bigint").alias("end_us"), F.lit(True).alias("active"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_documents(sessions, events, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    folders = [p for p in (tmp_path / "out").iterdir()]
    assert len(folders) < 20 and (tmp_path / "out" / "document=long_raw.json").is_dir()
    assert len(list((tmp_path / "out" / "document=long_raw.json").iterdir())) > 1
    found, back = read_sessions_in_pieces(spark, str(tmp_path / "out"))
    assert {r.session_id for r in found.collect()} == {*ids, "long"}
    got = sorted((r.session_id, r.seq) for r in back.collect())
    assert got == sorted((r.session_id, r.seq) for r in rows.collect())
