"""Stream == batch: the keyed streaming processors against the batch operators."""

import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig, FilterConfig
from sessionlog.operators.blocks import activity_blocks
from sessionlog.operators.denoise import cursor_filter
from sessionlog.sources.command_log import read_command_log
from sessionlog.streaming.pipelines import command_stream
from sessionlog.streaming.processors import denoise_stream, latest_blocks, live_blocks


def _iso(us):
    import datetime as dt
    return (dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)).isoformat()


def write_command_log(folder, n_sessions=12, n_files=4, seed=5):
    rnd = random.Random(seed)
    files = [[] for _ in range(n_files)]
    cid = 0
    for s in range(n_sessions):
        sid, t = f"{1700000000 + s}_p", 0
        cmds = [("start", [sid, "/proj", "/save", "markdown"])]
        for _ in range(rnd.randint(5, 60)):
            typ = rnd.choice(["record-cursor"] * 5 + ["record-edit"] * 3 + ["record-terminal", "annotate",
                                                                           "record-file-open"])
            f = rnd.choice(["a.lua", "b.lua"])
            args = {"record-cursor": [sid, "/save", f, str(rnd.randint(1, 9)), "0"],
                    "record-edit": [sid, "/save", f, "3", "1", "10", str(rnd.randint(1, 99)), "x = 1"],
                    "record-terminal": [sid, "/save", "make"],
                    "annotate": [sid, "/save", "Fix bug"],
                    "record-file-open": [sid, "/save", f, "lua"]}[typ]
            cmds.append((typ, args))
        cmds.append(("end", [sid, "/save"]))
        part = 0
        for typ, args in cmds:
            t += rnd.choice([50_000, 150_000, 250_000, 400_000, 900_000, 3_000_000])
            cid += 1
            files[part].append(json.dumps({"id": cid, "command": typ, "args": args, "ts": _iso(t)}))
            if rnd.random() < 0.15 and part < n_files - 1:
                part += 1
    files[0] += ['{"id": 999001, "command": "nope", "args": []}',
                 '{"id": 999002, "command": "record-edit", "args": ["x", "y"]}', "{broken"]
    for i, lines in enumerate(files):
        p = os.path.join(folder, f"log-{i:03d}.jsonl")
        with open(p, "w") as fh:
            fh.write("\n".join(lines) + "\n")
        # the file source takes files in modification-time order: make it the write order
        os.utime(p, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))


def test_command_log_rejects(spark):
    d = tempfile.mkdtemp(prefix="cmdlog-")
    write_command_log(d)
    ev, meta, rej = read_command_log(spark.read.text(d))
    errs = sorted(r.error for r in rej.collect())
    assert errs == ["invalid json", "record-edit requires 8 args", "unknown command: nope"]
    assert meta.count() == 12
    assert ev.filter(F.col("type") == "session_start").count() == 12


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="cmdlog-")
    write_command_log(d)
    cfg = FilterConfig()
    ev, _, _ = read_command_log(spark.read.text(d))
    batch = cursor_filter(ev, cfg, ExecConfig(chunk_rows=8))
    raw, _ = command_stream(spark, d, max_files_per_trigger=1)
    q = (denoise_stream(raw, cfg).writeStream.format("memory").queryName("denoised_t")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("denoised_t")
    cols = ["session_id", "seq", "type", "ts_us", "filename", "line", "changed_tick", "note"]
    b, s = batch.select(*cols), got.select(*cols)
    assert b.count() == s.count()
    assert b.exceptAll(s).count() == 0 and s.exceptAll(b).count() == 0

    # live blocks over the raw log == batch blocks over the same log (it ends with session_end)
    agg = AggregationConfig()
    bb = activity_blocks(ev, agg, ExecConfig()).select("session_id", "block_no", "start_us", "event_count",
                                                       "delta_tick", "closed_by")
    q2 = (live_blocks(command_stream(spark, d, 1)[0], agg)
          .writeStream.format("memory").queryName("blocks_t").outputMode("append")
          .trigger(availableNow=True).start())
    q2.awaitTermination()
    sb = latest_blocks(spark.table("blocks_t")).select("session_id", "block_no", "start_us", "event_count", "delta_tick", "closed_by")
    assert bb.exceptAll(sb).count() == 0 and sb.exceptAll(bb).count() == 0


def test_stream_equals_batch_drop_mode(spark):
    d = tempfile.mkdtemp(prefix="cmdlog-")
    write_command_log(d, n_sessions=8, n_files=3, seed=17)
    cfg = FilterConfig(idle_commit="drop")
    ev, _, _ = read_command_log(spark.read.text(d))
    batch = cursor_filter(ev, cfg, ExecConfig(chunk_rows=6))
    raw, _ = command_stream(spark, d, max_files_per_trigger=1)
    q = (denoise_stream(raw, cfg).writeStream.format("memory").queryName("denoised_drop")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    cols = ["session_id", "seq", "type", "ts_us", "line"]
    b, s = batch.select(*cols), spark.table("denoised_drop").select(*cols)
    assert b.count() == s.count()
    assert b.exceptAll(s).count() == 0 and s.exceptAll(b).count() == 0


def _log(folder, name, at, rows):
    """One file of (command, args after the session, seconds) for session s, at place ``at`` of the write order."""
    p = os.path.join(folder, name)
    with open(p, "w") as fh:
        for n, (command, args, t) in enumerate(rows):
            fh.write(json.dumps({"id": 1000 * at + n, "command": command, "args": ["s", *args], "ts": _iso(int(t * 1e6))}) + "\n")
    os.utime(p, (1_700_000_000 + 10 * at, 1_700_000_000 + 10 * at))


def test_resumed_sessions(spark):
    """A session end closes no block, in the stream as in batch: an edit after a resume may go on with it."""
    d = tempfile.mkdtemp(prefix="cmdlog-")
    edit = lambda f, tick, t: ("record-edit", ["/save", f, "1", "1", "1", str(tick), "x"], t)
    end, resume = (lambda t: ("end", ["/save"], t)), (lambda t: ("resume", ["/save"], t))
    move = lambda t: ("record-cursor", ["/save", "a.lua", "1", "0"], t)
    _log(d, "0.jsonl", 0, [("start", ["/proj", "/save", "markdown"], 0), edit("a.lua", 1, 1), edit("a.lua", 2, 2), move(2.1), end(2.5)])
    _log(d, "1.jsonl", 1, [resume(3), edit("a.lua", 5, 4), edit("a.lua", 9, 5), end(6)])
    _log(d, "2.jsonl", 2, [resume(60), edit("a.lua", 10, 62.5), move(63), end(64), resume(65), edit("b.lua", 11, 65.5), end(66)])
    ev, _, _ = read_command_log(spark.read.text(d))
    cols = ["block_no", "filename", "start_us", "end_us", "event_count", "delta_tick", "velocity", "closed_by"]
    q = (live_blocks(command_stream(spark, d, 1)[0]).writeStream.format("memory").queryName("resumed_blocks")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    told = spark.table("resumed_blocks")
    got = sorted(map(tuple, latest_blocks(told).select(*cols).collect()))
    assert got == sorted(map(tuple, activity_blocks(ev).select(*cols).collect()))
    assert [(g[0], g[4], g[7]) for g in got] == [(1, 4, "timeout"), (2, 1, "context_switch"), (3, 1, "session_end")]
    assert told.filter("block_no = 1").count() == 3  # at both ends, and when the timeout closed it


def test_shipped_zip_holds_every_module(tmp_path):
    """Executors import the package from its zip, where a folder without ``__init__.py`` can't be imported."""
    import subprocess
    import sys
    from pathlib import Path

    import sessionlog
    from sessionlog.spark import package_zip

    home = Path(sessionlog.__file__).parent
    own = {".".join(p.relative_to(home.parent).with_suffix("").parts) for p in home.glob("streaming/*.py")}
    code = f"import sys; sys.path.insert(0, {package_zip()!r}); import importlib; [importlib.import_module(m) for m in {sorted(own)!r}]"
    code += "; import sessionlog; assert '.zip' in sessionlog.__file__"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert all((p.parent / "__init__.py").exists() for p in home.rglob("*.py"))
