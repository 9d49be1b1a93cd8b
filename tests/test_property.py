"""Random logs: Spark operators == plain loop model, for tiny and default chunk sizes."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlog.config import AggregationConfig, ExecConfig, FilterConfig
from sessionlog.operators.blocks import activity_blocks
from sessionlog.operators.corrections import error_corrections
from sessionlog.operators.denoise import cursor_decisions, cursor_filter
from sessionlog.operators.focus import file_focus
from sessionlog.operators.gaps import idle_gaps
from sessionlog.operators.timeline import timeline
from tests import model
from tests.helpers import rows_to_df

AGG = AggregationConfig(merge_window_us=2_000_000, idle_threshold_us=30_000_000, lookback_us=20_000_000)
TYPES = ["file_edit"] * 5 + ["cursor_move"] * 3 + ["terminal_command", "file_open", "annotation", "lsp_diagnostic",
                                                  "session_start", "session_end"]
FILES = ["a.lua", "b.lua", "NvimTree_1", None, ""]
NOTES = ["Fix bug", "note", "debug this", "prefix", None]


def random_logs(seed, n_sessions=40, max_len=60, back_in_time=True):
    rnd = random.Random(seed)
    out = {}
    for s in range(n_sessions):
        t = rnd.randint(0, 10**9)
        evs = []
        for _ in range(rnd.randint(0, max_len)):
            t += rnd.choice([0, 100_000, 500_000, 1_500_000, 2_000_000, 2_500_000, 40_000_000])
            if back_in_time and rnd.random() < 0.05:
                t -= rnd.randint(0, 3_000_000)
            typ = rnd.choice(TYPES)
            e = {"type": typ, "ts": t, "filename": rnd.choice(FILES),
                 "changed_tick": rnd.choice([0, rnd.randint(1, 50)]) if typ == "file_edit" else None,
                 "note": rnd.choice(NOTES) if typ == "annotation" else None}
            evs.append(e)
        out[f"s{s}"] = evs
    return out


@pytest.fixture(scope="module", params=[3, 1 << 20], ids=["chunk3", "chunkbig"])
def exe(request):
    return ExecConfig(chunk_rows=request.param)


@pytest.fixture(scope="module")
def logs():
    return random_logs(7)


def test_blocks_match_loop(spark, logs, exe):
    df = rows_to_df(spark, logs)
    got = {}
    for r in activity_blocks(df, AGG, exe).collect():
        got.setdefault(r.session_id, []).append(
            (r.block_no, r.filename or "", r.start_us, r.end_us, r.duration_us, r.event_count, r.start_tick,
             r.end_tick, r.delta_tick, r.velocity, r.closed_by))
    for sid, evs in logs.items():
        exp = model.blocks(evs, AGG)
        g = sorted(got.get(sid, []))
        assert len(g) == len(exp), sid
        for a, b in zip(g, exp):
            # velocity: final values; the loop keeps the same rule when duration <= 0
            assert a[:9] == b[:9] and a[10] == b[10], (sid, a, b)
            assert a[9] == pytest.approx(b[9]), (sid, a, b)


def test_idle_gaps_match_loop(spark, logs, exe):
    df = rows_to_df(spark, logs)
    got = sorted((r.session_id, r.end_seq, r.start_us, r.end_us) for r in idle_gaps(df, AGG, exe).collect())
    exp = sorted((sid, *g) for sid, evs in logs.items() for g in model.idle_gaps(evs, AGG))
    assert got == exp


def test_focus_match_loop(spark, logs, exe):
    df = rows_to_df(spark, logs)
    got = {(r.session_id, r.filename): (r.seconds, r.distraction) for r in file_focus(df, AGG, exe).collect()}
    exp = {}
    for sid, evs in logs.items():
        files, dist = model.focus(evs, AGG)
        exp.update({(sid, f): (v, False) for f, v in files.items()})
        exp.update({(sid, f): (v, True) for f, v in dist.items()})
    assert got == exp


def test_corrections_match_loop(spark, logs, exe):
    df = rows_to_df(spark, logs)
    got = sorted((r.session_id, r.seq, r.blocks_affected, r.ticks_reversed)
                 for r in error_corrections(df, AGG, exe).collect())
    exp = sorted((sid, *c) for sid, evs in logs.items() for c in model.corrections(evs, AGG))
    assert got == exp


def test_timeline_match_loop(spark, logs, exe):
    df = rows_to_df(spark, logs)
    got = sorted((r.session_id, r.entry_no, r.type, r.first_seq, r.edit_count)
                 for r in timeline(df, AGG, exe).collect())
    exp = sorted((sid, k, t, first, n) for sid, evs in logs.items() for (k, t, first, last, n) in model.timeline(evs))
    assert got == exp


def cursor_logs(seed, n_sessions=30, max_len=80, back=0.0):
    rnd = random.Random(seed)
    logs = {}
    for s in range(n_sessions):
        t, evs = 0, []
        for _ in range(rnd.randint(0, max_len)):
            t += rnd.choice([30_000, 90_000, 150_000, 199_999, 200_000, 260_000, 500_000, 700_000])
            if rnd.random() < back:
                t -= rnd.choice([50_000, 100_000, 400_000, 900_000])
            typ = rnd.choice(["cursor_move"] * 6 + ["file_edit", "terminal_command", "annotation", "file_open"])
            evs.append({"type": typ, "ts": t, "filename": "a.lua"})
        if rnd.random() < 0.5:
            t += rnd.choice([100_000, 5_000_000])
            evs.append({"type": "session_end", "ts": t})
        logs[f"c{s}"] = evs
    return logs


def decisions(spark, logs, cfg, exe):
    df = rows_to_df(spark, logs)
    return {(r.session_id, r.seq): (r.reason, r.flush_seq)
            for r in cursor_decisions(df, cfg, exe).filter(F.col("kept")).collect()}


def expected_decisions(logs, cfg):
    return {(sid, i): v for sid, evs in logs.items() for i, v in model.cursor_filter(evs, cfg).items()}


@pytest.mark.parametrize("chunk_rows", [1, 4, 1 << 20], ids=["rows", "chunks", "whole"])
@pytest.mark.parametrize("mode,idle,back", [("record", 500_000, 0.0), ("drop", 500_000, 0.15), ("record", 250_000, 0.1),
                                            ("drop", 100_000, 0.0)])
def test_cursor_filter_matches_model(spark, chunk_rows, mode, idle, back):
    """Any debounce and idle, moves that go back in time, chunks of any size."""
    cfg = FilterConfig(idle_commit=mode, idle_us=idle)
    logs = cursor_logs(11, back=back)
    exe = ExecConfig(chunk_rows=chunk_rows)
    exp = expected_decisions(logs, cfg)
    assert decisions(spark, logs, cfg, exe) == exp
    # the denoised log keeps every non-cursor event and the kept moves, densely re-sequenced
    df = rows_to_df(spark, logs)
    out = cursor_filter(df, cfg, exe)
    n_non_cursor = df.filter(F.col("type") != "cursor_move").count()
    assert out.count() == n_non_cursor + len(exp)
    per = out.groupBy("session_id").agg(F.max("seq").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n - 1 for r in per)


def test_cursor_filter_back_step_inside_a_burst(spark):
    moves = [0, 150_000, 250_000, 190_000, 195_000]
    logs = {"s": [{"type": "cursor_move", "ts": t} for t in moves] + [{"type": "file_edit", "ts": 600_000}]}
    for chunk_rows in (1, 2, 100):
        got = decisions(spark, logs, FilterConfig(), ExecConfig(chunk_rows=chunk_rows))
        assert got == expected_decisions(logs, FilterConfig()) == {("s", 4): ("trigger", 5)}


def test_rows_without_a_session_are_a_session(spark):
    """NULL keys: the same rows and numbers whatever the group and chunk sizes."""
    from sessionlog.operators.search import cap_cursor_events
    from sessionlog.operators.sequence import assign_seq

    logs = {**cursor_logs(5, n_sessions=2, max_len=60), None: cursor_logs(6, n_sessions=1, max_len=60)["c0"]}
    df = rows_to_df(spark, logs)
    plain = df.drop("seq").withColumn("nth", F.col("ts_us"))
    one, many = (assign_seq(plain, "session_id", ["ts_us", "type"], max_group_rows=n) for n in (1 << 20, 5))
    pick = ["session_id", "seq", "ts_us", "type"]
    rows = lambda d: sorted(map(tuple, d.select(*pick).collect()), key=str)
    assert one.count() == many.count() == df.count()
    assert [r[:3] for r in rows(one)] == [r[:3] for r in rows(many)]
    small, big = ExecConfig(chunk_rows=3), ExecConfig()
    assert rows(cap_cursor_events(df, 4, small)) == rows(cap_cursor_events(df, 4, big))
    assert decisions(spark, logs, FilterConfig(), small) == expected_decisions(logs, FilterConfig())
    cols = ["session_id", "block_no", "start_us", "end_us", "event_count", "closed_by"]
    got = [sorted(map(tuple, activity_blocks(df, AGG, e).select(*cols).collect()), key=str) for e in (small, big)]
    assert got[0] == got[1]


@pytest.mark.parametrize("seed,chunk", [(21, 5), (33, 7), (45, 2)])
def test_scan_operators_more_seeds(spark, seed, chunk):
    """Longer random logs (many chunk boundaries per session) for blocks, gaps, focus, timeline."""
    logs = random_logs(seed, n_sessions=15, max_len=200)
    df = rows_to_df(spark, logs)
    exe = ExecConfig(chunk_rows=chunk)
    got_b = {}
    for r in activity_blocks(df, AGG, exe).collect():
        got_b.setdefault(r.session_id, []).append((r.block_no, r.event_count, r.delta_tick, r.closed_by))
    got_g = sorted((r.session_id, r.end_seq) for r in idle_gaps(df, AGG, exe).collect())
    got_f = {(r.session_id, r.filename): r.seconds for r in file_focus(df, AGG, exe).collect()}
    got_t = sorted((r.session_id, r.entry_no, r.first_seq, r.edit_count) for r in timeline(df, AGG, exe).collect())
    exp_g, exp_f, exp_t = [], {}, []
    for sid, evs in logs.items():
        exp_b = [(b[0], b[5], b[8], b[10]) for b in model.blocks(evs, AGG)]
        assert sorted(got_b.get(sid, [])) == exp_b, sid
        exp_g += [(sid, g[0]) for g in model.idle_gaps(evs, AGG)]
        files, dist = model.focus(evs, AGG)
        exp_f.update({(sid, f): v for f, v in {**files, **dist}.items()})
        exp_t += [(sid, k, first, n) for (k, t, first, last, n) in model.timeline(evs)]
    assert got_g == sorted(exp_g)
    assert got_f == exp_f
    assert got_t == sorted(exp_t)


def test_session_without_an_id_has_the_same_numbers(spark, tmp_path):
    """Every per-session operator, report and sink gives a NULL session what it gives the same log under an id."""
    from sessionlog.operators.analytics import session_analytics
    from sessionlog.operators.stats import session_state, session_stats
    from sessionlog.operators.topk import top_files
    from sessionlog.sinks.reports import summary_report, timeline_report
    from sessionlog.sinks.replace import replace_sessions
    from sessionlog.sinks.store import store_events, store_sessions, upsert
    from sessionlog.streaming.pipelines import latest_summaries, refresh_summaries

    log = next(v for v in random_logs(7).values() if len(v) > 40)
    log = log + [{"type": "file_edit", "ts": log[-1]["ts"] + 1, "filename": "a.lua", "changed_tick": 5, "note": None},
                 {"type": "annotation", "ts": log[-1]["ts"] + 2, "filename": "a.lua", "changed_tick": None, "note": "fix bug"}]
    df = rows_to_df(spark, {"named": log, None: log}).cache()
    state = session_state(df).withColumn("project_path", F.lit("/p")).withColumn("output_format", F.lit("sqlite"))
    exe = ExecConfig()

    def rows(d):
        out = {None: [], "named": []}
        for r in d.collect():
            out[r.session_id].append(str({k: str(v).replace("named", "None") for k, v in r.asDict().items() if k != "session_id"}))
        return {k: sorted(v) for k, v in out.items()}

    found = {"stats": session_stats(df), "analytics": session_analytics(df, AGG, exe), "corrections": error_corrections(df, AGG, exe),
             "top": top_files(file_focus(df, AGG, exe), AGG, exe)}
    for name, d in found.items():
        got = rows(d)
        assert got["named"] and got[None] == got["named"], name
    for d in (timeline_report(df, state, AGG, exe), summary_report(df, state, AGG, exe)):
        got = rows(d.select("session_id", "sec", "ord", "sub").withColumn("n", F.lit(1)))
        assert len(got[None]) == len(got["named"]) > 0

    ids, path = df.select("session_id").distinct(), str(tmp_path / "table")
    for _ in range(2):
        replace_sessions(df.select("session_id", "seq"), ids, path)
    assert spark.read.parquet(path).count() == df.count()

    s, e = upsert(store_sessions(state), store_events(df), store_sessions(state), store_events(df))
    assert (s.count(), e.count()) == (2, df.count())

    stored, out = str(tmp_path / "log"), str(tmp_path / "summaries")
    from sessionlog.sinks.replace import bucket_of
    df.withColumn("bucket", bucket_of()).write.partitionBy("bucket").parquet(stored)
    for epoch in range(2):
        refresh_summaries(stored, out, AGG, exe)(df, epoch)
    got = rows(latest_summaries(spark, out))
    assert len(got[None]) == 1 and got[None] == got["named"]


@pytest.mark.parametrize("seed", range(4))
def test_chunk_functions_compose(seed):
    """The composed functions of chunks give the state of the walk over all rows, for any cut."""
    from sessionlog.operators.denoise import END, MOVE, NOTHING, OTHER, TRIGGER, apply_function, chunk_function, walk
    rnd = random.Random(seed)
    for _ in range(400):
        cfg = FilterConfig(debounce_us=rnd.choice([3, 10]), idle_us=rnd.choice([0, 4, 25]))
        t, times = 0, []
        for _ in range(rnd.randint(1, 40)):
            t += rnd.choice([0, 1, 2, 5, 12]) - (rnd.random() < 0.1) * rnd.randint(0, 20)
            times.append(t)
        kinds = rnd.choices([MOVE, OTHER, TRIGGER, END], [30, 4, rnd.choice([0, 1, 6]), 1], k=len(times))
        seqs, state, at = list(range(len(times))), NOTHING, 0
        while at < len(times):
            to = at + rnd.randint(1, 9)
            top = max((x for x, k in zip(times[:at], kinds) if k != OTHER), default=None)
            state = apply_function(chunk_function(seqs[at:to], times[at:to], kinds[at:to], top, cfg), state, cfg)
            at = to
            assert state == walk(NOTHING, seqs[:at], times[:at], kinds[:at], cfg, [])


def test_corrections_at_chunk_edges(spark, logs):
    """A halo gives each chunk the rows that its annotations look back on, over several chunks if these are small."""
    df = rows_to_df(spark, logs)
    for agg in (AGG, AggregationConfig(lookback_us=10**9, annotation_file="last_active")):
        got = [sorted(map(tuple, error_corrections(df, agg, ExecConfig(chunk_rows=n)).collect()), key=str) for n in (1 << 20, 1, 4, 10, 11)]
        assert got[0] and all(g == got[0] for g in got)
