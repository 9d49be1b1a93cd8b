"""Hypothesis-generated logs (equal times, time going back, all event kinds) vs the loop model."""

from dataclasses import replace

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sessionlog.config import AggregationConfig, ExecConfig
from sessionlog.operators.blocks import activity_blocks
from sessionlog.operators.corrections import error_corrections
from sessionlog.operators.gaps import idle_gaps
from sessionlog.operators.timeline import timeline
from tests import model
from tests.helpers import rows_to_df

AGG = AggregationConfig(merge_window_us=2_000_000, idle_threshold_us=10_000_000, lookback_us=6_000_000)
TYPES = ["file_edit", "file_edit", "cursor_move", "terminal_command", "file_open", "annotation", "lsp_diagnostic",
         "session_end"]

event = st.fixed_dictionaries({
    "type": st.sampled_from(TYPES),
    "dt": st.sampled_from([-1_000_000, 0, 0, 500_000, 2_000_000, 2_000_001, 7_000_000, 11_000_000]),
    "filename": st.sampled_from(["a", "b", "NvimTree_1", "", None]),
    "changed_tick": st.integers(0, 30),
    "note": st.sampled_from(["fix it", "Bug here", "plain", None]),
})
logs = st.dictionaries(st.sampled_from([f"s{i}" for i in range(6)]), st.lists(event, max_size=40), min_size=1)


def _materialize(log):
    out, t = [], 1_000_000_000
    for e in log:
        t += e["dt"]
        out.append({"type": e["type"], "ts": t, "filename": e["filename"], "changed_tick": e["changed_tick"],
                    "note": e["note"]})
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(logs)
def test_generated_logs_match_loop(spark, generated):
    sessions = {sid: _materialize(log) for sid, log in generated.items()}
    df = rows_to_df(spark, sessions)
    exe = ExecConfig(chunk_rows=2)
    got_b = {}
    for r in activity_blocks(df, AGG, exe).collect():
        got_b.setdefault(r.session_id, []).append((r.block_no, r.event_count, r.delta_tick, r.closed_by))
    got_g = sorted((r.session_id, r.end_seq) for r in idle_gaps(df, AGG, exe).collect())
    got_t = sorted((r.session_id, r.entry_no, r.first_seq, r.edit_count) for r in timeline(df, AGG, exe).collect())
    la = replace(AGG, annotation_file="last_active")
    got_c = sorted((r.session_id, r.seq, r.blocks_affected, r.ticks_reversed)
                   for r in error_corrections(df, la, exe).collect())
    exp_g, exp_t, exp_c = [], [], []
    for sid, evs in sessions.items():
        assert sorted(got_b.get(sid, [])) == [(b[0], b[5], b[8], b[10]) for b in model.blocks(evs, AGG)]
        exp_g += [(sid, g[0]) for g in model.idle_gaps(evs, AGG)]
        exp_t += [(sid, k, first, n) for (k, t, first, last, n) in model.timeline(evs)]
        # last-active mode: the annotation's file is the last named file before it
        filled, cur = [], None
        for e in evs:
            filled.append(dict(e, filename=e["filename"] if e["type"] != "annotation" else (e["filename"] or cur)))
            if e["filename"]:
                cur = e["filename"]
        exp_c += [(sid, *c) for c in model.corrections(filled, la)]
    assert got_g == sorted(exp_g)
    assert got_t == sorted(exp_t)
    assert got_c == sorted(exp_c)
