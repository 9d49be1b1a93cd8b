"""Plain-Python statement of the recorder's rules (ground truth for tests).

Each function takes one session's events as a list of dicts in seq order with
keys type, ts (micros), filename, changed_tick, note, line, column, line_text.
The rules are stated over whole lists: boundaries first, then groups.
"""

from __future__ import annotations

from itertools import accumulate, pairwise, takewhile
from typing import NamedTuple

from sessionlog.config import AggregationConfig, FilterConfig


def _file(e) -> str:
    return e.get("filename") or ""


def _tick(e) -> int:
    return e.get("changed_tick") or 0


def blocks(evs, cfg: AggregationConfig):
    """Edits cut wherever a rule separates two neighbouring edits."""
    closers = list(accumulate((e["type"] in cfg.block_closers for e in evs), initial=0))  # before event i
    edits = [i for i, e in enumerate(evs) if e["type"] == "file_edit"]

    def why(a, b):
        """What separates edit a from the next edit b, if anything."""
        if closers[a] != closers[b] or _file(evs[a]) != _file(evs[b]):
            return "context_switch"
        return "timeout" if evs[b]["ts"] - evs[b - 1]["ts"] > cfg.merge_window_us else None

    reasons = [why(a, b) for a, b in pairwise(edits)]
    if edits:
        reasons.append("context_switch" if closers[-1] != closers[edits[-1]] else "session_end")
    out, first = [], 0
    for k, reason in enumerate(reasons):
        if reason is None:
            continue
        own = [evs[i] for i in edits[first : k + 1]]
        first = k + 1
        span, gain = own[-1]["ts"] - own[0]["ts"], _tick(own[-1]) - _tick(own[0])
        out.append((len(out) + 1, _file(own[0]), own[0]["ts"], own[-1]["ts"], span, len(own), _tick(own[0]),
                    _tick(own[-1]), gain, gain / (span / 1e6) if span > 0 else 0.0, reason))
    return out


def idle_gaps(evs, cfg: AggregationConfig):
    times = [e["ts"] for e in evs]
    return [(i, a, b) for i, (a, b) in enumerate(pairwise(times), 1) if b - a > cfg.idle_threshold_us]


def focus(evs, cfg: AggregationConfig):
    """Each interval between events belongs to the last named file at its start."""
    named = list(accumulate((_file(e) for e in evs), lambda seen, f: f or seen))
    totals: dict[bool, dict[str, int]] = {False: {}, True: {}}
    for f, (a, b) in zip(named, pairwise(evs)):
        if f:
            kind = totals[any(p in f for p in cfg.distraction_patterns)]
            whole = abs(b["ts"] - a["ts"]) // 1_000_000  # towards zero
            kind[f] = kind.get(f, 0) + (whole if b["ts"] >= a["ts"] else -whole)
    return totals[False], totals[True]


def corrections(evs, cfg: AggregationConfig):
    out = []
    for i, a in enumerate(evs):
        note = (a.get("note") or "").lower()
        if a["type"] == "annotation" and any(k in note for k in cfg.error_keywords):
            back = evs[max(0, i - cfg.lookback_events) : i][::-1]
            recent = takewhile(lambda e: a["ts"] - e["ts"] <= cfg.lookback_us, back)
            ticks = [_tick(e) for e in recent if e["type"] == "file_edit" and _file(e) == _file(a)]
            if ticks:
                out.append((i, len(ticks), sum(x - y for x, y in pairwise(ticks) if 0 < x and y < x)))
    return out


def timeline(evs):
    """Entries of events other than moves; neighbouring edits of one file are one entry."""
    shown = [i for i, e in enumerate(evs) if e["type"] != "cursor_move"]
    edit = [evs[i]["type"] == "file_edit" for i in shown]
    joins = [a and b and _file(evs[i]) == _file(evs[j]) for (i, j), (a, b) in zip(pairwise(shown), pairwise(edit))]
    starts = [k for k in range(len(shown)) if k == 0 or not joins[k - 1]]
    out = []
    for no, (k, end) in enumerate(zip(starts, starts[1:] + [len(shown)]), 1):
        own = shown[k:end]
        out.append((no, evs[own[0]]["type"], own[0], own[-1], len(own) if edit[k] else 0))
    return out


END_OF_LOG = 1 << 60


class Pending(NamedTuple):
    """What the cursor filter remembers between events."""

    move: int | None = None
    anchor: float = float("-inf")
    due: float = float("inf")


def cursor_filter(evs, cfg: FilterConfig):
    """{index of kept move: (reason, index of the event it is recorded before, or END_OF_LOG / None)}."""
    kept, now = {}, Pending()
    for i, e in enumerate(evs):
        if e["ts"] > now.due:  # the timer has run out, whatever arrives
            kept[now.move] = ("idle", i)
            now = now._replace(move=None, due=float("inf"))
        if e["type"] in cfg.triggers:
            kept[now.move] = ("end" if e["type"] == "session_end" else "trigger", i)
            now = Pending() if e["type"] == "session_end" else Pending(anchor=e["ts"])
        elif e["type"] == "cursor_move":
            near = e["ts"] - now.anchor < cfg.debounce_us
            now = now._replace(move=i) if near else Pending(i, e["ts"], e["ts"] + cfg.idle_us)
    kept[now.move] = ("end", None) if now.due == float("inf") else ("idle", END_OF_LOG)
    kept.pop(None, None)
    return {k: v for k, v in kept.items() if cfg.idle_commit == "record" or v[0] != "idle"}
