"""Frozen configuration objects (user overlays via ``dataclasses.replace``)."""

from __future__ import annotations

from dataclasses import dataclass

US = 1_000_000  # microseconds per second

# ---------------------------------------------------------------------------
# Fixed values that must equal the recorder's defaults for identical results.
# Distraction patterns are case-sensitive substrings; error keywords are
# substrings of the lower-cased note.
# ---------------------------------------------------------------------------
DISTRACTION_PATTERNS = ("NvimTree", "copilot-chat", "neo-tree", "CHADTree", "fern", "undotree")
ERROR_KEYWORDS = ("fix", "error", "bug", "issue", "mistake", "correct", "debug")
BLOCK_CLOSERS = ("terminal_command", "file_open")
CURSOR_TRIGGERS = ("file_edit", "terminal_command", "session_end")
EVENT_TYPES = (
    "session_start", "session_resume", "session_end", "file_edit", "terminal_command",
    "cursor_move", "file_open", "lsp_diagnostic", "annotation",
)


@dataclass(frozen=True)
class AggregationConfig:
    """Block, idle, focus and correction rules (all durations in microseconds)."""

    merge_window_us: int = 2 * US
    idle_threshold_us: int = 300 * US
    flow_velocity: float = 10.0
    distraction_patterns: tuple[str, ...] = DISTRACTION_PATTERNS
    block_closers: tuple[str, ...] = BLOCK_CLOSERS
    error_keywords: tuple[str, ...] = ERROR_KEYWORDS
    lookback_events: int = 10
    lookback_us: int = 300 * US
    # "own": match edits on the annotation's own file name (recorder code);
    # "last_active": use the last file seen before the annotation (documented intent).
    annotation_file: str = "own"
    # False: sum forward tick progress like the recorder; True: count real decreases.
    true_reversals: bool = False
    top_files: int = 10
    report_blocks: int = 50


@dataclass(frozen=True)
class FilterConfig:
    """Cursor debounce (microseconds); any pair of ``debounce_us`` > 0 and ``idle_us`` >= 0."""

    debounce_us: int = 200_000
    idle_us: int = 500_000
    triggers: tuple[str, ...] = CURSOR_TRIGGERS
    # "record": idle-committed moves are kept (documented); "drop": discarded (recorder code).
    idle_commit: str = "record"

    def __post_init__(self):
        if self.debounce_us <= 0 or self.idle_us < 0 or self.idle_commit not in ("record", "drop"):
            raise ValueError("debounce_us must be positive, idle_us not negative, idle_commit record or drop")


@dataclass(frozen=True)
class ExecConfig:
    """Physical knobs.

    ``chunk_rows`` bounds the rows one window partition may hold: every
    order-dependent operator works on ``(session_id, seq div chunk_rows)`` and
    stitches chunks together through a small carry table, so one session with
    billions of events is still spread over many tasks.
    """

    chunk_rows: int = 1 << 20
    # Hash fan-out used by two-phase top-k so one group never sorts in one task.
    topk_fanout: int = 64


# Parameters for the driver's synthetic ``events`` table: its gaps are hours,
# not seconds, so the second-scale defaults above would give one edit per block.
ADAPTER_AGG = AggregationConfig(
    merge_window_us=6 * 3600 * US,
    idle_threshold_us=24 * 3600 * US,
    lookback_us=48 * 3600 * US,
    flow_velocity=0.0045,
)
ADAPTER_FILTER = FilterConfig(debounce_us=3600 * US, idle_us=4 * 3600 * US)
# An idle time shorter than two debounces: the timer runs out among moves that debounce each other.
TIGHT_FILTER = FilterConfig(debounce_us=24 * 3600 * US, idle_us=6 * 3600 * US)


@dataclass(frozen=True)
class CaptureOptions:
    """Capture-side switches: which event kinds are logged and the cursor cap."""

    terminal_commands: bool = True
    file_open: bool = True
    lsp_diagnostics: bool = True
    max_cursor_events: int | None = None
    # How often running summaries are refreshed.
    periodic_update_us: int = 300 * US


def from_options(opts: dict | None = None) -> tuple[AggregationConfig, FilterConfig, CaptureOptions]:
    """Overlay a user option table (the plugin's ``setup{...}`` shape: milliseconds,
    nested ``aggregation`` and ``log_events``) on the defaults; unknown keys are ignored."""
    from dataclasses import replace

    o = dict(opts or {})
    a = dict(o.get("aggregation") or {})
    agg = AggregationConfig()
    if "merge_window" in a:
        agg = replace(agg, merge_window_us=int(a["merge_window"]) * 1000)
    if "idle_threshold" in a:
        agg = replace(agg, idle_threshold_us=int(a["idle_threshold"]) * 1000)
    if "flow_velocity_threshold" in a:
        agg = replace(agg, flow_velocity=float(a["flow_velocity_threshold"]))
    if "distraction_files" in a:
        agg = replace(agg, distraction_patterns=tuple(a["distraction_files"]))
    flt = FilterConfig()
    if "debounce_interval" in o:
        flt = replace(flt, debounce_us=int(o["debounce_interval"]) * 1000)
    if "filter_threshold" in o:
        flt = replace(flt, idle_us=int(o["filter_threshold"]) * 1000)
    le = dict(o.get("log_events") or {})
    cap = CaptureOptions(
        terminal_commands=bool(le.get("terminal_commands", o.get("record_terminal", True))),
        file_open=bool(le.get("file_open", True)),
        lsp_diagnostics=bool(le.get("lsp_diagnostics", True)),
        max_cursor_events=o.get("max_cursor_events"),
        periodic_update_us=int(o.get("periodic_update_interval", 300_000)) * 1000,
    )
    return agg, flt, cap
