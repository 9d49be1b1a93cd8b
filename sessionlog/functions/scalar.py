"""Scalar Column functions used by the operators and the report sinks.

Everything here returns a ``pyspark.sql.Column`` built from native functions,
so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

__all__ = [
    "epoch_us", "us_to_ts", "is_distraction", "has_error_keyword", "format_duration",
    "format_duration_or_progress", "go_duration", "title_case", "type_title", "type_icon",
    "location", "snippet", "detail", "base_name", "pct_vs_distraction", "secs_trunc",
    "velocity", "velocity_badge", "edit_percent", "nav_percent", "clock", "day",
    "strip_session_suffix", "start_note", "parse_session_id", "blank_to_null", "zero_to_null", "edit_location",
]

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_us(c: Column, dtype) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    if isinstance(dtype, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c)
    raise TypeError(f"not a timestamp type: {dtype}")


def us_to_ts(c: Column) -> Column:
    """BIGINT epoch microseconds -> TIMESTAMP_NTZ (wall clock in UTC)."""
    return F.timestamp_add("MICROSECOND", c, F.expr(_EPOCH_NTZ))


def _any(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    if not cols:
        return F.lit(False)
    return reduce(lambda a, b: a | b, cols)


def is_distraction(filename: Column, patterns: Iterable[str]) -> Column:
    """Case-sensitive literal substring match against any pattern."""
    f = F.coalesce(filename, F.lit(""))
    return _any(f.contains(F.lit(p)) for p in patterns)


def has_error_keyword(note: Column, keywords: Iterable[str]) -> Column:
    """Lower-cased literal substring match against any keyword."""
    n = F.lower(F.coalesce(note, F.lit("")))
    return _any(n.contains(F.lit(k)) for k in keywords)


def _trunc_div(us: Column, unit: int) -> Column:
    """Integer division of BIGINT micros truncated toward zero."""
    u = us.cast("bigint")
    return F.when(u >= 0, F.floor(u / unit)).otherwise(-F.floor(-u / unit)).cast("bigint")


def secs_trunc(us: Column) -> Column:
    """Whole seconds toward zero (``div`` truncates, so -7.5 s -> -7)."""
    return _trunc_div(us, 1_000_000)


def format_duration(us: Column) -> Column:
    """``Ns`` under a minute (half-even), ``Xm Ys`` under an hour, else ``Xh Ym``."""
    secs = us / 1_000_000.0
    whole = secs_trunc(us)
    mins = _trunc_div(us, 60_000_000)
    hours = _trunc_div(us, 3_600_000_000)
    return (
        F.when(us < 60_000_000, F.format_string("%.0fs", F.rint(secs)))
        .when(us < 3_600_000_000, F.format_string("%dm %ds", mins, whole % 60))
        .otherwise(F.format_string("%dh %dm", hours, mins % 60))
    )


def format_duration_or_progress(start_us: Column, end_us: Column) -> Column:
    """Duration of a session, or ``in progress`` while it has no end."""
    return F.when(end_us.isNull(), F.lit("in progress")).otherwise(format_duration(end_us - start_us))


def go_duration(us: Column) -> Column:
    """Duration text such as ``1h30m0s``, ``2m5.5s``, ``1.5s``, ``250ms``, ``0s``."""
    a = F.abs(us)
    sign = F.when(us < 0, F.lit("-")).otherwise(F.lit(""))
    h = F.floor(a / 3_600_000_000).cast("bigint")
    m = (F.floor(a / 60_000_000) % 60).cast("bigint")
    s_int = (F.floor(a / 1_000_000) % 60).cast("bigint")
    frac = (a % 1_000_000).cast("bigint")
    frac_txt = F.when(frac == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.regexp_replace(F.lpad(frac.cast("string"), 6, "0"), "0+$", ""))
    )
    sec_txt = F.concat(s_int.cast("string"), frac_txt, F.lit("s"))
    sub_sec = F.when(a % 1000 == 0, F.concat((a / 1000).cast("bigint").cast("string"), F.lit("ms"))).otherwise(
        F.concat(F.regexp_replace(F.format_string("%.3f", a / 1000.0), "\\.?0+$", ""), F.lit("ms"))
    )
    body = (
        F.when(a == 0, F.lit("0s"))
        .when(a < 1000, F.concat(a.cast("string"), F.lit("µs")))
        .when(a < 1_000_000, sub_sec)
        .when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), sec_txt))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), sec_txt))
        .otherwise(sec_txt)
    )
    return F.concat(sign, body)


def title_case(t: Column) -> Column:
    """snake_case -> Title Case; only the first letter of each word changes."""
    return F.array_join(
        F.transform(F.split(t, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        " ",
    )


# Fixed display values per event type (title, icon), in the recorder's order.
_TITLES = {
    "annotation": "Note", "file_edit": "Edits", "lsp_diagnostic": "LSP", "terminal_command": "Terminal",
    "file_open": "File Open", "session_start": "Session Started", "session_end": "Session Ended",
    "session_resume": "Session Resumed",
}
_ICONS = {
    "annotation": "📝", "file_edit": "🛠", "lsp_diagnostic": "⚠️", "terminal_command": "💻",
    "file_open": "📂", "session_start": "🚀", "session_end": "🏁", "session_resume": "🔄",
}


def _case(t: Column, mapping: dict[str, str], default: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(t == k, F.lit(v)) if expr is None else expr.when(t == k, F.lit(v))
    return expr.otherwise(default)


def type_title(t: Column) -> Column:
    """Title per type; other types: underscores to spaces, words capitalised."""
    return _case(t, _TITLES, title_case(t))


def type_icon(t: Column) -> Column:
    """Icon per event type; other types get a bullet."""
    return _case(t, _ICONS, F.lit("•"))


def location(filename: Column, line: Column) -> Column:
    """``file:line`` when line > 0, ``file`` when only the name is known, else empty."""
    f = F.coalesce(filename, F.lit(""))
    return (
        F.when(f == "", F.lit(""))
        .when(F.coalesce(line, F.lit(0)) > 0, F.concat(f, F.lit(":"), line.cast("string")))
        .otherwise(f)
    )


def edit_location(line: Column, column: Column) -> Column:
    """``L{line}:C{column}`` of an edit."""
    return F.format_string("L%d:C%d", F.coalesce(line, F.lit(0)), F.coalesce(column, F.lit(0)))



def snippet(text: Column, max_bytes: int = 120, keep_bytes: int = 117) -> Column:
    """Trim Unicode space; above ``max_bytes`` UTF-8 bytes keep the longest
    whole-character prefix of at most ``keep_bytes`` bytes and append ``...``."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    chars = F.regexp_extract_all(F.substring(t, 1, keep_bytes), F.lit("(?s)."), 0)
    init = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    cut = F.aggregate(
        chars, init,
        lambda acc, c: F.when(acc["n"] + F.octet_length(c) <= keep_bytes,
                              F.struct(F.concat(acc["s"], c).alias("s"), (acc["n"] + F.octet_length(c)).alias("n")))
        .otherwise(F.struct(acc["s"].alias("s"), F.lit(keep_bytes + 1).alias("n"))),
    )["s"]
    return F.when(F.octet_length(t) > max_bytes, F.concat(cut, F.lit("..."))).otherwise(t)


def detail(t: Column, note: Column, message: Column, command: Column, file_type: Column) -> Column:
    """Detail text per type: note, message, command, file type (or ``opened``)."""
    return (
        F.when(t == "annotation", F.coalesce(note, F.lit("")))
        .when(t == "lsp_diagnostic", F.coalesce(message, F.lit("")))
        .when(t == "terminal_command", F.coalesce(command, F.lit("")))
        .when(t == "file_open", F.when(F.coalesce(file_type, F.lit("")) != "", file_type).otherwise(F.lit("opened")))
        .otherwise(F.lit(""))
    )


def base_name(path: Column) -> Column:
    """Last path element; empty -> ``.``; only slashes -> ``/``."""
    p = F.coalesce(path, F.lit(""))
    stripped = F.regexp_replace(p, "/+$", "")
    return (
        F.when(p == "", F.lit("."))
        .when(stripped == "", F.lit("/"))
        .otherwise(F.element_at(F.split(stripped, "/"), -1))
    )


def pct_vs_distraction(seconds: Column, distraction: Column) -> Column:
    """seconds / (distraction + seconds) * 100; NULL where the denominator is 0."""
    den = (distraction + seconds).cast("double")
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(seconds.cast("double") / den * 100)


def velocity(delta_tick: Column, duration_us: Column) -> Column:
    """Ticks per second; 0 when the duration is not positive."""
    return F.when(duration_us > 0, delta_tick.cast("double") / (duration_us.cast("double") / 1_000_000.0)).otherwise(
        F.lit(0.0)
    )


def velocity_badge(v: Column, threshold: float = 10.0) -> Column:
    """Flame badge for a velocity at or above the threshold."""
    return F.when(v >= threshold, F.lit(" 🔥")).otherwise(F.lit(""))


def edit_percent(edits: Column, navs: Column) -> Column:
    """trunc(100 * edits / (edits + navs)); 0 when both are 0."""
    tot = edits + navs
    return F.when(tot == 0, F.lit(0)).otherwise((edits.cast("double") / tot.cast("double") * 100).cast("int"))


def nav_percent(edits: Column, navs: Column) -> Column:
    """100 minus the edit percentage; 0 when there are no edits or moves."""
    return F.when((edits + navs) == 0, F.lit(0)).otherwise(100 - edit_percent(edits, navs))


def clock(us: Column) -> Column:
    """``HH:mm:ss`` of epoch micros (UTC)."""
    return F.date_format(us_to_ts(us), "HH:mm:ss")


def day(us: Column) -> Column:
    """``yyyy-MM-dd`` of epoch micros (UTC)."""
    return F.date_format(us_to_ts(us), "yyyy-MM-dd")


def strip_session_suffix(name: Column) -> Column:
    """File name -> session id (drops ``_raw.json`` or ``.json``)."""
    return F.regexp_replace(F.regexp_replace(name, "_raw\\.json$", ""), "\\.json$", "")


# Fixed value: note of the session_start event (followed by the project path).
START_NOTE_PREFIX = "Started debugging session in "


def start_note(project: Column) -> Column:
    """Note of a ``session_start`` event for a project."""
    return F.concat(F.lit(START_NOTE_PREFIX), F.coalesce(project, F.lit("")))


def parse_session_id(sid: Column) -> Column:
    """``<epoch seconds>_<project>`` -> struct(started_at_s, project)."""
    secs = F.regexp_extract(sid, r"^(\d+)_(.*)$", 1)
    return F.struct(
        F.when(secs == "", F.lit(None)).otherwise(secs.try_cast("bigint")).alias("started_at_s"),
        F.when(secs == "", F.lit(None)).otherwise(F.regexp_extract(sid, r"^(\d+)_(.*)$", 2)).alias("project"),
    )


def blank_to_null(s: Column) -> Column:
    """Empty string -> NULL (an absent field)."""
    return F.when(s == "", F.lit(None)).otherwise(s)


def zero_to_null(i: Column) -> Column:
    """Zero -> NULL (an absent field)."""
    return F.when(i == 0, F.lit(None)).otherwise(i)
