"""What separates an edit from the edit before it: one rule for batch Columns and streamed values."""

from __future__ import annotations

from typing import Any


def boundaries(closer: Any, other_file: Any, gap_us: Any, merge_us: Any) -> tuple[tuple[str, Any], ...]:
    """(reason, condition) in order; the first condition that holds separates the two edits.

    ``closer``: a block closer came between them; ``other_file``: their files differ;
    ``gap_us``: time since the event before the later edit, whatever its type.
    Conditions are Columns or plain truth values, as the arguments are.
    """
    return ("context_switch", closer | other_file), ("timeout", gap_us > merge_us)
