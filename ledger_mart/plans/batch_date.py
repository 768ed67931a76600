"""Which day a run is for."""

from __future__ import annotations

import re
from datetime import date

_SHAPE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def checked_batch_date(text: str) -> str:
    """``text`` itself if it is a ``YYYY-MM-DD`` day.

    The batch filter compares text. A timestamp or a short form would match no row,
    or rows whose date does not parse, so it is refused here.
    """
    if not _SHAPE.fullmatch(text):
        raise ValueError(f"batch date must be YYYY-MM-DD, not {text!r}")
    date.fromisoformat(text)
    return text


def resolve_batch_date(override: str | None = None, scheduled: str | None = None) -> str:
    """An explicit override wins over the scheduled day, and that over today."""
    return checked_batch_date(override or scheduled or date.today().isoformat())
