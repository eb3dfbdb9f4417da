"""Durations such as 1h30m, 250ms or 1.5s, in nanoseconds."""

from __future__ import annotations

import re
from fractions import Fraction

UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")
_WHOLE = re.compile(rf"[+-]?(?:{_PART.pattern})+")
MINUTE = UNITS["m"]


def parse_duration(text: str) -> int:
    """Nanoseconds of a signed sum of decimal numbers with units; ``0`` needs none. There is no unit for days."""
    if text in ("0", "+0", "-0"):
        return 0
    if not _WHOLE.fullmatch(text):
        raise ValueError(f"invalid duration: {text!r}")
    total = sum(int(Fraction(n if n[-1] != "." else n + "0") * UNITS[u]) for n, u in _PART.findall(text))
    return -total if text[0] == "-" else total


def parse_interval(text: str | None) -> int:
    """Width of a histogram bucket: one minute if the text is no positive duration."""
    try:
        n = parse_duration(text or "")
    except ValueError:
        return MINUTE
    return n if n > 0 else MINUTE
