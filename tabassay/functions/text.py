"""Small driver-side text and rounding helpers for report rows (never per-row work)."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

# Every character Python's str.strip removes; used with btrim so that the work stays in the JVM.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def rounded(value, digits):
    """Round half away from zero on the shortest decimal text, as Spark's ``round`` does."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return value
    step = Decimal(1).scaleb(-digits)
    return float(Decimal(repr(float(value))).quantize(step, rounding=ROUND_HALF_UP))


def share(part, whole, digits=2):
    """Percentage of ``whole``, 0.0 for an empty whole."""
    return rounded(part / whole * 100, digits) if whole else 0.0


def name_tokens(name):
    return re.split(r"[\s_\-]+", name.lower())


def title(finding_type):
    return finding_type.replace("_", " ").title()


def quoted(columns):
    return ", ".join(f"'{c}'" for c in columns)
