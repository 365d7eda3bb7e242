"""Canonical keys: letter case, white space, joiners and Unicode form carry no meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbago.functions.text import canon, canon_col

__all__ = ["canon", "canon_col", "canon_hash", "trimmed"]


def canon_hash(text: str | None) -> str | None:
    """A hash by its value: ``canon`` without a leading algorithm name or 0x."""
    key = canon(text)
    return None if key is None else (re.sub(r"^(sha256[:=]?|0x)", "", key) or None)


def trimmed(column: Column | str) -> Column:
    """An id as results show it: trimmed and in lower case; blank gives null. Runs in the JVM."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, "^[\\s\u3000\u00a0\ufeff\u200b]+|[\\s\u3000\u00a0\ufeff\u200b]+$", "")), F.lit(""))
