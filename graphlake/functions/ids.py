"""Vertex ids that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_id(text: Column) -> Column:
    """The number a text writes, as LONG; null for null, other text or a number beyond LONG.

    Blanks around the digits and leading zeros do not matter.
    """
    digits = F.regexp_extract(text.cast("string"), r"^\s*([+-]?[0-9]+)\s*$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))
