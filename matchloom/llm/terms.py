"""Terms of names, shared by the term statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is a longest run of Unicode letters and digits.
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Terms of the upper-cased text in order, repeats kept; null gives null, a text without letters an empty array."""
    return F.regexp_extract_all(F.upper(text), F.lit(TERM), F.lit(0))
