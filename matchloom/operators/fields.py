"""Conditions on single fields that comparison and rules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K

#: Rules that read the query's name alone: comparison finds their outcome once a query.
QUERY_FLAGS = {"forprofit_x": K.FORPROFIT_PATTERN, "government_x": K.GOVERNMENT_PATTERN}


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def plain(c: Column) -> Column:
    """Upper case, everything else than letters and digits a blank, single blanks; null ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9 ]", " "), " +", " "))


def query_flags(name: Column) -> dict[str, Column]:
    return {flag: plain(name).rlike(pattern) for flag, pattern in QUERY_FLAGS.items()}
