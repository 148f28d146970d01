"""Set membership and differencing: what is new against what was handled before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHED = ("YES", "MATCH", "match")
KEYS = ("unique_entity_id", "UNIQUE ENTITY ID", "uei", "UEI", "id", "source_id")


def _key(df: DataFrame, given: str | None) -> str:
    col = given or next((k for k in KEYS if k in df.columns), None)
    if col is None or col not in df.columns:
        raise ValueError("no key column found; name it")
    return col


def diff_unmatched(fresh: DataFrame, crosswalk: DataFrame, key_fresh: str | None = None, key_cross: str | None = None, status: str | None = None, matched: tuple[str, ...] = MATCHED) -> DataFrame:
    """Rows of fresh whose key isn't in the crosswalk with a matched status; without a status column any appearance counts.
    An anti join; rows with a null key stay."""
    kf, kc = _key(fresh, key_fresh), _key(crosswalk, key_cross)
    status = status or next((c for c in ("tier", "status", "match_status", "determination") if c in crosswalk.columns), None)
    done = crosswalk.where(F.col(status).isin(*matched)) if status else crosswalk
    keys = done.select(F.col(f"`{kc}`").cast("string").alias("__k")).where("__k is not null").distinct()
    return fresh.withColumn("__k", F.col(f"`{kf}`").cast("string")).join(keys, "__k", "left_anti").drop("__k")


def diff_counts(fresh: DataFrame, crosswalk: DataFrame, key_fresh: str | None = None, key_cross: str | None = None, status: str | None = None, matched: tuple[str, ...] = MATCHED) -> DataFrame:
    """One row: rows of fresh, those already matched, those retained, and keys that the crosswalk has never had."""
    kf, kc = _key(fresh, key_fresh), _key(crosswalk, key_cross)
    status = status or next((c for c in ("tier", "status", "match_status", "determination") if c in crosswalk.columns), None)
    hit = F.col(status).isin(*matched) if status else F.lit(True)
    keys = crosswalk.groupBy(F.col(f"`{kc}`").cast("string").alias("__k")).agg(F.max(F.coalesce(hit, F.lit(False))).alias("__m"))
    j = fresh.select(F.col(f"`{kf}`").cast("string").alias("__k")).join(keys.withColumn("__in", F.lit(True)), "__k", "left")
    done = F.coalesce("__m", F.lit(False)).cast("int")
    return j.agg(F.count(F.lit(1)).alias("fresh"), F.sum(done).alias("already"), F.sum(1 - done).alias("retained"), F.countDistinct(F.when(F.col("__in").isNull(), F.col("__k"))).alias("new_ids"))


def flag_codes(df: DataFrame, column: str, codes: list[str], flag: str, delimiter: str = "~", exact: bool = False, keep: bool = False) -> DataFrame:
    """Whether a delimited string of codes has one of codes: anywhere in it, or exactly as one of its parts. keep filters."""
    if exact:
        hit = F.arrays_overlap(F.split(F.col(column), delimiter), F.array(*[F.lit(c) for c in codes]))
    else:
        hit = reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(c)) for c in codes], F.lit(False))
    hit = F.coalesce(hit, F.lit(False))
    return df.where(hit) if keep else df.withColumn(flag, hit)


def code_flags(df: DataFrame, column: str, prefix: str, labels: dict[str, str] | None = None, delimiter: str = "~") -> DataFrame:
    """One boolean column per code that occurs in a delimited string: the schema depends on the data, so the distinct codes
    are read (a code list is short). labels names the columns."""
    codes = df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), delimiter)).alias("c")).where("c != ''").distinct().orderBy("c")
    names = [r["c"] for r in codes.collect()]
    parts = F.split(F.coalesce(F.col(column), F.lit("")), delimiter)
    return df.withColumns({f"{prefix}{(labels or {}).get(c, c.lower())}": F.array_contains(parts, c) for c in names}) if names else df
