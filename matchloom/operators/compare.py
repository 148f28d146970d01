"""Comparison of candidate pairs: similarities, exact geographic flags, alternative names, provenance."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COMPARED, GEO_PROFILES, Config
from ..functions import similarity as S
from ..functions.text import tokens
from .fields import present, query_flags

#: What is carried from both sides for rules, display and review.
CARRIED = ["name", "dba", "division", "name_key", "dba_key", "division_key", "name_form", "name_gen", "name_gen_rank", "name_nums", "name_ord", "name_dir", "street", "city", "state", "zip5", "street_key"]


@dataclass(frozen=True)
class Pairs:
    """Compared pairs with what later steps need to know of them."""

    df: DataFrame
    compared: list[str]
    profile: str

    def with_df(self, df: DataFrame) -> Pairs:
        return Pairs(df, self.compared, self.profile)


def geo_coverage(queries: DataFrame) -> DataFrame:
    """One row: the share of queries with each geographic field."""
    return queries.agg(*[F.avg(F.when(present(F.col(f)), 1.0).otherwise(0.0)).alias(f) for f in ("street", "unit", "city", "county", "state", "zip5")])


def detect_profile(queries: DataFrame, min_coverage: float = 0.5) -> str:
    """The profile with most fields whose fields all have the coverage, the first of equals; 'state' if none. One row is read."""
    row = geo_coverage(queries).first()
    have = {f for f in row.asDict() if (row[f] or 0) >= min_coverage}
    fits = [p for p, fields in GEO_PROFILES.items() if have.issuperset(fields)]
    return max(fits, key=lambda p: (len(GEO_PROFILES[p]), -list(GEO_PROFILES).index(p)), default="state")


def compared_fields(queries: DataFrame, reference: DataFrame, profile: str) -> list[str]:
    """Fields of the profile, and the name, that both sides have at all; state only blocks."""
    fields = ["name", *[f for f in GEO_PROFILES[profile] if f != "state"]]
    some = [F.max(F.col(COMPARED[f]).isNotNull().cast("int")).alias(f) for f in fields]
    q, r = queries.agg(*some).first(), reference.agg(*some).first()
    return [f for f in fields if q[f] and r[f]]


def geo_flags() -> dict[str, Column]:
    """Exact geographic agreements as 0 or 1; both sides must have the field."""
    x, y = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    same = lambda c: flag(present(x(c)) & present(y(c)) & (x(c) == y(c)))
    return {**{f"geo_{c}": same(c) for c in ("zip9", "zip5", "zip3", "state")}, "geo_stnum": same("street_num"), "geo_pobox": flag(x("is_po_box") & y("is_po_box"))}


def _overlap(idf: bool, idf_min: float):
    @F.pandas_udf(T.DoubleType())
    def overlap(a: pd.Series, b: pd.Series, rare: pd.Series) -> pd.Series:
        out = []
        for x, y, strong in zip(a, b, rare):
            if x is None or y is None:
                out.append(0.0)
                continue
            v = S.contained_overlap(list(x), list(y), None if strong is None or strong else {}, idf_min)
            out.append(v if v >= 0.6 else 0.0)
        return pd.Series(out, dtype="float64")

    return overlap


def compare(candidates: DataFrame, queries: DataFrame, reference: DataFrame, config: Config | None = None, profile: str | None = None, name_freq: DataFrame | None = None, token_idf: DataFrame | None = None) -> Pairs:
    """Compared pairs, one row per candidate (id, rid).

    Names, streets, units, cities and counties are compared by Jaro, postal codes by equality, alternative names by
    Jaro-Winkler; what is under the floor is 0. The effective name similarity is the best of all versions and of the
    token overlap, which is only looked at within a state and where no version reaches the floor. name_freq (name, freq)
    and token_idf (token, idf) are statistics of the reference. Null ids and missing records give no row.
    """
    config = config or Config()
    profile = profile or detect_profile(queries)
    fields = compared_fields(queries, reference, profile)
    cols = [COMPARED[f] for f in fields]
    side = [*CARRIED, "zip3", "zip9", "street_num", "street_unit", "county", "is_po_box"]
    own = ["owner"] if "owner" in queries.columns else []
    q = queries.select("id", *own, *[c.alias(n) for n, c in query_flags(F.col("name")).items()], *[F.col(c).alias(f"{c}_x") for c in side])
    r = reference.select("rid", "ein", F.col("active").alias("bmf_active"), *[F.col(c).alias(f"{c}_y") for c in side])
    p = candidates.select("id", "rid").join(q, "id").join(r, "rid")
    x, y = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    p = p.withColumns(geo_flags())
    floor = config.similarity_floor
    sims = {"__" + c: (F.when(x(c) == y(c), 1.0).otherwise(0.0) if c == "zip5" else S.jaro_column(x(c), y(c), floor)) for c in cols}
    alts = {"nd": ("name_key", "dba_key"), "dn": ("dba_key", "name_key"), "dd": ("dba_key", "dba_key"), "vn": ("division_key", "name_key"), "vd": ("division_key", "dba_key")}
    sims |= {"__" + k: S.jaro_winkler_column(x(a), y(b), floor) for k, (a, b) in alts.items()}
    p = p.withColumns(sims)
    nn = F.col("__name_key")
    best_version = F.greatest(nn, *[F.col("__" + k) for k in alts])
    wanted = (best_version < floor) & (F.col("geo_state") == 1)
    p = p.withColumn("__rare", F.lit(None).cast("boolean"))
    if token_idf is not None:
        # whether a shared token is rare: only pairs that may be recovered are looked at
        need = p.where(wanted).select("id", "rid", F.explode(F.array_intersect(tokens(x("name_key")), tokens(y("name_key")))).alias("token"))
        strong = need.join(token_idf.where(F.col("idf") >= config.overlap_idf_min).select("token"), "token", "left_semi").select("id", "rid").distinct()
        p = p.drop("__rare").join(strong.withColumn("__rare", F.lit(True)), ["id", "rid"], "left").withColumn("__rare", F.coalesce("__rare", F.lit(False)))
    only = lambda c: F.when(wanted, tokens(c))
    p = p.withColumn("__ov", _overlap(token_idf is not None, config.overlap_idf_min)(only(x("name_key")), only(y("name_key")), F.col("__rare")))
    versions = [("name_key", "MAIN", "MAIN"), ("nd", "MAIN", "DBA"), ("dn", "DBA", "MAIN"), ("dd", "DBA", "DBA"), ("vn", "DIVISION", "MAIN"), ("vd", "DIVISION", "DBA"), ("ov", "TOKEN_OVERLAP", "TOKEN_OVERLAP")]
    top = F.greatest(*[F.col("__" + v) for v, _, _ in versions])
    p = p.withColumn("__top", top)
    first = None
    for v, a, b in versions:
        cond, val = (F.col("__" + v) == F.col("__top")), F.struct(F.lit(v).alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        first = F.when((F.col("__top") > 0) & cond, val) if first is None else first.when((F.col("__top") > 0) & cond, val)
    first = F.when(nn >= 0.999, F.struct(F.lit("name_key").alias("v"), F.lit("MAIN").alias("a"), F.lit("MAIN").alias("b"))).otherwise(first)
    p = p.withColumn("__how", first)
    shown = lambda s, which: F.when(F.col(f"__how.{which}") == "DBA", F.col(f"dba_{s}")).when(F.col(f"__how.{which}") == "DIVISION", F.col(f"division_{s}")).otherwise(F.col(f"name_{s}"))
    kind = F.when(F.col("__top") == 0, None).when(nn >= 0.999, "exact").when(F.col("__how.v") == "name_key", "name").when(F.col("__how.v") == "ov", "token_overlap").otherwise("dba")
    p = p.withColumns({
        "name_raw_x": x("name"), "name_raw_y": y("name"), "name_ver_x": F.coalesce("__how.a", F.lit("none")), "name_ver_y": F.coalesce("__how.b", F.lit("none")),
        "name_match_type": kind, "name_sim": F.col("__top"), "__shown_x": shown("x", "a"), "__shown_y": shown("y", "b"),
        **{f"{c}_sim": F.col("__" + c) for c in cols if c != "name_key"},
    }).withColumns({"name_x": F.col("__shown_x"), "name_y": F.col("__shown_y")})
    if name_freq is not None:
        p = p.withColumn("__k", F.upper(y("name_key"))).join(name_freq.select(F.col("name").alias("__k"), F.col("freq").alias("name_freq")), "__k", "left").withColumn("name_freq", F.coalesce("name_freq", F.lit(1)))
    else:
        p = p.withColumn("name_freq", F.lit(None).cast("long"))
    out = p.drop(*[c for c in p.columns if c.startswith("__")])
    return Pairs(out, fields, profile)


def similarity(field: str) -> str:
    """The pair column that holds a field's similarity."""
    return "name_sim" if field == "name" else f"{COMPARED[field]}_sim"
