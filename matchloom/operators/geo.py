"""Optional cleaning of places and joins with crosswalks by postal code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.constants import CITY_ALIASES


def pad5(c: Column) -> Column:
    return X.pad_left(X.digits(c), 5)


def clean_city(city: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper case, ST, STE, FT and MT at the start written out, popular names replaced."""
    c = F.upper(X.squish(city))
    for short, long in (("ST", "SAINT"), ("STE", "SAINTE"), ("FT", "FORT"), ("MT", "MOUNT")):
        c = F.regexp_replace(c, f"^{short} ", f"{long} ")
    return F.coalesce(X.lookup(CITY_ALIASES if aliases is None else aliases, c), c)


def refine_city(df: DataFrame, zip_ref: DataFrame, max_dist: int = 2) -> DataFrame:
    """city by the postal code's own: filled where missing, replaced where it is within max_dist edits. zip_ref has zip5 and
    city (or major_city, primary_city, po_name); its first city by name counts."""
    col = next((c for c in ("city", "major_city", "primary_city", "po_name") if c in zip_ref.columns), None)
    if col is None or "zip5" not in zip_ref.columns:
        return df
    ref = zip_ref.select(pad5(F.col("zip5")).alias("zip5"), F.upper(col).alias("__ref")).where("__ref != ''").groupBy("zip5").agg(F.min("__ref").alias("__ref"))
    own = F.upper("city")
    out = df.join(ref, "zip5", "left")
    better = F.when(F.col("__ref").isNull(), own).when(own.isNull() | (own == ""), F.col("__ref")).when(F.levenshtein(own, F.col("__ref"), max_dist) >= 0, F.col("__ref")).otherwise(own)
    return out.withColumn("city", better).drop("__ref")


def clean_geo(df: DataFrame, engine: str = "rules", aliases: dict[str, str] | None = None, zip_ref: DataFrame | None = None, max_dist: int = 2) -> DataFrame:
    """city and state in one spelling; with zip_ref also refined by postal code. Only the engine 'rules' is there."""
    if engine != "rules":
        raise NotImplementedError("only the engine 'rules' is there: others need dictionaries that aren't public here")
    out = df
    if "state" in df.columns:
        out = out.withColumn("state", X.state_code(F.col("state")))
    if "city" in df.columns:
        out = out.withColumn("city", clean_city(F.col("city"), aliases))
    return refine_city(out, zip_ref, max_dist) if zip_ref is not None and {"city", "zip5"} <= set(df.columns) else out


def augment_geo(df: DataFrame, crosswalk: DataFrame, by: str = "zip5", cols: list[str] | None = None) -> DataFrame:
    """Left join of crosswalk columns by postal code; of repeated codes the smallest row counts. Columns of the same name
    are replaced."""
    for name, d in (("data", df), ("crosswalk", crosswalk)):
        if by not in d.columns:
            raise ValueError(f"{name} has no column {by!r}")
    cols = cols or [c for c in crosswalk.columns if c != by]
    one = crosswalk.select(X.pad_left(F.col(by).cast("string"), 5).alias(by), F.struct(*cols).alias("__c")).groupBy(by).agg(F.min("__c").alias("__c"))
    return df.drop(*[c for c in cols if c != by]).join(one, by, "left").select("*", *[F.col(f"__c.{c}").alias(c) for c in cols]).drop("__c")


def ruca_urban(c: Column, urban_max: int = 3) -> Column:
    n = F.floor(c.try_cast("double"))
    return F.when(n <= urban_max, "urban").when(n.isNotNull(), "rural")


def _found(df: DataFrame, names: tuple[str, ...], what: str) -> str:
    col = next((c for c in names if c in df.columns), None)
    if col is None:
        raise ValueError(f"no {what} column found")
    return col


def load_hud(df: DataFrame, ratio: str = "tot") -> DataFrame:
    """(zip5, geography): of each postal code the one with the largest share; on equal shares the smallest geography."""
    low = df.toDF(*[c.lower() for c in df.columns])
    code = _found(low, ("zip", "zip_code", "zipcode"), "postal code")
    geo = next((c for c in low.columns if c != code and not c.endswith("_ratio")), None)
    if geo is None:
        raise ValueError("no geography column found")
    share = F.coalesce(F.col(f"{ratio}_ratio").try_cast("double"), F.lit(-1.0)) if f"{ratio}_ratio" in low.columns else F.lit(1.0)
    return low.select(pad5(F.col(code)).alias("zip5"), F.col(geo), share.alias("__s")).groupBy("zip5").agg(F.min_by(geo, F.struct(-F.col("__s"), F.col(geo))).alias(geo))


def load_ruca(df: DataFrame) -> DataFrame:
    """(zip5, ruca): one number per postal code, the smallest of repeated ones."""
    low = df.toDF(*[c.lower() for c in df.columns])
    code, ruca = _found(low, ("zip_code", "zipa", "zip", "zipcode"), "postal code"), _found(low, ("ruca1", "ruca", "primary_ruca"), "RUCA")
    return low.groupBy(pad5(F.col(code)).alias("zip5")).agg(F.min(F.col(ruca).try_cast("double")).alias("ruca"))


def load_zipcode_db(df: DataFrame, cols: tuple[str, ...] = ("county", "state", "major_city"), code: str = "zipcode") -> DataFrame:
    """(zip5, cols) of a table of postal codes."""
    return df.select(pad5(F.col(code)).alias("zip5"), *[c for c in cols if c in df.columns])
