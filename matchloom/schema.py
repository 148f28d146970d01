"""Canonical records: any table is projected to the same fields by a map of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import FIELDS

SAM_MAP = {
    "id": "unique_entity_id", "name": "legal_business_name", "dba": "dba_name", "division": "entity_division_name", "street": "physical_address_line_1",
    "unit": "physical_address_line_2", "city": "physical_address_city", "state": "physical_address_province_or_state", "zip5": "physical_address_zip_postal_code",
}


def bmf_map(active: str | None = None) -> dict[str, str]:
    m = {"ein": "ein", "name": "org_name_join", "dba": "dba_name", "street": "org_addr_street", "city": "org_addr_city", "state": "org_addr_state", "zip5": "org_addr_zip5", "zip_plus4": "org_addr_zip4"}
    return m | ({"active": active} if active else {})


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonical(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """FIELDS of df by a map canonical -> own column; a mapped column that is missing is an error, an unmapped field null.
    Blanks are squeezed; ids become strings."""
    missing = sorted(set(names.values()) - set(df.columns))
    if missing:
        raise ValueError(f"mapped columns are missing: {', '.join(missing)}")
    return df.select(*[squish(F.col(f"`{names[f]}`").cast("string")).alias(f) if f in names else F.lit(None).cast("string").alias(f) for f in FIELDS])


def truth(c: Column) -> Column:
    return F.upper(F.trim(c)).isin("TRUE", "T", "1", "Y", "YES", "ACTIVE")


def query(df: DataFrame, names: dict[str, str] = SAM_MAP) -> DataFrame:
    """Canonical queries. Without a mapped id every row gets one of its own, which stays the same only for the same input."""
    out = canonical(df, names)
    return out if "id" in names else out.withColumn("id", F.monotonically_increasing_id().cast("string"))


def reference(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Canonical reference entries; rid is a surrogate, since an ein may repeat. active becomes a boolean, null where unknown."""
    names = names or bmf_map()
    if "ein" not in names:
        raise ValueError("a reference must map an entity key to ein")
    out = canonical(df, names).withColumn("active", truth(F.col("active")))
    return out.withColumn("rid", F.xxhash64(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in FIELDS])).dropDuplicates(["rid"])


def flag_active(ref: DataFrame, active: DataFrame, key: str = "ein") -> DataFrame:
    """active = whether the entry's ein is among the keys of active; one join, no list on the driver."""
    keys = active.select(F.col(key).cast("string").alias("ein")).distinct().withColumn("__in", F.lit(True))
    return ref.drop("active").join(keys, "ein", "left").withColumn("active", F.coalesce("__in", F.lit(False))).drop("__in")
