"""Problem 4: how distinctive a term is for its record, by positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from .terms import terms


def ppmi(records: DataFrame, keys: list[str], text: str, exponent: float = 0.75, presence: bool = False, weight: str | None = None) -> DataFrame:
    """(keys, term, tf, n_records, ppmi) of every term of every record.

    PMI(t, r) = ln(#(t, r) * S / (#(t) * #(r)^a)), S the sum of #(r)^a over the records and a the smoothing exponent of
    the context (record) counts; negative values become 0. With presence a term counts once in a record; with presence
    and a = 0, PPMI is ln(n / d), the inverse record frequency. weight: a column with the number of equal records a row
    stands for (1 if not given). Null texts are no records; a text without terms is a record without terms. Empty input
    gives no rows. keys tell records apart.
    """
    own = records.where(F.col(text).isNotNull()).select(*keys, F.col(weight).cast("long").alias("__m") if weight else F.lit(1).cast("long").alias("__m"), terms(F.col(text)).alias("__t"))
    size = F.size(F.array_distinct("__t")) if presence else F.size("__t")
    own = own.withColumn("__r", F.pow(size.cast("double"), F.lit(float(exponent))))
    s = own.agg(F.sum(F.col("__m") * F.col("__r")).alias("__s"))
    each = F.transform(F.array_distinct("__t"), lambda t: F.struct(t.alias("term"), F.size(F.filter("__t", lambda x: x == t)).alias("tf")))
    pairs = own.select(*keys, "__m", "__r", F.explode(each).alias("__e")).select(*keys, "__m", "__r", F.col("__e.term").alias("term"), F.col("__e.tf").cast("long").alias("tf"))
    joint = F.lit(1).cast("long") if presence else F.col("tf")
    margins = pairs.groupBy("term").agg(F.sum(joint * F.col("__m")).alias("__c"), F.sum("__m").alias("n_records"), F.count(F.lit(1)).alias("__pairs"))
    value = F.log(joint * F.col("__s") / (F.col("__c") * F.col("__r")))
    return skew_join(pairs.drop("__m"), margins, ["term"], "__pairs").join(F.broadcast(s)).select(*keys, "term", "tf", "n_records", F.greatest(F.lit(0.0), value).alias("ppmi"))  # one row is broadcast


def top_term(sides: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(side, row_id, term): the term with the highest tf * PPMI of each record over the names of all sides together.

    sides: side -> (DataFrame, id column, name column). PPMI is taken with presence counts and exponent 0, where it is
    ln(n / d). Terms of one record only don't compete; equal weights go to the first term by code point. Equal names are
    weighed once and joined back to their rows.
    """
    rows = None
    for side, (df, row_id, text) in sides.items():
        one = df.where(F.col(text).isNotNull()).select(F.lit(side).alias("side"), F.col(row_id).cast("long").alias("row_id"), F.upper(text).alias("name"))
        rows = one if rows is None else rows.unionByName(one)
    # 128 hashed bits stand for the name in what is shuffled by term
    rows = rows.withColumn("h1", F.xxhash64("name")).withColumn("h2", F.xxhash64(F.lit(2), "name"))
    names = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.first("name").alias("name"))
    scored = ppmi(names, ["h1", "h2"], "name", exponent=0.0, presence=True, weight="m").where(F.col("n_records") > 1)
    best = scored.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("tf") * F.col("ppmi")).alias("w"), F.col("term").alias("term"))).getField("term").alias("term"))
    return rows.select("side", "row_id", "h1", "h2").join(best, ["h1", "h2"]).select("side", "row_id", "term")
