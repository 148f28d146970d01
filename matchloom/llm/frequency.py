"""Problem 3: how often every term occurs and in how many records, kept by incremental signed deltas.

The counts live in a table partitioned by a hash of the term. A change set never reads the collection again: only added,
changed and deleted records are turned into signed per-term changes, and those are merged into the parts of the table
they fall into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop, keep, new_path
from .terms import terms

PARTS = 64
SCHEMA = "term string, occurrences long, records long, part int"


def empty_counts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def signed_changes(records: DataFrame, text: str, sign: int) -> DataFrame:
    """Per-term changes of occurrences and record counts for records that come (sign 1) or go (sign -1).

    Terms of a record are counted inside its row; only (term, count) pairs are shuffled, after a map-side sum, so the
    commonest term costs one row per task. The number of records with a non-null text is the change of the null term.
    Null texts change nothing; a blank text counts as a record without terms.
    """
    own = records.where(F.col(text).isNotNull()).select(terms(F.col(text)).alias("__t"))
    each = own.select(F.explode(F.transform(F.array_distinct("__t"), lambda t: F.struct(t.alias("term"), F.size(F.filter("__t", lambda x: x == t)).alias("k")))).alias("__e"))
    per_term = each.groupBy(F.col("__e.term").alias("term")).agg((F.lit(sign) * F.sum("__e.k")).alias("occurrences"), (F.lit(sign) * F.count(F.lit(1))).alias("records"))
    whole = own.agg((F.lit(sign) * F.count(F.lit(1))).alias("records")).select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("occurrences"), "records")
    return per_term.unionByName(whole)


def merge_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """counts plus signed changes; terms whose records come to 0 leave the table."""
    both = counts.select("term", "occurrences", "records").unionByName(changes.select("term", "occurrences", "records"))
    out = both.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return out.where(F.col("records") != 0).withColumn("part", _part())


def _part():
    return F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")


def change_set(text: str, added: DataFrame | None = None, deleted: DataFrame | None = None, changed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame | None:
    """The signed changes of a change set as one row a term; None without any. changed: (the records as they were, as they are).
    Extra columns don't matter; a term that as many records lose as gain and as often is no change."""
    signed = [signed_changes(df, text, sign) for df, sign in ((added, 1), (deleted, -1), *(zip(changed, (-1, 1)) if changed else ())) if df is not None]
    if not signed:
        return None
    both = reduce(DataFrame.unionByName, signed).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return both.where("occurrences != 0 or records != 0").withColumn("part", _part())


class CountTable:
    """Counts that stay at a path of the shared storage, as a Parquet table split by part.

    A change set reads and writes only the parts that its terms fall into: the merged parts are written beside the table
    and then replace theirs by dynamic partition overwrite, so that an executor lost on the way costs only its tasks. The
    table of an empty collection has no parts.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self._exists() else empty_counts(self.spark)

    def apply(self, text: str, added: DataFrame | None = None, deleted: DataFrame | None = None, changed: tuple[DataFrame, DataFrame] | None = None) -> None:
        delta = change_set(text, added, deleted, changed)
        if delta is None:
            return
        delta = keep(delta, "term-changes")
        parts = [r["part"] for r in delta.select("part").distinct().collect()]  # at most PARTS
        if not parts:
            return
        merged = keep(merge_counts(self.read().where(F.col("part").isin(parts)), delta).repartition("part"), "term-parts")
        # a part that lost all its terms has no rows to replace it: it is removed
        left = {r["part"] for r in merged.select("part").distinct().collect()}
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        for part in set(parts) - left:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={part}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        drop(delta, merged)


def marked(counts: DataFrame, common_share: float = 0.02, rare_at_most: int = 2) -> DataFrame:
    """term, occurrences, records, mark: 'common' from common_share of the records on, else 'rare' up to rare_at_most
    occurrences, else null. An empty collection has no terms."""
    n = counts.where(F.col("term").isNull()).agg(F.max("records").alias("__n"))
    mark = F.when(F.col("records") >= F.lit(common_share) * F.col("__n"), "common").when(F.col("occurrences") <= rare_at_most, "rare")
    return counts.where(F.col("term").isNotNull()).join(F.broadcast(n)).select("term", "occurrences", "records", mark.alias("mark"))  # one row is broadcast


def counted_by_vintage(df: DataFrame, text: str, version: str) -> DataFrame:
    """Counts over all rows, taken as they came: the rows before the newest version first, then the newest as a change set."""
    newest = df.agg(F.max(version).alias("__v"))
    tagged = df.select(text, version).join(F.broadcast(newest)).withColumn("__new", F.coalesce(F.col(version) == F.col("__v"), F.lit(False)))  # one row is broadcast
    counts = CountTable(df.sparkSession, new_path(df.sparkSession, "term-counts"))
    counts.apply(text, added=tagged.where(~F.col("__new")))
    counts.apply(text, added=tagged.where("__new"))
    return counts.read()
