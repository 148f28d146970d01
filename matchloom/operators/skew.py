"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are grouped by (key, value) before anything is grouped by key. The first grouping is combined on the map side and
spreads a hot key over as many tasks as it has values; whatever follows works on weighted values. Distinct counts,
modes and percentiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cut points per key of the first percentile step. The cut points of a key are spread over as many parts as a shuffle has.
SPLITS = 64


def value_frequency(df: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    """One row per (keys, value) with its number of rows. Null keys and null values are groups of their own."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))


def key_totals(freq: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    """rows, distinct values and the most frequent value (the smallest on a tie) of each key.

    Null values count as rows and as nothing else; a key with only null values has 0 distinct values and a null mode.
    An empty input gives no rows. All three are combined on the map side, so a hot key never meets in one task.
    """
    best = F.min_by(F.col(value), F.struct((-F.col(count)).alias("c"), F.col(value).alias("v")))
    return freq.groupBy(*keys).agg(
        F.sum(count).alias("n_rows"),
        F.count(value).alias("n_distinct"),
        best.alias("mode_value") if not _nullable(freq, value) else _mode(value, count),
    )


def _nullable(freq: DataFrame, value: str) -> bool:
    return freq.schema[value].nullable


def _mode(value: str, count: str) -> Column:
    present = F.when(F.col(value).isNotNull(), F.struct((-F.col(count)).alias("c"), F.col(value).alias("v")))
    return F.min(present).getField("v").alias("mode_value")


def weighted_percentiles(freq: DataFrame, keys: list[str], value: str, points: dict[str, float], count: str = "n") -> DataFrame:
    """Exact discrete percentiles of each key: the smallest value v with cumulative weight >= p * total.

    Two steps keep hot keys apart. Approximate cut points (a mergeable sketch, SPLITS a key) put the weighted values of a
    key into bins; bin totals, at most SPLITS + 1 a key, tell which bin holds each percentile; only those bins are sorted.
    The result doesn't depend on the sketch's error, which only makes bins uneven. Null values are ignored.
    """
    salts = int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = freq.where(F.col(value).isNotNull()).withColumnRenamed(count, "__w")
    cuts = f.groupBy(*keys).agg(F.percentile_approx(value, [i / SPLITS for i in range(1, SPLITS)], 10_000).alias("__cuts"))
    cuts = cuts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    f = f.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col("f.__salt") == F.col("c.__salt")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    binned = f.alias("f").join(cuts.alias("c"), on).select(
        *[F.col(f"f.{k}").alias(k) for k in keys], F.col(f"f.{value}").alias(value), "__w",
        F.size(F.filter("__cuts", lambda c: c < F.col(f"f.{value}"))).alias("__bin"),
    )
    by_key = Window.partitionBy(*keys).orderBy("__bin")
    bins = binned.groupBy(*keys, "__bin").agg(F.sum("__w").alias("__bw"))
    bins = bins.withColumn("__upto", F.sum("__bw").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    bins = bins.withColumn("__total", F.sum("__bw").over(Window.partitionBy(*keys)))
    want = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in points.items()])
    bins = bins.withColumn("__want", F.explode(want)).withColumn("__rank", F.greatest(F.lit(1), F.ceil(F.col("__want.p") * F.col("__total"))))
    hit = bins.where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__bw") < F.col("__rank")))
    hit = hit.select(*keys, "__bin", F.col("__want.name").alias("__name"), (F.col("__rank") - F.col("__upto") + F.col("__bw")).alias("__need"))
    targets = hit.groupBy(*keys, "__bin").agg(F.collect_list(F.struct("__name", "__need")).alias("__hits"))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col("b.__bin") == F.col("t.__bin")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    inside = binned.alias("b").join(targets.alias("t"), on).select(*[F.col(f"b.{k}").alias(k) for k in keys], "b.__bin", f"b.{value}", "__w", "__hits")
    in_bin = Window.partitionBy(*keys, "__bin").orderBy(value)
    inside = inside.withColumn("__cum", F.sum("__w").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("__hit", F.explode("__hits")).where((F.col("__cum") >= F.col("__hit.__need")) & (F.col("__cum") - F.col("__w") < F.col("__hit.__need")))
    return inside.groupBy(*keys).agg(*[F.max(F.when(F.col("__hit.__name") == name, F.col(value))).alias(name) for name in points])


def state_of(raw: Column) -> Column:
    """A state field as it is compared: dots removed, outer blanks trimmed, upper case."""
    return F.upper(F.trim(F.replace(raw, F.lit("."))))


def hot_states(tables: dict[str, tuple[DataFrame, str]], state_codes: DataFrame, min_share: float = 0.08) -> DataFrame:
    """(table_name, state_code) of the states that hold at least min_share of all rows of a table.

    tables: name -> (DataFrame, state field). Fields are compressed to (table, spelling, rows) first, so each spelling is
    normalized once and the largest state costs no more than the smallest. Null, blank and unknown spellings belong to no
    state but count among the rows. state_codes is the fixed list of states (51 rows): it is broadcast.
    """
    freq = None
    for name, (df, field) in tables.items():
        one = value_frequency(df.select(F.lit(name).alias("table_name"), F.col(field).alias("raw")), ["table_name"], "raw")
        freq = one if freq is None else freq.unionByName(one)
    codes = state_codes.select(F.upper("state_code").alias("state_code"), F.explode(F.array(F.upper("state_code"), F.upper("state_name"))).alias("__spelling")).distinct()
    named = freq.join(F.broadcast(codes), state_of(F.col("raw")) == F.col("__spelling"), "left")
    per_state = named.groupBy("table_name", "state_code").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("table_name"))  # at most one row a state and table here
    return per_state.withColumn("__all", total).where(F.col("state_code").isNotNull() & (F.col("n") >= F.lit(min_share) * F.col("__all"))).select("table_name", "state_code")


#: Keys with more than 1/HOT of all rows are hot: fewer than HOT of them can exist, whatever the data.
HOT = 10_000


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """big inner-joined with small on keys; a key may hold a third of big's rows.

    small has one row per key; weight is how many rows of big (or more) have it. Rows of small with more than 1/HOT of
    the total weight, fewer than HOT by counting, are broadcast; all other keys are shuffled, none of them with more than
    1/HOT of the rows. weight itself isn't returned.
    """
    limit = small.agg((F.sum(weight) / HOT).alias("__limit"))
    tagged = small.join(F.broadcast(limit)).withColumn("__hot", F.col(weight) > F.col("__limit")).drop("__limit", weight)
    hot, cold = tagged.where("__hot").drop("__hot"), tagged.where("not __hot").drop("__hot")
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return big.join(F.broadcast(hot), keys).unionByName(rest)
