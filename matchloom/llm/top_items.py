"""Problem 7: the N best items of every group, by simultaneous bisection of an order-preserving code.

A row's code is its score followed by its identifier: level 0 is the score, level 1 and the following are the bytes of
the identifier, CHUNK at a time, negated so that a smaller identifier has a larger code. All groups narrow their own
interval of codes at the same time: the rows in each of BUCKETS parts of the interval are counted (partial sums, so a
group with a third of all rows is counted by all tasks), and the part in which the N-th row lies becomes the next
interval, until the rows at and above a cutoff are exactly N. No group is sorted or brought into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import skew_join
from ..runtime import drop, keep

BUCKETS, CHUNK = 256, 6
FLOOR = -float(1 << (8 * CHUNK))


def id_code(item: Column, level: Column) -> Column:
    """The CHUNK bytes of the identifier at this level as a number from FLOOR to 0; beyond its end 0."""
    part = F.hex(F.encode(item, "utf-8")).substr((level - 1) * (2 * CHUNK) + 1, F.lit(2 * CHUNK))
    return -F.conv(F.rpad(part, 2 * CHUNK, "0"), 16, 10).cast("double")


def bucket(x: Column, lo: Column, hi: Column) -> Column:
    """The part of [lo, hi] that holds x, in the order of x; hi itself has a part of its own, so an interval always splits."""
    share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    inner = F.when(F.isnan(share) | share.isNull(), 0).otherwise(F.least(F.lit(BUCKETS - 2), F.floor(share * (BUCKETS - 1))))
    return F.when(x == hi, BUCKETS - 1).when(lo == F.lit(float("-inf")), F.when(x == lo, 0).otherwise(1)).otherwise(inner).cast("int")


def _counted(rows: DataFrame, state: list[str], code: Column, part: Column) -> DataFrame:
    coded = rows.withColumn("x", code).withColumn("bucket", part)
    return coded.groupBy("g", *state, "bucket").agg(
        F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("i").alias("i_lo"), F.max("i").alias("i_hi")
    )


def _narrowed(counted: DataFrame) -> DataFrame:
    """One row per group: its new interval, how many rows it still needs from it, or its final cutoff.

    The window sees at most BUCKETS rows a group."""
    down = Window.partitionBy("g").orderBy(F.col("bucket").desc())
    above = F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    w = counted.withColumn("above", above).withColumn("last", F.lead("bucket").over(down).isNull()).withColumn("size", F.sum("c").over(Window.partitionBy("g")))
    w = w.where((F.col("above") < F.col("need")) & ((F.col("above") + F.col("c") >= F.col("need")) | F.col("last")))
    w = w.withColumn("need", F.col("need") - F.col("above"))
    stuck = (F.col("lo") == F.col("hi")) & (F.col("level") > 0) & (F.col("i_lo") == F.col("i_hi"))
    done = (F.col("c") <= F.col("need")) | stuck
    deeper = F.col("lo") == F.col("hi")
    at_score = F.when(F.col("level") == 0, F.col("lo")).otherwise(F.col("score"))
    return w.select(
        "g", "size", done.alias("done"), "need", "i_lo", "i_hi",
        F.when(deeper, F.col("level") + 1).otherwise(F.col("level")).alias("level"),
        F.when(deeper | (F.col("level") > 0), at_score).alias("score"),
        F.when(deeper, F.lit(FLOOR)).otherwise(F.col("lo")).alias("lo"),
        F.when(deeper, F.lit(0.0)).otherwise(F.col("hi")).alias("hi"),
        F.when(done, F.when(F.col("level") == 0, F.col("lo")).otherwise(F.col("score"))).alias("cut_score"),
        F.when(done & (F.col("level") > 0), F.col("i_hi")).alias("cut_item"),
    )


def best_scores(pairs: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(g, i, s): the highest score of each pair. Null and NaN scores and null groups or items don't compete."""
    ok = pairs.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), F.col(score).cast("double").alias("s"))
    return ok.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")).groupBy("g", "i").agg(F.max("s").alias("s"))


def top_n(rows: DataFrame, n: int = 3) -> DataFrame:
    """(g, i, s) of the n best rows of each group g: highest s first, on equal s the smaller i as a string.

    rows: (g, i, s), each (g, i) once, s neither null nor NaN (best_scores gives that). Groups with at most n rows come
    out whole; an empty input gives no rows. Identifiers that differ only in NUL bytes at their end count as equal.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    ends = rows.agg(F.min("s"), F.max("s")).first()
    if ends[0] is None:
        return rows.limit(0)
    lo, hi = F.lit(ends[0]), F.lit(ends[1])
    state = ["level", "need", "score"]
    first = rows.withColumn("level", F.lit(0)).withColumn("need", F.lit(n).cast("long")).withColumn("score", F.lit(None).cast("double"))
    step = keep(_narrowed(_counted(first, state, F.col("s"), bucket(F.col("s"), lo, hi))), "bisect")
    # rows above the first interval are taken, rows below it are dropped, rows in it stay in the race
    joined = skew_join(rows, step.select("g", "size", "done", "lo", "hi", "level", "score", "cut_score"), ["g"], "size")
    low, high = F.coalesce("cut_score", "score", "lo"), F.coalesce("score", "hi")
    race = keep(joined.where(F.col("s") >= low).select("g", "i", "s", (F.col("done") | (F.col("s") > high)).alias("taken")), "race")
    cuts, open_rows = [], race.where("not taken").select("g", "i", "s")
    while True:
        left = keep(step.where("not done"), "open")
        drop(step)
        if left.isEmpty():
            break
        j = skew_join(open_rows, left.select("g", "size", *state, "lo", "hi", "i_lo", "i_hi"), ["g"], "size")
        inside = F.when(F.col("level") == 0, (F.col("s") >= F.col("lo")) & (F.col("s") <= F.col("hi"))).otherwise((F.col("s") == F.col("score")) & (F.col("i") >= F.col("i_lo")) & (F.col("i") <= F.col("i_hi")))
        x = F.when(F.col("level") == 0, F.col("s")).otherwise(id_code(F.col("i"), F.col("level")))
        counted = _counted(j.where(inside).withColumnsRenamed({"lo": "from", "hi": "to"}).drop("i_lo", "i_hi"), state, x, bucket(F.col("x"), F.col("from"), F.col("to")))
        step = keep(_narrowed(counted), "bisect")
        cuts.append(keep(step.where("done").select("g", "size", "cut_score", "cut_item"), "cut"))
        drop(left)
    out = race.where("taken").select("g", "i", "s")
    if cuts:
        final = skew_join(open_rows, reduce(DataFrame.unionByName, cuts), ["g"], "size")
        ok = (F.col("s") > F.col("cut_score")) | ((F.col("s") == F.col("cut_score")) & (F.col("cut_item").isNull() | (F.col("i") <= F.col("cut_item"))))
        out = out.unionByName(final.where(ok).select("g", "i", "s"))
    return out


def top_both_ways(pairs: DataFrame, left: str, right: str, score: str, n: int, kinds: tuple[str, str]) -> DataFrame:
    """(group_kind, group_key, item_key): the n best right of each left and the n best left of each right."""
    rows = keep(best_scores(pairs, left, right, score), "pairs")
    there = top_n(rows, n)
    back = top_n(rows.select(F.col("i").alias("g"), F.col("g").alias("i"), "s"), n)
    parts = [df.select(F.lit(kind).alias("group_kind"), F.col("g").alias("group_key"), F.col("i").alias("item_key")) for df, kind in zip((there, back), kinds)]
    return parts[0].unionByName(parts[1])
