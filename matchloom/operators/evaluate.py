"""Quality of scores against labels. Everything is counted per distinct score first, so ties cost nothing and the window
that accumulates runs over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_label(c: Column, kind: str = "string") -> Column:
    """1 or 0 of a label given as boolean, number or text; null stays null."""
    if kind == "boolean":
        return c.cast("int")
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return F.when(c.isNotNull(), (c != 0).cast("int"))
    return F.when(c.isNotNull(), F.upper(F.trim(c)).isin("1", "TRUE", "T", "YES", "MATCH").cast("int"))


def labelled(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(s, n, p) per distinct score: rows and positives; null scores and labels are left out."""
    kind = dict(df.dtypes)[label]
    d = df.select(F.col(score).cast("double").alias("s"), as_label(F.col(label), kind).alias("y")).where("s is not null and y is not null")
    return d.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))


#: Ranges into which distinct scores are divided; only their totals, one row each, meet in one task.
RANGES = 256


def accumulated(per: DataFrame) -> DataFrame:
    """per (s, n, p) with n_upto and p_upto, the sums over all scores up to s, itself included, and all_n and all_p. Scores are put
    in ranges of nearly equal numbers; sums within a range and totals of the ranges before it add up."""
    marks = per.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)]).alias("__marks"), F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    own = per.join(F.broadcast(marks)).withColumn("__b", F.size(F.filter("__marks", lambda m: m < F.col("s")))).drop("__marks")  # one row is broadcast
    totals = own.groupBy("__b").agg(F.sum("n").alias("__n"), F.sum("p").alias("__p"))  # at most RANGES rows
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__n", "__p")])
    inside = Window.partitionBy("__b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({"__nu": F.sum("n").over(inside), "__pu": F.sum("p").over(inside)}).join(F.broadcast(totals), "__b")
    return out.select("s", "n", "p", (F.col("__nu") + F.col("__n0")).alias("n_upto"), (F.col("__pu") + F.col("__p0")).alias("p_upto"), "all_n", "all_p")


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: auc by average ranks (Mann-Whitney); null if a class is missing."""
    ranks = accumulated(labelled(df, score, label)).withColumn("r", F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2)
    t = ranks.agg(F.sum(F.col("r") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return t.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def evaluate(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """One row: n, n_pos, auc, precision, recall, f1, accuracy at a threshold (score >= threshold counts as match)."""
    per = labelled(df, score, label)
    yes = F.col("s") >= threshold
    t = per.agg(F.sum("n").alias("n"), F.sum("p").alias("n_pos"), F.sum(F.when(yes, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(yes, F.col("n") - F.col("p")).otherwise(0)).alias("fp"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "n_pos")
    right = F.col("n") - F.col("n_pos") - F.col("fp") + F.col("tp")
    out = t.select("n", "n_pos", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), F.try_divide(right, F.col("n")).alias("accuracy"))
    return out.join(F.broadcast(auc(df, score, label)))  # one row each


def tune_thresholds(df: DataFrame, target_precision: float = 0.98, min_recall: float = 0.95, score: str = "score", label: str = "label") -> DataFrame:
    """One row (yes, maybe): the lowest score whose precision reaches the target (just above the highest if none does), and
    the highest one whose recall reaches the minimum, but not above yes."""
    c = accumulated(labelled(df, score, label))
    c = c.select("s", (F.col("all_p") - F.col("p_upto") + F.col("p")).alias("tp"), (F.col("all_n") - F.col("n_upto") + F.col("n")).alias("k"), F.col("all_p").alias("all"))
    t = c.agg(F.min(F.when(F.col("tp") >= target_precision * F.col("k"), F.col("s"))).alias("a"), F.max("s").alias("top"), F.max(F.when(F.col("tp") >= min_recall * F.col("all"), F.col("s"))).alias("b"))
    yes = F.coalesce("a", F.col("top") + 1e-6)
    return t.select(yes.alias("yes"), F.least(F.coalesce("b", yes), yes).alias("maybe"))
