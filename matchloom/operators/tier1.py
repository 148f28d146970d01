"""A first, cheap screen of queries against an index of names, and the selection of one counterpart each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop, keep
from .block import coded, held, meet, units
from .stats import telling


def index(reference: DataFrame) -> DataFrame:
    """(state, token, rid, ein): the telling tokens of the reference's names; records without a state are left out."""
    r = reference.where(F.coalesce("state", F.lit("")) != "")
    return r.select("state", F.explode(F.array_distinct(telling(F.col("name_key")))).alias("token"), "rid", "ein")


def screen(queries: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, ein, share): the entries that have at least this share of a query name's telling tokens in its state, and the largest
    share. A query may have several names; null, blank and stopword names have no entry. Pairs aren't shuffled: each is made
    under its rarest shared token."""
    told = keep(queries.select("id", "state", F.array_distinct(telling(F.col("name_key"))).alias("told")), "query-tokens")
    names = keep(names, "names")
    q = held(told, "id", ["state"], F.col("told"), True)
    r = names.select(F.col("ein").alias("u"), F.col("state").alias("k0"), "token", F.lit(1).cast("long").alias("m"), F.col("rid").cast("string").alias("form"), F.lit(None).cast("int").alias("size"))
    codes = coded(q, r, names.groupBy("token").agg(F.count(F.lit(1)).alias("df")), ["k0"])
    x = units(q, codes, ["k0"], {"n": F.col("size")}, F.lit(1.0), least * F.col("size") - 1e-9)
    y = units(r, codes, ["k0"], {}, None, None)
    several = F.when(F.size("forms") > 1, F.col("forms")).alias("forms")
    x = x.select("u", "pre", "codes", F.array_min(F.transform("forms", lambda f: f[0]["n"])).alias("n"), several)
    found = meet(x, y.select("u", "pre", "codes", several))
    # one name a side is the rule: its share is one intersection; for several, that of all their tokens is a bound
    bound = F.size(F.array_intersect("x_codes", "y_codes")) / F.col("x_n")
    numbers = lambda f: F.transform(f, lambda i: i["code"])
    xs = F.coalesce("x_forms", F.array(F.transform("x_codes", lambda c: F.struct(c.alias("code"), F.col("x_n").alias("n")))))
    ys = F.coalesce("y_forms", F.array(F.transform("y_codes", lambda c: F.struct(c.alias("code")))))
    best = F.array_max(F.flatten(F.transform(xs, lambda f: F.transform(ys, lambda s: F.size(F.array_intersect(numbers(f), numbers(s))) / f[0]["n"]))))
    share = F.when(bound < least, None).when(F.col("x_forms").isNull() & F.col("y_forms").isNull(), bound).otherwise(best)
    return found.select(F.col("x_u").alias("id"), F.col("y_u").alias("ein"), share.alias("share")).where(F.col("share") >= least)


def one_to_one(pairs: DataFrame) -> DataFrame:
    """(id, ein, score): a selection in which no id and no ein occurs twice: the best pair of all is taken, its id and ein are out, and
    so on. Order: score, then a hash of the pair.

    In each round every pair that is the best of both its id and its ein is taken at once, which gives the same pairs as
    one by one; maxima are combined on the map side. Null and NaN scores don't take part; repeated pairs count once, by
    their best score.
    """
    left = keep(pairs.where("score is not null and not isnan(score)").groupBy("id", "ein").agg(F.max("score").alias("score")), "open-pairs")
    rank = F.struct("score", F.xxhash64("id", "ein").alias("h"), "id", "ein")
    taken = None
    while not left.isEmpty():
        best = [left.groupBy(k).agg(F.max(rank).alias(f"best_{k}")) for k in ("id", "ein")]
        top = left.join(best[0], "id").join(best[1], "ein").where((F.col("best_id") == rank) & (F.col("best_ein") == rank)).select("id", "ein", "score")
        top = keep(top, "taken")
        taken = top if taken is None else taken.unionByName(top)
        rest = keep(left.join(top.select("id"), "id", "left_anti").join(top.select("ein"), "ein", "left_anti"), "open-pairs")
        drop(left)
        left = rest
    return taken if taken is not None else left
