"""Candidate pairs (id, rid) of queries and reference entries: equi joins on exact keys or on shared tokens."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import STOPWORDS
from ..runtime import keep
from .stats import telling


def _keyed(df: DataFrame, row: str, cols: list[str]) -> DataFrame:
    """Rows with all key columns present and not blank, as k0, k1, ..."""
    valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in cols], F.lit(True))
    return df.where(valid).select(row, *[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])


def exact(queries: DataFrame, reference: DataFrame, by_x: list[str], by_y: list[str] | None = None) -> DataFrame:
    """Pairs with equal keys; by_y names the reference's columns where they differ. A null or blank part makes no pair."""
    q, r = _keyed(queries, "id", by_x), _keyed(reference, "rid", by_y or by_x)
    return q.join(r, [f"k{i}" for i in range(len(by_x))]).select("id", "rid").distinct()


def told_of(column: str, min_len: int, stopwords: list[str], concat: bool) -> Column:
    told = telling(F.col(column), min_len, stopwords)
    if concat:
        pairs = F.when(F.size(told) > 1, F.zip_with(F.slice(told, F.lit(1), F.size(told) - 1), F.slice(told, F.lit(2), F.size(told) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
        told = F.concat(told, pairs)
    return told


def held(df: DataFrame, unit: str, by: list[str], told: Column, apart: bool) -> DataFrame:
    """(u, k0, ..., token, m, form, size): how often each form of a unit holds a token. Rows of a unit are forms of their
    own if apart, else they add up to one."""
    keys = [f"k{i}" for i in range(len(by))]
    valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in by], F.lit(True))
    rows = df.where(valid).select(F.col(unit).alias("u"), *[F.col(c).alias(k) for c, k in zip(by, keys)], F.array_sort(told).alias("told"))
    if not apart:
        return rows.select("u", *keys, F.explode("told").alias("token")).groupBy("u", *keys, "token").agg(F.count(F.lit(1)).alias("m")).withColumns({"form": F.lit(0), "size": F.lit(None).cast("int")})
    # numbered instead of named: the forms of a unit are few, and their rows many
    rows = rows.groupBy("u").agg(F.array_sort(F.collect_set(F.struct(*keys, "told"))).alias("forms")).select("u", F.posexplode("forms").alias("form", "f"))
    rows = rows.select("u", "form", *[F.col(f"f.{k}").alias(k) for k in keys], F.col("f.told").alias("told"), F.array_distinct("f.told").alias("each"))
    rows = rows.select("u", *keys, "told", "form", F.size("each").alias("size"), F.explode("each").alias("token"))
    return rows.select("u", *keys, "token", F.size(F.filter("told", lambda t: t == F.col("token"))).cast("long").alias("m"), "form", "size")


def coded(q: DataFrame, r: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, df, code, q_most, r_most): a number for each key and token that both sides hold, the rarest first, and
    how often one form of a side holds it at most. It is a kept table: its numbers stay the same however often it is read."""
    both = r.groupBy(*keys, "token").agg(F.max("m").alias("r_most")).join(q.groupBy(*keys, "token").agg(F.max("m").alias("q_most")), [*keys, "token"]).join(df, "token")
    return keep(both.orderBy("df", "token", *keys).withColumn("code", F.monotonically_increasing_id()), "token-codes")


def units(held: DataFrame, codes: DataFrame, keys: list[str], item: dict[str, Column], rest: Column | None, enough: Column | None) -> DataFrame:
    """(u, pre, codes, forms): each unit with its forms, arrays of items in the order of codes, all their codes and the codes
    under which it must be looked up. rest is what an item can add to a pair at most and enough what a pair needs: once all
    that is left of a form is too little, its later codes needn't be looked up. A form with too little in all is left out."""
    order = Window.partitionBy("u", "form").orderBy(F.col("code").desc())
    x = held.join(codes, [*keys, "token"]).select("u", "form", "size", "code", F.struct("code", *[c.alias(n) for n, c in item.items()]).alias("item"), *([rest.alias("rest")] if rest is not None else []))
    x = x.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u")
    if rest is not None:
        x = x.withColumn("left", F.sum("rest").over(order)).withColumn("look", F.when(F.col("left") >= enough, F.col("code")))
    else:
        x = x.withColumn("look", F.col("code"))
    forms = x.groupBy("u", "form").agg(F.array_sort(F.collect_list("item")).alias("items"), F.collect_list("look").alias("look")).where(F.size("look") > 0)
    one = forms.groupBy("u").agg(F.array_distinct(F.collect_list("items")).alias("forms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("look")))).alias("pre"))
    return one.select("u", "pre", F.array_sort(F.array_distinct(F.flatten(F.transform("forms", lambda f: F.transform(f, lambda i: i["code"]))))).alias("codes"), "forms")


def meet(x: DataFrame, y: DataFrame) -> DataFrame:
    """Each pair of units that have a code to be looked up in common, once: where they meet under the first of those.

    Nothing is shuffled by pair, as many as those may be: only the units are, once for each code that they are looked up under."""
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # units are few bytes and their pairs many: partitions must not be merged by the units' size
    sides = [df.select(F.explode("pre").alias("code"), *[F.col(c).alias(f"{s}_{c}") for c in df.columns]).repartition(parts, "code") for df, s in ((x, "x"), (y, "y"))]
    return sides[0].join(sides[1], "code").where(F.element_at(F.array_intersect("x_pre", "y_pre"), 1) == F.col("code"))


def by_tokens(queries: DataFrame, reference: DataFrame, by: list[str] | None = None, column: str = "name_key", stopwords: list[str] = STOPWORDS, min_len: int = 2,
              max_ref_freq: int | None = None, min_pair_idf: float | None = None, concat: bool = False, unit: str = "rid", apart: bool = False) -> DataFrame:
    """Pairs that share a telling token, within equal keys by if given.

    max_ref_freq leaves out tokens that more reference records hold; it bounds the fan-out of each token. min_pair_idf
    keeps pairs whose shared tokens' idf adds up to at least that, or to ln(N) where that is less; a token that is
    repeated in a name counts as often as it is. concat adds the adjacent tokens of a name written together. Pairs are of
    id and unit, a column of the reference. Where an id or a unit has several rows, their tokens add up, or, if apart, one
    row of each must do. Pairs come out once and are never shuffled: a pair is made where its rarest shared token is.
    """
    by = by or []
    keys = [f"k{i}" for i in range(len(by))]
    told = told_of(column, min_len, stopwords, concat)
    queries = keep(queries.select("id", *by, told.alias("told")), "query-tokens")
    ref = keep(reference.select(*dict.fromkeys(["rid", unit, *by]), told.alias("told")), "reference-tokens")
    # a record counts once for a token, with or without a valid key
    df = ref.select("rid", F.explode("told").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    if max_ref_freq is not None:
        df = df.where(F.col("df") <= max_ref_freq)
    q, r = held(queries, "id", by, F.col("told"), apart), held(ref, unit, by, F.col("told"), apart)
    codes = coded(q, r, df, keys)
    if min_pair_idf is None:
        found = meet(*[units(side, codes, keys, {}, None, None).select("u", "pre") for side in (q, r)])
        return found.select(F.col("x_u").alias("id"), F.col("y_u").alias(unit))
    n = ref.count()
    bar = min(float(min_pair_idf), math.log(max(n, 2))) - 1e-9
    idf, low = F.log(F.lit(float(n)) / F.col("df")), F.lit(bar - 1e-6)
    x = units(q, codes, keys, {"w": F.col("m") * idf}, F.col("m") * F.col("r_most") * idf, low)
    y = units(r, codes, keys, {"m": F.col("m")}, F.col("m") * F.col("q_most") * idf, low)
    # one form a side without repeats is the rule: its weight is one sum; the others get the same sum as a bound first
    x = x.select("u", "pre", F.when(F.size("forms") == 1, F.element_at("forms", 1)).otherwise(F.flatten("forms")).alias("items"), F.when(F.size("forms") > 1, F.col("forms")).alias("forms"))
    most = F.array_max(F.transform(F.flatten("forms"), lambda i: i["m"]))
    y = y.select("u", "pre", "codes", most.alias("most"), F.when((F.size("forms") > 1) | (most > 1), F.col("forms")).alias("forms"))
    found = meet(x, y)
    total = F.aggregate("x_items", F.lit(0.0), lambda a, i: a + F.when(F.array_contains("y_codes", i["code"]), i["w"]).otherwise(0.0))
    times = lambda s, c: F.aggregate(s, F.lit(0).cast("long"), lambda a, i: a + F.when(i["code"] == c, i["m"]).otherwise(F.lit(0).cast("long")))
    weight = lambda f, s: F.aggregate(f, F.lit(0.0), lambda a, i: a + i["w"] * times(s, i["code"]))
    xs, ys = F.coalesce("x_forms", F.array("x_items")), F.coalesce("y_forms", F.array(F.transform("y_codes", lambda c: F.struct(c.alias("code"), F.lit(1).cast("long").alias("m")))))
    exact = F.exists(xs, lambda f: F.exists(ys, lambda s: weight(f, s) >= bar))
    plain = F.col("x_forms").isNull() & F.col("y_forms").isNull()
    found = found.where(F.when(total * F.col("y_most") < bar, False).when(plain, True).otherwise(exact))
    return found.select(F.col("x_u").alias("id"), F.col("y_u").alias(unit))


def union(*blocks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, blocks).select("id", "rid").distinct()
