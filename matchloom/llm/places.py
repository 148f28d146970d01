"""Problem 2: address records that denote the same place, by a deletion-neighbourhood index and component assignment.

Records are taken apart and counted by their form; everything fuzzy runs on distinct forms. House and box numbers must be
equal (a hard veto: the number is in every block's key). A form is in the blocks of its number in the town of its postal
code, in its own town and in that town's neighbours (towns that share a code with it, and its best supported spelling).
Inside a block, street names that share a string with one letter deleted are neighbours; each is assigned to its best
supported neighbour, so pairs are never listed and a block of many records costs no more than its distinct names. What is
found is followed to a fixpoint over all blocks. Localities, then direction and type, are assigned to components in the same way; where both are given and
differ, the places differ.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import drop, keep
from .addresses import state, street, town, zip5

FORM = ["kind", "num", "core", "dir", "type", "zip", "town", "state"]
_PARTS = "struct<kind string, num string, core string, dir string, type string, unit string, zip string, town string, state string>"


def parsed(records: DataFrame) -> DataFrame:
    """records (rec, line, second, city, region, postcode) with the parts of the address; records without a usable
    street line (null, blank, no number or no name) are left out, as they denote no place."""

    @F.pandas_udf(_PARTS)
    def parts(line: pd.Series, second: pd.Series, city: pd.Series, region: pd.Series, postcode: pd.Series) -> pd.DataFrame:
        towns = {c: town(c) for c in city.unique()}
        rows = [(*street(a, b), zip5(e), towns[c], state(d)) for a, b, c, d, e in zip(line, second, city, region, postcode)]
        return pd.DataFrame(rows, columns=["kind", "num", "core", "dir", "type", "unit", "zip", "town", "state"])

    some = records.where(F.length(F.trim("line")) > 0)
    out = some.select("rec", F.xxhash64("line").alias("raw"), parts("line", "second", "city", "region", "postcode").alias("p")).select("rec", "raw", "p.*")
    return out.where((F.col("num") != "") & ((F.col("kind") == "X") | ((F.col("kind") == "B") & (F.col("core") != ""))))


def _deletions(word: str):
    """The word and every string with one of its letters left out, hashed; short words only themselves."""
    w = F.col(word)
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    return F.when(F.length(w) >= 5, F.concat(F.array(w), cut)).otherwise(F.array(w))


def corrected_streets(placed: DataFrame) -> DataFrame:
    """(form, name): a hash of the best supported street name that is reached from a form's own over neighbours, where it isn't
    its own. placed: form, kind, block (a hash of number and locality; a form may be in several), core, n."""
    placed = placed.where("kind = 'B'")
    per = placed.groupBy("block", "core").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("block")
    per = per.withColumn("a", F.min("core").over(w)).withColumn("z", F.max("core").over(w)).where("a < z").drop("a", "z")
    near = per.select("block", "core", "n", F.explode(F.array_distinct(_deletions("core"))).alias("cut"))
    near = near.select(F.xxhash64("block", "cut").alias("key"), "block", "core", "n")
    near = near.withColumn("best", F.max(F.struct("n", "core")).over(Window.partitionBy("key"))).where(F.col("best.core") != F.col("core"))
    near = near.where(F.levenshtein("core", F.col("best.core"), 2) >= 0)
    chosen = near.groupBy("block", "core").agg(F.max("best").alias("best"))
    at = F.xxhash64("block", "core").alias("at")
    edges = keep(chosen.select(at, F.xxhash64("block", "best.core").alias("to")), "streets")
    # only names with a neighbour are followed: best is the strongest name known at each place of a form
    touched = edges.select("at").unionByName(edges.select(F.col("to").alias("at"))).distinct()
    stands = keep(placed.select("form", at, "n", F.xxhash64("core").alias("own")).join(touched, "at"), "stands")
    label = keep(stands.groupBy("at").agg(F.struct(F.sum("n").alias("n"), F.first("own").alias("name")).alias("best")), "labels")
    # both ways: a name may be stronger in another block than the neighbour it was assigned to
    ways = edges.select("at", "to").unionByName(edges.select(F.col("to").alias("at"), F.col("at").alias("to")))
    while True:
        over = ways.join(label.select(F.col("at").alias("to"), "best"), "to").select("at", "best")
        step = label.unionByName(over).groupBy("at").agg(F.max("best").alias("best"))
        forms = stands.select("form", "at").join(step, "at").groupBy("form").agg(F.max("best").alias("best"))
        new = keep(stands.select("form", "at").join(forms, "form").groupBy("at").agg(F.max("best").alias("best")), "labels")
        changed = new.alias("a").join(label.alias("b"), "at").where("a.best > b.best").limit(1).count()
        drop(label)
        label = new
        if not changed:
            break
    best = stands.join(label, "at").groupBy("form").agg(F.max("best").alias("best"), F.first("own").alias("own"))
    return best.where("best.name != own").select("form", F.col("best.name").alias("name"))


def located(forms: DataFrame) -> DataFrame:
    """forms with blocks: hashes of the number and each locality of a form: the usual town of its postal code (or the code
    itself), its own town, the usual towns of that town's postal codes, and the best supported spelling of the town in the
    state. Empty without town and code. There are at most 100,000 postal codes: their towns are broadcast."""
    counts = forms.where("zip != '' and town != '' and state != ''").groupBy("zip", "town", "state").agg(F.sum("n").alias("n"))
    counts = keep(counts, "towns")
    by_zip = counts.groupBy("zip").agg(F.max_by(F.xxhash64("town", "state"), F.struct("n", "town", "state")).alias("zip_loc"))
    around = counts.join(F.broadcast(by_zip), "zip").select("town", "state", F.col("zip_loc").alias("beside"))
    towns = forms.where("town != ''").groupBy("town", "state").agg(F.sum("n").alias("n"))
    spelt = towns.select("town", "state", "n", F.explode(F.array_distinct(_deletions("town"))).alias("cut"))
    spelt = spelt.withColumn("m", F.max(F.struct("n", "town")).over(Window.partitionBy("state", "cut"))).where((F.col("m.town") != F.col("town")) & (F.levenshtein("town", F.col("m.town"), 2) >= 0))
    around = around.unionByName(spelt.select("town", "state", F.xxhash64("m.town", "state").alias("beside"))).groupBy("town", "state").agg(F.collect_set("beside").alias("beside"))
    own, code = F.when(F.col("town") != "", F.xxhash64("town", "state")), F.coalesce("zip_loc", F.when(F.col("zip") != "", F.xxhash64("zip")))
    j = forms.join(F.broadcast(by_zip), "zip", "left").join(around, ["town", "state"], "left")
    locs = F.array_distinct(F.concat(F.array_compact(F.array(own, code)), F.coalesce("beside", F.array().cast("array<bigint>"))))
    return j.withColumn("blocks", F.transform(locs, lambda x: F.xxhash64("num", x))).drop("zip_loc", "beside")


def placed_forms(forms: DataFrame, units: bool = False) -> DataFrame:
    """(form, place): a 64-bit id of the place of each distinct form. forms has FORM, unit if units, and n."""
    forms = keep(located(forms), "forms")
    right = corrected_streets(forms.select("form", "kind", "core", "n", F.explode("blocks").alias("block")))
    f = forms.join(right, "form", "left").withColumn("g", F.xxhash64("kind", "num", F.coalesce("name", F.xxhash64("core"))))
    # numbers and names that the whole country has (BOX 1, 100 MAIN) are divided by state: that of the postal code, or else their own
    begins = forms.where("zip != '' and state != ''").groupBy(F.substring("zip", 1, 3).alias("z3"), "state").agg(F.sum("n").alias("k"))
    begins = begins.groupBy("z3").agg(F.max_by("state", F.struct("k", "state")).alias("z3_state"))  # at most 1000 rows are broadcast
    f = f.withColumn("z3", F.substring("zip", 1, 3)).join(F.broadcast(begins), "z3", "left").withColumn("region", F.coalesce("z3_state", "state"))
    f = f.select("form", "n", "g", "region", "dir", "type", "zip", "town", "state", *(["unit"] if units else [])).repartition("g", "region")
    by = ["g", "region"]

    def top(value: str, *also: str):
        return F.max(F.when(F.col(value) != "", F.struct("n", value))).over(Window.partitionBy(*by, *also))[value]

    # a missing postal code is the town's; the commonest town of a postal code says which of its codes is meant
    f = f.withColumn("z0", F.when(F.col("zip") != "", F.col("zip")).when(F.col("town") != "", top("zip", "town", "state")))
    f = f.withColumn("z0", F.coalesce("z0", F.when(F.col("town") == "", top("zip", "state")), F.lit("")))
    main = F.max(F.when((F.col("town") != "") & (F.col("z0") != ""), F.struct("n", "town", "state"))).over(Window.partitionBy(*by, "z0"))
    f = f.withColumn("m", main).withColumn("mt", F.coalesce(F.col("m.town"), F.col("town"))).withColumn("ms", F.coalesce(F.col("m.state"), F.col("state")))
    f = f.withColumn("z1", F.max(F.when((F.col("mt") != "") & (F.col("z0") != ""), F.struct("n", "z0"))).over(Window.partitionBy(*by, "mt", "ms"))["z0"])
    f = f.withColumn("loc", F.coalesce("z1", F.when(F.col("z0") != "", F.col("z0")), F.concat("mt", F.lit("|"), "ms")))
    f = f.withColumn("dir1", F.when(F.col("dir") != "", F.col("dir")).otherwise(F.coalesce(top("dir", "loc"), F.lit(""))))
    f = f.withColumn("type1", F.when(F.col("type") != "", F.col("type")).otherwise(F.coalesce(top("type", "loc", "dir1"), top("type", "loc"), F.lit(""))))
    return f.select("form", F.xxhash64("g", "loc", "dir1", "type1", *(["unit"] if units else [])).alias("place"))


def places(records: DataFrame, units: bool = False) -> DataFrame:
    """(rec, raw, place) of every address record; raw is a hash of the street field as stored.

    records: (rec, line, second, city, region, postcode). units: different units of a building are different places (a
    missing unit is a place of its own); otherwise units don't count. Records without a usable street line are left out.
    """
    cols = FORM + (["unit"] if units else [])
    own = keep(parsed(records).withColumn("form", F.xxhash64(*cols)).select("rec", "raw", "form", *cols), "addresses")
    forms = own.groupBy("form").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in cols])
    return own.select("rec", "raw", "form").join(placed_forms(forms, units), "form").select("rec", "raw", "place")


def same_place(records: DataFrame, units: bool = False) -> DataFrame:
    """(addr_a, addr_b): pairs of records of one place whose street fields differ as stored; addr_a < addr_b."""
    own = keep(places(records, units), "places")
    # only places with more than one spelling have pairs
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.rec") < F.col("b.rec")) & (F.col("a.raw") != F.col("b.raw")))
    return pairs.select(F.col("a.rec").alias("addr_a"), F.col("b.rec").alias("addr_b"))
