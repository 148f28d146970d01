"""Cases that a cap or a cut used to lose."""

import pytest
from pyspark.sql import functions as F

from matchloom.llm import entities, places

RECORDS = "owner string, name string, city string, region string, postcode string, line string"


def _candidates(spark, left, right):
    """(left owner, right owner) of the candidate pairs."""
    p = entities.profiles(*[spark.createDataFrame(x, RECORDS) for x in (left, right)])
    o = {}
    for x in p.collect():
        o.setdefault((x["is_left"], x["o"]), set()).add(x["key"])
    return {(a, b) for x in entities.candidates(p).collect() for a in o[True, x["lo"]] for b in o[False, x["ro"]]}


@pytest.mark.parametrize("town", ["KENWORTH", "FARVILLE", None])
def test_typos_at_the_same_street_are_candidates(spark, town):
    """Names with a typo meet by number, also from different towns or without one."""
    typos = [("HARRISONOW CLUB", "HARISSONOW CLUB"), ("GREENWOOD CHURCH", "GREENVOOD CHURCH"), ("OLOCKCOMBE CHURCH", "OLOCKCMBE CHURCH")]
    left = [(f"u{i}", a, "KENWORTH", "DC", None, f"{i + 7} Olockcombe St") for i, (a, _) in enumerate(typos)]
    right = [(f"e{i}", b, town, "DC", None, f"{i + 7} OLOCKCOMBE STREET") for i, (_, b) in enumerate(typos)]
    assert _candidates(spark, left, right) >= {(f"u{i}", f"e{i}") for i in range(3)}


def test_common_names_stay_candidates(spark):
    """A name of more than three towns is still looked for in the whole state."""
    left = [("u0", "Kenwick Food Bank", "TOWNX", "TX", None, "9 Elm St")]
    right = [(f"e{i}", "KENWICK FOOD BANK", f"TOWN{i}", "TX", None, f"{i} Oak St") for i in range(6)]
    assert _candidates(spark, left, right) == {("u0", f"e{i}") for i in range(6)}


def test_misspelt_streets_meet_over_town_and_code(spark):
    """One side has no postal code, the other's belongs mostly to another town; or its town is misspelt."""
    many = [(f"o{i}", f"{i} Elm St", None, "FARVILLE", "DC", "16434") for i in range(5)]
    rows = [*many, ("a1", "77 Olockcombe Rd", None, "KENWORTH", "DC", "16434"), ("a2", "77 OLOCKCOMBE ROAD", None, "KENWORTH", "DC", "16434"), ("b", "77 Oslockcombe Rd", None, "KENWORTH", "DC", None), ("c", "77 Olockcmbe Rd", None, "KENWORTHH", "DC", None)]
    df = spark.createDataFrame(rows, "rec string, line string, second string, city string, region string, postcode string")
    num = places.parsed(df).select("rec", *places.FORM).withColumn("form", F.xxhash64("rec")).withColumn("n", F.lit(1))
    f = places.located(num)
    right = places.corrected_streets(f.select("form", "kind", "core", "n", F.explode("blocks").alias("block")))
    got = {r["rec"] for r in f.join(right, "form").select("rec").collect()}
    assert got == {"b", "c"}
    assert ("a1", "b") in {tuple(r) for r in places.same_place(df).collect()}


def test_equally_supported_streets_are_one_place(spark):
    """Two spellings with one record each are joined, whichever of them is chosen."""
    rows = [(f"{s}{i}", f"{i + 1} {w} Rd", None, "KENWORTH", "DC", "16434") for i in range(12) for s, w in (("a", "Olockcombe"), ("b", "Olockcmbe"))]
    df = spark.createDataFrame(rows, "rec string, line string, second string, city string, region string, postcode string")
    assert {tuple(r) for r in places.same_place(df).collect()} == {(f"a{i}", f"b{i}") for i in range(12)}
