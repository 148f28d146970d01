"""Review context, screening, one-to-one selection, sources, accumulated scores, rules and ties."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom import queries
from matchloom.config import Config
from matchloom.operators import evaluate as E
from matchloom.operators import review, tier1, veto
from matchloom.operators.compare import Pairs
from matchloom.operators.select import select, tier
from matchloom.sources import readers


def test_review_fields(spark):
    sam = spark.createDataFrame([("u1", "8H", "A8~BZ"), ("u2", "QQ", None), (None, None, "A8~zz")], "`UNIQUE ENTITY ID` string, `ENTITY STRUCTURE` string, `BUS TYPE STRING` string")
    rows = {r["uei"]: r for r in review.sam_review_fields(sam).collect()}
    assert rows["u1"]["SAM_entity_structure_label"] == "Corporate Entity (Tax Exempt)" and rows["u2"]["SAM_entity_structure_label"] == "QQ" and rows[None]["SAM_entity_structure_label"] is None
    assert rows["u1"]["SAM_bus_type_foundation"] and not rows["u2"]["SAM_bus_type_nonprofit"] and rows[None]["SAM_bus_type_zz"] and rows["u1"]["SAM_entity_url"] is None
    assert review.sam_review_fields(sam.limit(0)).count() == 0
    bmf = spark.createDataFrame([
        ("1", "1", "x", "Private operating foundation", "199901", "12.5"), ("2", "0", "990-N required", None, "19x", "none"), ("3", None, "990 (all other) or 990EZ return", "private non-operating foundation", None, None), ("4", "0", "Group return", "", "2001", ""),
        ("5", "0", "Not required to file", "school", "", "7"), ("6", "0", None, None, None, None),
    ], "ein string, pf_filing_requirement_code string, filing_requirement_code_definition string, foundation_code_definition string, ruling_date string, asset_amount string")
    rows = {r["ein"]: r for r in review.bmf_review_fields(bmf).collect()}
    assert [rows[str(i)]["BMF_form_990"] for i in range(1, 7)] == ["990PF", "990N", "990/990EZ", "990-group", "none", None]
    assert [rows[str(i)]["BMF_is_foundation"] for i in range(1, 7)] == [True, False, True, False, False, False]
    assert [rows[str(i)]["BMF_rule_year"] for i in range(1, 7)] == [1999, None, None, 2001, None, None]
    assert rows["1"]["BMF_assets"] == 12.5 and rows["2"]["BMF_assets"] is None and rows["1"]["BMF_affiliation"] is None


def test_one_to_one_matches_brute_force(spark):
    r = random.Random(3)
    rows = [(f"q{r.randint(0, 30)}", f"e{r.randint(0, 30)}", r.choice([0.5, 0.7, 0.9, r.random()])) for _ in range(300)] + [("q1", "e1", None), ("q2", "e2", float("nan"))]
    df = spark.createDataFrame(rows, "id string, ein string, score double")
    best = {(x["id"], x["ein"]): (x["score"], x["h"]) for x in df.where("score is not null and not isnan(score)").groupBy("id", "ein").agg(F.max("score").alias("score")).withColumn("h", F.xxhash64("id", "ein")).collect()}
    want, ids, eins = set(), set(), set()
    for i, e in sorted(best, key=lambda k: best[k], reverse=True):
        if i not in ids and e not in eins:
            want.add((i, e))
            ids.add(i)
            eins.add(e)
    assert {(x["id"], x["ein"]) for x in tier1.one_to_one(df).collect()} == want
    assert tier1.one_to_one(df.limit(0)).count() == 0


def test_scores_accumulate_like_a_sort(spark):
    r = random.Random(5)
    rows = [(r.choice([0.1, 0.25, r.random()]), r.random() < 0.3) for _ in range(2000)] + [(None, True), (0.4, None)]
    df = spark.createDataFrame(rows, "score double, label boolean")
    known = sorted((s, y) for s, y in rows if s is not None and y is not None)
    got = {x["s"]: (x["n_upto"], x["p_upto"]) for x in E.accumulated(E.labelled(df)).collect()}
    for s in {s for s, _ in known}:
        assert got[s] == (sum(a <= s for a, _ in known), sum(y for a, y in known if a <= s))
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert E.auc(df).first()["auc"] == pytest.approx(want)
    assert E.auc(df.limit(0)).first()["auc"] is None and E.auc(df.where("label")).first()["auc"] is None


def test_near_ties_go_to_the_names_most_alike(spark):
    rows = [("q", "1", 1, 0.99, "ALPHA CARE", "BETA HOME"), ("q", "2", 2, 0.97, "ALPHA CARE", "ALPHA CARE"), ("q", "3", 3, 0.5, "ALPHA CARE", "ALPHA CARE"), ("p", "1", 4, 0.94, "ALPHA CARE", "BETA HOME"), ("p", "2", 5, 0.92, "ALPHA CARE", "ALPHA CARE"), ("v", "9", 6, 0.99, "LOCAL 32", "LOCAL 45")]
    df = spark.createDataFrame(rows, "id string, ein string, rid int, score double, name_x string, name_y string")
    none = F.lit(None).cast("string")
    df = df.withColumns({"name_sim": F.col("score"), "street_key_sim": F.col("score"), "name_raw_x": F.col("name_x"), **{f"{c}_{s}": none for c in ("name_ord", "name_dir") for s in "xy"}, "name_nums_x": F.when(F.col("id") == "v", "32"), "name_nums_y": F.when(F.col("id") == "v", "45")})
    pairs = Pairs(veto.veto(df), ["name", "street"], "street_full")
    got = {r["id"]: r for r in tier(select(pairs)).collect()}
    assert got["q"]["overall_ein"] == "2" and got["p"]["overall_ein"] == "1" and got["v"]["overall_ein"] is None and got["v"]["tier"] == "NO"
    assert {r["id"]: r["overall_ein"] for r in select(pairs, Config(tiebreak="none")).collect()}["q"] == "1"


def test_nonprofits_and_sources(spark, tmp_path):
    assert readers.registration_layout()[0] == "UNIQUE ENTITY ID" and len(readers.registration_layout()) == 142
    at = readers.registration_layout().index("BUS TYPE STRING")
    rows = [["U1"], ["U2"], ["U3"]]
    for row, code in zip(rows, ("2X~A8", "2X", "")):
        row += [""] * 141
        row[at] = code
    (tmp_path / "x.dat").write_text("\n".join("|".join(r) for r in rows) + "\n")
    got = readers.prepare_registrations(spark, str(tmp_path / "x.dat"), str(tmp_path / "out"))
    assert [r[0] for r in got.collect()] == ["U1"] and spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    assert readers.flag_nonprofits(readers.read_delimited(spark, str(tmp_path / "x.dat")), keep=False).where("is_nonprofit").count() == 1
    with pytest.raises(ValueError):
        readers.flag_nonprofits(spark.range(1))
    assert {r["key"] for r in readers.source_urls("file:///a")} >= {"unified", "registrations", "registry_fresh"} and len(readers.source_urls()) == 2
    (tmp_path / "registry_unified.csv").write_text("ein\n1\n")
    assert readers.fetch_registry(tmp_path.as_uri(), dest=str(tmp_path / "got.csv"), manifest=False).endswith("got.csv") and (tmp_path / "got.csv").read_text() == "ein\n1\n"
    with pytest.raises(ValueError):
        readers.fetch_registrations()
    with pytest.raises(ValueError):
        readers.fetch_registry("x", "other")


@pytest.mark.parametrize("query", ["screen", "one_to_one", "geo_flags", "hier_pairs", "select_ruled", "select_tiebreak", "veto_optional", "registry_fields"])
def test_queries_run(spark, query):
    assert queries.QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0
