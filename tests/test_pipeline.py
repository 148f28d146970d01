import pytest
from pyspark.sql import functions as F

from matchloom import schema
from matchloom.config import Config
from matchloom.operators import block, veto
from matchloom.operators import evaluate as E
from matchloom.operators import train as T
from matchloom.operators.compare import Pairs, compare, detect_profile
from matchloom.operators.normalize import normalize
from matchloom.operators.score import fit_em, score
from matchloom.operators.select import candidates, select, tier
from matchloom.operators.stats import name_freq, token_idf
from matchloom.plans import pipeline, report
from matchloom.plans.route import prompt, route

COLS = "k string, name string, dba string, street string, city string, state string, zip string"
MAP = {"name": "name", "dba": "dba", "street": "street", "city": "city", "state": "state", "zip5": "zip"}
REF = [
    ("01", "ALASKA YOUTH CENTER INC", "", "100 MAIN ST", "JUNEAU", "AK", "99801-1111"), ("05", "NORTHERN LIGHTS FOUNDATION", "", "3406 GLACIER HWY STE A", "JUNEAU", "AK", "99801-1234"),
    ("10", "SITKA FOOD BANK", "GIVE FOOD", "12 HARBOR DR", "SITKA", "AK", "99835"), ("11", "SITKA FOOD BANK FOUNDATION", "", "12 HARBOR DR", "SITKA", "AK", "99835"), ("14", "LOCAL 32 CARPENTERS UNION", "", "PO BOX 77", "NOME", "AK", "99762"),
    ("15", "ZANZIBAR OBSERVATORY SOCIETY", "", "9 HILL RD", "RENO", "NV", "89501"),
]
QUERY = [
    ("q1", "Northern Lights Foundation, Inc.", "", "3406 Glacier Hwy", "JUNEAU", "AK", "99801"), ("q2", "Sitka Food Bank", "", "12 Harbor Drive", "SITKA", "AK", "99835"), ("q3", "Carpenters Union Local 45", "", "P.O. Box 77", "NOME", "AK", "99762"),
    ("q4", "Give Food", "", None, None, "AK", None), ("q5", "Zanzibar Observatory Society", "", None, "MESA", "AZ", None), ("q6", "Nothing Alike", "", None, None, "WY", None), ("q7", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def sides(spark):
    q = schema.query(spark.createDataFrame(QUERY, COLS), MAP | {"id": "k"})
    r = schema.reference(spark.createDataFrame(REF, COLS), MAP | {"ein": "k"})
    return q, r


@pytest.fixture(scope="module")
def result(sides):
    return pipeline.cascade(*sides)


def test_profile(sides, spark):
    assert detect_profile(sides[0].where("id in ('q1', 'q2', 'q3')")) == "street_full"
    assert detect_profile(sides[0].limit(0)) == "state"


def test_blocks(sides):
    q, r = (normalize(x) for x in sides)
    assert block.exact(q, r, ["state"]).count() == 4 * 5
    pairs = lambda b: {(x["id"], x["ein"]) for x in b.join(r.select("rid", "ein"), "rid").collect()}
    assert ("q4", "10") in pairs(block.exact(q, r, ["state", "name_key"], ["state", "dba_key"]))
    assert ("q5", "15") in pairs(block.by_tokens(q, r)) and ("q5", "15") not in pairs(block.by_tokens(q, r, ["state"]))
    assert pairs(block.by_tokens(q, r, max_ref_freq=1)) < pairs(block.by_tokens(q, r))
    assert ("q2", "10") in pairs(block.by_tokens(q, r, ["state"], min_pair_idf=2.0)) and block.union(block.by_tokens(q, r), block.by_tokens(q, r)).count() == block.by_tokens(q, r).count()


def test_concat(spark):
    m = {"name": "name", "state": "state"}
    q = normalize(schema.query(spark.createDataFrame([("a", "STEP FORWARD", "AK"), ("b", "SKILLSUSA", "AK")], "k string, name string, state string"), m | {"id": "k"}))
    r = normalize(schema.reference(spark.createDataFrame([("1", "STEPFORWARD", "AK"), ("2", "SKILLS USA", "AK")], "k string, name string, state string"), m | {"ein": "k"}))
    assert block.by_tokens(q, r, ["state"]).count() == 0 and block.by_tokens(q, r, ["state"], concat=True).count() == 2


def test_cascade(result):
    rows = {r["id"]: r for r in result.tiered.collect()}
    assert rows["q1"]["overall_ein"] == "05" and rows["q1"]["tier"] == "YES" and rows["q1"]["pass"] == "exact-name"
    assert rows["q2"]["overall_ein"] in ("10", "11")
    assert rows["q4"]["pass"] == "exact-name-dba" and rows["q5"]["pass"] == "token-crossstate" and rows["q5"]["tier"] == "MAYBE"
    assert "q6" not in rows and "q7" not in rows
    assert rows["q3"]["overall_ein"] is None or rows["q3"]["overall_ein"] != "14"
    assert all(0 <= (r["overall_score"] or 0) <= 1 for r in rows.values())
    assert [s["pass"] for s in result.stages][:1] == ["exact-name"]


def test_cascade_without_candidates(sides):
    with pytest.raises(ValueError):
        pipeline.cascade(sides[0].where("id = 'q6'"), sides[1], passes=pipeline.default_passes()[:1])


def test_match_methods(sides):
    for method in ("weighted", "hier", "em"):
        r = pipeline.match(*sides, method=method)
        picks = {x["id"]: x["overall_ein"] for x in r.tiered.collect()}
        assert picks["q1"] == "05", method
    with pytest.raises(ValueError):
        score(r.pairs, method="model")
    assert {x["field"] for x in pipeline.preview(r.pairs, "q1", "05").collect()} >= {"score", "name_sim"}


def test_overlap_is_held_for_review(spark):
    m = MAP
    q = schema.query(spark.createDataFrame([("q", "PORT MATILDA EMS", "", "1 OAK ST", "PORT MATILDA", "PA", "16870")], COLS), m | {"id": "k"})
    r = schema.reference(spark.createDataFrame([("1", "PORT MATILDA EMERGENCY MEDICAL SERVICE", "", "1 OAK ST", "PORT MATILDA", "PA", "16870")], COLS), m | {"ein": "k"})
    p = pipeline.match(q, r, method="hier").pairs.df.first()
    assert p["name_match_type"] == "token_overlap" and 0.65 <= p["score"] < 0.78


def test_rare_name_is_promoted(spark, sides):
    q, r = (normalize(x) for x in sides)
    freq = name_freq(r)
    c = compare(block.by_tokens(q, r), q, r, name_freq=freq, token_idf=token_idf(r))
    row = score(c, method="hier").df.where("id = 'q5' and ein = '15'").first()
    assert row["score"] == pytest.approx(0.72) and row["name_freq"] == 1
    row = score(c.with_df(c.df.withColumn("name_freq", F.lit(40))), method="hier").df.where("id = 'q5' and ein = '15'").first()
    assert row["score"] < 0.72


@pytest.mark.parametrize(("x", "y", "hard", "soft"), [
    ("Local 32", "Local 45", "number_conflict", None), ("First Baptist", "Second Baptist", "ordinal_conflict", None), ("Southwest Care", "Southeast Care", "direction_conflict", None), ("Southwest Care", "Care", None, None),
    ("Widget LLC", "Widget", "forprofit_form", None), ("Nome Housing Authority", "Nome", None, "government_entity"), ("Columbia University in the City of New York", "Columbia", None, None), ("City of Nome", "Nome", None, "government_entity"),
    ("Gow School", "Gow School Foundation", None, "affiliate_suffix"), ("Gow School Foundation", "Gow School Foundation", None, None),
])
def test_rules(spark, x, y, hard, soft):
    full = lambda c: normalize(schema.query(spark.createDataFrame([(c,)], "n string"), {"name": "n"})).select("name_nums", "name_ord", "name_dir").first()
    a, b = full(x), full(y)
    df = spark.createDataFrame([(x, y, x, *a, *b, 0.97)], "name_x string, name_y string, name_raw_x string, name_nums_x string, name_ord_x string, name_dir_x string, name_nums_y string, name_ord_y string, name_dir_y string, name_sim double")
    r = veto.veto(df).first()
    assert (r["veto_reason"], r["veto_soft_reason"]) == (hard, soft) and r["veto"] == (hard is not None)


def scored(spark, rows):
    df = spark.createDataFrame(rows, "id string, ein string, rid long, score double, name_sim double, street_key_sim double, name_x string, name_y string, veto boolean, veto_soft boolean, veto_soft_reason string")
    return Pairs(df, ["name", "street"], "street_full")


def test_select_and_tier(spark):
    rows = [
        ("a", "1", 1, 0.97, 0.9, 1.0, "GOW SCHOOL", "GOW ACADEMY", False, False, None), ("a", "2", 2, 0.96, 1.0, 0.2, "GOW SCHOOL", "GOW SCHOOL", False, False, None),
        ("b", "1", 1, 0.99, 1.0, 1.0, "X", "X", True, False, None), ("b", "2", 2, 0.70, 0.7, 0.7, "X", "XY", False, False, None),
        ("c", "1", 1, 0.9, 1.0, 1.0, "Y", "Y", False, True, "why"), ("d", "1", 1, 0.9, 1.0, 1.0, "Z", "Z", True, False, None), ("e", "2", 2, 0.5, 0.5, 0.5, "T", "U", False, False, None), ("e", "1", 1, 0.5, 0.5, 0.5, "T", "U", False, False, None),
    ]
    p = scored(spark, rows)
    got = {r["id"]: r for r in tier(select(p)).collect()}
    assert got["a"]["overall_ein"] == "2" and got["a"]["tie"] and got["a"]["n_close"] == 2 and got["a"]["tier"] == "MAYBE" and not got["a"]["views_agree"]
    assert got["b"]["overall_ein"] == "2" and got["b"]["tier"] == "MAYBE" and got["c"]["tier"] == "MAYBE"
    assert got["d"]["overall_ein"] is None and got["d"]["tier"] == "NO" and got["e"]["overall_ein"] == "1"
    assert {r["id"]: r["overall_ein"] for r in select(p, Config(tiebreak="none")).collect()}["a"] == "1"
    types = {(r["id"], r["ein"]): r["candidate_type"] for r in candidates(p, 1).collect()}
    assert types["a", "1"] == "best_addr+top1" and types["a", "2"] == "best_name" and ("b", "1") not in types


def test_route_and_report(result, spark, tmp_path):
    r = route(result, token_idf=None, source_data=spark.createDataFrame([("q1", "x")], "uei string, extra string"))
    s = r.summary.first()
    assert s["accepted"] + s["review"] + s["unmatched"] == result.tiered.count()
    assert r.review.columns[:8] == ["uei", "ein", "name_similarity", "addr_similarity", "candidate_type", "total_score", "num_of_candidates", "is_top_candidate"]
    assert "extra_uss" in r.review.columns and "CANDIDATES" in prompt(r, "q1")
    assert route(result, review_tiers=("MAYBE",)).review.where("uei = 'q1'").count() == 0
    text = report.report(result, timings={"all": 60.0}, file=str(tmp_path / "r.md"))
    assert "## Outcome" in text and (tmp_path / "r.md").read_text() == text


def test_train_and_benchmark(spark):
    rows = [(f"i{k}", str(k), k, None, 0.95 if k % 3 else 0.2 + 0.01 * (k % 7), 0.9 if k % 3 else 0.3, "a", "b", False, False, None) for k in range(60)]
    p = scored(spark, rows)
    p = T.label(p, spark.createDataFrame([(f"i{k}", str(k), k % 3 > 0) for k in range(60)], "id string, ein string, label boolean"))
    m = T.train(p)
    s = {r["id"]: r["p_model"] for r in m.predict(p.df).collect()}
    assert s["i1"] > 0.5 > s["i0"]
    b = T.benchmark(p, k=3).collect()
    assert {r["method"] for r in b} == {"weighted", "em", "model"} and all(r["auc"] > 0.99 for r in b)
    with pytest.raises(ValueError):
        T.train(p.with_df(p.df.where("label = 1")))
    own = T.train(p, engine=lambda df, f, y: lambda d: d.withColumn("p_model", F.lit(0.5)))
    assert own.predict(p.df).first()["p_model"] == 0.5
    t = tier(select(p.with_df(p.df.withColumn("score", F.col("name_sim")))))
    f = T.calibration_frame(t, p.with_df(p.df.withColumn("score", F.col("name_sim"))), {"YES": 5, "NO": 4})
    assert f.select("id").distinct().count() == 9


def test_evaluate(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.3, False), (0.1, False), (None, True), (0.5, None)], "score double, label boolean")
    r = E.evaluate(df, 0.75).first()
    assert (r["n"], r["n_pos"]) == (5, 2) and r["auc"] == pytest.approx(5.5 / 6) and r["precision"] == pytest.approx(2 / 3) and r["recall"] == 1.0
    t = E.tune_thresholds(df, 0.9, 1.0).first()
    assert t["yes"] == 0.9 and t["maybe"] == 0.8
    assert E.auc(df.where("label")).first()["auc"] is None and E.evaluate(df.limit(0)).first()["n"] is None


def test_em_separates():
    p, m, u = fit_em([((1, 1, 1), 90), ((0, 0, 0), 900), ((1, 0, 0), 30), ((1, 1, 0), 10)])
    assert 0.05 < p < 0.2 and min(m) > max(u)
