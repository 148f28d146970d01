import random

from matchloom.llm import names, spellings

RECORD = "rec string, owner string, name string, city string, region string, postcode string, line string, other_line string, other_postcode string, side string"


def test_names_are_taken_apart_once(spark):
    one = spark.createDataFrame([("a", "x", "Orastcroft Club", "Arwick", "AL", "01129", "9 Elm St", None, None, "s"), ("b", "y", "The Inc", "Arwick", "AL", "01129", None, None, None, "s")], RECORD)
    out = spellings.parsed(one, {})
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["rec"], r["core"], r["numbers"]) for r in out.collect()] == [("a", "ORASTCROFT", [9])]


def test_keys_are_those_of_the_names_module(spark):
    r = random.Random(3)
    cores = sorted({"".join(r.choice("ABC") for _ in range(r.randint(3, 11))) for _ in range(300)})
    for sure in (True, False):
        df = spark.createDataFrame([(1, i, sure, c) for i, c in enumerate(cores)], "block long, nid long, sure boolean, core string")
        index, probe = (spellings.segment_keys(df, x) for x in (True, False))
        found = {tuple(x) for x in probe.select("key", "nid").join(index.selectExpr("key", "nid AS to_id"), "key").select("nid", "to_id").distinct().collect()}
        assert found == {(i, j) for i, a in enumerate(cores) for j, b in enumerate(cores) if set(names.probe_keys(a, sure)) & set(names.index_keys(b, sure))}


def test_turned_is_the_first_rotation():
    r = random.Random(4)
    for _ in range(500):
        w = "".join(r.choice("AB1") for _ in range(r.randint(1, 9)))
        assert names.turned(w) == min(w[i:] + w[:i] for i in range(len(w)))
