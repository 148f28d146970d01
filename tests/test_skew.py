import random
from collections import Counter, defaultdict

from matchloom.operators import skew


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v long, n string, __w int")


def test_totals_and_percentiles_match_brute_force(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.choice([None, *range(50)]) if r.random() < 0.9 else r.randint(0, 10**6), "x", 1) for _ in range(3000)] + [(None, 5, "y", 2), ("nulls", None, None, None)]
    df = frame(spark, rows)
    freq = skew.value_frequency(df, ["k"], "v", "c")
    got = {x["k"]: x for x in skew.key_totals(freq, ["k"], "v", "c").collect()}
    pct = {x["k"]: x for x in skew.weighted_percentiles(freq, ["k"], "v", {"p50": 0.5, "p90": 0.9, "p100": 1.0, "p0": 0.0}, "c").collect()}
    by = defaultdict(list)
    for k, v, *_ in rows:
        by[k].append(v)
    assert set(got) == set(by) and set(pct) == set(by) - {"nulls"}
    for k, vs in by.items():
        have = sorted(v for v in vs if v is not None)
        assert got[k]["n_rows"] == len(vs) and got[k]["n_distinct"] == len(set(have))
        if have:
            top = max(Counter(have).values())
            assert got[k]["mode_value"] == min(v for v, c in Counter(have).items() if c == top)
            for name, p in (("p50", 0.5), ("p90", 0.9), ("p100", 1.0), ("p0", 0.0)):
                assert pct[k][name] == have[max(1, -(-int(p * 100) * len(have) // 100)) - 1], (k, name)
        else:
            assert got[k]["mode_value"] is None


def test_empty_table(spark):
    freq = skew.value_frequency(frame(spark, []), ["k"], "v", "c")
    assert skew.key_totals(freq, ["k"], "v", "c").count() == 0 and skew.weighted_percentiles(freq, ["k"], "v", {"p": 0.5}, "c").count() == 0


def test_hot_states(spark):
    codes = spark.createDataFrame([("NY", "New York"), ("TX", "Texas"), ("ME", "Maine")], "state_code string, state_name string")
    t = spark.createDataFrame([(x,) for x in ["ny", " N.Y. ", "new york", "TEXAS", "Zz", None, "", "ME", "x", "y"]], "field string")
    got = {tuple(r) for r in skew.hot_states({"t": (t, "field")}, codes, 0.2).collect()}
    assert got == {("t", "NY")}
    assert skew.hot_states({"t": (t.limit(0), "field")}, codes).count() == 0


def test_skew_join_keeps_every_row(spark):
    big = spark.range(30000).selectExpr("case when id % 3 = 0 then -1 else id end as k", "id as v")
    small = big.groupBy("k").count().selectExpr("k", "count as w", "k * 2 as y")
    out = skew.skew_join(big, small, ["k"], "w")
    assert out.count() == 30000 and out.where("y != k * 2").count() == 0 and set(out.columns) == {"k", "v", "y"}
