import pytest

from matchloom.llm import mixture


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, 5, "u") for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, copies int, steps string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_capped_poisson():
    for cap in (1, 2, 5):
        for mean in (0.1, 0.5, 0.9 * cap):
            assert mixture.draw_table(0.7, cap)[-1] <= 1
            assert mixture.capped_mean(mixture.rate_for(mean, cap), cap) == pytest.approx(mean, abs=1e-6)
    assert mixture.capped_mean(mixture.rate_for(1500, 2000), 2000) == pytest.approx(1500, abs=1e-3)
    assert mixture.rate_for(0, 3) == 0.0 and mixture.rate_for(3, 3) == float("inf") and mixture.draw_table(float("inf"), 2) == [0.0, 0.0]


def test_tokens_and_shares(spark):
    rows = [("a", "one two three four")] * 400 + [("b", "one two")] * 300 + [("c", "x y z")] * 20 + [(None, "one")] * 30 + [("other", None), ("other", ""), ("a", "word " * 3000)]
    c = mixture.with_tokens(docs(spark, rows)).cache()
    assert c.where("source = 'b'").first()["tokens"] == 2 and c.where("text is null or text = ''").agg({"tokens": "sum"}).first()[0] == 0
    t = targets(spark, [("a", 0.5, 1), ("b", 0.3, 8), ("c", 0.1, 2), ("none", 0.1, 3)])
    plan = {r["source"]: r for r in mixture.source_plan(c, t).collect()}
    total = c.agg({"tokens": "sum"}).first()[0]
    for s, p in plan.items():
        have = sum(r["tokens"] for r in c.collect() if r["source"] == s)
        assert p["have"] == have and p["short"] == (have * p["max_repeats"] < p["target_share"] * total)
    mix = mixture.replicate(c, t)
    uses = {}
    for r in mix.collect():
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    cap = {"a": 1, "b": 8, "c": 2}
    assert all(n <= cap[rows[d][0]] for d, n in uses.items())
    assert {d for d, n in uses.items() if rows[d][0] == "c" and n == 2} == {i for i, r in enumerate(rows) if r[0] == "c"}  # short: used as often as allowed
    assert sorted(map(tuple, mix.select("doc_id", "copy_no").collect())) == sorted(map(tuple, mixture.replicate(c.repartition(3), t).select("doc_id", "copy_no").collect()))
    shares = {r["source"]: r for r in mixture.shares(c, t).collect()}
    assert sum(r["actual_share"] for r in shares.values()) == pytest.approx(1.0)
    assert {s for s, r in shares.items() if r["short"]} == {s for s, p in plan.items() if p["short"]}
    assert shares["b"]["tokens"] / total == pytest.approx(0.3, abs=0.03) and shares["none"]["short"] and shares["none"]["tokens"] == 0


def test_empty(spark):
    c = mixture.with_tokens(docs(spark, []))
    t = targets(spark, [("a", 0.5, 1)])
    assert mixture.replicate(c, t).count() == 0 and mixture.shares(c, t).first()["tokens"] == 0 and mixture.source_plan(c, t.limit(0)).count() == 0
