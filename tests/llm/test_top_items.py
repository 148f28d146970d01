import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matchloom.llm import top_items

KIND = "u string, e string, score double, g string, i string, s double, n long"


def brute(rows, n):
    best = {}
    for u, e, s in rows:
        if u is not None and e is not None and s is not None and s == s:
            best[u, e] = max(s, best.get((u, e), float("-inf")))
    by = {}
    for (u, e), s in best.items():
        by.setdefault(u, []).append((-s, e))
    return {(u, e) for u, x in by.items() for _, e in sorted(x)[:n]}


def run(spark, rows, n):
    df = spark.createDataFrame([(*r, "x", "y", 0.0, 1) for r in rows], KIND)
    return {(r["g"], r["i"]) for r in top_items.top_n(top_items.best_scores(df, "u", "e", "score"), n).collect()}


def test_hot_group_ties_and_odd_scores(spark):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.6 else f"u{r.randint(0, 40)}", f"E{r.randint(0, 400):09d}", r.choice([0.5, 0.5, 0.7, round(r.random(), 3), float("nan"), None, -1.0, float("inf"), float("-inf"), 1e300, -1e300, 5e-324, 0.0, -0.0])) for _ in range(3000)]
    rows += rows[:200] + [(None, "a", 1.0), ("u1", None, 9.0), ("tie", "Z" * 30 + "1", 0.5), ("tie", "Z" * 30 + "2", 0.5), ("tie", "é", 0.5), ("tie", "", 0.5), ("tie", "z" * 900, 0.5)]
    for n in (1, 3):
        assert run(spark, rows, n) == brute(rows, n)


def test_empty_and_small(spark):
    assert run(spark, [], 3) == set() and run(spark, [("a", "b", None)], 3) == set() and run(spark, [("a", "b", 1.0)], 3) == {("a", "b")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.text("xyé\U0001f600", max_size=9), st.floats(allow_nan=False)), max_size=40))
def test_any_scores(spark, rows):
    assert run(spark, rows, 2) == brute(rows, 2)


def test_both_ways(spark):
    df = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.8), ("b", "1", 0.95)], "u string, e string, s double")
    got = {tuple(r) for r in top_items.top_both_ways(df, "u", "e", "s", 1, ("uei", "ein")).collect()}
    assert got == {("uei", "a", "1"), ("uei", "b", "1"), ("ein", "1", "b"), ("ein", "2", "a")}
