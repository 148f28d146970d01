import math
import random
import re
from collections import Counter

import pytest

from matchloom.llm import distinctive, frequency

NAMES = ["Alpha Beta alpha", "beta  BETA, gamma", None, "", "Ünïcode 3³ x", "one two three", "ONE", "a" * 5000, "Alpha Beta alpha"]


def terms(t):
    return re.findall(r"[^\W_]+", t.upper())


def brute(names):
    occ, rec = Counter(), Counter()
    for t in names:
        if t is not None:
            occ.update(terms(t))
            rec.update(set(terms(t)))
    return {t: (occ[t], rec[t]) for t in occ}


def table(spark, names):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(names)], "id long, name string, term string, part int, records int")


def found(counts):
    return {r["term"]: (r["occurrences"], r["records"]) for r in counts.where("term is not null").collect()}


def test_signed_changes_equal_a_recount(spark, tmp_path):
    counts = frequency.CountTable(spark, f"file://{tmp_path}/counts")
    assert counts.read().count() == 0
    counts.apply("name", added=table(spark, NAMES))
    assert found(counts.read()) == brute(NAMES)
    written = {p: p.stat().st_mtime_ns for p in tmp_path.glob("counts/part=*/*.parquet")}
    new = ["delta beta", None]
    old, edited = ["one two three", "ONE"], ["one two", None]
    counts.apply("name", added=table(spark, new), deleted=table(spark, ["Alpha Beta alpha"]), changed=(table(spark, old), table(spark, edited)))
    left = [t for t in NAMES if t not in (*old, "Alpha Beta alpha")] + ["Alpha Beta alpha", *new, *edited]
    after = counts.read()
    assert found(after) == brute(left)
    assert after.where("term is null").first()["records"] == sum(t is not None for t in left)
    # parts that no changed term falls into are the files that they were
    touched = {r["part"] for r in frequency.change_set("name", table(spark, new), table(spark, ["Alpha Beta alpha"]), (table(spark, old), table(spark, edited))).select("part").distinct().collect()}
    same = [p for p in written if int(p.parent.name.removeprefix("part=")) not in touched]
    assert same and all(p.exists() and p.stat().st_mtime_ns == written[p] for p in same)
    counts.apply("name", deleted=table(spark, left))
    assert counts.read().count() == 0
    counts.apply("name")
    counts.apply("name", added=table(spark, []))
    assert counts.read().count() == 0


def test_marks_and_empty(spark, tmp_path):
    counts = frequency.CountTable(spark, f"file://{tmp_path}/counts")
    counts.apply("name", added=table(spark, ["a b"] * 60 + ["c", "d d d"]))
    assert {(r["term"], r["mark"]) for r in frequency.marked(counts.read()).where("mark is not null").collect()} == {("A", "common"), ("B", "common"), ("C", "rare")}
    assert frequency.marked(frequency.empty_counts(spark)).count() == 0
    assert frequency.marked(frequency.counted_by_vintage(table(spark, []), "name", "term")).count() == 0


@pytest.mark.parametrize(("exponent", "presence"), [(0.75, False), (0.0, True), (1.0, False)])
def test_ppmi_matches_the_formula(spark, exponent, presence):
    df = table(spark, NAMES)
    joint = {i: Counter(set(terms(t)) if presence else terms(t)) for i, t in enumerate(NAMES) if t is not None}
    s = sum(sum(c.values()) ** exponent for c in joint.values())
    total = Counter()
    for c in joint.values():
        total.update(c)
    want = {(i, t): max(0.0, math.log(k * s / (total[t] * sum(c.values()) ** exponent))) for i, c in joint.items() for t, k in c.items()}
    got = {(r["id"], r["term"]): r["ppmi"] for r in distinctive.ppmi(df, ["id"], "name", exponent, presence).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_top_term_brute_force(spark):
    r = random.Random(3)
    words = [f"W{i}" for i in range(12)]
    names = [None if r.random() < 0.1 else " ".join(r.choices(words, k=r.randint(0, 5))) + (" ONCE%d" % i if r.random() < 0.3 else "") for i in range(80)] + ["W1 w1", "W1 w1"]
    n = sum(t is not None for t in names)
    df = Counter(t for x in names if x is not None for t in set(terms(x)))
    want = set()
    for i, x in enumerate(names):
        c = Counter(terms(x)) if x is not None else {}
        best = sorted((-(k * math.log(n / df[t])), t) for t, k in c.items() if df[t] > 1)
        if best:
            want.add(("s", i, best[0][1]))
    got = {tuple(x) for x in distinctive.top_term({"s": (table(spark, names), "id", "name")}).collect()}
    assert got == want
    assert distinctive.top_term({"s": (table(spark, []), "id", "name")}).count() == 0
