"""Token blocks by brute force, and that their pairs, which may be very many, are never shuffled."""

import math
import random
from collections import Counter

import pytest

from matchloom import queries
from matchloom.operators import block

DATA = "/root/testdata/sf0.001"


def above_join(df):
    """What the plan does with the rows of its last join, by lines."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return plan[: next(i for i, x in enumerate(plan) if "Join" in x)]


def invented(spark, seed, with_state):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(12)]
    name = lambda: " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(0, 5)))
    state = lambda: rng.choice(["OH", "NY", "", None])
    q = [(f"q{rng.randrange(25)}", state(), name()) for _ in range(40)]
    r = [(i, f"e{rng.randrange(30)}", state(), name()) for i in range(50)]
    return q, r, spark.createDataFrame(q, "id string, state string, name_key string"), spark.createDataFrame(r, "rid long, ein string, state string, name_key string")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("by", [[], ["state"]])
@pytest.mark.parametrize("bar", [None, 3.0])
def test_by_tokens_is_brute_force(spark, seed, by, bar):
    q, r, qs, rs = invented(spark, seed, by)
    df = Counter(t for *_, n in r for t in set(n.split()))
    want = set()
    for id, s, n in q:
        for _, ein, z, m in r:
            a, b = Counter(n.split()), Counter(m.split())
            both = [t for t in a if t in b and df[t] <= 40]
            weight = sum(a[t] * b[t] * math.log(len(r) / df[t]) for t in both)
            if both and (not by or s and s == z) and (bar is None or weight >= bar - 1e-9):
                want.add((id, ein))
    found = [tuple(x) for x in block.by_tokens(qs, rs, by, max_ref_freq=40, min_pair_idf=bar, unit="ein", apart=True).collect()]
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("query", ["block_crossstate", "block_token_idf", "screen", "block_token", "block_token_concat"])
def test_pairs_are_not_shuffled(spark, query):
    above = above_join(queries.QUERIES[query](spark, DATA))
    assert not [x for x in above if "Exchange" in x or "Aggregate" in x]
