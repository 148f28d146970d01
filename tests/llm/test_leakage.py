import random

from matchloom.llm import leakage

R = random.Random(11)
VOCAB = [a + b for a in ("lor", "ips", "dol", "sit", "ame", "con", "sec", "adi") for b in ("em", "um", "or", "et", "it", "us", "an", "il")]


def passage(n):
    return [R.choice(VOCAB) for _ in range(n)]


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, x in items:
            own = leakage.words(x)
            run = any(w[k : k + len(own)] == own for k in range(len(w)))
            if own and (leakage.alignment(own, w) / len(own) >= 0.5 if len(own) >= 3 else run):
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    items = [(i, " ".join(passage(R.randint(30, 70)))) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (93, "Straße, ÉTÉ &amp; co " * 8)]
    docs = []
    for d in range(60):
        w = passage(R.randint(0, 60))
        if d % 3 == 0:
            own = leakage.words(items[d % 12][1])
            part = own[: len(own) * R.choice([1, 3, 6, 8, 10]) // 10]
            for k in range(7, len(part), 9):
                part[k] = "edited"
            w = w + part + passage(20)
        docs.append((d, " ".join(w).upper() if d % 2 else ",\n ".join(w)))
    docs += [(100, None), (101, ""), (102, "strasse ete & CO " * 8), (103, " ".join(passage(3000)) + " " + items[3][1] + " " + " ".join(passage(3000))), (104, items[5][1]), (105, items[5][1])]
    kind = "doc_id long, text string, words string, i long"
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], kind)
    it = spark.createDataFrame([(i, t, "x", 2) for i, t in items], "item_id long, text string, words string, d long")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it).collect()}
    assert got == brute(docs, items) and {(103, 3), (104, 5), (105, 5), (102, 93)} <= got


def test_short_items_and_edited_halves(spark):
    """Items of 15 to 25 words of which the first half or more stands in a document with a third of it edited, and items under three words."""
    items = [(i, " ".join(passage(15 + i % 11))) for i in range(40)] + [(80, "Quintessence unbound"), (81, "zymurgy")]
    docs = []
    for i, t in items[:40]:
        own = leakage.words(t)
        part = own[: max(len(own) * 2 // 3, 8)]
        for k in range(3, len(part), 4):
            part[k] = "edited"
        docs.append((i, " ".join(passage(30) + part + passage(30))))
    docs += [(200, "So: QUINTESSENCE, unbound!"), (201, "quintessence is unbound"), (202, "Some zymurgy here"), (203, "some"), (204, " ".join(passage(4000)))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, x in items:
            own = leakage.words(x)
            run = any(w[k : k + len(own)] == own for k in range(len(w)))
            if run if len(own) < leakage.SHINGLE else leakage.alignment(own, w) / len(own) >= 0.5:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it).collect()}
    assert got == want and {(200, 80), (202, 81)} <= got and sum(d == i for d, i in got) >= 20


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert leakage.leaks(df, it).count() == 1 and leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0
