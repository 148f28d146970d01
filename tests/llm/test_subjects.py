import random

import numpy as np

from matchloom.llm import subjects

R = random.Random(2)
WORDS = {("en", s): [f"{s}{k}" for k in range(14)] for s in ("law", "music")} | {("de", s): [f"d{s}{k}" for k in range(14)] for s in ("law", "music")}
PLAIN = {"en": [f"plain{k}" for k in range(14)], "de": [f"einfach{k}" for k in range(14)]}
GLUE = {"en": ["the", "of", "near"], "de": ["der", "bei", "und"]}


def sentence(lang, s):
    return " ".join(R.choices(WORDS[lang, s] if s else PLAIN[lang], k=3) + R.choices(GLUE[lang], k=3)).capitalize() + "."


def corpus(n):
    docs, truth = [], {}
    for i in range(n):
        lang = R.choice(["en", "de"])
        own = R.choice([[], ["law"], ["music"], ["law", "music"]])
        parts = [s for s in own for _ in range(R.randint(2, 3))] + [None] * R.randint(1, 3)
        if R.random() < 0.3:
            parts.append(next((s for s in ("law", "music") if s not in own), None))
        R.shuffle(parts)
        docs.append((i, " ".join(sentence(lang, s) for s in parts), R.choice([lang, lang, lang.upper(), None])))
        truth[i] = set(own)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(900)
    labels = [(i, s) for i in range(0, 200) for s in (truth[i] or {None})] + [(3, next(iter(truth[3] or {None}))), (10**6, "law"), (5, "unheard of")]
    odd = [(2000, None, None), (2001, "", "en"), (2002, sentence("en", "law") * 2000, "en")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs + odd], "doc_id long, text string, lang string, bag string, language int")
    out = subjects.subject_posteriors(df, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([("law",), ("music",)], "subject string")).collect()
    assert len(out) == 2 * (900 + 3) and all(0 <= r["posterior"] <= 1 for r in out)
    got = {(r["doc_id"], r["subject"]) for r in out if r["posterior"] >= 0.5}
    want = {(i, s) for i in range(200, 900) for s in truth[i]}
    held = {g for g in got if 200 <= g[0] < 900}
    assert len(held & want) / len(want) > 0.95 and len(held & want) / len(held) > 0.95
    assert not {g for g in got if g[0] in (2000, 2001)}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b.", "en")], "doc_id long, text string, lang string")
    none, s = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("law",)], "subject string")
    assert [tuple(r) for r in subjects.subject_posteriors(df, none, s).collect()] == [(1, "law", 0.0)]
    assert subjects.subject_posteriors(df.limit(0), none, s).count() == 0 and subjects.subject_posteriors(df, none, s.limit(0)).count() == 0


def test_two_or_more():
    p = np.array([[0.9, 0.0], [0.8, 1.0], [0.1, 1.0]])
    brute = sum(np.prod([q if b else 1 - q for q, b in zip(p[:, 0], bits)]) for bits in np.ndindex(2, 2, 2) if sum(bits) >= 2)
    assert np.allclose(subjects.at_least_two(p), [brute, 1.0]) and np.allclose(subjects.at_least_two(np.zeros((0, 2))), 0)
