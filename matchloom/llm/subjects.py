"""Problem 10: subject areas of documents, by complement naive Bayes refined with expectation-maximization.

The unit is the sentence: it is about one of the subjects or about none. Complement naive Bayes, in its one-versus-rest
form (the log share of a word in the class against its share in the complement of the class), is started from labelled
documents, whose sentences can be about their subjects, about none, or in passing about another; each round of
expectation-maximization then reads the sentences of all documents. Words and class sizes are kept apart by language,
since languages would otherwise be the strongest clusters that expectation-maximization finds. A document's subjects are
independent: the posterior of a subject is the probability that at least two sentences are about it, calibrated on the
labelled documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import keep

#: Hashed features: bounds the model (BUCKETS x (subjects + 1) numbers) whatever the vocabulary.
BUCKETS, LABELLED_ROUNDS, ROUNDS, ALPHA = 1 << 18, 2, 4, 1.0
#: Languages with at least this share of the documents are told apart; there are at most 1 / LANGUAGE_SHARE of them.
LANGUAGE_SHARE = 0.01
#: Labelled documents that the calibration reads at most; the rest of the model reads every document.
CALIBRATION_ROWS = 20_000
#: One labelled document in so many calibrates.
HELD = 4
#: What a sentence of a labelled document is about before its words are read: each of its subjects, none, any other.
PRIOR_OWN, PRIOR_NONE, PRIOR_OTHER = 1.0, 0.5, 0.05
_WORD, _STOP = re.compile(r"[^\W\d_]+"), re.compile(r"(?<=[.!?…])\s+")


#: Three-letter codes whose first two letters aren't the two-letter code.
CODES = {"spa": "es", "deu": "de", "ger": "de", "por": "pt", "zho": "zh", "jpn": "ja", "pol": "pl", "swe": "sv", "dut": "nl", "nld": "nl"}


def language_code(lang: Column) -> Column:
    """Two-letter code of a language field: case and regions are dropped, null stays null."""
    low = F.lower(F.trim(lang))
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(codes[F.substring(low, 1, 3)], F.substring(low, 1, 2))


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of the whole text; numbers are left out, case, accents and entities folded."""
    out = []
    for part in _STOP.split(html.unescape(html.unescape(text or ""))):
        folded = unicodedata.normalize("NFKD", part.casefold())
        words = _WORD.findall("".join(c for c in folded if not unicodedata.combining(c)))
        if words:
            out.append(words)
    return out


def bucket(word: str, language: int = 0) -> int:
    return zlib.crc32(word.encode(), language) % BUCKETS


def _sums(df: DataFrame, task, width: int) -> np.ndarray:
    """Adds up what each task of mapInPandas found, one row a bucket; the driver gets a bounded number of rows."""
    sums = df.mapInPandas(task, "word int, n array<double>").groupBy("word").agg(*[F.sum(F.col("n")[c]).alias(f"n{c}") for c in range(width)]).toPandas()
    out = np.zeros((BUCKETS + int(1 / LANGUAGE_SHARE) + 1, width))
    if len(sums):
        out[sums["word"].to_numpy()] = sums[[f"n{c}" for c in range(width)]].to_numpy()
    return out


def language_weights(documents: DataFrame, text: str, lang: str | None) -> np.ndarray:
    """Log shares of each hashed word in each language, 0 for an unseen word, learned from the (partly wrong) language field of all documents."""
    if lang is None:
        return np.zeros((BUCKETS, 1))
    coded = documents.select(F.col(text).alias("t"), language_code(F.col(lang)).alias("l"))
    sizes = coded.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    common = sizes.join(F.broadcast(total)).where(F.col("l").isNotNull() & (F.col("n") >= LANGUAGE_SHARE * F.col("all")))
    languages = sorted(r["l"] for r in common.select("l").collect())
    if len(languages) < 2:
        return np.zeros((BUCKETS, 1))
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS, len(number)))
        for pdf in batches:
            for t, code in zip(pdf["t"], pdf["l"]):
                if code in number:
                    ids = [bucket(w) for s in sentences(t) for w in s]
                    np.add.at(total[:, number[code]], ids, 1.0)
        seen = np.flatnonzero(total.sum(axis=1))
        if len(seen):
            yield pd.DataFrame({"word": seen, "n": list(total[seen])})

    counts = _sums(coded, count, len(languages))[:BUCKETS] + 0.5
    logs = np.log(counts / counts.sum(axis=0, keepdims=True))
    return logs - np.log(0.5 / counts.sum(axis=0, keepdims=True))


def _flat(bags: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all sentences in a row, where each sentence starts, and how many sentences each document has."""
    lists = [s for doc in bags for s in doc]
    per_doc = np.fromiter((len(doc) for doc in bags), dtype=np.int64, count=len(bags))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), per_doc
    starts = np.concatenate([[0], np.cumsum([len(s) for s in lists])[:-1]])
    return np.concatenate([np.asarray(s, dtype=np.int64) for s in lists]), starts, per_doc


def weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Complement naive Bayes, one against the rest: per word, and per language what a word of any kind adds.

    counts: words by classes, and from row BUCKETS on the sizes of the classes in each language."""
    words, sizes = counts[:BUCKETS], counts[BUCKETS:]
    all_words = words.sum(axis=1, keepdims=True)
    a = ALPHA * max(1, int((all_words > 0).sum()))
    smooth = a * all_words / max(1.0, all_words.sum()) + 1e-9
    per_word = np.log(words + smooth) - np.log(all_words - words + smooth)
    all_sizes = sizes.sum(axis=1, keepdims=True)
    share = a * all_sizes / max(1.0, all_sizes.sum()) + 1e-9
    return np.where(all_words > 0, per_word, 0.0), np.log(sizes + share) - np.log(all_sizes - sizes + share)


def posteriors(bags: pd.Series, languages: pd.Series, model: tuple[np.ndarray, np.ndarray], log_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(class) of each sentence. log_prior: one row a document."""
    per_word, per_language = model
    ids, starts, per_doc = _flat(bags)
    if not len(starts):
        return np.zeros((0, per_word.shape[1])), ids, starts, per_doc
    lengths = np.diff(np.append(starts, len(ids)))[:, None]
    of_doc = log_prior, per_language[languages.to_numpy(dtype=np.int64)]
    prior, base = (np.repeat(x, per_doc, axis=0) for x in of_doc)
    score = np.add.reduceat(per_word[ids], starts, axis=0) - lengths * base + prior
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True), ids, starts, per_doc


def at_least_two(p: np.ndarray) -> np.ndarray:
    """Probability, for each class, that two or more of independent sentences (rows) are about it."""
    none, one = np.ones(p.shape[1]), np.zeros(p.shape[1])
    for row in p:
        none, one = none * (1 - row), one * (1 - row) + none * row
    return np.clip(1 - none - one, 0.0, 1.0)


def _prior(labels: pd.Series, k: int) -> np.ndarray:
    """Of each document: labels null: none known, empty: none of the subjects, else the numbers of its subjects."""
    out = np.zeros((len(labels), k + 1))
    for i, own in enumerate(labels):
        if own is None:
            continue
        row = np.full(k + 1, PRIOR_OTHER)
        row[k] = PRIOR_NONE if len(own) else PRIOR_OWN
        row[[int(x) for x in own]] = PRIOR_OWN
        out[i] = np.log(row / row.sum())
    return out


def _packed(model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is broadcast of a model: its rows that aren't 0, in half the width."""
    seen = np.flatnonzero(np.abs(model[0]).sum(axis=1))
    return seen.astype(np.int32), model[0][seen].astype(np.float32), model[1].astype(np.float32)


def _unpacked(packed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    per_word = np.zeros((BUCKETS, packed[1].shape[1]), dtype=np.float32)
    per_word[packed[0]] = packed[1]
    return per_word, packed[2]


def _expected(bags: DataFrame, model: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """One E and M step: expected counts of (word, class) over the documents. Each task adds up its own documents and
    sends one row a word."""
    shared = bags.sparkSession.sparkContext.broadcast(_packed(model))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS + int(1 / LANGUAGE_SHARE) + 1, k + 1))
        own = _unpacked(shared.value)
        for pdf in batches:
            p, ids, starts, per_doc = posteriors(pdf["bag"], pdf["language"], own, _prior(pdf["labels"], k))
            if len(starts):
                lengths = np.diff(np.append(starts, len(ids)))
                np.add.at(total, ids, np.repeat(p, lengths, axis=0))
                np.add.at(total, BUCKETS + np.repeat(pdf["language"].to_numpy(dtype=np.int64), per_doc), p * lengths[:, None])
        seen = np.flatnonzero(total.sum(axis=1))
        if len(seen):
            yield pd.DataFrame({"word": seen, "n": list(total[seen])})

    out = _sums(bags.select("bag", "language", "labels"), add_up, k + 1)
    shared.destroy()
    return out


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y), by Newton's method with smoothed targets and a small ridge."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, design = np.array([1.0, 0.0]), np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        grad = design.T @ (p - t) + 1e-2 * (w - [1.0, 0.0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def subject_posteriors(documents: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, subject, posterior) of every document and subject; the subjects of a document don't compete.

    labels: (doc_id, subject), a null subject says that the document has none of them; labels of unknown documents or
    subjects are ignored, repeated ones count once. lang: a field with language codes, some of them wrong or null, from
    which languages are learned; None: one language. Null and empty texts have posterior 0 for all subjects. Without
    labels nothing can be learned: every posterior is 0.
    """
    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.select("subject").distinct().collect() if r[0] is not None)  # a fixed list
    k = len(names)
    kind = dict(documents.dtypes)[doc_id]
    if not k:
        return spark.createDataFrame([], f"{doc_id} {kind}, subject string, posterior double")
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "subject string, number int")
    known = labels.select(F.col(doc_id), "subject").join(F.broadcast(numbers), "subject", "left").where(F.col("subject").isNull() | F.col("number").isNotNull())
    known = known.groupBy(doc_id).agg(F.sort_array(F.collect_set("number")).alias("labels"))
    table = language_weights(documents, text, lang)
    languages = spark.sparkContext.broadcast(_packed((table, table[:0])))

    @F.pandas_udf("struct<bag array<array<int>>, language int>")
    def bag_of(texts: pd.Series) -> pd.DataFrame:
        bags, numbers = [], []
        table = _unpacked(languages.value)[0]
        for t in texts:
            parts = sentences(t)
            plain = [bucket(w) for s in parts for w in s]
            one = int(table[plain].sum(axis=0).argmax()) if plain else 0
            bags.append([[bucket(w, one + 1) for w in s] for s in parts])
            numbers.append(one)
        return pd.DataFrame({"bag": bags, "language": numbers})

    bags = documents.select(F.col(doc_id), bag_of(F.col(text)).alias("b")).select(doc_id, "b.*").join(known, doc_id, "left")
    bags = keep(bags, "bags")
    model = np.zeros((BUCKETS, k + 1)), np.zeros((int(1 / LANGUAGE_SHARE) + 1, k + 1))
    labelled = keep(bags.where(F.col("labels").isNotNull()), "labelled")
    # the labels of every HELD-th labelled document calibrate and don't teach, if both have every subject
    held = F.pmod(F.xxhash64(doc_id), F.lit(HELD)) == 0
    subject = F.explode("labels")
    enough = all(labelled.where(side).select(subject.alias("c")).distinct().count() == k for side in (held, ~held))
    taught = labelled.where(~held) if enough else labelled
    if enough:
        bags = bags.withColumn("labels", F.when(~held, F.col("labels")))
    for used in [taught] * (1 + LABELLED_ROUNDS) + [bags] * ROUNDS:
        counts = _expected(used, model, k)
        if not counts.any():
            each = F.explode(F.array(*[F.lit(n) for n in names]))
            return bags.select(doc_id, each.alias("subject"), F.lit(0.0).alias("posterior"))
        model = weights(counts)
    shared = spark.sparkContext.broadcast(_packed(model))

    def raw(pdf: pd.DataFrame, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        p, _, _, per_doc = posteriors(pdf["bag"], pdf["language"], own, np.zeros((len(pdf), k + 1)))
        ends = np.cumsum(per_doc)
        return np.array([at_least_two(p[e - n : e, :k]) for e, n in zip(ends, per_doc)]).reshape(len(pdf), k)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _unpacked(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"x": list(_logit(raw(pdf, own))), "labels": pdf["labels"]})

    chosen = (labelled.where(held) if enough else labelled).orderBy(F.xxhash64(doc_id), doc_id).limit(CALIBRATION_ROWS)
    seen = chosen.select("bag", "language", "labels").mapInPandas(sample, "x array<double>, labels array<int>").toPandas()
    x = np.array(seen["x"].tolist())
    curves = [_platt(x[:, c], seen["labels"].map(lambda own, c=c: float(c in list(own))).to_numpy()) for c in range(k)]

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slope, offset = np.array([a for a, _ in curves]), np.array([b for _, b in curves])
        own = _unpacked(shared.value)
        for pdf in batches:
            r = raw(pdf, own)
            p = np.where(r > 0, 1 / (1 + np.exp(-np.clip(_logit(r) * slope + offset, -35, 35))), 0.0)
            yield pd.DataFrame({doc_id: np.repeat(pdf[doc_id].to_numpy(), k), "subject": np.tile(np.array(names, dtype=object), len(pdf)), "posterior": p.ravel()})

    return bags.select(doc_id, "bag", "language").mapInPandas(final, f"{doc_id} {kind}, subject string, posterior double")
