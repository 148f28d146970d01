"""Problem 8: evaluation texts in the training corpus, by a prefix-filtered set join and alignment of item-sized windows."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import keep

#: Words of a shingle (an item of fewer words is one shingle), the least share of an item's shingles that a window must have,
#: and the least share of its words. Half an item, a third of its words edited, still keeps MIN_SHARED of the shingles.
SHINGLE, MIN_SHARED, MIN_WORDS = 3, 0.1, 0.5
#: Index rows up to which the items' side is broadcast (some 30 bytes each); beyond it the join shuffles both sides.
BROADCAST_ROWS = 500_000
_WORD = re.compile(r"[^\W_]+")
#: Hashes of words seen; emptied when full.
_HASHES: dict[str, int] = {}
_MOST = 500_000


def words(text: str | None) -> list[str]:
    """Words as they are compared: entities resolved, case and accents folded, punctuation and spacing ignored."""
    if not text:
        return []
    folded = html.unescape(html.unescape(text)).casefold() if "&" in text else text.casefold()
    if not folded.isascii():
        folded = "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))
    return _WORD.findall(folded)


def _hashed(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    out = []
    for w in words(text):
        h = _HASHES.get(w)
        if h is None:
            if len(_HASHES) >= _MOST:
                _HASHES.clear()
            h = _HASHES[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    return out.view(np.int64)


def shingled(df: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (SHINGLE,)) -> DataFrame:
    """(key, pos, h): a hash of each run of words of the given sizes; a text of fewer words has none. Only hashes leave Python."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def runs(texts: pa.Array) -> pa.Array:
        found = [[shingles(h, k) for k in sizes] for h in map(_hashed, texts.to_pylist())]
        flat = [x for row in found for x in row]
        if len(sizes) > 1:  # a run's position is that of its first word
            found = [np.concatenate([x for pair in ((np.array([len(one)]), one) for one in row) for x in pair]) for row in found]
            flat = found
            ends = np.cumsum([len(x) for x in found])
        else:
            ends = np.cumsum([len(x) for x in flat]) if flat else np.zeros(0)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)))

    own = df.select(key, runs(F.col(text)).alias("h"))
    if len(sizes) == 1:
        return own.select(key, F.posexplode("h").alias("pos", "h"))
    # the list of each size follows its length
    rest, out = own, None
    for _ in sizes:
        one = rest.select(key, F.posexplode(F.slice("h", F.lit(2), F.element_at("h", 1).cast("int"))).alias("pos", "h"))
        out = one if out is None else out.unionByName(one)
        rest = rest.select(key, F.slice("h", F.element_at("h", 1).cast("int") + 2, F.size("h")).alias("h"))
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def alignment(item: list[str], window: list[str], mismatch: float = 1.0, gap: float = 0.5) -> int:
    """Words of the item that the best local alignment matches, in order. A run of unrelated words costs more than the
    odd common phrase brings, so scattered phrases don't add up; left-out or added words cost half a word each."""
    before, best, found = [(0.0, 0)] * (len(window) + 1), 0.0, 0
    for a in item:
        row = [(0.0, 0)]
        for j, b in enumerate(window):
            s, c = before[j]
            here = (s + 1, c + 1) if a == b else (s - mismatch, c)
            up, left = before[j + 1], row[j]
            if up[0] - gap > here[0]:
                here = (up[0] - gap, up[1])
            if left[0] - gap > here[0]:
                here = (left[0] - gap, left[1])
            if here[0] <= 0:
                here = (0.0, 0)
            elif here[0] > best:
                best, found = here
            row.append(here)
        before = row
    return found


def may_reach(item: list[str], window: list[str], need: float) -> bool:
    """Whether an alignment can match need words: no more than both have in common, nor than their longest common
    subsequence (found bit by bit, a word of the window at a time)."""
    places: dict[str, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    seen = [p for w in window if (p := places.get(w))]
    if len(seen) < need:
        return False
    whole = (1 << len(item)) - 1
    v = whole
    for p in seen:
        u = v & p
        v = (v + u | v - u) & whole
    return len(item) - v.bit_count() >= need


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, share): documents that carry at least MIN_WORDS of an item's words as a passage, in order.

    The items' shingles are ordered by rarity in the corpus; a window with at least MIN_SHARED of an item's shingles must
    have one of the rarest (1 - MIN_SHARED) of them, the prefix, so prefixes are joined first and whole items only with the
    documents that are left. Matches are counted in windows of three times the item, stepping by half of that (the
    positional and length bound), all counts by partial sums; windows with enough shingles whose words in common would be
    enough are aligned word by word. A
    document of any length is read whole; one with an item in two places gives one row, with the larger share. An item of
    fewer than SHINGLE words must stand there wholly. Null and empty texts give no rows.
    """
    tests = keep(items.select(F.col(item_id).alias("i"), F.col(text).alias("text"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0), "items")
    lengths = {r[0] for r in tests.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()}  # at most SHINGLE
    if not lengths:
        return documents.select(F.col(doc_id), F.lit(None).cast("long").alias(item_id), F.lit(None).cast("double").alias("share")).limit(0)
    parts = [shingled(tests.where(F.least(F.size("words"), F.lit(SHINGLE)) == k), "i", "text", (k,)) for k in sorted(lengths)]
    index = keep(reduce(DataFrame.unionByName, parts).groupBy("i", "h").agg(F.min("pos").alias("at")), "index")
    index_rows = index.count()
    docs = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("text"))
    corpus = keep(shingled(docs, "d", "text", tuple(sorted(lengths))).join(_small(index.select("h").distinct(), index_rows), "h", "left_semi").select("d", "pos", "h"), "shingles")
    rarity = corpus.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # shingles that no document has come first in the order of rarity
    known = index.join(rarity, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("df", "h"))).join(tests.select("i", F.ceil(F.size("words") * 1.5).cast("int").alias("step")), "i")
    sizes = index.groupBy("i").agg(F.count(F.lit(1)).alias("size"))
    ranked = keep(ranked.join(sizes, "i").withColumn("need", F.ceil(F.col("size") * MIN_SHARED)).where("df > 0"), "ranked")
    prefix = ranked.where("r <= size - need + 1").select("h", "i")
    held = corpus.join(_small(prefix, index_rows), "h").select("d", "i").distinct()
    hits = corpus.join(_small(ranked.select("h", "i", "at", "need", "step"), index_rows), "h").join(held, ["d", "i"], "left_semi")
    own = F.floor(F.col("pos") / F.col("step")).cast("int")
    hits = hits.withColumn("win", F.explode(F.when(own > 0, F.array(own - 1, own)).otherwise(F.array(own))))
    windows = hits.groupBy("d", "i", "win", "need", "step").agg(F.size(F.collect_set("at")).alias("got")).where(F.col("got") >= F.col("need")).select("d", "i", "win", "step")
    windows = keep(windows, "windows")
    parts = windows.join(docs, "d").join(_small(tests.select("i", F.col("words").alias("item")), index_rows), "i")

    @F.pandas_udf("double")
    def share(t: pd.Series, win: pd.Series, step: pd.Series, item: pd.Series) -> pd.Series:
        out, last, own = [], None, []
        for x, k, s, w in zip(t, win, step, item):
            if x is not last and x != last:  # rows are sorted by document: its words are found once
                last, own = x, words(x)
            item, window = list(w), own[k * s : (k + 2) * s]
            need = MIN_WORDS * len(item) if len(item) >= SHINGLE else len(item)
            found = alignment(item, window) if may_reach(item, window, need) else 0
            out.append(found / len(item) if found >= need else 0.0)
        return pd.Series(out, dtype="float64")

    spread = parts.repartition("d", "i").sortWithinPartitions("d")
    found = spread.withColumn("share", share("text", "win", "step", "item")).where(F.col("share") >= MIN_WORDS)
    return found.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.max("share").alias("share"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_of(texts: pd.Series) -> pd.Series:
    return texts.map(words)
