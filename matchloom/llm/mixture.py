"""Problem 9: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Setting of the session that names the vocabulary file, and the file where it is unset.
SETTING, TOKENIZER = "spark.matchloom.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual split of a text before byte-pair merges, as published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def with_tokens(documents: DataFrame, text: str = "text", tokenizer: str | None = None, out: str = "tokens") -> DataFrame:
    """documents with the number of tokens of the whole text; 0 for a null or empty text. tokenizer: a vocabulary file, or
    the one that the session's SETTING names.

    The vocabulary file (under 2 MB, whatever the corpus) is read on the driver and broadcast."""
    tokenizer = tokenizer or documents.sparkSession.conf.get(SETTING, TOKENIZER)
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    held: dict = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if "e" not in held:
            import base64

            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.value.splitlines() if x)}
            held["e"] = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        return texts.map(lambda t: len(held["e"].encode_ordinary(t)) if t else 0).astype("int64")

    return documents.withColumn(out, count(F.col(text)))


def _chances(rate: float, cap: int) -> list[float]:
    """P(X = k) for k = 0 .. cap - 1, X Poisson with this rate; by logarithms, so that no rate is too high for a float."""
    log_rate = math.log(rate) if rate > 0 else 0.0
    return [math.exp(k * log_rate - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0) for k in range(cap)]


def capped_mean(rate: float, cap: int) -> float:
    """Mean of min(X, cap), X Poisson with this rate."""
    p = _chances(rate, cap)
    return sum(k * x for k, x in enumerate(p)) + cap * max(0.0, 1 - sum(p))


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose draws, capped, have this mean; infinite where even the cap doesn't reach it."""
    if mean <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean:
        lo, hi = hi, hi * 2
        if capped_mean(hi, cap) >= cap * (1 - 1e-12):
            break
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return hi


def draw_table(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k = 0 .. cap - 1: a draw is the number of these that a uniform number reaches."""
    return [0.0] * cap if math.isinf(rate) else list(accumulate(_chances(rate, cap)))


def source_plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of targets: its tokens, target tokens, mean repetition rate wanted, and whether it falls short.

    The size of the mixture is the tokens of all documents, those without a listed source included. A source falls short
    if tokens * max_repeats < target_share * all tokens; a source without documents does. Tokens are summed on the map
    side; targets is a fixed list and is broadcast.
    """
    per = counted.groupBy("source").agg(F.sum("tokens").alias("have"))
    total = per.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("all_tokens"))
    plan = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    plan = plan.join(per, "source", "left").withColumn("have", F.coalesce("have", F.lit(0))).join(F.broadcast(total))
    want = F.col("target_share") * F.col("all_tokens")
    return plan.select("source", "target_share", "max_repeats", "have", "all_tokens", want.alias("target_tokens"), F.when(F.col("have") > 0, want / F.col("have")).alias("rate"), (F.col("have") * F.col("max_repeats") < want).alias("short"))


def replicate(counted: DataFrame, targets: DataFrame, seed: int = 17, doc_id: str = "doc_id") -> DataFrame:
    """The mixture: (doc_id, source, tokens, copy_no, place), each document used at most max_repeats times.

    A document's count inverts a Poisson distribution at a uniform number hashed from seed and doc_id, so any executor
    draws the same again. The distribution's mean, after the cap, is the source's target repetition rate; where that is
    beyond the cap every document is used max_repeats times. place is a hashed global order: the rows are range
    partitioned and sorted by it. Documents of null or unlisted sources aren't used. Only the plan, one row per listed
    source, comes to the driver.
    """
    spark = counted.sparkSession
    tables = [(r.source, draw_table(rate_for(r.rate, r.max_repeats), r.max_repeats)) for r in source_plan(counted, targets).collect() if r.rate is not None and r.source is not None]
    steps = spark.createDataFrame(tables, "source string, steps array<double>")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    drawn = counted.select(doc_id, "source", "tokens").join(F.broadcast(steps), "source").withColumn("u", uniform)
    copies = F.size(F.filter("steps", lambda s: F.col("u") >= s))
    out = drawn.withColumn("copies", copies).where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.select(doc_id, "source", "tokens", "copy_no", F.xxhash64(F.lit(seed + 1), doc_id, "copy_no").alias("place"))
    return out.repartitionByRange("place", doc_id, "copy_no").sortWithinPartitions("place", doc_id, "copy_no")


def shares(counted: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """One row per source of targets: the share asked for, the documents' uses and tokens in the mixture, their share of the
    mixture (the shares add up to 1 unless it is empty), and whether the source falls short: every one of its documents is used
    max_repeats times in the mixture, and still its tokens are fewer than asked for. A source without documents is short."""
    got = replicate(counted, targets, seed).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
    held = counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    out = source_plan(counted, targets).select("source", "target_share", "max_repeats", "target_tokens").join(held, "source", "left").join(got, "source", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "uses", "tokens")})
    whole = out.agg(F.sum("tokens").alias("mixture"))  # one row a listed source; one row is broadcast
    used_up = F.col("uses") == F.col("documents") * F.col("max_repeats")
    return out.join(F.broadcast(whole)).select("source", "target_share", "tokens", "uses", F.try_divide("tokens", "mixture").alias("actual_share"), (used_up & (F.col("tokens") < F.col("target_tokens"))).alias("short"))
