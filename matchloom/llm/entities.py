"""Problem 5: registrations and registry entries of the same organisation, without a common key.

Both sides are reduced to distinct names in their towns. Candidates share a key of MinHash signatures across the attributes:
a band of the core's signature with the usual words and the town, or with a house number and the state, or the whole name
in a state. Names are compared once for each pair of names, owners by what their addresses share; a logistic classifier learns
these features from weak and hand labels, and its probabilities are calibrated on hand labels that it hasn't seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import drop, keep
from .spellings import _distance, localised, parsed
from .subjects import _platt

#: Bands of a core's signature and minima of each; how many of the bands are looked up with a house number.
BANDS, ROWS, WITH_NUMBER = 7, 2, 6
#: Pairs of each weak class that the classifier is fitted on at most, and hand-labelled pairs for it and its calibration.
SAMPLE, HAND_SAMPLE = 20_000, 50_000
#: Letters of cores that are hashed at once.
LETTERS = 100_000
_SEP = "\x1f"
_PRIME = (1 << 31) - 1
#: How alike two names are: equal but for one edit; near (NEAR of the letters); the same core with most of the usual words
#: (WORDS of them); or neither.
NEAR, WORDS = 0.7, 0.6
ALIKE = ("equal", "near", "words")
CELLS = [f"{name}_{place}" for name in ALIKE for place in ("number", "town", "towns_own", "far")]
FEATURES = ["word_overlap", "same_zip", "same_state", *CELLS, *[f"{c}_rival" for c in CELLS if not c.endswith("number")], "far_namesakes"]


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(7)
    return r.randint(1, _PRIME, BANDS * ROWS).astype(np.int64), r.randint(0, _PRIME, BANDS * ROWS).astype(np.int64)


def minima(cores: list[str]) -> np.ndarray:
    """The MinHash minima over the pairs of letters of each name's core, the last and the first being neighbours. Every pair is hashed once."""
    a, b = _hashers()
    ids: dict[str, int] = {}
    at, starts = [], []
    for core in cores:
        starts.append(len(at))
        ring = core + core[:1]
        at += [ids.setdefault(ring[i : i + 2], len(ids)) for i in range(len(core) or 1)]
    h = np.fromiter((zlib.crc32(g.encode()) & _PRIME for g in ids), dtype=np.int64, count=len(ids))
    return np.minimum.reduceat(((h[:, None] % _PRIME) * a + b).__mod__(_PRIME)[at], starts, axis=0)


def _few(cores: list[str]) -> Iterator[list[str]]:
    """cores in parts of some LETTERS letters, so that long ones don't fill the memory."""
    part, n = [], 0
    for core in cores:
        part.append(core)
        n += len(core) + 1
        if n >= LETTERS:
            yield part
            part, n = [], 0
    if part:
        yield part


@F.arrow_udf(T.ArrayType(T.LongType()))
def signature(cores: pa.Array) -> pa.Array:
    """BANDS hashes of ROWS minima each."""
    out, size = [], 8 * ROWS
    for part in _few(cores.to_pylist()):
        for low in minima(part):
            raw = low.tobytes()
            out += [zlib.crc32(raw[size * i : size * (i + 1)], i) for i in range(BANDS)]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, BANDS, dtype=np.int32)), pa.array(out, pa.int64()))


def profiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(is_left, key, o, nid, core, ordered, short, usual, nums, initials, loc, other_loc, region, zip, numbers, towns_own) of the records of both
    sides; o is a name in its town; repeated records change nothing. Records with a null key and those without a name are left out."""
    def records(df: DataFrame, side: str) -> DataFrame:
        text = ["name", "city", "region", "postcode", "line", "other_line", "other_postcode"]
        own = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in text]
        return df.where(F.col("owner").isNotNull()).select(F.lit("").alias("rec"), "owner", F.col("owner").alias("key"), F.lit(side).alias("side"), *own)

    both = records(left, "left").unionByName(records(right, "right"))
    own = keep(parsed(both, None, ("key",)).drop("rec", "raw", "owner").withColumn("rec", F.xxhash64("key", "turned").cast("string")), "profiles")
    f = localised(own).withColumn("nid", F.xxhash64("short", "nums", "turned", "region", F.when(F.col("cut"), F.col("last"))))
    f = f.withColumns({"o": F.xxhash64("nid", "loc"), "kind": F.xxhash64("short", "nums"), "is_left": F.col("side") == F.xxhash64(F.lit("left")), "towns_own": (F.col("core") == "") | F.contains("town", "core")})
    out = keep(f.select("is_left", "key", "o", "nid", "kind", "usual", "short", "nums", "core", "ordered", "turned", "initials", "base", "last", "cut", "loc", "other_loc", "region", "zip", "numbers", "towns_own"), "located-profiles")
    drop(own)
    return out


def candidates(p: DataFrame) -> DataFrame:
    """(lo, ro): pairs of names in towns, one of each side, that share a key. Names with different numbers share none; a name
    without a core is looked up by its usual words."""
    said = F.when(F.col("turned") != "", F.col("turned")).otherwise(F.col("short"))
    towns = F.array_distinct(F.array_compact(F.array("loc", "other_loc")))
    near = F.flatten(F.transform(towns, lambda t: F.transform("sig", lambda x, i: F.xxhash64(F.lit("in"), i, x, t, F.col("kind")))))
    far = F.when(F.col("region") != "", F.array(F.xxhash64(F.lit("of"), "nid"))).otherwise(F.array().cast("array<bigint>"))
    door = F.flatten(F.transform("numbers", lambda n: F.transform(F.slice("sig", 1, WITH_NUMBER), lambda x, i: F.xxhash64(F.lit("at"), i, x, n, F.col("region"), F.col("nums")))))

    def keyed(side: Column, o: str) -> DataFrame:
        at = p.where(side).select("o", "nid", "kind", "loc", "other_loc", "region", "numbers", F.xxhash64("nums").alias("nums"), signature(said).alias("sig"))
        return at.select(F.col("o").alias(o), F.explode(F.concat(near, far, door)).alias("key"))

    # a repeated record repeats its keys, which only the distinct pairs forget: one shuffle less
    return keyed(F.col("is_left"), "lo").join(keyed(~F.col("is_left"), "ro"), "key").select("lo", "ro").distinct()


def names_compared(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """(lo, ro, equal, near, words, word_overlap, likeness): the pairs of names with how alike they are. equal: the same usual
    words, numbers and initials with a core at most one edit apart, or one is the other cut off; near: with most of its letters; words: such a core with most of the usual words."""
    names = p.groupBy("o").agg(*[F.first(c).alias(c) for c in ("usual", "short", "nums", "core", "ordered", "turned", "initials", "base", "last", "cut")])
    own = names.select("o", "base", "last", "cut", F.array_distinct(F.array("core", F.when(F.col("ordered") != "", F.col("ordered")).otherwise(F.col("core")))).alias("cores"), "turned", "usual", "short", "nums", "initials")
    a, b = (own.select(*[F.col(c).alias(f"{s}_{c}") for c in own.columns]) for s in "ab")
    j = pairs.join(a, F.col("lo") == F.col("a_o")).join(b, F.col("ro") == F.col("b_o"))
    x, y = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    words = lambda c: F.filter(F.split(c, ""), lambda w: w != "")
    shared, union = F.size(F.array_intersect(words(x("short")), words(y("short")))), F.size(F.array_union(words(x("short")), words(y("short"))))
    same_words = (x("usual") == y("usual")) | ((x("short") == y("short")) & ((x("usual") == x("short")) | (y("usual") == y("short"))))
    kept = same_words & (x("nums") == y("nums")) & ~((x("initials") != "") & (y("initials") != "") & (x("initials") != y("initials")))
    # a cut-off name equals those that begin with it
    flat = lambda s: F.concat(f"{s}_base", f"{s}_last")
    begins = lambda s, t: F.col(f"{s}_cut") & F.startswith(flat(t), F.col(f"{s}_base")) & ((flat(t) == F.col(f"{s}_base")) | F.startswith(F.expr(f"substring(concat({t}_base, {t}_last), length({s}_base) + 1)"), F.col(f"{s}_last")))
    begun = begins("a", "b") | begins("b", "a")
    overlap = F.when(union == 0, 1.0).otherwise(shared / union)
    j = j.withColumns({"kept": kept | begun, "begun": begun, "word_overlap": overlap})
    looked_at = F.col("kept") | (F.col("word_overlap") >= WORDS) & (x("nums") == y("nums"))
    far = F.when((x("turned") == y("turned")) | F.col("begun"), 0).when(looked_at, F.array_min(F.flatten(F.transform(x("cores"), lambda c: F.transform(y("cores"), lambda d: _distance(c, d)))))).otherwise(9)
    j = j.select("lo", "ro", "kept", "word_overlap", far.alias("far"), F.greatest(F.length(x("turned")), F.length(y("turned")), F.lit(1)).alias("most"), F.least(F.length(x("turned")), F.length(y("turned"))).alias("least"))
    one = (F.col("far") == 0) | (F.col("far") == 1) & (F.col("least") >= 5)
    likeness = F.when(F.col("far") < 9, F.greatest(F.lit(0.0), 1 - F.col("far") / F.col("most"))).otherwise(0.0)
    j = j.withColumns({"equal": F.col("kept") & one, "likeness": likeness})
    return j.select("lo", "ro", "equal", (F.col("kept") & ~one & (F.col("likeness") >= NEAR)).alias("near"), (~F.col("kept") & one & (F.col("least") >= 5) & (F.col("word_overlap") >= WORDS)).alias("words"), "word_overlap", "likeness")


def compared(named: DataFrame, p: DataFrame) -> DataFrame:
    """FEATURES of each pair of owners whose names are alike, and of a sample of those whose names are not (unlike), as numbers from 0 to 1.

    rival: the pair shares no number, and one of its owners has another candidate that it shares more with. far_namesakes: of a pair
    without a number or a town in common, how many namesakes the state has if kinds and cores of names were independent."""
    alike = F.col("equal") | F.col("near") | F.col("words")
    unlike = named.where(~alike).orderBy(F.xxhash64("lo", "ro"), "lo", "ro").limit(SAMPLE)
    named = named.where(alike).withColumn("unlike", F.lit(False)).unionByName(unlike.withColumn("unlike", F.lit(True)))
    cols = ["key", "loc", "other_loc", "region", "zip", "numbers", "towns_own"]
    l, r = (p.where(w).select("o", *cols).select(F.col("o").alias(o), *[F.col(c).alias(f"{s}_{c}") for c in cols]) for w, o, s in (("is_left", "lo", "a"), ("not is_left", "ro", "b")))  # noqa: E741
    j = named.join(l, "lo").join(r, "ro")
    towns = lambda s: F.array_compact(F.array(f"{s}_loc", f"{s}_other_loc"))
    number = F.arrays_overlap("a_numbers", "b_numbers")
    town = F.coalesce(F.arrays_overlap(towns("a"), towns("b")), F.lit(False))
    place = F.when(number, 3).when(town & ~F.col("a_towns_own") & ~F.col("b_towns_own"), 2).when(town, 1).otherwise(0)
    num = lambda c: F.when(c, 1.0).otherwise(0.0)
    how = F.when(F.col("equal"), 3).when(F.col("near"), 2).when(F.col("words"), 1).otherwise(0)
    # of two owners' pairs of names the best counts: where it lies, then how alike the names are
    best = F.struct((~F.col("unlike")).alias("ok"), place.alias("place"), how.alias("how"), "likeness", "word_overlap", num((F.col("a_zip") == F.col("b_zip")) & (F.col("a_zip") != "")).alias("same_zip"), num(F.col("a_region") == F.col("b_region")).alias("same_state"), "ro")
    j = keep(j.groupBy(F.col("a_key").alias("left_key"), F.col("b_key").alias("right_key")).agg(F.max(best).alias("m")).select("left_key", "right_key", "m.*").withColumn("level", F.when(F.col("ok"), F.col("place") * 4 + F.col("how")).otherwise(-1)), "owners")
    own, other = (j.groupBy(k).agg(F.max("level").alias(b)) for k, b in (("left_key", "left_best"), ("right_key", "right_best")))
    j = j.join(own, "left_key").join(other, "right_key")
    held = keep(p.select("nid", "kind", F.xxhash64("turned").alias("core"), "region", "loc").distinct().groupBy("nid", "kind", "core", "region").agg(F.count(F.lit(1)).alias("n")), "held")
    per = {c: held.groupBy(c).agg(F.sum("n").cast("double").alias(f"{c}_n")) for c in ("kind", "core", "region")}
    every = held.agg(F.sum("n").alias("every"))  # one row is broadcast
    distant = j.where("ok and place = 0").select("ro").distinct().join(p.where("not is_left").groupBy(F.col("o").alias("ro")).agg(F.first("nid").alias("nid")), "ro").join(held, "nid")
    for c, counts in per.items():
        distant = distant.join(counts, c)
    others = [F.greatest(F.lit(0.0), F.col(f"{c}_n") - F.col("n")) for c in ("kind", "core")]
    distant = distant.join(F.broadcast(every)).select("ro", F.least(F.lit(1.0), F.log1p(10 * others[0] * others[1] * F.col("region_n") / F.col("every") / F.col("every")) / 5).alias("namesakes"))
    j = j.join(distant, "ro", "left")
    rival = (F.col("place") < 3) & (F.greatest("left_best", "right_best") > F.col("level"))
    cells = {}
    for h, name in ((3, "equal"), (2, "near"), (1, "words")):
        for k, at in enumerate(("far", "towns_own", "town", "number")):
            here = F.col("ok") & (F.col("how") == h) & (F.col("place") == k)
            cells[f"{name}_{at}"] = num(here)
            if at != "number":
                cells[f"{name}_{at}_rival"] = num(here & rival)
    cells["far_namesakes"] = F.when(F.col("ok") & (F.col("place") == 0), F.coalesce("namesakes", F.lit(0.0))).otherwise(0.0)
    return j.withColumns(cells).select("left_key", "right_key", *FEATURES, (~F.col("ok")).alias("unlike"))


def weak_label() -> Column:
    """1 where names agree but for one edit and the addresses share a number; 0 where names aren't alike; else null."""
    return F.when(F.col("equal_number") == 1, 1.0).when(F.col("unlike"), 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one is the offset) of a ridge logistic regression, by Newton's method."""
    design = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(design.shape[1]), ridge * np.eye(design.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        grad = design.T @ (w * (p - y)) + penalty @ beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def match(left_records: DataFrame, right_records: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(left_key, right_key, confidence) of every candidate pair of owners with names that are alike: the calibrated probability
    that they are the same.

    Records: (owner, name) and, where known, city, region, postcode, line (the street), other_line and other_postcode (of another
    address of the owner). Several records an owner; repeated ones count once; null owners and names give no row. labels:
    (left_key, right_key), hand labels, right_key null where the left owner has no counterpart; may be missing or empty,
    the weak labels then calibrate as well. The labels of a third of the labelled owners, by a hash, calibrate, the others
    teach. Empty sides give no rows. Only samples of bounded size reach the driver.
    """
    p = profiles(left_records, right_records)
    found = keep(candidates(p), "candidates")
    named = keep(names_compared(found, p), "compared-names")
    drop(found)
    pairs = keep(compared(named, p), "compared")
    drop(p, named)
    pairs = pairs.withColumn("weak", weak_label()).withColumn("at", F.xxhash64("left_key", "right_key"))
    sample = None
    for y in (0.0, 1.0):
        one = pairs.where(F.col("weak") == y).orderBy("at").limit(SAMPLE).select(*FEATURES, "weak")
        sample = one if sample is None else sample.unionByName(one)
    taught = sample.toPandas()
    x, y = taught[FEATURES].to_numpy(dtype=float), taught["weak"].to_numpy(dtype=float)
    hand_x, hand_y, held = np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0, dtype=bool)
    if labels is not None:
        # a pair of a labelled owner is right if its counterpart is the one named; another counterpart with an equal name
        # and number may be a second key of the same organisation and says nothing
        known = pairs.join(labels.select("left_key", F.col("right_key").alias("right_one")).distinct(), "left_key")
        right_one = F.col("right_one").eqNullSafe(F.col("right_key"))
        known = known.where(right_one | F.col("right_one").isNull() | (F.col("equal_number") == 0)).withColumn("y", F.when(right_one, 1.0).otherwise(0.0))
        hand = known.withColumn("held", F.pmod(F.xxhash64("left_key"), F.lit(3)) == 0).orderBy("at").limit(HAND_SAMPLE).select(*FEATURES, "y", "held").toPandas()
        hand_x, hand_y, held = hand[FEATURES].to_numpy(dtype=float), hand["y"].to_numpy(dtype=float), hand["held"].to_numpy(dtype=bool)
    if not len(x) and not len(hand_x):
        return pairs.select("left_key", "right_key", F.lit(0.0).alias("confidence")).limit(0)
    # hand labels together weigh as much as the weak ones
    heavy = len(x) / max(1, (~held).sum()) if len(hand_x) and len(x) else 1.0
    beta = fit_logistic(np.vstack([x, hand_x[~held]]), np.concatenate([y, hand_y[~held]]), np.concatenate([np.ones(len(x)), np.full(int((~held).sum()), heavy)]))
    cal_x, cal_y = (hand_x[held], hand_y[held]) if len(np.unique(hand_y[held])) == 2 else (x, y)
    slope, offset = _platt(np.column_stack([cal_x, np.ones(len(cal_x))]) @ beta, cal_y)
    raw = F.lit(float(beta[-1]))
    for f, b in zip(FEATURES, beta):
        raw = raw + F.lit(float(b)) * F.col(f)
    return pairs.where("not unlike").select("left_key", "right_key", (1 / (1 + F.exp(-(F.lit(slope) * raw + F.lit(offset))))).alias("confidence"))
