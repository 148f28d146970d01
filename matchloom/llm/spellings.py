"""Problem 6: spellings of the same name of the same organisation, by a pigeonhole segment join.

Names are taken apart (names.py); what is usual in names is compared as whole words, what is peculiar to one, its core,
letter by letter. Distinct forms are blocked by usual words and numbers with a locality or a house number, so different
kinds of bodies, ordinals and lodge numbers are never compared. In a block, cores are cut into k + 1 segments, shifted
substrings are looked up in the index of segments, and what is found is verified by a banded edit distance. A core joins
the best supported spelling that is reached from it.

Equal names are not yet one organisation: namesakes are told apart by evidence. Records of one name in a state belong
together if they share the owner's key, a house or box number, or the town; a name that is only the town's own needs one
of the first two. What is left apart is joined where a name stands in two clusters that different sources know, if the
chance of a namesake in the state is small.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import drop, keep
from .addresses import state, town, zip5
from .components import components
from .names import LEGAL, name_form, town_core, unfinished

#: Namesakes that may be expected in a state, if the words of names were independent, up to which two clusters are joined.
MOST_NAMESAKES = 0.2
#: Towns written without state and postal code up to which their usual states are broadcast.
TOWNS = 100_000
#: A width is one at which a source cuts names off if it has SPIKE times as many names as the widths around it.
SPIKE, WIDEST = 1.3, 400
_NUMBER = re.compile(r"(?<![0-9A-Za-z#])([0-9]{1,12})[A-Za-z]?(?![0-9A-Za-z])")
_LAST_LINE = re.compile(r",\s*[A-Za-z]{2}\s+[0-9]{5}(?:-[0-9]{4})?\s*$")
PARTS = ["usual", "short", "nums", "core", "turned", "initials", "base", "last", "zip", "town", "state", "cut", "ordered", "numbers", "other_zip"]
_SEP = "\x1f"
_OTHER = {"line": "string", "other_line": "string", "other_postcode": "string", "side": "string"}


#: Cores of at least so many letters may lie two edits apart, if something else says that they are the same name (names.allowed).
TWO_EDITS = 5


def _looked_up(edits: int) -> list[tuple[int, int, int, int]]:
    """(edits, longer, segment, shift): where a core looks for the segments of another one that has so many letters more, as
    names.probe_keys does. A segment that doesn't exist is the letters around the middle, for two that changed places."""
    k, out = edits, []
    for longer in range(-k, k + 1):
        for i in range(k + 1):
            out += [(k, longer, i, shift) for shift in range(max(-i, -longer - (k - i)), min(i, -longer + (k - i)) + 1)]
    return out


_HOLE = (1, 0, 2, 0)
_INDEX = {True: [(k, 0, i, 0) for k in (1, 2) for i in range(k + 1)], False: [(1, 0, 0, 0), (1, 0, 1, 0), _HOLE]}


def segment_keys(cores: DataFrame, index: bool) -> DataFrame:
    """cores (block, nid, sure, core) with key instead of core and block: hashes of the block and a segment, the keys of names.index_keys or else
    of names.probe_keys, for cores of at least three letters."""
    rows = lambda keys: F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(key, ("k", "longer", "i", "shift"))]) for key in keys])
    if index:
        keys = F.when(F.col("sure"), rows(_INDEX[True])).otherwise(rows(_INDEX[False]))
    else:
        one = _looked_up(1)
        keys = F.when(~F.col("sure"), rows([*one, _HOLE])).when(F.length("core") >= TWO_EDITS, rows(_looked_up(2))).otherwise(rows(one))
    at = cores.select("block", "nid", "sure", "core", F.length("core").alias("n"), F.explode(keys).alias("x")).select("block", "nid", "sure", "core", "n", "x.*")
    at = at.withColumn("size", F.expr("n + longer")).where("size > k + 1 and (i <= k or n > 3)")
    at = at.withColumns({"q": F.expr("size div (k + 1)"), "short": F.expr("k + 1 - size % (k + 1)")})
    at = at.withColumns({"start": F.expr("cast(q * i + greatest(0, i - short) + shift as int)"), "len": F.expr("cast(q + if(i >= short, 1, 0) as int)")})
    at = at.where("i > k or start between 0 and n - len")
    part = F.expr("if(i <= k, substring(core, start + 1, len), concat(substring(core, 1, cast(q as int) - 1), '.', substring(core, cast(q as int) + 2)))")
    return at.select(F.xxhash64("block", "k", "size", "i", part).alias("key"), "nid", "sure")


@lru_cache(200_000)
def _town(city: str) -> tuple[str, str]:
    return town(city), town_core(city)


@lru_cache(10_000)
def _state(field: str) -> str:
    return state(field)


def house_numbers(line: str) -> set[str]:
    """The numbers of a street line (house, box, unit; a unit hardly ever equals another address's house). Ordinals and the postal
    code at the line's end are none."""
    if "," in line:
        line = _LAST_LINE.sub("", line)
    return {x.lstrip("0") or "0" for x in _NUMBER.findall(line)} if line else set()


def cut_widths(records: DataFrame) -> dict[str, int]:
    """side -> the width at which its names are cut off, where the lengths of its names have a spike. One row a length of at most WIDEST
    letters comes to the driver."""
    n = records.select("side", F.length(F.trim("name")).alias("w")).where(f"w between 1 and {WIDEST}").groupBy("side", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["side"], r["w"]): r["n"] for r in n.collect()}
    out = {}
    for (side, w), k in counts.items():
        around = [counts.get((side, w + d), 0) for d in (-4, -3, -2, 2, 3, 4)]
        usual = sum(around) / len(around)
        if k >= SPIKE * usual and k - usual > 8 * usual**0.5 + 8 and k > counts.get((side, out.get(side)), 0):
            out[side] = w
    return out


def parsed(records: DataFrame, cut_at: dict[str, int] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """records (rec, owner, name, city, region, postcode, line, other_line, other_postcode, side) with the parts of name and
    locality, the numbers of the addresses and the columns in also. Control characters count as blanks. Null and blank names, and names without any word or number, are left out."""
    some = records.where(F.length(F.trim("name")) > 0)
    widths = cut_widths(some) if cut_at is None else cut_at

    # one string goes to Python and one comes back: columns of their own would cost more than the parsing
    @F.arrow_udf(T.StringType())
    def parts(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            a, b, c, d, line, other, code, side = row.split(_SEP)
            here, own = _town(b)
            w = widths.get(side)
            cut = w is not None and w - 1 <= len(a.strip()) <= w and unfinished(a)
            form = name_form(a, cut, own)
            # a town's name that stands before the rest is also looked up behind it
            ordered = form[3][len(own) :] + own if own and form[3].startswith(own) else ""
            numbers = " ".join(house_numbers(line) | house_numbers(other) if other else house_numbers(line))
            out.append(_SEP.join((*form, zip5(d), here, _state(c), "1" if cut else "", ordered, numbers, zip5(code))))
        return pa.array(out, pa.string())

    # else the filter below is moved before it, with a copy of it, and every name is taken apart twice
    parts = parts.asNondeterministic()

    text = [F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(_SEP), F.lit(" ")) for c in ("name", "city", "region", "postcode", "line", "other_line", "other_postcode", "side")]
    out = some.select("rec", F.xxhash64("owner").alias("owner"), F.xxhash64("name").alias("raw"), F.xxhash64("side").alias("side"), *[c for c in also], F.split(parts(F.concat_ws(_SEP, *text)), _SEP).alias("p"))
    out = out.select("rec", "owner", "raw", "side", *also, *[F.col("p")[i].alias(c) for i, c in enumerate(PARTS)])
    numbers = F.when(F.col("numbers") != "", F.split("numbers", " ").cast("array<bigint>")).otherwise(F.array().cast("array<bigint>"))
    return out.where(F.concat("usual", "nums", "core") != "").withColumns({"cut": F.col("cut") != "", "numbers": numbers})


def localised(own: DataFrame) -> DataFrame:
    """own with loc, a hash of the usual town of the postal code or else of the own town (null without either), near, both
    of them, other_loc, the usual town of the other postal code, and region, the own state or else the usual one of the postal
    code's first digits or of the town. There are at most 100,000 postal codes and 1000 beginnings of one: their towns
    and states are broadcast, those of towns without both only up to TOWNS of them."""
    counts = keep(own.groupBy("zip", "town", "state").agg(F.count(F.lit(1)).alias("n")), "towns")
    known = F.when((F.col("town") != "") & (F.col("state") != ""), F.struct("n", "town", "state"))
    by_zip = keep(counts.where("zip != ''").groupBy("zip").agg(F.max(known).alias("m")).where("m is not null").select("zip", F.xxhash64("m.town", "m.state").alias("zip_loc")), "zips")
    begins = counts.where("state != '' and zip != ''").groupBy(F.substring("zip", 1, 3).alias("z3"), "state").agg(F.sum("n").alias("k"))
    begins = begins.groupBy("z3").agg(F.max_by("state", F.struct("k", "state")).alias("usual_state"))
    bare = counts.where("state = '' and zip = '' and town != ''").select("town").distinct()
    in_state = counts.where("state != '' and town != ''").join(bare, "town").groupBy("town", "state").agg(F.sum("n").alias("k")).groupBy("town").agg(F.max_by("state", F.struct("k", "state")).alias("town_state"))
    in_state = keep(in_state.select(F.col("town").alias("bare_town"), "town_state"), "bare-towns")
    in_state = F.broadcast(in_state) if in_state.count() <= TOWNS else in_state
    f = own.withColumn("z3", F.substring("zip", 1, 3)).join(F.broadcast(by_zip), "zip", "left").join(F.broadcast(begins), "z3", "left")
    f = f.join(F.broadcast(by_zip.select(F.col("zip").alias("other_zip"), F.col("zip_loc").alias("other_loc"))), "other_zip", "left")
    f = f.withColumn("bare_town", F.when((F.col("state") == "") & (F.col("zip") == ""), F.col("town")).otherwise(F.concat(F.lit("."), "rec"))).join(in_state, "bare_town", "left")
    region = F.when(F.col("state") != "", F.col("state")).otherwise(F.coalesce("usual_state", "town_state", F.concat(F.lit("?"), "town", "zip")))
    f = f.withColumn("region", region)
    at_home = F.when(F.col("town") != "", F.xxhash64("town", "region")).when(F.col("zip") != "", F.xxhash64("zip"))
    f = f.withColumn("loc", F.coalesce("zip_loc", at_home)).withColumn("near", F.array_distinct(F.array_compact(F.array("zip_loc", at_home))))
    return f.drop("z3", "other_zip", "zip_loc", "usual_state", "bare_town", "town_state")


def completed(own: DataFrame) -> DataFrame:
    """(nid, best): the full name that a cut-off one stands for, where its locality has one, or its state for a long beginning.
    Place and beginning of the name are joined as one hash."""
    begins = [F.when(F.col("loc").isNotNull(), F.xxhash64("loc", F.substring("flat", 1, 16))), F.when(F.length("flat") >= 24, F.xxhash64("region", F.substring("flat", 1, 22)))]
    some = own.where(F.length("flat") >= 16).select("nid", "flat", "last", "cut", F.explode(F.array_compact(F.array(*begins))).alias("key"))
    cut = some.where("cut").select("key", F.col("nid"), F.substring("flat", F.lit(1), F.length("flat") - F.length("last")).alias("base"), "last").distinct()
    keys = cut.select("key").distinct()
    full = some.where("not cut").join(keys, "key", "left_semi").groupBy("key", F.col("nid").alias("best")).agg(F.first("flat").alias("flat"), F.count(F.lit(1)).alias("n"))
    j = cut.join(full, "key").where((F.col("nid") != F.col("best")) & F.startswith("flat", "base"))
    rest = F.expr("substring(flat, length(base) + 1)")
    legal = F.exists(F.array(*[F.lit(x) for x in sorted(LEGAL)]), lambda w: F.startswith(w, F.col("last")))
    ok = j.where(F.when((F.col("last") == "") | (rest == ""), ((F.col("last") == "") & (rest != "")) | ((F.col("last") != "") & legal)).otherwise(F.startswith(rest, F.col("last"))))
    return ok.groupBy("nid").agg(F.max_by("best", F.struct("n", -F.length("flat"), "flat")).alias("best"))


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _distance(a: Column, b: Column) -> Column:
    """Edits between two strings, two letters that changed places being one; 9 if there are more than three."""
    apart = F.size(F.filter(F.zip_with(_letters(a), _letters(b), lambda x, y: x != y), lambda x: x))
    swapped = (F.length(a) == F.length(b)) & (apart == 2) & (F.array_sort(_letters(a)) == F.array_sort(_letters(b)))
    d = F.levenshtein(a, b, 3)
    return F.when(d < 0, 9).when((d == 2) & swapped, 1).otherwise(d)


def corrected(names: DataFrame, blocks: DataFrame) -> DataFrame:
    """(nid, best): the best supported name that is reached from a name over neighbours, where it isn't the name itself.

    names: (nid, cores, turned, n), a name in a state with the orders its core is written in and its number of records
    everywhere. blocks: (block, nid, sure), sure where names in the block share a house number: there two edits may lie
    between them (two letters that changed places are one), elsewhere one, and none in cores of under five letters.
    """
    blocks = keep(blocks.groupBy("block", "nid").agg(F.max("sure").alias("sure")), "blocks")
    several = blocks.groupBy("block").agg((F.min("nid") != F.max("nid")).alias("several")).where("several").select("block")
    at = blocks.join(several, "block")
    # what is shuffled by key are hashes only, and found pairs fetch their letters
    keyed = keep(at.join(names.select("nid", "cores"), "nid").select("block", "sure", "nid", F.explode("cores").alias("core")).where("length(core) > 2"), "keyed")
    index = segment_keys(keyed, True).select("key", F.col("nid").alias("to_id"))
    probe = segment_keys(keyed, False)
    pairs = probe.join(index, "key").where("nid != to_id").groupBy("nid", "to_id").agg(F.max("sure").alias("sure"))
    j = pairs.join(names, "nid").join(names.select(F.col("nid").alias("to_id"), F.col("cores").alias("to_cores"), F.col("turned").alias("to"), F.col("n").alias("to_n")), "to_id")
    j = j.where(F.struct("to_n", "to", "to_id") > F.struct("n", "turned", "nid"))
    j = j.withColumn("far", F.array_min(F.flatten(F.transform("cores", lambda a: F.transform("to_cores", lambda b: _distance(a, b))))))
    small = F.least(F.length("turned"), F.length("to"))
    j = j.where((F.col("far") == 1) & (F.col("sure") | (small >= 5)) | F.col("sure") & ((F.col("far") == 2) & (small >= 5) | (F.col("far") == 3) & (small >= 7)))
    step = keep(j.groupBy("nid").agg(F.max_by("to_id", F.struct("to_n", "to", "to_id")).alias("best")), "spellings")
    drop(blocks, keyed)
    # a better spelling may have one of its own: every round halves the way to the end
    while True:
        further = step.alias("a").join(step.select(F.col("nid").alias("best"), F.col("best").alias("next")).alias("b"), "best", "left")
        new = keep(further.select("nid", F.coalesce("next", "best").alias("best"), F.col("next").isNotNull().alias("moved")), "spellings")
        moved = new.where("moved").limit(1).count()
        drop(step)
        step = new.drop("moved")
        if not moved:
            return step


def _shown(prefix: str) -> list[Column]:
    """usual (a hash: it is only told apart from here on), plain, person (there is a given name or an initial) and initials."""
    found = {"usual": F.xxhash64("usual"), "plain": F.col("usual") == F.col("short"), "person": F.rlike("short", F.lit("[\u0400-\u04ff]")), "initials": F.col("initials")}
    return [c.alias(prefix + name) for name, c in found.items()]


def state_names(own: DataFrame) -> DataFrame:
    """own with name, the id of the name that a record shows in its state, after completion and correction, and kind and best, hashes of
    the usual words and of the core of that name. own: the records with the parts of their names, nid, loc, near, region."""
    written = F.concat_ws("\x1f", "core", F.when(F.col("ordered") != "", F.col("ordered")))
    names = own.groupBy("nid").agg(F.collect_set(written).alias("w"), F.first("turned").alias("turned"), F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"),
                                   *[F.max(F.struct(c, F.lit(0)))[c].alias(c) for c in ("usual", "short", "initials")])
    names = keep(names.withColumn("cores", F.array_distinct(F.flatten(F.transform("w", lambda x: F.split(x, "\x1f"))))).drop("w"), "state-names")
    door = F.transform("numbers", lambda x: F.struct(F.xxhash64(x, "kind", "region").alias("block"), F.lit(True).alias("sure")))
    near = F.transform("near", lambda x: F.struct(F.xxhash64(x, "kind").alias("block"), F.lit(False).alias("sure")))
    lost = F.when(F.col("loc").isNull(), F.array(F.struct(F.xxhash64("region", "kind").alias("block"), F.lit(False).alias("sure")))).otherwise(F.array().cast("array<struct<block bigint, sure boolean>>"))
    blocks = own.select("nid", F.explode(F.concat(near, lost, door)).alias("b")).select("b.block", "nid", "b.sure")
    whole = keep(completed(own), "completed")
    right = corrected(names.select("nid", "cores", "turned", "n"), blocks)
    # a completed name may be misspelt, or a misspelt one cut off: completion counts first
    right = whole.alias("w").join(right.alias("r"), F.col("w.best") == F.col("r.nid"), "left").select("w.nid", F.coalesce("r.best", "w.best").alias("best")).unionByName(right.join(whole, "nid", "left_anti"))
    to = names.select(F.col("nid").alias("best"), F.xxhash64("turned").alias("better"), F.col("kind").alias("new_kind"), *_shown("new_"))
    right = right.join(to, "best").join(whole.select("nid", F.lit(True).alias("completed")), "nid", "left").drop("best")
    f = own.select("rec", "owner", "raw", "side", "numbers", "other_loc", "loc", "region", "nid", "kind", "towns_own", *_shown(""), F.xxhash64("turned").alias("as_is")).join(right, "nid", "left")
    whole_now = lambda c: F.when(F.col("completed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    f = f.select("rec", "owner", "raw", "side", "numbers", "other_loc", "loc", "region", "towns_own", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("better", "as_is").alias("best"), *[whole_now(c) for c in ("usual", "plain", "person", "initials")])
    f = keep(f.withColumn("g", F.xxhash64("kind", "region", "best")), "corrected-names")
    rest = f.where("not person").withColumn("name", F.xxhash64("g", "usual", "initials")).drop("g", "usual", "initials", "plain", "person")
    p = f.where("person").drop("person")

    def filled(df: DataFrame, value: str, is_known: Column, by: list[str]) -> DataFrame:
        """df with value taken over, where it isn't known, from the commonest known one of the same name in its town, or else in its state."""
        seen = df.where(is_known).groupBy(*by, "loc", value).agg(F.count(F.lit(1)).alias("k"))
        in_town = seen.groupBy(*by, "loc").agg(F.max(F.struct("k", value))[value].alias("in_town"))
        in_state = seen.groupBy(*by, value).agg(F.sum("k").alias("k")).groupBy(*by).agg(F.max(F.struct("k", value))[value].alias("in_state"))
        open_ = df.where(~is_known).join(in_town, [*by, "loc"], "left").join(in_state, by, "left").withColumn(value, F.coalesce("in_town", "in_state", value)).drop("in_town", "in_state")
        return df.where(is_known).unionByName(open_)

    # a given name's mere initial joins the commonest full name it can stand for, a name without initials the commonest with them
    p = filled(p, "usual", ~F.col("plain"), ["g"])
    p = filled(p, "initials", F.col("initials") != "", ["g", "usual"])
    return rest.unionByName(p.withColumn("name", F.xxhash64("g", "usual", "initials")).drop("g", "usual", "initials", "plain"))


def namesakes(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, expected) of the wanted names: how many other towns of its state would hold a name if its core and its usual words
    were independent, by all other names. names: (name, kind, best, region, loc)."""
    held = keep(names.select("name", "kind", "best", "region", "loc").distinct(), "held")
    every = held.agg(F.count(F.lit(1)).alias("every"))  # one row is broadcast
    out = held.join(wanted.select("name"), "name").groupBy("name").agg(*[F.first(c).alias(c) for c in ("kind", "best", "region")], F.count(F.lit(1)).alias("own"))
    for c in ("kind", "best", "region"):
        out = out.join(held.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias(f"{c}_n")), c)
    others = [F.col(f"{c}_n") - F.col("own") for c in ("kind", "best")]
    return out.join(F.broadcast(every)).select("name", (others[0] * others[1] * F.col("region_n") / F.col("every") / F.col("every")).alias("expected"))


def told_apart(named: DataFrame) -> DataFrame:
    """(rec, owner, raw, org) of the records with their names in a state (what state_names gives), divided into organisations.

    A name in one town that isn't the town's own is one organisation; the records of other names are clustered by what they
    share. Two clusters are joined where each is known to one source only and to another one, and either the name is the
    town's own or few namesakes are expected.
    """
    per = named.groupBy("name").agg(F.min("loc").alias("a"), F.max("loc").alias("z"), F.count(F.when(F.col("loc").isNull(), 1)).alias("lost"), F.max("towns_own").alias("towns_own"))
    per = per.where((F.col("a") != F.col("z")) | (F.col("lost") > 0) | F.col("towns_own")).select("name", "towns_own")
    r = keep(named.select("rec", "owner", "raw", "side", "name", "loc", "other_loc", "numbers").join(per, "name", "left"), "named-records")
    closed = r.where(F.col("towns_own").isNull()).select("rec", "owner", "raw", F.col("name").alias("org"))
    some = r.where(F.col("towns_own").isNotNull()).withColumn("v", F.xxhash64("name", "owner"))
    in_towns = F.when(F.col("towns_own"), F.array().cast("array<bigint>")).otherwise(F.array_compact(F.array("loc", "other_loc")))
    keys = F.concat(F.transform("numbers", lambda x: F.xxhash64("name", F.lit("at"), x)), F.transform(in_towns, lambda x: F.xxhash64("name", F.lit("in"), x)))
    clustered = keep(some.join(components(some.select("v", F.explode_outer(keys).alias("key"))), "v").select("rec", "owner", "raw", "side", "name", "towns_own", "comp"), "clusters")
    by_comp = clustered.groupBy("name", "comp").agg(F.min("side").alias("side"), F.max("side").alias("other"), F.max("towns_own").alias("towns_own"))
    pairs = by_comp.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.min("side").alias("s"), F.max("side").alias("t"), F.count(F.when(F.col("side") != F.col("other"), 1)).alias("mixed"), F.max("towns_own").alias("towns_own"))
    pairs = keep(pairs.where("k = 2 and mixed = 0 and s != t").select("name", "towns_own"), "two-clusters")
    joined = pairs.join(namesakes(named, pairs), "name").where(F.col("towns_own") | (F.col("expected") <= MOST_NAMESAKES)).select("name", F.lit(True).alias("one"))
    split = clustered.join(joined, "name", "left").select("rec", "owner", "raw", F.when(F.col("one"), F.col("name")).otherwise(F.xxhash64("name", "comp")).alias("org"))
    return closed.unionByName(split)


def named(records: DataFrame, cut_at: dict[str, int] | None = None) -> DataFrame:
    """(rec, owner, raw, org) of every name record; owner and raw are hashes of the owner's key and the name as stored.

    records: (rec, owner, name, city, region, postcode) and, where known, line (the street), other_line and other_postcode
    (of another address of the owner) and side (the source that the record is from). owner is the key that the record
    already has. cut_at: side -> width at which it cuts names off; learned where not given. Null and blank names are left out.
    """
    records = records.withColumns({c: F.lit(None).cast(t) for c, t in _OTHER.items() if c not in records.columns})
    parsed_names = keep(parsed(records.withColumn("side", F.coalesce("side", F.lit(""))), cut_at), "names")
    own = localised(parsed_names).withColumns({
        "flat": F.concat("base", "last"), "kind": F.xxhash64("short", "nums"), "nid": F.xxhash64("short", "nums", "turned", "region"),
        "towns_own": (F.col("core") == "") | F.contains("town", "core"),
    }).drop("zip", "town", "state", "base")
    in_state = keep(state_names(own), "names-in-state")
    drop(parsed_names)
    return told_apart(in_state)


def same_name(records: DataFrame, cut_at: dict[str, int] | None = None) -> DataFrame:
    """(name_a, name_b): pairs of records that spell one name of one organisation in different ways and don't share their
    owner; name_a < name_b."""
    own = keep(named(records, cut_at), "named")
    a, b = own.alias("a"), own.alias("b")
    on = (F.col("a.org") == F.col("b.org")) & (F.col("a.rec") < F.col("b.rec")) & (F.col("a.raw") != F.col("b.raw")) & (F.col("a.owner") != F.col("b.owner"))
    return a.join(b, on).select(F.col("a.rec").alias("name_a"), F.col("b.rec").alias("name_b"))
