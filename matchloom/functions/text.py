"""Normalization of names, streets, postal codes and states as column expressions; everything stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _folding() -> tuple[str, str]:
    """Letters with accents and what they become: made from the decomposition of Latin letters, one for one."""
    pairs = []
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and plain[0].isascii():
            pairs.append((chr(code), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def basic_clean(c: Column) -> Column:
    """Upper case without accents and punctuation, '&' written out, single blanks. An eszett becomes a blank, null ''."""
    folded = F.translate(F.upper(F.replace(F.coalesce(c, F.lit("")), F.lit("ß"), F.lit(" "))), _FROM, _TO)
    return squish(F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" AND ")), "[^A-Z0-9 ]", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def replace_tokens(c: Column, table: dict[str, str]) -> Column:
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(lookup(table, t), t)), " ")


def name_full(c: Column) -> Column:
    return replace_tokens(basic_clean(c), K.ABBREVIATIONS)


def name_key(full: Column) -> Column:
    """The full name without the legal forms at its end and one THE at its start; never blanked by that."""
    bare = F.trim(F.regexp_replace(full, f"(?:(?:^| )(?:{'|'.join(K.LEGAL_SUFFIXES)}))+$", ""))
    bare = F.when(bare == "", full).otherwise(bare)
    return F.regexp_replace(bare, "^THE (.+)$", "$1")


def name_form(full: Column) -> Column:
    last = F.try_element_at(F.filter(tokens(full), lambda t: t.isin(K.LEGAL_SUFFIXES)), F.lit(-1))
    return F.coalesce(lookup(K.CANONICAL_FORMS, last), last)


def generation(full: Column) -> Column:
    return F.try_element_at(F.filter(tokens(full), lambda t: t.isin(list(K.GENERATIONS))), F.lit(1))


def joined_or_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.array_join(array, " "))


def numbers(full: Column) -> Column:
    return joined_or_null(F.array_sort(F.regexp_extract_all(full, F.lit("[0-9]+"), F.lit(0))))


def mapped_tokens(full: Column, table: dict[str, str]) -> Column:
    """The distinct values of the tokens that the table has, sorted as strings and joined; null if there are none."""
    hits = F.filter(F.transform(tokens(full), lambda t: lookup(table, t)), lambda v: v.isNotNull())
    return joined_or_null(F.array_sort(F.array_distinct(hits)))


def street_unit(raw: Column) -> Column:
    unit = F.regexp_extract(F.upper(raw), K.UNIT_PATTERN, 0)
    return squish(F.when(unit != "", unit))


def street_key(raw: Column) -> Column:
    """The street in postal short forms without its unit; any spelling of a post office box becomes 'PO BOX n'."""
    plain = squish(replace_tokens(F.regexp_replace(basic_clean(raw), K.UNIT_DROPPED, " "), K.STREET_WORDS))
    return F.when(plain.rlike(K.BOX_PATTERN), F.concat(F.lit("PO BOX "), F.regexp_extract(plain, "[0-9]+", 0))).otherwise(plain)


_NUMBER = "^[0-9]+[A-Z]?(-[0-9]+[A-Z]?)?"


def street_parts(key: Column) -> dict[str, Column]:
    """Number, name and type of a street key; for a box its number, 'PO BOX' and null."""
    box = key.rlike(r"\bBOX\b")
    number = F.when(box, F.regexp_extract(key, r"BOX\s*#?\s*([0-9]+)", 1)).otherwise(F.regexp_extract(key, _NUMBER, 0))
    rest = squish(F.regexp_replace(key, _NUMBER, ""))
    last = F.regexp_extract(rest, "([^ ]+)$", 1)
    typed = last.isin(K.STREET_TYPES)
    body = F.when(typed, F.regexp_replace(rest, " ?[^ ]+$", "")).otherwise(rest)
    return {
        "street_num": F.when(number != "", number), "street_name": F.when(box, F.lit("PO BOX")).when(body != "", body),
        "street_type": F.when(~box & typed, last),
    }


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def pad_left(c: Column, width: int) -> Column:
    """Zeros before c up to width; longer values stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def zip_parts(code: Column, plus4: Column) -> dict[str, Column]:
    """zip5, zip3 and zip9 of a postal code: over five digits the last four are the add-on, else plus4 is; zeros restored."""
    d, p = digits(code), digits(plus4)
    n = F.length(d)
    base = F.when(n > 5, F.substring(d, F.lit(1), n - 4)).otherwise(d)
    z5 = F.when(n > 0, pad_left(F.substring(base, 1, 5), 5))
    add_on = F.when(n > 5, F.substring(d, n - 3, F.lit(4))).when(F.length(p) > 0, pad_left(F.substring(p, 1, 4), 4))
    return {"zip5": z5, "zip3": F.substring(z5, 1, 3), "zip9": F.concat(z5, F.lit("-"), add_on)}


def state_code(c: Column) -> Column:
    s = F.upper(squish(c))
    return F.when(s.isin(sorted(set(K.STATE_CODES.values()))), s).otherwise(lookup(K.STATE_CODES, s))
