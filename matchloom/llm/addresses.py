"""Postal addresses taken apart: what is written differently for one place is brought to one form."""

from __future__ import annotations

import re
import unicodedata

from ..functions.constants import STATE_CODES

# Postal abbreviations of directions, street types, units and ordinals, with forms that people type.
DIRECTIONS = {
    "N": "N", "NO": "N", "NORTH": "N", "S": "S", "SO": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W",
    "NE": "NE", "NORTHEAST": "NE", "NW": "NW", "NORTHWEST": "NW", "SE": "SE", "SOUTHEAST": "SE", "SW": "SW", "SOUTHWEST": "SW",
}
TYPES = {
    "ST": "ST", "STR": "ST", "STREET": "ST", "AVE": "AVE", "AV": "AVE", "AVENUE": "AVE", "AVEN": "AVE", "RD": "RD", "ROAD": "RD",
    "DR": "DR", "DRV": "DR", "DRIVE": "DR", "LN": "LN", "LA": "LN", "LANE": "LN", "CT": "CT", "CRT": "CT", "COURT": "CT",
    "PL": "PL", "PLACE": "PL", "BLVD": "BLVD", "BOUL": "BLVD", "BOULEVARD": "BLVD", "HWY": "HWY", "HIWAY": "HWY", "HIGHWAY": "HWY",
    "PKWY": "PKWY", "PKY": "PKWY", "PARKWAY": "PKWY", "TER": "TER", "TERR": "TER", "TERRACE": "TER", "CIR": "CIR", "CRCL": "CIR",
    "CIRC": "CIR", "CIRCLE": "CIR", "WAY": "WAY", "WY": "WAY", "SQ": "SQ", "SQUARE": "SQ", "TRL": "TRL", "TRAIL": "TRL",
    "LOOP": "LOOP", "ALY": "ALY", "ALLEY": "ALY", "PLZ": "PLZ", "PLAZA": "PLZ", "PIKE": "PIKE", "RUN": "RUN", "PATH": "PATH",
    "ROW": "ROW", "XING": "XING", "CROSSING": "XING", "EXPY": "EXPY", "EXPRESSWAY": "EXPY", "FWY": "FWY", "FREEWAY": "FWY",
}
ORDINALS = {
    "FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH",
    "EIGHTH": "8TH", "NINTH": "9TH", "TENTH": "10TH", "ELEVENTH": "11TH", "TWELFTH": "12TH",
}
TOWN_WORDS = {"ST": "SAINT", "STE": "SAINTE", "MT": "MOUNT", "FT": "FORT", "N": "NORTH", "NO": "NORTH", "S": "SOUTH", "SO": "SOUTH", "E": "EAST", "W": "WEST"}
UNIT = r"(?:STE|SUITE|APT|APARTMENT|UNIT|RM|ROOM|FL|FLOOR|BLDG|DEPT|LOT)"

_BOX = re.compile(r"(?:^|\b)(?:(?:P\s?O|POST OFFICE)\s?(?:BOX|BX|B)|BOX|BX)\s*(?:#|NO\b)?\s*([0-9]+[A-Z]?)\b")
_UNIT = re.compile(rf"(?:\b{UNIT}\b\s*(?:#|NO\b)?\s*([0-9]+[A-Z]?|[A-Z])\b|#\s*([0-9A-Z]+)\b)")
_LAST_LINE = re.compile(r"^[A-Z]{2}\s*[0-9]{5}(?:\s*-?\s*[0-9]{4})?$|^[0-9]{5}(?:-[0-9]{4})?$")
_TOKEN = re.compile(r"[A-Z0-9]+")
_NUMBER = re.compile(r"[0-9]+[A-Z]?$")


def fold(text: str) -> str:
    """Upper case without accents."""
    if text.isascii():
        return text.upper()
    return "".join(c for c in unicodedata.normalize("NFKD", text.upper()) if not unicodedata.combining(c))


def town(city: str | None) -> str:
    """A city's letters with its abbreviations written out, without blanks; '' if missing."""
    if not city:
        return ""
    return "".join(TOWN_WORDS.get(t, t) for t in _TOKEN.findall(fold(city).replace(".", "")))


def zip5(code: str | None) -> str:
    """The five digits of a postal code; a lost leading zero is restored; '' where there are fewer than 4 digits."""
    if not code:
        return ""
    if len(code) == 5 and code.isdigit():
        return code
    digits = "".join(c for c in code if c.isdigit())
    if len(digits) in (8, 4):
        digits = "0" + digits
    return digits[:5] if len(digits) >= 5 else ""


def street(line: str | None, second: str | None = None) -> tuple[str, str, str, str, str, str]:
    """(kind, number, core, direction, type, unit) of a street line.

    kind: 'X' a post office box, 'B' a building, '' nothing to go by. core: the street's name without blanks, ordinals as
    digits. A care-of part, a building's name, the city line and the unit are left out of it, wherever they stand; the
    number may stand last. Missing parts are ''.
    """
    if not line or not line.strip():
        return "", "", "", "", "", ""
    text = fold(line).replace(".", "").replace("'", "")
    unit = ""
    box = _BOX.search(text)
    if box and not _NUMBER.match(text.split(None, 1)[0].strip(",")):
        return "X", box.group(1).lstrip("0") or "0", "", "", "", ""
    m = _UNIT.search(text)
    if m:
        unit = m.group(1) or m.group(2)
        text = text[: m.start()] + " , " + text[m.end() :]
    elif second:
        m = _UNIT.search(fold(second).replace(".", ""))
        unit = (m.group(1) or m.group(2)) if m else ""
    tokens: list[str] = []
    has_number = has_name = False
    for part in text.split(","):
        part = part.strip()
        if not part or part.startswith(("C/O", "ATTN", "CO ", "%")) or _LAST_LINE.match(part) and (has_number and has_name):
            continue
        own = _TOKEN.findall(part)
        if not own or own[-1] in ("BUILDING", "BLDG", "TOWER", "HALL") and not any(t[0].isdigit() for t in own):
            continue
        if has_number and has_name:
            break
        tokens += own
        has_number = has_number or any(_NUMBER.match(t) for t in own)
        has_name = has_name or any(t.isalpha() and t != "NO" for t in own)
    return ("B", *_street_parts(tokens), unit) if tokens else ("", "", "", "", "", unit)


def _street_parts(tokens: list[str]) -> tuple[str, str, str, str]:
    number = ""
    if len(tokens) > 1 and tokens[0] == "NO" and _NUMBER.match(tokens[1]):
        tokens = tokens[1:]
    if _NUMBER.match(tokens[0]):
        number, tokens = tokens[0], tokens[1:]
    elif len(tokens) > 1 and _NUMBER.match(tokens[-1]):
        number, tokens = tokens[-1], tokens[:-1]
        if len(tokens) > 1 and tokens[-1] == "NO":
            tokens = tokens[:-1]
    number = number.lstrip("0")
    direction = ""
    if len(tokens) > 2 and tokens[0] in "NS" and tokens[1] in "EW":
        tokens = [tokens[0] + tokens[1], *tokens[2:]]
    if len(tokens) > 1 and tokens[0] in DIRECTIONS and not (len(tokens) == 2 and tokens[1] in TYPES):
        direction, tokens = DIRECTIONS[tokens[0]], tokens[1:]
    elif len(tokens) > 1 and tokens[-1] in DIRECTIONS:
        direction, tokens = DIRECTIONS[tokens[-1]], tokens[:-1]
    kind = ""
    if len(tokens) > 1 and tokens[-1] in TYPES:
        kind, tokens = TYPES[tokens[-1]], tokens[:-1]
    return number, "".join(ORDINALS.get(t, t) for t in tokens), direction, kind


def state(field: str | None) -> str:
    """Two-letter code of a state field, given as code or name with dots, blanks or in any case; '' if it is neither."""
    if not field:
        return ""
    s = " ".join(field.upper().replace(".", "").split())
    return STATE_CODES.get(s) or (s if s in _STATES else "")


_STATES = frozenset(STATE_CODES.values())
