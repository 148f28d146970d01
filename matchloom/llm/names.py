"""Names of organisations taken apart: what is written differently in one name is brought to one form."""

from __future__ import annotations

import re

from .addresses import ORDINALS, fold

# Words usual in names of organisations, each with the forms that stand for it.
WORDS = {
    "ACADEMY": "ACAD", "ADMINISTRATION": "ADMIN", "AGENCY": "AGCY", "AID": "", "ALLIANCE": "", "ALUMNI": "ALUM", "AMERICAN": "AMER", "ANIMAL": "",
    "AREA": "", "ARTS": "ART", "ASSEMBLY": "", "ASSOCIATION": "ASSOC ASSN ASSO ASSOCIATES", "AUTHORITY": "AUTH", "AUXILIARY": "AUX AUXIL", "BANK": "",
    "BAPTIST": "BAPT", "BOARD": "BD", "BOOSTER": "BOOSTERS", "BROTHERHOOD": "BHD", "BUILDING": "BLDG", "CARE": "", "CENTER": "CTR CNTR CENTRE CENT",
    "CHAPTER": "CHAP CHPT CHPTR", "CHARITABLE": "CHAR CHARIT", "CHILD": "CHILDREN CHILDRENS", "CHURCH": "CH CHRCH CHUR", "CIRCLE": "CIR",
    "CITY": "", "CLUB": "CLB", "COLLEGE": "COLL", "COMMITTEE": "COMMITTE CMTE", "COMMUNITY": "COMM COMMUN CMNTY CMTY", "CONSERVATION": "CONSERV CONS",
    "COOPERATIVE": "COOP", "COUNCIL": "CNCL COUN", "COUNTY": "CNTY CTY", "DEPARTMENT": "DEPT DEP DPT", "DEVELOPMENT": "DEV DEVEL DVLPMT", "DISTRICT": "DIST DISTR",
    "EDUCATION": "ED EDUC EDUCATIONAL", "EMERGENCY": "EMERG EMER", "ENDOWMENT": "ENDOW", "FAMILY": "FAM FAMILIES", "FIRE": "", "FOOD": "", "FORT": "FT",
    "FOUNDATION": "FDN FNDN FOUND FNDTN", "FRIENDS": "FR FRNDS FRIEND", "FUND": "FND", "GARDEN": "GDN GARDENS GDNS", "GOSPEL": "", "GRANGE": "",
    "GUILD": "GLD", "HEALTH": "HLTH", "HISTORICAL": "HIST HISTORIC HISTL", "HOSPITAL": "HOSP", "HOUSING": "HSG", "INSTITUTE": "INST INSTIT",
    "INTERNATIONAL": "INTL", "LAKE": "LK", "LEAGUE": "LGE LEAG", "LEARNING": "LRNG", "LEGAL": "", "LIBRARY": "LIB LIBR", "LITTLE": "", "LOCAL": "LOC LCL",
    "LODGE": "LDG", "LUTHERAN": "LUTH", "MANAGEMENT": "MGMT MGT", "MEDICAL": "MED", "MEMORIAL": "MEM MEML", "METHODIST": "METH", "METROPOLITAN": "METRO METROP",
    "MINISTRIES": "MINISTRY MINS MIN", "MISSION": "MSN MISS", "MOUNT": "MT", "MUSEUM": "MUS", "MUSIC": "", "NATIONAL": "NATL NAT", "NEIGHBORHOOD": "NBHD NEIGHBOURHOOD NHD",
    "NEW": "", "NORTH": "N NO", "ORDER": "ORD", "ORGANIZATION": "ORG ORGANISATION", "OUTREACH": "", "PARTNERSHIP": "", "POST": "PST", "PRESBYTERIAN": "PRESB PRES", "RECOVERY": "RECOV",
    "REGIONAL": "REGL REG", "RESCUE": "RESC", "RIVER": "RIV", "RURAL": "", "SAINT": "ST", "SCHOLARSHIP": "SCHOL SCHLRSHP", "SCHOOL": "SCH", "SENIOR": "SR SENIORS", "SERVICES": "SERVICE SERV SVCS SVC SRVCS", "SHELTER": "SHLTR",
    "SISTERS": "", "SOCIETY": "SOC SOCY", "SOUTH": "S SO", "THEATER": "THEATRE THTR", "TRADES": "TRADE", "TRAIL": "TRL", "UNION": "UN", "UNITED": "UNTD", "UNIVERSITY": "UNIV", "VALLEY": "VLY VAL",
    "VETERANS": "VETERAN VETS VET", "WATER": "WTR", "WEST": "W", "EAST": "E", "WOMENS": "WOMEN WOMANS WOMAN", "WORKFORCE": "WKFORCE", "YOUTH": "YTH", "COVENANT": "COV", "BETHEL": "",
}
# Given names with their short and pet forms; names that share one (Ted, Pat) stand together.
GIVEN = {
    "ANTHONY": "", "ANTONIO": "TONY", "BARBARA": "BARB BABS", "CHARLES": "CHAS CHUCK CHARLIE", "CHRISTOPHER": "CHRIS", "DANIEL": "DAN DANNY", "DAVID": "DAVE", "DOROTHY": "DOT DOTTIE DOLLY",
    "EDWARD": "EDW ED EDDIE NED TED THEODORE THEO TEDDY", "ELEANOR": "NELL ELLIE NORA", "ELIZABETH": "ELIZ LIZ BETTY BETH LIZZIE", "FRANCIS": "", "FRANCISCO": "PACO FRANK PANCHO", "FREDERICK": "FRED FREDK FREDDY", "GEORGE": "GEO",
    "GUADALUPE": "LUPE", "JAMES": "JAS JIM JIMMY", "JOHN": "JACK JNO", "JOSEPH": "JOS JOE", "KATHERINE": "KATE KATHY KAY KATIE", "MARGARET": "MAGGIE PEGGY MARGE MEG", "MICHAEL": "MIKE MICH",
    "PATRICIA": "PAT PATTY TRISH PATRICK", "PETER": "PETE", "RICHARD": "DICK RICH RICK", "ROBERT": "ROBT ROB BOB BOBBY", "SAMUEL": "SAM", "STEPHEN": "STEVE", "SUSAN": "SUE SUSIE",
    "THOMAS": "THOS TOM TOMMY", "WILLIAM": "WM WILL BILL BILLY",
}
LEGAL = set("INC INCORPORATED INCORP CORP CORPORATION CORPN CO COMPANY LLC LC LTD LIMITED TR TRUST LP LLP PLLC PC".split())
DROPPED = set("THE OF AND A AN FOR DE LA EL".split())
#: Words after which a postal-style RICK, TED and the like could be a family name are not looked at: a pet name counts only first.
_FORMS = {w: w for w in WORDS} | {short: w for w, forms in WORDS.items() for short in forms.split()}
_PET = {w: w for w in GIVEN} | {short: w for w, forms in GIVEN.items() for short in forms.split()}
_ORDINAL = {v: k for k, v in ORDINALS.items()} | {k: k for k in ORDINALS}
_CODE = {w: chr(0x100 + i) for i, w in enumerate([*WORDS, *GIVEN, *ORDINALS])}
_TOKEN = re.compile(r"[A-Z0-9]+")
_BLANKED = bytes(i if re.match("[A-Z0-9]", chr(i)) else 32 for i in range(256))
#: A core of more letters is its own rotation, so that no name costs the square of its length; it is compared in order.
LONG_CORE = 400


def _near() -> dict[str, str]:
    """Deletion neighbourhood of the long usual words: every such word with one letter left out, where that is unambiguous."""
    out: dict[str, str] = {}
    for w in [*_CODE, *(x for x in LEGAL if len(x) >= 7)]:
        if len(w) >= 5:
            for k in range(len(w) + 1):
                cut = w[:k] + w[k + 1 :]
                out[cut] = w if out.get(cut, w) == w else ""
    return out


_NEAR = _near()


#: What tokens were found to be; tokens repeat, so most are looked up here. Emptied when full.
_SEEN: dict[str, tuple[str, str, str, str]] = {}
_SEEN_MOST = 200_000


def _token(t: str) -> tuple[str, str, str, str]:
    """(what, sign, short sign, word) of a token wherever it stands. what: 'D' dropped, 'L' legal form, 'N' number, 'W' a usual
    word, 'I' a single letter, 'C' part of the core."""
    if t in DROPPED:
        return "D", "", "", ""
    if t in LEGAL:
        return "L", "", "", ""
    if t.isdigit():
        return "N", t.lstrip("0"), "", t
    w = t if t in GIVEN else _looked_up(t)
    if w in LEGAL:
        return "L", "", "", ""
    if w:
        return "W", _CODE[w], _initial_sign(w[0]) if w in GIVEN else _CODE[w], w
    return ("I" if len(t) == 1 else "C"), t, "", t


def _looked_up(token: str) -> str | None:
    """The usual word that a token stands for: one of its forms, or the word with one letter wrong, missing or added."""
    w = _FORMS.get(token) or _ORDINAL.get(token)
    if w or len(token) < 5:
        return w
    if token in _CODE:
        return token
    w = _NEAR.get(token)
    if w:
        return w
    for k in range(len(token)):
        w = _NEAR.get(token[:k] + token[k + 1 :])
        if w and abs(len(w) - len(token)) <= 1:
            return w
    return None


def mended(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252 is read again."""
    if "Ã" in text or "Â" in text:
        for code in ("latin-1", "cp1252"):
            try:
                return text.encode(code).decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                pass
    return text


_PERSONAL_WORDS = {"CHARITABLE", "FAMILY", "MEMORIAL", "SCHOLARSHIP", "FOUNDATION", "FUND"}
_PERSONAL = frozenset(t for t, w in _FORMS.items() if w in _PERSONAL_WORDS)


def _initial_sign(letter: str) -> str:
    return chr(0x400 + ord(letter))


def _tokens(text: str) -> list[str]:
    return text.encode().translate(_BLANKED).decode().split() if text.isascii() else _TOKEN.findall(text)


def turned(word: str) -> str:
    """The first in order of a word's rotations: what stays the same when its end is put first, however it is split."""
    n = len(word)
    if not 1 < n <= LONG_CORE:
        return word
    # it begins with the first letter in order
    letter, twice = min(word), word + word
    at = word.find(letter)
    best = twice[at : at + n]
    while (at := word.find(letter, at + 1)) > 0:
        best = min(best, twice[at : at + n])
    return best


def name_form(name: str | None, cut: bool = False, town: str = "") -> tuple[str, str, str, str, str, str, str, str]:
    """(usual, short, numbers, core, turned_core, initials, base, last) of a name.

    usual: one sign for each usual word (type of body, given name, ordinal), sorted; short: the same with given names
    reduced to their initials; base: all words written out in order, but the last, which is last (to complete names that
    were cut off); numbers: its numbers, sorted; core:
    the letters of all other words in their order; turned_core: the first of the core's rotations; initials: its single letters, sorted. Legal forms and articles are dropped, a part after a comma is put first, accents and mangled
    encodings are undone. All are '' for a null or blank name. cut: the name is unfinished, so that a last word that
    begins a legal form counts as one. town: the core of the town's name, before which a letter is a direction.
    """
    if not name or not name.strip():
        return "", "", "", "", "", "", "", ""
    text = fold(mended(name)).replace("'", "").replace("’", "").replace("&", " AND ")
    if "," in text:
        parts = [w for w in map(_tokens, text.split(",")) if w and not all(x in LEGAL or len(x) == 1 and x in "LCP" for x in w)]
        tokens = parts[0] if parts else []
        if len(parts) > 1:
            tail = [w for p in parts[1:] for w in p]
            # the legal form at the end belongs to the whole name
            while tail and tail[-1] in LEGAL:
                tail.pop()
            tokens = tail + tokens
    else:
        tokens = _tokens(text)
    if "U" in tokens:
        tokens = ["UNIVERSITY" if t == "U" and _FORMS.get(n) == "FOUNDATION" else t for t, n in zip(tokens, [*tokens[1:], ""])]
    merged = tokens
    if "NO" in tokens or "L" in tokens:
        merged, i = [], 0
        while i < len(tokens):
            if tokens[i] == "L" and tokens[i : i + 3] == ["L", "L", "C"]:
                i += 3
            elif tokens[i] == "NO" and i + 1 < len(tokens) and tokens[i + 1].isdigit():
                i += 1
            else:
                merged.append(tokens[i])
                i += 1
    usual, short, numbers, core, initials, flat = [], [], [], [], [], []
    seen = False
    # in a person's name the first given name counts, or else the first single letter, wherever it stands
    person = not _PERSONAL.isdisjoint(merged)
    given = letter = None
    heading: set[int] = set()
    if person:
        # ED before a letter or after OF is a given name, else it stands for education; a letter before the town's name is its direction
        given = next((i for i, t in enumerate(merged) if t in _PET and (t != "ED" or merged[i - 1 : i] == ["OF"] or any(len(x) == 1 for x in merged[i + 1 : i + 2]))), None)
        heading = {i for i, t in enumerate(merged[:-1]) if town and t in "NSEW" and town.startswith(merged[i + 1])}
        if given is None and len(merged) > 2:
            letter = next((i for i, t in enumerate(merged) if len(t) == 1 and t.isalpha() and i not in heading), None)
    partial = len(merged) - 1 if cut and len(merged) > 2 and any(x.startswith(merged[-1]) for x in LEGAL) else None
    plain = not person and not cut
    for i, t in enumerate(merged):
        found = _SEEN.get(t)
        if found is None:
            if len(_SEEN) >= _SEEN_MOST:
                _SEEN.clear()
            found = _SEEN[t] = _token(t)
        what, sign, brief, word = found
        if plain and seen and what in "CWD":
            # most tokens: nothing depends on where they stand
            if what == "C":
                core.append(t)
                flat.append(t)
            elif what == "W":
                usual.append(sign)
                short.append(brief)
                flat.append(word)
            continue
        if i == letter:
            seen = True
            usual.append(_initial_sign(t))
            short.append(_initial_sign(t))
            flat.append(t)
            continue
        if i == partial:
            flat.append(t)
            continue
        if what == "D" and not (person and t == "A" and seen):
            continue
        if what == "L":
            if not (t == "CO" and seen and i + 1 < len(merged) and merged[i + 1] not in LEGAL):
                continue
            what, sign, brief, word = "W", _CODE["COUNTY"], _CODE["COUNTY"], "COUNTY"
        elif what == "N":
            numbers.append(sign)
            flat.append(word)
            continue
        elif i == given or not seen and t in _PET and t != "ED":
            word = _PET[t]
            what, sign, brief = "W", _CODE[word], _initial_sign(word[0])
        elif person and len(t) == 1 and i not in heading:
            what, word = "I", t
        seen = True
        flat.append(t if cut and i == len(merged) - 1 and t not in _CODE else word)
        if what == "W":
            usual.append(sign)
            short.append(brief)
        elif what == "I":
            initials.append(t)
        else:
            core.append(t)
    if merged and (not flat or merged[-1] in LEGAL or merged[-1] in DROPPED):
        flat.append(merged[-1] if cut and flat and merged[-1] in ("A", "AN", "DE", "LA", "EL") else "")
    base, last = "".join(flat[:-1]), flat[-1] if flat else ""
    letters = "".join(core)
    return "".join(sorted(usual)), "".join(sorted(short)), " ".join(sorted(numbers)), letters, turned(letters), "".join(sorted(initials)), base, last


def unfinished(name: str) -> bool:
    """Whether a name of the width at which names are cut off may go on: its last word is neither a whole usual word nor a
    legal form."""
    words = _TOKEN.findall(fold(mended(name)).replace("'", "")) if "," not in name else []
    return len(words) > 1 and words[-1] not in _CODE and words[-1] not in LEGAL


def town_core(city: str | None) -> str:
    """A town's letters without its usual words (LAKE, NORTH, SAINT and the like)."""
    return "".join(t for t in _TOKEN.findall(fold(city or "").replace(".", "")) if _token(t)[0] == "C")


def segments(core: str, edits: int) -> list[tuple[int, str]]:
    """core cut into edits + 1 parts of nearly equal length: (start, part)."""
    n, parts, at = len(core), edits + 1, 0
    out = []
    for i in range(parts):
        size = n // parts + (i >= parts - n % parts)
        out.append((at, core[at : at + size]))
        at += size
    return out


def allowed(core: str) -> int:
    """Edits that may lie between two spellings of a core if something else says that they are the same name."""
    return 2 if len(core) >= 5 else 1 if len(core) >= 3 else 0


def index_keys(core: str, sure: bool = True) -> list[str]:
    """Keys under which a core is found: its length, the number of a segment and the segment. sure: for every number of edits
    that a core looking for it may allow; else for one edit, and for two letters that changed places where the halves meet."""
    n, most = len(core), (1, 2) if sure else (1,)
    keys = [f"{k}:{n}:{i}:{part}" for k in most if n > k + 1 for i, (_, part) in enumerate(segments(core, k))]
    return keys if sure or n < 4 else [*keys, _hole(core)]


def _hole(core: str) -> str:
    """A core of this length without the two letters where its halves meet."""
    at = segments(core, 1)[1][0]
    return f"h:{len(core)}:{core[: at - 1]}.{core[at + 1 :]}"


def probe_keys(core: str, sure: bool = True) -> list[str]:
    """Keys that a core within its allowed edits (one, if not sure) must share: by the pigeonhole principle one of the other's
    segments stands unchanged in this one. Before segment i there are at most i edits and after it at most k - i, or another
    segment would be found as well; that bounds how far it can be shifted."""
    k, n, out = allowed(core) if sure else min(1, allowed(core)), len(core), set()
    for length in range(max(k + 2, n - k), n + k + 1) if k else ():
        longer = n - length
        for i, (at, part) in enumerate(segments("." * length, k)):
            low, high = max(at - i, at + longer - (k - i)), min(at + i, at + longer + (k - i))
            for start in range(max(0, low), min(n - len(part), high) + 1):
                out.add(f"{k}:{length}:{i}:{core[start : start + len(part)]}")
    if k and not sure and n >= 4:
        out.add(_hole(core))
    return sorted(out)
