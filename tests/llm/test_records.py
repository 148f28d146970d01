import random

import pytest

from matchloom.llm import addresses, components, entities, names, places, spellings

ADDRESS = "rec string, line string, second string, city string, region string, postcode string, num string, core string"
SAME = [
    ["4423 OLOCKCOMBE RD.", "4423 Olockcombe Road, Suite 3", "Olockcombe Rd 4423", "No. 4423 Oslockcombe Rd #9", "4423 OLOCKCOMBE", "Elm Building, 4423 Olockcombe Rd", "4423 Olockcombe Rd, Kenworth, DC 16434", "UNIT F, 4423 OLOCKCOMBE RD"],
    ["P.O. Box 168", "POB 168", "PO BX 168", "POST OFFICE BOX 168", "POBox  168", "BOX 168"],
    ["993 North Renelcroft Place", "993 N. RENELCROFT PL", "No Renelcroft Place 993", "993 RENELCROFT PL NORTH"],
    ["993 SOUTH RENELCROFT PLACE", "993 So Renelcroft Pl."],
    ["12 Tenth Street", "12 10TH ST"],
    ["12 Tenth Avenue"],
    ["14 Tenth Street"],
]


def test_same_place(spark):
    rows, place = [], {}
    for g, lines in enumerate(SAME):
        for k, line in enumerate(lines):
            rec = f"{g}_{k}"
            rows.append((rec, line, None, ["Kenworth", "KENWORTH", None][k % 3], ["DC", "d.c.", None][k % 3], ["16434-1633", "16434", "16434"][k % 3], "x", "y"))
            place[rec] = g
    rows += [("n1", None, None, "A", "DC", "16434", "", ""), ("n2", " ", None, None, None, None, "", ""), ("far", "4423 Olockcombe Rd", None, "Otherville", "TX", "75001", "", ""), ("long", "9 " + "Long" * 2000 + " St", None, None, None, None, "", ""), ("0_9", SAME[0][0], None, "Kenworth", "DC", "16434", "", "")]
    place["0_9"] = 0
    df = spark.createDataFrame(rows, ADDRESS)
    line = {r[0]: r[1] for r in rows}
    want = {(a, b) for a in place for b in place if a < b and place[a] == place[b] and line[a] != line[b]}
    assert {tuple(r) for r in places.same_place(df).collect()} == want
    apart = {(r["rec"]): r["place"] for r in places.places(df, units=True).collect()}
    assert apart["0_1"] != apart["0_0"] and apart["0_0"] == apart["0_2"]
    assert places.same_place(df.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if False else _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_segments_find_every_pair_within_the_edits():
    r = random.Random(4)
    words = ["".join(r.choices("ABC", k=r.randint(4, 12))) for _ in range(160)]
    words += [w[:3] + "X" + w[3:] for w in words[:40]] + [w[:2] + w[3:] for w in words[40:80]] + [w[:-1] for w in words[80:120]]
    for a in words:
        keys = set(names.probe_keys(a))
        for b in words:
            k = names.allowed(a)
            if a != b and k and edits(a, b) <= k and len(b) > k + 1:
                assert keys & set(names.index_keys(b)), (a, b)


@pytest.mark.parametrize(("a", "b", "same"), [
    ("Larerley Hist Society of Saint Chedillgate (The)", "THE LARERLEY HISTORICAL SOC OF ST. CHEDILLGATE, INC.", True), ("LARSEN, ELIZABETH M MEMORIAL FUND", "Memorial Fund of Liz M. Larsen", True),
    ("Center, Dorgate Senior Child Care Tr", "DORGATE SENIOR CHILD CARE CTR LLC", True), ("VARÃ¶FALL MUSIC ACADEMY", "Varöfall Music Acad. L L C", True), ("United Weavers Union Chapter No. 2120", "UNITED WEAVERS UNION CHAPTER #2120, INC.", True),
    ("First Methodist Church", "SECOND METHODIST CHURCH", False), ("Gow School", "Gow School Foundation", False), ("Local 32", "Local 45", False), ("Yaridlea Co Fire Department Co", "YARIDLEA COUNTY FIRE DEPT", True),
])
def test_name_forms(a, b, same):
    x, y = names.name_form(a), names.name_form(b)
    assert ((x[0], x[2], x[4], x[5]) == (y[0], y[2], y[4], y[5])) == same
    assert names.name_form(None) == names.name_form(" ") == ("",) * 8


NAME = "rec string, owner string, name string, city string, region string, postcode string, core string"


def test_same_name(spark):
    at, far = ("Kenworth", "DC", "16434"), ("Dallas", "TX", "75001")
    rows = [
        ("L1", "u1", "Olockcombe Youth Theater Inc", *at), ("L2", "u2", "OLOCKCOMBE YOUTH THEATRE", *at), ("B2", "u2", "Oslockcombe Youth Theater", *at), ("O1", "e1", "THEATER, OLOCKCOMBE YOUTH", *at), ("O2", "e2", "OLOCKCOMBE YOUTH THEATER ALUMNI ASSOCIATION", *at),
        ("O3", "e3", "OLOCKCOMBE YOUTH THEATER CO", *far), ("L4", "u4", "The Margaret H. Ulkov Memorial Library", *at), ("O4", "e4", "ULKOV, PEGGY H MEMORIAL LIB", *at), ("O5", "e5", "M. H. Ulkov Memorial Library", *at), ("L6", "u6", "Order of the Heron Lodge 12", *at),
        ("O6", "e6", "ORDER OF THE HERON LODGE 13", *at), ("L7", "u7", "Doreswell Emergency Medical Services", *at), ("O7", "e7", "DORES WELL EMERGENCY MEDICAL SERVICES ", *at), ("O8", "e8", None, *at), ("O9", "e9", " ", None, None, None), ("O10", "e10", "X" * 4000, *at), ("O11", "e1", "Olockcombe Youth Theater LLC", *at),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], NAME)
    groups = [["L1", "L2", "B2", "O1", "O11"], ["L4", "O4", "O5"], ["L7", "O7"]]
    owner, name = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    want = {(a, b) for g in groups for a in g for b in g if a < b and owner[a] != owner[b] and name[a] != name[b]}
    assert {tuple(r) for r in spellings.same_name(df).collect()} == want
    assert spellings.same_name(df.limit(0)).count() == 0


def test_cut_names_are_completed(spark):
    full, at = "MOUNT OLUCKCOMBE SALOSTGATE RECOVERY CENTER", {"db": 38}
    place, other = ("Kenworth", "DC", "16434", "12 Oak St"), ("Elsewhere", "TX", "75001", "13 Oak St")
    rows = [("L1", "u1", "source", full, *place), ("O1", "e1", "db", full[:38], *place), ("O2", "e2", "db", full[:38], *other), ("L3", "u3", "source", "Norastley Ulingwood Youth Little League Housing", *place), ("O3", "e3", "db", "NORASTLEY ULINGWOOD YOUTH LITTLE LEAGUE", *place)]
    df = spark.createDataFrame(rows, "rec string, owner string, side string, name string, city string, region string, postcode string, line string")
    assert {tuple(r) for r in spellings.same_name(df, at).collect()} == {("L1", "O1")}
    # one length holds far more names than those around it
    many = [(f"O{i}", f"e{i}", "db", "A" * (20 + i % 30), None, None, None, None) for i in range(3000)] + [(f"X{i}", f"x{i}", "db", "B" * 38, None, None, None, None) for i in range(400)]
    assert spellings.cut_widths(spark.createDataFrame(many, df.schema)) == {"db": 38}
    assert spellings.cut_widths(df.limit(0)) == {}


def test_namesakes_are_told_apart(spark):
    """One name in several towns of a state, names of the town itself, near cores in one town: brute force over stated organisations."""
    town = lambda i: (f"Town{'abcdefghij'[i]}ville", "TX", f"750{i}1")
    rows, org = [], {}

    def add(rec, owner, side, name, place, line, o):
        rows.append((rec, owner, side, name, *place, line, None, None))
        org[rec] = o

    for i in range(6):  # the same hot name in six towns, known to both sources in each
        add(f"L{i}", f"u{i}", "source", "Friends of the Salanwick Library", town(i), f"{100 + i} Oak St", i)
        add(f"O{i}", f"e{i}", "db", "FRIENDS OF THE SALANWICK LIBRARY INC", town(i), f"{100 + i} OAK STREET", i)
    # two churches of a town's own name: only the street tells them apart
    add("L20", "u20", "source", "Second Lutheran Church of Townaville", town(0), "55 Elm Ave", 20)
    add("O20", "e20", "db", "2ND LUTHERAN CHURCH OF TOWNAVILLE", town(0), "55 ELM AVENUE STE 4", 20)
    add("O21", "e21", "db", "SECOND LUTHERAN CHURCH OF TOWNAVILLE INC", town(0), "990 PINE RD", 21)
    # distinct cores two edits apart in one town, and a spelling two edits away at one door
    add("L30", "u30", "source", "Harwicz Music Academy", town(1), "7 First St", 30)
    add("O31", "e31", "db", "MARWIRZ MUSIC ACADEMY", town(1), "81 THIRD ST", 31)
    add("L32", "u32", "source", "Ulkenbridge Food Bank", town(1), "4411 Lane Rd", 32)
    add("O32", "e32", "db", "ULKEMBRIGE FOOD BANK", town(1), "4411 LANE ROAD", 32)
    # a rare name that moved: one source knows each end, and the other address says so
    add("L40", "u40", "source", "Orastville Gowan Society", town(2), "3 Low St", 40)
    add("O40", "e40", "db", "ORASTVILLE GOWAN SOC", town(3), "77 HIGH ST", 40)
    add("L50", "u50", "source", "Friends of the Salanwick Trail", town(4), "9 Low St", 50)
    rows[-1] = (*rows[-1][:-2], "812 Hill Dr", town(5)[2])
    add("O50", "e50", "db", "FRIENDS OF THE SALANWICK TRAIL CO", town(5), "812 HILL DRIVE", 50)
    df = spark.createDataFrame(rows, "rec string, owner string, side string, name string, city string, region string, postcode string, line string, other_line string, other_postcode string")
    owner, name = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    want = {(a, b) for a in org for b in org if a < b and org[a] == org[b] and owner[a] != owner[b] and name[a] != name[b]}
    assert {tuple(r) for r in spellings.same_name(df).collect()} == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), 1000 + r.randint(0, 70)) for _ in range(70)] + [(500 + i // 2, 2000 + (i + 1) // 2) for i in range(80)] + [(900, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for v, k in edges:
        parent[root(v)] = root(k) if k is not None else root(v)
    df = spark.createDataFrame(edges, "v long, key long")
    got = {x["v"]: x["comp"] for x in components.components(df).collect()}
    assert set(got) == {v for v, _ in edges}
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a in got for b in got)
    assert components.components(df.limit(0)).count() == 0


def test_parse_address():
    assert addresses.street("14 W. Walethgate Hiway")[:5] == ("B", "14", "WALETHGATE", "W", "HWY")
    assert addresses.street(None) == addresses.street("  ") == ("",) * 6
    assert addresses.zip5("2139") == "02139" and addresses.zip5("12") == addresses.zip5(None) == "" and addresses.state(" new york ") == "NY" and addresses.town("St. Louis") == addresses.town("SAINT LOUIS")


def entity_rows(n):
    r = random.Random(9)
    left, right, labels = [], [], []
    for i in range(n):
        core = "".join(r.choice(["ba", "do", "ke", "li", "mu", "ra", "si", "to"]) for _ in range(5)).upper()
        kind = r.choice(["YOUTH THEATER", "FOOD BANK", "LIBRARY", "ANIMAL SHELTER"])
        num, town = r.randint(1, 9999), f"TOWN{'ABCDEFGHIJKL'[i % 12]}"
        place = (town, "TX", f"75{i % 12:03d}", f"{num} MAIN{i % 7} ST")
        left.append((f"u{i}", f"{core} {kind} INC", *place))
        if i % 3:
            typo = core[:4] + core[5:] if i % 5 == 0 else core
            right.append((f"e{i}", f"The {typo.title()} {kind.title()}", *place[:3], place[3].replace("ST", "STREET")))
            if i % 4 == 0:
                right.append((f"x{i}", f"{core} {kind} FOUNDATION", *place))
        labels.append((f"u{i}", f"e{i}" if i % 3 else None))
    return left, right, labels


RECORDS = "owner string, name string, city string, region string, postcode string, line string"


def test_match_finds_counterparts(spark):
    left, right, labels = entity_rows(240)
    nothing = [(None, "A B", None, None, None, None), ("n", None, None, None, None, None), ("m", " ", "A", "TX", "75001", "1 A St")]
    l, r = spark.createDataFrame(left + left[:30] + nothing, RECORDS), spark.createDataFrame(right + nothing, RECORDS)  # noqa: E741
    want = {(f"u{i}", f"e{i}") for i in range(240) if i % 3}
    held_out = {f"u{i}" for i in range(60, 240)}
    for known in (spark.createDataFrame(labels[:60], "left_key string, right_key string"), None):
        got = {(x["left_key"], x["right_key"]) for x in entities.match(l, r, known).collect() if x["confidence"] >= 0.5}
        fair = {x for x in got if x[0] in held_out}  # owners whose labels the classifier hasn't seen
        right_ones = {x for x in want if x[0] in held_out}
        assert len(fair & right_ones) / len(right_ones) > 0.95 and len(fair & right_ones) / len(fair) > 0.95
        assert len(got & want) / len(want) > 0.95
    assert entities.match(l.limit(0), r).count() == 0 and entities.match(l, r.limit(0)).count() == 0


def test_candidate_recall(spark):
    """Against brute force over all pairs: counterparts with one typo, a changed town or a lost address share a key."""
    r = random.Random(1)
    left, right, want = [], [], set()
    for i in range(300):
        core = "".join(r.choices("ABCDEFGHIKLMNOPRSTUW", k=r.randint(7, 12)))
        at = (f"TOWN{'ABCDEFGH'[i % 8]}", "TX", f"7510{i % 8}", f"{r.randint(1, 9999)} OAK ST")
        k = r.randint(1, len(core) - 2)
        other = [core, core[:k] + "Z" + core[k + 1 :], core[:k] + core[k + 1 :], core[:k] + core[k + 1] + core[k] + core[k + 2 :]][i % 4]
        place = at if i % 3 else (at[0], at[1], None, None)
        left.append((f"u{i}", f"{core} MUSIC ACADEMY", *at))
        right.append((f"e{i}", f"{other} MUSIC ACADEMY INC", *place))
        want.add((f"u{i}", f"e{i}"))
    l, rr = (spark.createDataFrame(x, RECORDS) for x in (left, right))
    p = entities.profiles(l, rr)
    o = {(x["is_left"], x["o"]): x["key"] for x in p.collect()}
    got = {(o[True, x["lo"]], o[False, x["ro"]]) for x in entities.candidates(p).collect()}
    assert len(got & want) / len(want) >= 0.95
    assert len(got) < len(left) * len(right) / 4
