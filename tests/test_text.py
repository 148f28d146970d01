import pytest
from pyspark.sql import functions as F

from matchloom import schema
from matchloom.functions import similarity as S
from matchloom.functions import text as X
from matchloom.operators.normalize import normalize

VECTORS = [
    ("ACME CORP", "ACME CORPORATION", 0.8541667), ("123 MAIN ST", "123 MAIN STREET", 0.9111111), ("TUCSON", "SCOTTSDALE", 0.5638889), ("85001", "85701", 0.8666667),
    ("WIDGET LLC", "WIDGETS LLC", 0.9696970), ("456 OAK AVE", "456 OAK AVENUE", 0.9285714), ("GLOBEX INC", "GLOBEX INCORPORATED", 0.8421053), ("789 PINE RD", "789 PINE ROAD", 0.9487179),
    ("ACME CORP", "GLOBEX INCORPORATED", 0.6052632), ("WIDGET LLC", "ACME CORPORATION", 0.4250000), ("GLOBEX INC", "ACME CORPORATION", 0.4916667), ("PHOENIX", "TUCSON", 0.5396825), ("ABCDEFGH", "BCADEFGH", 0.9375),
]


@pytest.mark.parametrize(("a", "b", "want"), VECTORS)
def test_jaro_vectors(a, b, want):
    assert S.jaro(a, b) == pytest.approx(want, abs=1e-6)
    assert S.jaro(b, a) == pytest.approx(S.jaro(a, b), abs=1e-12)


def test_jaro_edges_and_bound():
    assert S.jaro("", "") == S.jaro(None, "A") == S.jaro("A", "B") == 0.0 and S.jaro("A", "A") == 1.0
    assert S.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611111, abs=1e-6)
    words = ["PORT MATILDA EMS", "PORT MATILDA EMERGENCY MEDICAL SERVICE", "A", "AB", "CENTER", "CENTRE", "X" * 40]
    for a in words:
        for b in words:
            for floor in (0.7, 0.85, 0.95):
                assert S.reachable([a], [b], floor, False)[0] or S.jaro(a, b) < floor
                assert S.reachable([a], [b], floor, True)[0] or S.jaro_winkler(a, b) < floor


def test_overlap():
    a, b = "NEWAYGO COUNTY MUSEUM HERITAGE CENTER".split(), "HERITAGE MUSEUM OF NEWAYGO COUNTY".split()
    assert S.name_overlap(a, b) == pytest.approx(4 / 5)
    assert S.name_overlap("PORT MATILDA EMS".split(), "PORT MATILDA EMERGENCY MEDICAL SERVICE".split()) == 1.0
    assert S.name_overlap("F O R".split(), "FOCUS ON RENEWAL".split()) == 1.0
    assert S.contained_overlap("BAPTIST BIBLE COLLEGE".split(), "BAPTIST BIBLE COLLEGE AND GRADUATE SCHOOL".split()) == pytest.approx(0.95)
    assert S.contained_overlap("LIHI NORTHWEST BUILDING".split(), "LIHI CASCADE SENIOR HOUSING".split()) < 0.6
    assert S.name_overlap([], ["A"]) == 0.0


def one(spark, columns, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(*[c.alias(n) for n, c in columns(F.col("v")).items()]).first()


@pytest.mark.parametrize(("name", "key", "form"), [
    ("Widget, LLC", "WIDGET", "LLC"), ("Acme Corp.", "ACME", "CORP"), ("THE SAN DIEGO EDUCATION FOUNDATION", "SAN DIEGO EDUCATION", "FOUNDATION"), ("THEATER GUILD", "THEATER GUILD", None),
    ("TRUST FUND", "TRUST FUND", "FUND"), ("Inc", "INC", "INC"), ("A & B Ass'n", "A AND B ASS N", None), (None, "", None), ("   ", "", None), ("Fundación Más Allá", "FUNDACION MAS ALLA", None),
])
def test_names(spark, name, key, form):
    r = one(spark, lambda c: {"key": X.name_key(X.name_full(c)), "form": X.name_form(X.name_full(c))}, name)
    assert (r["key"], r["form"]) == (key, form)


def test_name_features(spark):
    r = one(spark, lambda c: {"nums": X.numbers(X.name_full(c)), "ord": X.mapped_tokens(X.name_full(c), {"FIRST": "1", "2ND": "2"}), "gen": X.generation(X.name_full(c))}, "First 2ND FIRST Local 32 9 JR SR")
    assert (r["nums"], r["ord"], r["gen"]) == ("2 32 9", "1 2", "JR")


@pytest.mark.parametrize(("street", "want"), [
    ("3406 GLACIER HWY STE A", ("3406", "GLACIER", "HWY", "STE A")), ("430 WEST 7TH AVENUE", ("430", "W 7TH", "AVE", None)), ("P.O. Box 12", ("12", "PO BOX", None, None)),
    ("POB 12", ("12", "PO BOX", None, None)), ("Boxer Street", (None, "BOXER", "ST", None)), (None, (None, None, None, None)),
])
def test_streets(spark, street, want):
    r = one(spark, lambda c: X.street_parts(X.street_key(c)) | {"unit": X.street_unit(c)}, street)
    assert (r["street_num"], r["street_name"], r["street_type"], r["unit"]) == want


@pytest.mark.parametrize(("code", "plus", "want"), [
    ("2139", None, ("02139", "021", None)), ("21391234", None, ("02139", "021", "02139-1234")), ("02139-1234", "9", ("02139", "021", "02139-1234")), ("02139", "12", ("02139", "021", "02139-0012")), ("", "1", (None, None, None)), (None, None, (None, None, None)),
])
def test_zips(spark, code, plus, want):
    r = spark.createDataFrame([(code, plus)], "a string, b string").select(*[c.alias(n) for n, c in X.zip_parts(F.col("a"), F.col("b")).items()]).first()
    assert tuple(r) == want


def test_normalize_handles_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,) * 13, ("1", "2", *[""] * 10, None)], ", ".join(f"{f} string" for f in schema.FIELDS))
    out = normalize(df)
    assert out.count() == 2 and out.where("name_key != '' or street_key != ''").count() == 0 and normalize(df.limit(0)).count() == 0


def test_schema(spark):
    raw = spark.createDataFrame([(" a  b ", "1", "x")], "ein string, active string, name string")
    with pytest.raises(ValueError):
        schema.canonical(raw, {"ein": "missing"})
    ref = schema.reference(raw, {"ein": "ein", "active": "active"})
    assert ref.first()["ein"] == "a b" and ref.first()["active"] is True
    flagged = schema.flag_active(ref, spark.createDataFrame([("zz",)], "ein string"))
    assert flagged.first()["active"] is False
