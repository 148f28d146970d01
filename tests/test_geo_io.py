import pytest
from pyspark.sql import functions as F

from matchloom.operators import geo, incremental
from matchloom.sources import assets, readers
from matchloom.streaming.incremental import match_stream


def test_clean_and_refine(spark):
    df = spark.createDataFrame([("st louis", "Missouri", "63101"), ("nyc", "NY", "10001"), ("PHOENex", "az", "85001"), (None, None, "85001"), ("Tempe", "AZ", None)], "city string, state string, zip5 string")
    ref = spark.createDataFrame([("85001", "Phoenix"), ("10001", "Brooklyn")], "zip5 string, major_city string")
    got = [tuple(r) for r in geo.clean_geo(df, zip_ref=ref).select("city", "state").collect()]
    assert sorted(got, key=str) == sorted([("SAINT LOUIS", "MO"), ("NEW YORK CITY", "NY"), ("PHOENIX", "AZ"), ("PHOENIX", None), ("TEMPE", "AZ")], key=str)
    with pytest.raises(NotImplementedError):
        geo.clean_geo(df, "other")


def test_crosswalks(spark):
    hud = spark.createDataFrame([("2139", "A", 0.2), ("2139", "B", 0.8), ("99", "C", 1.0)], "ZIP string, CBSA string, TOT_RATIO double")
    assert {tuple(r) for r in geo.load_hud(hud).collect()} == {("02139", "B"), ("00099", "C")}
    ruca = geo.load_ruca(spark.createDataFrame([("2139", "1.1"), ("501", "10")], "ZIP_CODE string, RUCA1 string"))
    out = geo.augment_geo(spark.createDataFrame([("02139",), (None,), ("00501",)], "zip5 string"), ruca).withColumn("u", geo.ruca_urban(F.col("ruca")))
    assert {r["zip5"]: r["u"] for r in out.collect()} == {"02139": "urban", "00501": "rural", None: None}
    with pytest.raises(ValueError):
        geo.augment_geo(ruca, ruca.drop("zip5"))


def test_diff_and_codes(spark):
    fresh = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), (None, 5)], "uei string, n int")
    cross = spark.createDataFrame([("a", "YES"), ("b", "MAYBE"), ("c", "NO"), ("a", "YES")], "uei string, tier string")
    ids = lambda d: {r["uei"] for r in d.collect()}
    assert ids(incremental.diff_unmatched(fresh, cross)) == {"b", "c", "d", None}
    assert ids(incremental.diff_unmatched(fresh, cross, matched=("YES", "MAYBE"))) == {"c", "d", None}
    assert ids(incremental.diff_unmatched(fresh, cross.drop("tier"))) == {"d", None}
    assert tuple(incremental.diff_counts(fresh, cross).first()) == (5, 1, 4, 1)
    sam = spark.createDataFrame([("A8~23",), ("XA8",), (None,), ("2X",)], "bus_type_string string")
    assert incremental.flag_codes(sam, "bus_type_string", ["A8"], "f", keep=True).count() == 2
    assert incremental.flag_codes(sam, "bus_type_string", ["A8"], "f", exact=True, keep=True).count() == 1
    flags = incremental.code_flags(sam, "bus_type_string", "t_", {"A8": "nonprofit"})
    assert {"t_nonprofit", "t_23", "t_xa8", "t_2x"} <= set(flags.columns) and flags.where("t_nonprofit").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "x.dat").write_text('U1|NA|"q|z\nU2\n')
    rows = readers.read_delimited(spark, str(tmp_path / "x.dat"), ["a", "b", "c", "d"]).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("U1", None, '"q', "z"), ("U2", None, None, None)]
    assert len(readers.registration_layout()) == 142 == len(set(readers.registration_layout()))
    out = readers.write(spark.range(3), str(tmp_path / "p.parquet"))
    assert readers.read_any(spark, out).count() == 3
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    assert readers.read_any(spark, str(tmp_path / "c.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.zzz")


def test_assets(tmp_path):
    assets.data_root(str(tmp_path / "root"))
    assets.data_init()
    f = tmp_path / "t.csv"
    f.write_text("a\n1\n2\n")
    url = f.as_uri()
    got = readers.fetch(url)
    assert got.endswith("raw/t.csv") and assets.manifest()[0]["row_count"] == "2" and assets.manifest()[0]["md5"] == assets.md5(str(f))
    f.write_text("a\n")
    readers.fetch(url)
    assert assets.manifest()[0]["row_count"] == "2"
    readers.fetch(url, overwrite=True)
    assert len(assets.manifest()) == 1 and assets.manifest()[0]["row_count"] == "0"
    with pytest.raises(ValueError):
        assets.data_path("nowhere")


def test_stream(spark, tmp_path):
    from matchloom import schema

    names = {"name": "name", "state": "state"}
    ref = schema.reference(spark.createDataFrame([("1", "ZANZIBAR OBSERVATORY", "AK"), ("2", "KODIAK BEAR CLUB", "AK")], "k string, name string, state string"), names | {"ein": "k"})
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    query = lambda b: schema.query(b, names | {"id": "k"})
    kind = "k string, name string, state string"
    for batch in ([("a", "Zanzibar Observatory", "AK")], [("a", "Zanzibar Observatory", "AK"), ("b", "Kodiak Bear Club", "AK")]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        match_stream(spark.readStream.schema(kind).parquet(source), ref, target, str(tmp_path / "cp"), query).awaitTermination(120)
    rows = sorted((r["id"], r["ein"], r["tier"]) for r in spark.read.parquet(target).collect())
    assert rows == [("a", "1", "YES"), ("b", "2", "YES")]
