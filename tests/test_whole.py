"""Cases that a cap or a cut used to lose."""

from matchloom import queries


def test_blocks_keep_tokens_of_many_records(spark, tmp_path):
    """Four words that more than 200 entries hold say enough together."""
    words = ["HARBOR", "MEADOW", "LANTERN", "COMPASS"]
    names = [f"{w} {w[0]}QX{i}" for w in words for i in range(205)] + [f"FILLER{i} ZEBRA{i}" for i in range(980)]
    db = [(f"{i:09d}", n, "AK") for i, n in enumerate(names)] + [("999999999", " ".join(words), "AK")]
    db = [(e, n, None, "1 OAK ST", "NOME", s, "99762", None, "Y") for e, n, s in db]
    spark.createDataFrame(db, "ein string, org_name_join string, dba_name string, org_addr_street string, org_addr_city string, org_addr_state string, org_addr_zip5 string, org_addr_zip4 string, act string").write.parquet(f"{tmp_path}/df_db.parquet")
    fields = "unique_entity_id string, legal_business_name string, dba_name string, entity_division_name string, physical_address_line_1 string, physical_address_line_2 string, physical_address_city string, physical_address_province_or_state string, physical_address_zip_postal_code string"
    spark.createDataFrame([("U1", "Harbor Meadow Lantern Compass", None, None, None, None, None, "AK", None)], fields).write.parquet(f"{tmp_path}/df_source.parquet")
    for q in ("block_token", "block_token_idf", "block_token_concat", "block_crossstate"):
        assert ("U1", "999999999") in {tuple(r) for r in queries.QUERIES[q](spark, str(tmp_path)).collect()}, q


def _tables(spark, at, source, db):
    cols = "ein string, org_name_join string, dba_name string, org_addr_street string, org_addr_city string, org_addr_state string, org_addr_zip5 string, org_addr_zip4 string, act string"
    spark.createDataFrame([(e, n, None, s, c, a, z, None, "Y") for e, n, s, c, a, z in db], cols).write.parquet(f"{at}/df_db.parquet")
    fields = "unique_entity_id string, legal_business_name string, dba_name string, entity_division_name string, physical_address_line_1 string, physical_address_line_2 string, physical_address_city string, physical_address_province_or_state string, physical_address_zip_postal_code string"
    spark.createDataFrame([(u, n, None, None, s, None, c, a, z) for u, n, s, c, a, z in source], fields).write.parquet(f"{at}/df_source.parquet")


def test_every_registration_is_matched(spark, tmp_path):
    """An entity with two registrations has the pairs of both, and a misspelt name at another street is scored."""
    at = ("NOME", "AK", "99762")
    db = [("1", "SITKA FOOD BANK", "12 HARBOR DR", *at), ("2", "ZANZIBAR OBSERVATORY", "9 HILL RD", *at), ("3", "GLACIER LANTERN MUSEUM", "5 PINE ST", *at), *[(f"9{i}", f"FILLER{i} ZEBRA{i}", f"{i} ELM ST", *at) for i in range(30)]]
    source = [("U1", "Sitka Food Bank", "12 Harbor Dr", *at), ("U1", "Zanzibar Observatory", "9 Hill Rd", *at), ("U1", "Zanzibar Observatory", "9 Hill Rd", *at), ("U2", "Glacier Lantern Musuem", "77 Other Ave", *at)]
    _tables(spark, tmp_path, source, db)
    got = queries.QUERIES["score_hier"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["ein"]) for r in got if r["id"] == "U1" and r["score"] > 0.9) == [("U1", "1"), ("U1", "2")]
    assert ("U2", "3") in {(r["id"], r["ein"]) for r in got}
    result = queries._run(spark, str(tmp_path))
    assert {r["ein"] for r in result.pairs.df.where("id = 'U1' and score > 0.9").collect()} == {"1", "2"}
    assert {r["id"] for r in result.tiered.collect()} <= {"U1", "U2"}
