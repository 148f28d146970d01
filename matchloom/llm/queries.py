"""The queries of the subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import keep, new_path, table
from . import distinctive, entities, frequency, leakage, mixture, places, spellings, subjects, top_items


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All address records: rec, line, second, city, region, postcode."""
    source, db = table(spark, sf_dir, "df_source"), table(spark, sf_dir, "df_db")
    none = F.lit(None).cast("string")

    def fields(prefix: str, key: str, *names) -> list:
        return [F.concat(F.lit(prefix), key).alias("rec"), *[F.col(x).alias(n) if isinstance(x, str) else x.alias(n) for n, x in zip(("line", "second", "city", "region", "postcode"), names)]]

    p = source.select(*fields("P", "source_row_id", "physical_address_line_1", "physical_address_line_2", "physical_address_city", "physical_address_province_or_state", "physical_address_zip_postal_code"))
    m = source.select(*fields("M", "source_row_id", "mailing_address_line_1", "mailing_address_line_2", "mailing_address_city", "mailing_address_state_or_province", "mailing_address_zip_postal_code"))
    d = db.select(*fields("D", "db_row_id", "org_addr_street", none, "org_addr_city", "org_addr_state", "org_addr_zip"))
    return p.unionByName(m).unionByName(d)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.same_place(addresses(spark, sf_dir))


def name_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All name records: rec, owner, side, name, their address and the postal code and street of another one of the owner."""
    source, db = table(spark, sf_dir, "df_source"), table(spark, sf_dir, "df_db")
    none = F.lit(None).cast("string")
    own = F.array(F.struct(F.lit("L").alias("p"), F.col("legal_business_name").alias("name")), F.struct(F.lit("B").alias("p"), F.col("dba_name").alias("name")))
    source = source.select("source_row_id", F.concat(F.lit("u"), "unique_entity_id").alias("owner"), own.alias("names"), F.col("physical_address_city").alias("city"),
                           F.col("physical_address_province_or_state").alias("region"), F.col("physical_address_zip_postal_code").alias("postcode"), F.col("physical_address_line_1").alias("line"),
                           F.col("mailing_address_line_1").alias("other_line"), F.col("mailing_address_zip_postal_code").alias("other_postcode"))
    source = source.select(F.explode("names").alias("x"), "*").where(F.length(F.trim("x.name")) > 0).select(F.concat("x.p", "source_row_id").alias("rec"), "owner", F.lit("source").alias("side"), "x.name", "city", "region", "postcode", "line", "other_line", "other_postcode")
    registry = db.select(F.concat(F.lit("O"), "db_row_id").alias("rec"), F.concat(F.lit("e"), "ein").alias("owner"), F.lit("db").alias("side"), F.col("org_name_raw").alias("name"),
                         F.col("org_addr_city").alias("city"), F.col("org_addr_state").alias("region"), F.col("org_addr_zip").alias("postcode"), F.col("org_addr_street").alias("line"), none.alias("other_line"), none.alias("other_postcode"))
    return source.unionByName(registry)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = name_records(spark, sf_dir)
    left, right = (records.where(F.col("side") == side).withColumn("owner", F.substring("owner", 2, 1000)) for side in ("source", "db"))
    labels = table(spark, sf_dir, "match_labels").where(F.col("gt_is_match").isNotNull()).select(F.col("uei").alias("left_key"), F.when(F.col("gt_is_match"), F.col("gt_ein")).alias("right_key"))
    return entities.match(left, right, labels)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).where(F.col("confidence") >= 0.5).select(F.col("left_key").alias("unique_entity_id"), F.col("right_key").alias("ein"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.same_name(name_records(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = frequency.counted_by_vintage(table(spark, sf_dir, "df_db"), "org_name_raw", "vintage")
    return frequency.marked(counts).where(F.col("mark").isNotNull()).select("term", "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {"db": (table(spark, sf_dir, "df_db"), "db_row_id", "org_name_raw"), "source": (table(spark, sf_dir, "df_source"), "source_row_id", "legal_business_name")}
    return distinctive.top_term(sides)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items.top_both_ways(table(spark, sf_dir, "candidate_pairs"), "unique_entity_id", "ein", "total_score", 3, ("uei", "ein"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after three change sets: all rows are added, those without a state deleted, those without assets changed to their
    cleaned name."""
    db = table(spark, sf_dir, "df_db").select("db_row_id", "org_name_raw", "org_name_join", "org_addr_state", "assets")
    gone = F.trim(F.coalesce("org_addr_state", F.lit(""))) == ""
    changed = db.where(~gone & F.col("assets").isNull())
    counts = frequency.CountTable(spark, new_path(spark, "term-counts"))
    counts.apply("org_name_raw", added=db)
    counts.apply("org_name_raw", deleted=db.where(gone))
    counts.apply("org_name_raw", changed=(changed, changed.withColumn("org_name_raw", F.col("org_name_join"))))
    return counts.read().where(F.col("term").isNotNull()).select("term", "occurrences", "records")


def p4_ppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed positive pointwise mutual information (exponent 0.75) of every term of every registry name."""
    db = table(spark, sf_dir, "df_db").select("db_row_id", "org_name_raw")
    return distinctive.ppmi(db, ["db_row_id"], "org_name_raw").select("db_row_id", "term", "tf", F.round("ppmi", 6).alias("ppmi"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(mixture.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).where("short").select("source")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.replicate(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.subject_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return found.where(F.col("posterior") >= 0.5).select("doc_id", "subject")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_changes": p3_changes, "p4_found": p4_found, "p4_ppmi": p4_ppmi, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_found": p8_found, "p9_found": p9_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found}

SQL = {
    "p3_found": r"""
        WITH r AS (SELECT db_row_id, unnest(regexp_extract_all(upper(org_name_raw), '[\p{L}\p{N}]+')) AS term FROM df_db WHERE org_name_raw IS NOT NULL),
             g AS (SELECT term, count(*) AS o, count(DISTINCT db_row_id) AS d FROM r GROUP BY 1),
             n AS (SELECT count(org_name_raw) AS n FROM df_db)
        SELECT term, CASE WHEN d >= 0.02 * n THEN 'common' ELSE 'rare' END AS mark FROM g, n WHERE d >= 0.02 * n OR o <= 2""",
    "p4_found": r"""
        WITH c AS (SELECT 'db' AS side, db_row_id AS row_id, org_name_raw AS nm FROM df_db WHERE org_name_raw IS NOT NULL
                   UNION ALL SELECT 'source', source_row_id, legal_business_name FROM df_source WHERE legal_business_name IS NOT NULL),
             r AS (SELECT side, row_id, unnest(regexp_extract_all(upper(nm), '[\p{L}\p{N}]+')) AS term FROM c),
             tf AS (SELECT side, row_id, term, count(*) AS k FROM r GROUP BY ALL),
             d AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
             w AS (SELECT side, row_id, term, k * ln((SELECT count(*) FROM c) / d) AS w FROM tf JOIN d USING (term) WHERE d > 1)
        SELECT side, row_id, term FROM w QUALIFY row_number() OVER (PARTITION BY side, row_id ORDER BY w DESC, term) = 1""",
    "p3_changes": r"""
        WITH k AS (SELECT db_row_id, CASE WHEN assets IS NULL THEN org_name_join ELSE org_name_raw END AS nm FROM df_db WHERE trim(coalesce(org_addr_state, '')) <> ''),
             r AS (SELECT db_row_id, unnest(regexp_extract_all(upper(nm), '[\p{L}\p{N}]+')) AS term FROM k WHERE nm IS NOT NULL)
        SELECT term, count(*) AS occurrences, count(DISTINCT db_row_id) AS records FROM r GROUP BY 1""",
    "p4_ppmi": r"""
        WITH r AS (SELECT db_row_id, unnest(regexp_extract_all(upper(org_name_raw), '[\p{L}\p{N}]+')) AS term FROM df_db WHERE org_name_raw IS NOT NULL),
             tf AS (SELECT db_row_id, term, count(*) AS tf FROM r GROUP BY ALL), c AS (SELECT term, sum(tf) AS c FROM tf GROUP BY 1), s AS (SELECT db_row_id, sum(tf) AS size FROM tf GROUP BY 1)
        SELECT db_row_id, term, tf, round(greatest(0, ln(tf * (SELECT sum(size ** 0.75) FROM s) / (c * size ** 0.75))), 6) AS ppmi FROM tf JOIN c USING (term) JOIN s USING (db_row_id)""",
    "p7_found": """
        WITH p AS (SELECT unique_entity_id AS u, ein AS e, max(total_score) AS s FROM candidate_pairs
                   WHERE total_score IS NOT NULL AND NOT isnan(total_score) GROUP BY ALL)
        SELECT 'uei' AS group_kind, u AS group_key, e AS item_key FROM p QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC, e) <= 3
        UNION ALL SELECT 'ein', e, u FROM p QUALIFY row_number() OVER (PARTITION BY e ORDER BY s DESC, u) <= 3""",
}
