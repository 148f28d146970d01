"""The core queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import Config
from .functions import constants as K
from .functions import text as X
from .operators import block, geo, incremental, review, skew, stats, tier1
from .operators import evaluate as E
from .operators import train as T
from .operators import veto as V
from .operators.compare import Pairs, compare, geo_coverage
from .operators.compare import geo_flags as geo_flags_of
from .operators.normalize import normalize
from .operators.score import rescaled, score
from .operators.select import candidates, select, tier
from .oracle import SQL as ORACLE
from .plans import pipeline
from .plans.report import pair_stats, tier_shares
from .plans.route import route
from .runtime import keep, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "df_source": (table(spark, sf_dir, "df_source"), "physical_address_province_or_state"),
        "df_db": (table(spark, sf_dir, "df_db"), "org_addr_state"),
    }
    return skew.hot_states(tables, table(spark, sf_dir, "state_codes"))


def p1_state_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct cities, commonest city and revenue percentiles of each registry state."""
    db = table(spark, sf_dir, "df_db").select(skew.state_of(F.col("org_addr_state")).alias("state"), F.upper(F.trim("org_addr_city")).alias("city"), "revenue")
    cities = skew.key_totals(skew.value_frequency(db, ["state"], "city"), ["state"], "city")
    money = skew.weighted_percentiles(skew.value_frequency(db, ["state"], "revenue"), ["state"], "revenue", {"p50_revenue": 0.5, "p90_revenue": 0.9})
    out = cities.alias("a").join(money.alias("b"), F.col("a.state").eqNullSafe(F.col("b.state")), "left")  # at most one row a state
    return out.select("a.state", "n_rows", F.col("n_distinct").alias("n_cities"), F.col("mode_value").alias("top_city"), "p50_revenue", "p90_revenue")


def _source(spark: SparkSession, d: str) -> DataFrame:
    return schema.query(table(spark, d, "df_source"))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return schema.reference(table(spark, d, "df_db"), schema.bmf_map("act"))


def _registrations(spark: SparkSession, d: str) -> DataFrame:
    """Every different registration as a row of its own; owner is the entity that holds it."""
    s = _source(spark, d).distinct()
    content = F.sha2(F.to_json(F.struct(*s.columns)), 256)
    return s.withColumn("owner", F.col("id")).withColumn("id", content)


def _q(spark: SparkSession, d: str) -> DataFrame:
    return normalize(_source(spark, d)).select("id", "state", "name_key", "dba_key").distinct()


def _r(spark: SparkSession, d: str) -> DataFrame:
    return normalize(_registry(spark, d).dropDuplicates(["ein", "name", "dba", "street", "city", "state", "zip5", "zip_plus4"]))


def _eins(pairs: DataFrame, r: DataFrame) -> DataFrame:
    return pairs.join(r.select("rid", "ein"), "rid").select("id", "ein").distinct()


def canonicalize(spark, d):
    return _source(spark, d).select("id", "name", "dba", "division", "street", "unit", "city", "state", "zip5")


def name_features(spark, d):
    full = X.name_full(F.col("org_name_raw"))
    f = table(spark, d, "df_db").select("db_row_id", full.alias("name_full"))
    c = F.col("name_full")
    return f.select("db_row_id", "name_full", X.name_key(c).alias("name_key"), X.name_form(c).alias("name_form"), X.numbers(c).alias("name_nums"), X.mapped_tokens(c, K.ORDINAL_RANKS).alias("name_ord"),
                    X.mapped_tokens(c, K.NAME_DIRECTIONS).alias("name_dir"), X.generation(c).alias("name_gen"))


def street_features(spark, d):
    raw = F.col("org_addr_street")
    s = table(spark, d, "df_db").select("db_row_id", X.street_unit(raw).alias("street_unit"), X.street_key(raw).alias("street_key"))
    c = F.col("street_key")
    return s.select("db_row_id", "street_unit", "street_key", c.rlike(K.BOX_PATTERN).alias("is_po_box"), *[v.alias(k) for k, v in X.street_parts(c).items()])


def zip_family(spark, d):
    z = X.zip_parts(F.col("physical_address_zip_postal_code"), F.col("physical_address_zip_code_4"))
    return table(spark, d, "df_source").select("source_row_id", *[v.alias(k) for k, v in z.items()], X.state_code(F.col("physical_address_province_or_state")).alias("state_abb"))


def name_freq(spark, d):
    return stats.name_freq(_r(spark, d))


def token_idf(spark, d):
    return stats.token_idf(_r(spark, d))


def geo_profile(spark, d):
    return geo_coverage(_source(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("street", "unit", "city", "state", "zip5")])


def block_exact(spark, d):
    r = _r(spark, d)
    return _eins(block.exact(_q(spark, d), r, ["state", "name_key"]), r)


def block_cross_column(spark, d):
    r = _r(spark, d)
    return _eins(block.exact(_q(spark, d), r, ["state", "dba_key"], ["state", "name_key"]), r)


def block_union(spark, d):
    q, r = _q(spark, d), _r(spark, d)
    return _eins(block.union(block.exact(q, r, ["state", "name_key"]), block.exact(q, r, ["state", "dba_key"], ["state", "name_key"])), r)


def block_token(spark, d):
    return block.by_tokens(_q(spark, d), _r(spark, d), ["state"], unit="ein", apart=True)


def _block_idf(spark, d, by, **how):
    # forms of a query are told apart: idf adds up within one name
    return block.by_tokens(_q(spark, d), _r(spark, d), by, min_pair_idf=8, unit="ein", apart=True, **how)


def block_token_idf(spark, d):
    return _block_idf(spark, d, by=["state"], max_ref_freq=25_000)


def block_token_concat(spark, d):
    return _block_idf(spark, d, by=["state"], max_ref_freq=25_000, concat=True)


def block_crossstate(spark, d):
    return _block_idf(spark, d, by=[], max_ref_freq=5000)


def _scored(spark, d) -> Pairs:
    number = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    p = table(spark, d, "candidate_pairs").select(F.col("unique_entity_id").alias("id"), "ein", F.col("pair_id").alias("rid"), number("total_score").alias("score"), number("name_similarity").alias("name_sim"), number("addr_similarity").alias("street_key_sim"))
    none = F.lit(None).cast("string")
    return Pairs(p.withColumns({"name_x": none, "name_y": none, "veto": F.lit(False), "veto_soft": F.lit(False), "veto_soft_reason": none}), ["name", "street"], "street_full")


def select_best(spark, d):
    c = Config(tiebreak="none")
    out = tier(select(_scored(spark, d), c), c)
    return out.select("id", "overall_ein", F.round("overall_score", 6).alias("overall_score"), "name_ein", "addr_ein", "n_close", "tie", F.round("overall_margin", 6).alias("overall_margin"), "views_agree", "tier")


def _ruled(spark, d) -> Pairs:
    """The older scorer's pairs with the names of one record a side (the smallest name) and all rules on."""
    p = _scored(spark, d)
    x, y = _featured(table(spark, d, "df_source"), "unique_entity_id", "legal_business_name", "x"), _featured(table(spark, d, "df_db"), "ein", "org_name_raw", "y")
    one = lambda df, key, s: df.groupBy(key).agg(F.min(F.struct(f"name_{s}", *[c for c in df.columns if c not in (key, f"name_{s}")])).alias("m")).select(key, "m.*")
    df = p.df.drop("name_x", "name_y", "veto", "veto_soft", "veto_soft_reason")
    df = df.join(one(x, "unique_entity_id", "x").withColumnRenamed("unique_entity_id", "id"), "id").join(one(y, "ein", "y"), "ein")
    return p.with_df(V.veto(df))


def select_ruled(spark, d):
    """The picks with every rule on: hard-vetoed pairs don't take part, soft vetoes hold a YES back."""
    c = Config(tiebreak="none")
    out = tier(select(_ruled(spark, d), c), c)
    return out.select("id", "overall_ein", F.round("overall_score", 6).alias("overall_score"), F.coalesce("overall_veto_soft", F.lit(False)).alias("veto_soft"), "tier")


def select_tiebreak(spark, d):
    """The picks with every rule on, near ties going to the names most alike."""
    out = tier(select(_ruled(spark, d), Config()))
    return out.select("id", "overall_ein", F.round("overall_score", 6).alias("overall_score"), "n_close", "tie", F.round("overall_margin", 6).alias("overall_margin"), "tier")


def _flagged(spark, d) -> DataFrame:
    """Pairs of the older scorer with the geographic agreements of one record a side (the smallest row id) and its similarities."""
    number = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    first = lambda df, key, row: df.groupBy(key).agg(F.min_by(F.struct(*df.columns), row).alias("m")).select("m.*")
    q = normalize(schema.canonical(first(table(spark, d, "df_source"), "unique_entity_id", "source_row_id"), schema.SAM_MAP | {"zip_plus4": "physical_address_zip_code_4"}))
    r = normalize(schema.canonical(first(table(spark, d, "df_db"), "ein", "db_row_id"), schema.bmf_map("act")))
    cols = ["zip9", "zip5", "zip3", "state", "street_num", "is_po_box", "city"]
    q, r = q.select("id", *[F.col(c).alias(f"{c}_x") for c in cols]), r.select("ein", "name_key", *[F.col(c).alias(f"{c}_y") for c in cols])
    p = table(spark, d, "candidate_pairs").select("pair_id", F.col("unique_entity_id").alias("id"), "ein", number("name_similarity").alias("name_sim"), number("addr_similarity").alias("street_key_sim"))
    p = p.join(q, "id").join(r, "ein").join(stats.name_freq(_r(spark, d)).select(F.col("name").alias("name_key"), F.col("freq").alias("name_freq")), "name_key", "left")
    p = p.withColumns(geo_flags_of()).withColumn("city_sim", F.when(F.col("city_x") == F.col("city_y"), 1.0).otherwise(0.0)).withColumn("zip5_sim", F.col("geo_zip5").cast("double"))
    return p.withColumn("name_match_type", F.when(F.col("name_sim") < 0.85, "token_overlap").otherwise("name"))


def geo_flags(spark, d):
    return _flagged(spark, d).select("pair_id", *geo_flags_of())


def hier_pairs(spark, d):
    """The hierarchical score of the older scorer's pairs, by its similarities."""
    pairs = Pairs(_flagged(spark, d), ["name", "street", "city", "zip5"], "street_full")
    return score(pairs, Config(), "hier").df.select("pair_id", F.round("score", 6).alias("score"))


def weighted_pairs(spark, d):
    pairs = Pairs(_flagged(spark, d), ["name", "street", "city", "zip5"], "street_full")
    return score(pairs, Config(), "weighted").df.select("pair_id", F.round("score", 6).alias("score"))


def review_fields(spark, d):
    """Review context of the registrations: decoded structure and one flag a business type."""
    return review.sam_review_fields(table(spark, d, "df_source")).select("uei", "SAM_entity_start_date", "SAM_entity_structure", "SAM_entity_structure_label", "SAM_bus_type_nonprofit", "SAM_bus_type_foundation")


def registry_fields(spark, d):
    db = table(spark, d, "df_db").select("ein", F.col("ntee_clean").alias("ntee_code_clean"), F.col("subsection").alias("subsection_code"), "ruling_date", F.col("assets").alias("asset_amount"), F.col("revenue").alias("revenue_amount"))
    return review.bmf_review_fields(db).select("ein", "BMF_ntee_clean", "BMF_subsection", "BMF_rule_year", "BMF_assets", "BMF_revenue", "BMF_is_foundation", "BMF_form_990")


def screen(spark, d):
    """Registrations screened against the index of registry names: the share of each one's telling tokens that one entry of its state has."""
    return tier1.screen(_q(spark, d), tier1.index(_r(spark, d)))


def one_to_one(spark, d):
    return tier1.one_to_one(_scored(spark, d).df.where("score > 0").select("id", "ein", "score"))


def name_versions(spark, d):
    """Which versions of the names agree in pairs that an exact pass brings up."""
    x, y = keep(normalize(_registrations(spark, d)), "queries"), keep(normalize(_registry(spark, d)), "reference")
    found = block.union(*[p.block(x, y) for p in pipeline.default_passes()[:4]])
    return compare(found, x, y).df.select(F.col("owner").alias("id"), "ein", "name_ver_x", "name_ver_y", "name_match_type").distinct()


def rescale(spark, d):
    return rescaled(table(spark, d, "candidate_pairs"), "total_score", "score").select("pair_id", F.round("score", 6).alias("score"))


def report_pairs(spark, d):
    return pair_stats(_scored(spark, d).df).select("unique_pairs", "queries", F.round("per_query", 6).alias("per_query"), "most")


def label_frame(spark, d):
    return T.label_frame(_scored(spark, d), 3).select("id", "ein", "candidate_type", "label")


def candidates_topk(spark, d):
    return candidates(_scored(spark, d), 3).select("id", "ein", "candidate_type")


def _labelled(spark, d) -> DataFrame:
    m = table(spark, d, "match_labels").where(F.col("gt_is_match").isNotNull()).select(F.col("uei").alias("unique_entity_id"), "gt_ein")
    p = table(spark, d, "candidate_pairs").join(m, "unique_entity_id").where(~F.isnan("total_score"))
    return p.select(F.col("total_score").alias("score"), F.coalesce((F.col("ein") == F.col("gt_ein")).cast("int"), F.lit(0)).alias("label"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def auc(spark, d):
    return _rounded(E.auc(_labelled(spark, d)))


def evaluate(spark, d):
    return _rounded(E.evaluate(_labelled(spark, d), 0.65))


def tune_thresholds(spark, d):
    return _rounded(E.tune_thresholds(_labelled(spark, d), 0.9, 0.95))


def diff_unmatched(spark, d):
    return incremental.diff_unmatched(table(spark, d, "df_source"), table(spark, d, "match_labels"), "unique_entity_id", "uei", "gt_outcome_class", ("in_bmf_match",)).select("source_row_id", "unique_entity_id")


def diff_counts(spark, d):
    return incremental.diff_counts(table(spark, d, "df_source"), table(spark, d, "match_labels"), "unique_entity_id", "uei", "gt_outcome_class", ("in_bmf_match",))


def flag_membership(spark, d):
    return schema.flag_active(table(spark, d, "df_db").select("db_row_id", "ein"), table(spark, d, "candidate_pairs")).select("db_row_id", "active")


def code_flags(spark, d):
    s = incremental.flag_codes(table(spark, d, "df_source"), "bus_type_string", ["A8", "BZ", "2U", "A7"], "nonprofit")
    return incremental.flag_codes(s, "bus_type_string", ["M8"], "educational", exact=True).select("source_row_id", "nonprofit", "educational")


def clean_geo(spark, d):
    return geo.clean_geo(table(spark, d, "df_db").select("db_row_id", F.col("org_addr_city").alias("city"), F.col("org_addr_state").alias("state")))


def refine_city(spark, d):
    ref = table(spark, d, "df_db").where("org_addr_zip5 != ''").select(F.col("org_addr_zip5").alias("zip5"), F.col("org_addr_city").alias("city"))
    return geo.refine_city(table(spark, d, "df_source").select("source_row_id", F.col("physical_address_city").alias("city"), F.col("physical_address_zip_postal_code").alias("zip5")), ref).select("source_row_id", "city")


def dominant_geo(spark, d):
    g = table(spark, d, "df_db").where("org_addr_zip5 != '' and org_addr_state != ''").groupBy(F.col("org_addr_zip5").alias("zip"), F.col("org_addr_state").alias("state")).agg(F.count(F.lit(1)).alias("tot_ratio"))
    return geo.load_hud(g)


def augment_geo(spark, d):
    c = table(spark, d, "df_db").where("org_addr_zip5 != ''").groupBy(F.col("org_addr_zip5").alias("zip5")).agg(F.min("ntee_clean").alias("ntee"))
    return geo.augment_geo(table(spark, d, "df_source").select("source_row_id", F.col("physical_address_zip_postal_code").alias("zip5")), c).select("source_row_id", "ntee")


def _named_pairs(spark, d):
    """The older scorer's pairs with every name of both sides."""
    a, b = _featured(table(spark, d, "df_source"), "unique_entity_id", "legal_business_name", "x"), _featured(table(spark, d, "df_db"), "ein", "org_name_raw", "y")
    p = table(spark, d, "candidate_pairs").groupBy("unique_entity_id", "ein").agg(F.max(F.when(~F.isnan("name_similarity"), F.col("name_similarity"))).alias("name_sim"))
    p = p.join(a, "unique_entity_id").join(b, "ein").withColumnRenamed("unique_entity_id", "id").withColumn("score", F.lit(0.0))
    return p


def _featured(df: DataFrame, key: str, name: str, s: str) -> DataFrame:
    """The different names of each key with the features that rules read."""
    full = df.select(key, F.col(name).alias(f"name_{s}"), X.name_full(F.col(name)).alias("f")).distinct()
    c = F.col("f")
    return full.select(key, f"name_{s}", F.col(f"name_{s}").alias(f"name_raw_{s}"), X.numbers(c).alias(f"name_nums_{s}"), X.mapped_tokens(c, K.ORDINAL_RANKS).alias(f"name_ord_{s}"), X.mapped_tokens(c, K.NAME_DIRECTIONS).alias(f"name_dir_{s}"),
                       X.name_form(c).alias(f"name_form_{s}"), X.lookup(K.GENERATIONS, X.generation(c)).alias(f"name_gen_rank_{s}"))


def veto_audit(spark, d):
    """The default rules on the older scorer's pairs, names as given."""
    return V.veto_audit(V.veto(_named_pairs(spark, d))).select("id", "ein", "name_x", "name_y", "severity", "veto_rule")


def veto_optional(spark, d):
    """The rules that are off by default, on the same pairs."""
    rules = Config(rules=(V.LEGAL_FORM, V.GENERATION, V.GENERATION_ASYMMETRY))
    return V.veto_audit(V.veto(_named_pairs(spark, d), rules)).select("id", "ein", "name_x", "name_y", "severity", "veto_rule")


def _run(spark, d, slim=False):
    return pipeline.cascade(_registrations(spark, d), _registry(spark, d), slim=slim)


_RESULT = ["id", "tier", "overall_ein", "overall_score", "overall_margin", "name_ein", "addr_ein", "views_agree", "n_close", "pass"]


def cascade(spark, d):
    return _run(spark, d, slim=True).tiered.select(*_RESULT)


def _matched(spark, d, method, *columns):
    q, r = _registrations(spark, d), _registry(spark, d)
    x, y = keep(normalize(q), "queries"), keep(normalize(r), "reference")
    found = keep(block.union(block.exact(x, y, ["state", "street_key"]), *[p.block(x, y) for p in pipeline.default_passes()]), "candidates")
    return pipeline.scores(x, y, found, ["id", "ein", *columns], method=method)


_SCORED = ["id", "ein", "score", "name_sim", "name_match_type", "veto_reason"]


def score_weighted(spark, d):
    return _matched(spark, d, "weighted", *_SCORED).df.select(*_SCORED)


def score_hier(spark, d):
    return _matched(spark, d, "hier", *_SCORED).df.select(*_SCORED)


def score_em(spark, d):
    return _matched(spark, d, "em", "score", "weight_em").df.select("id", "ein", "score", "weight_em")


def score_model(spark, d):
    m = table(spark, d, "match_labels").where(F.col("gt_is_match").isNotNull())
    pairs = _matched(spark, d, "weighted")
    known = keep(pairs.df, "pairs").join(m.select(F.col("uei").alias("id"), "gt_ein"), "id", "left_outer").withColumn("label", F.when(F.col("id").isNotNull() & F.col("gt_ein").isNotNull(), F.col("ein") == F.col("gt_ein"))).drop("gt_ein")
    pairs = pairs.with_df(known)
    return T.train(pairs).predict(pairs.df).select("id", "ein", "p_model")


def route_review(spark, d):
    return route(_run(spark, d)).review


def run_report_stats(spark, d):
    return tier_shares(_run(spark, d, slim=True).tiered)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    p1_found, p1_state_profile, canonicalize, name_features, street_features, zip_family, name_freq, token_idf, geo_profile, block_exact, block_cross_column, block_union, block_token,
    block_token_idf, block_token_concat, block_crossstate, select_best, select_ruled, select_tiebreak, geo_flags, hier_pairs, weighted_pairs, review_fields, registry_fields, screen, one_to_one, name_versions, rescale, report_pairs, label_frame, candidates_topk, auc, evaluate, tune_thresholds, diff_unmatched, diff_counts, flag_membership, code_flags, clean_geo, refine_city,
    dominant_geo, augment_geo, veto_audit, veto_optional, score_weighted, score_hier, score_em, score_model, cascade, route_review, run_report_stats,
)}

SQL = ORACLE | {
    "p1_found": """
        WITH r AS (SELECT 'df_source' AS table_name, physical_address_province_or_state AS f FROM df_source
                   UNION ALL SELECT 'df_db', org_addr_state FROM df_db),
             n AS (SELECT table_name, count(*) AS n FROM r GROUP BY 1),
             s AS (SELECT table_name, state_code, count(*) AS k FROM r JOIN state_codes c
                   ON upper(trim(replace(f, '.', ''))) IN (upper(c.state_code), upper(c.state_name)) GROUP BY 1, 2)
        SELECT table_name, state_code FROM s JOIN n USING (table_name) WHERE k >= 0.08 * n""",
    "p1_state_profile": """
        WITH d AS (SELECT upper(trim(replace(org_addr_state, '.', ''))) AS state, upper(trim(org_addr_city)) AS city, revenue FROM df_db),
             c AS (SELECT state, city, count(*) AS k FROM d GROUP BY 1, 2),
             m AS (SELECT state, city AS top_city FROM c WHERE city IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY state ORDER BY k DESC, city) = 1),
             t AS (SELECT state, count(*) AS n_rows, count(DISTINCT city) AS n_cities, quantile_disc(revenue, 0.5) AS p50_revenue,
                          quantile_disc(revenue, 0.9) AS p90_revenue FROM d GROUP BY 1)
        SELECT t.state, n_rows, n_cities, top_city, p50_revenue, p90_revenue FROM t LEFT JOIN m ON t.state IS NOT DISTINCT FROM m.state""",
}
