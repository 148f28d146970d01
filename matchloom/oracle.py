"""SQL for the core queries, run by DuckDB over the same tables. Only the fixed values are shared with the operators."""

from __future__ import annotations

from .functions import constants as K


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {other} END"


def squish(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return squish(f"regexp_replace(replace(strip_accents(upper(replace(coalesce({x}, ''), 'ß', ' '))), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g')")


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def replaced(x: str, table: dict[str, str]) -> str:
    return f"array_to_string(list_transform({toks(x)}, lambda t: {_case('t', table, 't')}), ' ')"


def full(x: str) -> str:
    return replaced(clean(x), K.ABBREVIATIONS)


def key(f: str) -> str:
    bare = f"trim(regexp_replace({f}, '((^| )({'|'.join(K.LEGAL_SUFFIXES)}))+$', ''))"
    return f"regexp_replace(CASE WHEN {bare} = '' THEN {f} ELSE {bare} END, '^THE (.+)$', '\\1')"


def mapped(f: str, table: dict[str, str]) -> str:
    return f"nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform({toks(f)}, lambda t: {_case('t', table, 'NULL')}), lambda v: v IS NOT NULL))), ' '), '')"


def form(f: str) -> str:
    return f"(list_transform(list_filter({toks(f)}, lambda t: t IN {_in(K.LEGAL_SUFFIXES)})[-1:], lambda t: {_case('t', K.CANONICAL_FORMS, 't')}))[1]"


def numbers(f: str) -> str:
    return f"nullif(array_to_string(list_sort(regexp_extract_all({f}, '[0-9]+')), ' '), '')"


def telling(k: str) -> str:
    return f"list_filter(string_split({k}, ' '), lambda t: length(t) >= 2 AND t NOT IN {_in(K.STOPWORDS)})"


def zip5(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) > 5 THEN lpad(left({d}[:length({d}) - 4], 5), 5, '0') WHEN length({d}) > 0 THEN lpad({d}, 5, '0') END"


def plus4(x: str, p: str) -> str:
    d, q = f"regexp_replace({x}, '[^0-9]', '', 'g')", f"regexp_replace({p}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) > 5 THEN right({d}, 4) WHEN length({q}) > 0 THEN lpad(left({q}, 4), 4, '0') END"


def state(x: str) -> str:
    s = f"upper({squish(x)})"
    return f"CASE WHEN {s} IN {_in(sorted(set(K.STATE_CODES.values())))} THEN {s} ELSE {_case(s, K.STATE_CODES, 'NULL')} END"


def street(x: str) -> str:
    plain = squish(replaced(f"regexp_replace({clean(x)}, '{K.UNIT_DROPPED}', ' ', 'g')", K.STREET_WORDS))
    return f"(SELECT CASE WHEN regexp_matches(s, '{K.BOX_PATTERN}') THEN 'PO BOX ' || regexp_extract(s, '[0-9]+') ELSE s END FROM (SELECT {plain} AS s))"


# queries and reference as canonical, normalized records; qid and rid number the distinct records
Q = f"""q0 AS (SELECT unique_entity_id AS id, {squish('legal_business_name')} AS name, {squish('dba_name')} AS dba, {squish('physical_address_province_or_state')} AS state FROM df_source),
    q1 AS (SELECT DISTINCT id, state, {full('name')} AS f, {full('dba')} AS g FROM q0),
    q AS (SELECT DISTINCT id, state, {key('f')} AS name_key, {key('g')} AS dba_key FROM q1)"""
R = f"""r0 AS (SELECT DISTINCT ein, {squish('org_name_join')} AS name, {squish('dba_name')} AS dba, {squish('org_addr_street')} AS street, {squish('org_addr_city')} AS city, {squish('org_addr_state')} AS state,
               {squish('org_addr_zip5')} AS zip5, {squish('org_addr_zip4')} AS zip4 FROM df_db),
    r1 AS (SELECT row_number() OVER () AS rid, ein, state, {full('name')} AS f, {full('dba')} AS g FROM r0),
    r AS (SELECT rid, ein, state, {key('f')} AS name_key, {key('g')} AS dba_key FROM r1)"""
_TOKENS = f"""qt AS (SELECT DISTINCT id, state, unnest({telling('name_key')}) AS token FROM q), rt AS (SELECT rid, ein, state, unnest({telling('name_key')}) AS token FROM r),
    d AS (SELECT token, count(DISTINCT rid) AS df FROM rt GROUP BY 1)"""
_PAIRS = """p AS (SELECT pair_id, unique_entity_id AS id, ein, CASE WHEN isnan(total_score) THEN NULL ELSE total_score END AS score, coalesce(CASE WHEN isnan(name_similarity) THEN 0 ELSE name_similarity END, 0) AS name_sim,
               coalesce(CASE WHEN isnan(addr_similarity) THEN 0 ELSE addr_similarity END, 0) AS addr_sim FROM candidate_pairs),
    s AS (SELECT pair_id, id, ein, coalesce(score, 0) AS score, name_sim, addr_sim FROM p)"""
_PICKS = _PAIRS + """,
    w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ein, pair_id) AS r, row_number() OVER (PARTITION BY id ORDER BY name_sim DESC, score DESC, ein, pair_id) AS n,
               row_number() OVER (PARTITION BY id ORDER BY addr_sim DESC, score DESC, ein, pair_id) AS a, max(score) OVER (PARTITION BY id) AS top FROM s),
    o AS (SELECT id, max(ein) FILTER (r = 1) AS overall_ein, max(score) FILTER (r = 1) AS overall_score, max(score) FILTER (r = 2) AS runner_up, max(ein) FILTER (n = 1) AS name_ein,
               max(ein) FILTER (a = 1) AS addr_ein, count(*) FILTER (score >= top - 0.05) AS n_close FROM w GROUP BY 1)"""
_LABELLED = """l AS (SELECT p.total_score AS s, CASE WHEN p.ein = m.gt_ein THEN 1 ELSE 0 END AS y FROM candidate_pairs p JOIN match_labels m ON p.unique_entity_id = m.uei
               WHERE m.gt_is_match IS NOT NULL AND p.total_score IS NOT NULL AND NOT isnan(p.total_score)),
    k AS (SELECT s, count(*) AS n, sum(y) AS p FROM l GROUP BY 1)"""
_AUC = """(SELECT (sum(r * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)) FROM (SELECT n, p, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM k))"""

_AFFILIATE = f"coalesce(contains(other, ' ') AND regexp_extract(other, '([^ ]+)$', 1) IN {_in(K.AFFILIATES)} AND sim >= 0.95 AND NOT list_contains(string_split(raw, ' '), regexp_extract(other, '([^ ]+)$', 1)), false)"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def generation(f: str) -> str:
    return f"CASE list_filter({toks(f)}, lambda t: t IN ('JR', 'SR'))[1] WHEN 'JR' THEN '2' WHEN 'SR' THEN '1' END"


# the older scorer's pairs with every name of both sides, and what rules say of them
_NAMED = f"""a AS (SELECT DISTINCT unique_entity_id AS id, legal_business_name AS n, {full('legal_business_name')} AS f FROM df_source), b AS (SELECT DISTINCT ein, org_name_raw AS m, {full('org_name_raw')} AS g FROM df_db),
        c AS (SELECT unique_entity_id AS id, ein, max(CASE WHEN isnan(name_similarity) THEN NULL ELSE name_similarity END) AS sim FROM candidate_pairs GROUP BY ALL), j AS (SELECT id, ein, n, m, sim, {numbers('f')} AS na, {numbers('g')} AS nb,
             {mapped('f', K.ORDINAL_RANKS)} AS oa, {mapped('g', K.ORDINAL_RANKS)} AS ob, {mapped('f', K.NAME_DIRECTIONS)} AS da, {mapped('g', K.NAME_DIRECTIONS)} AS db, {form('f')} AS fa, {form('g')} AS fb, {generation('f')} AS ga, {generation('g')} AS gb,
             {_plain('n')} AS raw, {_plain('m')} AS other FROM c JOIN a USING (id) JOIN b USING (ein))"""
_RULED = """x AS (SELECT id, ein, n, m, array_to_string(list_filter(h, lambda e: e IS NOT NULL), ';') AS hard, array_to_string(list_filter(w, lambda e: e IS NOT NULL), ';') AS soft FROM v)
        SELECT id, ein, n AS name_x, m AS name_y, CASE WHEN hard <> '' THEN 'hard' ELSE 'soft' END AS severity, CASE WHEN hard <> '' THEN hard ELSE soft END AS veto_rule FROM x WHERE hard <> '' OR soft <> ''"""


def _number(k: str) -> str:
    return rf"nullif(CASE WHEN regexp_matches({k}, '\bBOX\b') THEN regexp_extract({k}, 'BOX\s*#?\s*([0-9]+)', 1) ELSE regexp_extract({k}, '^[0-9]+[A-Z]?(-[0-9]+[A-Z]?)?') END, '')"


def _same(c: str) -> str:
    return f"CASE WHEN x{c} <> '' AND x{c} = y{c} THEN 1 ELSE 0 END"


# the older scorer's pairs with the geographic agreements of one record a side
_FLAGS = f"""{R}, f AS (SELECT name_key, count(*) AS freq FROM r GROUP BY 1),
        qx AS (SELECT unique_entity_id AS id, {zip5('physical_address_zip_postal_code')} AS xz5, {zip5('physical_address_zip_postal_code')} || '-' || {plus4('physical_address_zip_postal_code', 'physical_address_zip_code_4')} AS xz9, {squish('physical_address_city')} AS xcity,
               {squish('physical_address_province_or_state')} AS xst, {street(squish('physical_address_line_1'))} AS xk FROM df_source QUALIFY row_number() OVER (PARTITION BY unique_entity_id ORDER BY source_row_id) = 1),
        ry AS (SELECT ein, {zip5('org_addr_zip5')} AS yz5, {zip5('org_addr_zip5')} || '-' || {plus4('org_addr_zip5', 'org_addr_zip4')} AS yz9, {squish('org_addr_city')} AS ycity, {squish('org_addr_state')} AS yst, {street(squish('org_addr_street'))} AS yk,
               {key('f')} AS name_key FROM (SELECT *, {full('org_name_join')} AS f FROM df_db) QUALIFY row_number() OVER (PARTITION BY ein ORDER BY db_row_id) = 1),
        p0 AS (SELECT pair_id, unique_entity_id AS id, ein, coalesce(CASE WHEN isnan(name_similarity) THEN 0 ELSE name_similarity END, 0) AS name_sim, coalesce(CASE WHEN isnan(addr_similarity) THEN 0 ELSE addr_similarity END, 0) AS addr_raw FROM candidate_pairs),
        k0 AS (SELECT *, left(xz5, 3) AS xz3, left(yz5, 3) AS yz3, {_number('xk')} AS xn, {_number('yk')} AS yn FROM p0 JOIN qx USING (id) JOIN ry USING (ein) LEFT JOIN f USING (name_key)),
        g AS (SELECT pair_id, name_sim, addr_raw AS addr_sim, freq, {_same('z9')} AS geo_zip9, {_same('z5')} AS geo_zip5, {_same('z3')} AS geo_zip3, {_same('st')} AS geo_state, {_same('n')} AS geo_stnum,
               CASE WHEN regexp_matches(xk, '{K.BOX_PATTERN}') AND regexp_matches(yk, '{K.BOX_PATTERN}') THEN 1 ELSE 0 END AS geo_pobox, CASE WHEN xcity = ycity THEN 1.0 ELSE 0 END AS city_sim FROM k0)"""

SQL = {
    "canonicalize": f"SELECT unique_entity_id AS id, {squish('legal_business_name')} AS name, {squish('dba_name')} AS dba, {squish('entity_division_name')} AS division, {squish('physical_address_line_1')} AS street, {squish('physical_address_line_2')} AS unit, {squish('physical_address_city')} AS city, {squish('physical_address_province_or_state')} AS state, {squish('physical_address_zip_postal_code')} AS zip5 FROM df_source",
    "name_features": f"""WITH f AS (SELECT db_row_id, {full('org_name_raw')} AS f FROM df_db)
        SELECT db_row_id, f AS name_full, {key('f')} AS name_key, {form('f')} AS name_form, {numbers('f')} AS name_nums, {mapped('f', K.ORDINAL_RANKS)} AS name_ord, {mapped('f', K.NAME_DIRECTIONS)} AS name_dir,
               list_filter({toks('f')}, lambda t: t IN ('JR', 'SR'))[1] AS name_gen FROM f""",
    "street_features": rf"""WITH s AS (SELECT db_row_id, nullif(regexp_extract(upper(org_addr_street), '{K.UNIT_PATTERN}'), '') AS u, {street('org_addr_street')} AS k FROM df_db),
             t AS (SELECT *, regexp_matches(k, '\bBOX\b') AS box, {squish("regexp_replace(k, '^[0-9]+[A-Z]?(-[0-9]+[A-Z]?)?', '')")} AS rest FROM s),
             e AS (SELECT *, regexp_extract(rest, '([^ ]+)$', 1) AS last FROM t), y AS (SELECT *, last IN {_in(K.STREET_TYPES)} AS typed FROM e)
        SELECT db_row_id, {squish('u')} AS street_unit, k AS street_key, regexp_matches(k, '{K.BOX_PATTERN}') AS is_po_box,
               nullif(CASE WHEN box THEN regexp_extract(k, 'BOX\s*#?\s*([0-9]+)', 1) ELSE regexp_extract(k, '^[0-9]+[A-Z]?(-[0-9]+[A-Z]?)?') END, '') AS street_num,
               CASE WHEN box THEN 'PO BOX' ELSE nullif(CASE WHEN typed THEN regexp_replace(rest, ' ?[^ ]+$', '') ELSE rest END, '') END AS street_name,
               CASE WHEN NOT box AND typed THEN last END AS street_type FROM y""",
    "zip_family": f"SELECT source_row_id, {zip5('physical_address_zip_postal_code')} AS zip5, left({zip5('physical_address_zip_postal_code')}, 3) AS zip3, {zip5('physical_address_zip_postal_code')} || '-' || {plus4('physical_address_zip_postal_code', 'physical_address_zip_code_4')} AS zip9, {state('physical_address_province_or_state')} AS state_abb FROM df_source",
    "name_freq": f"WITH {R} SELECT name_key AS name, count(*) AS freq FROM r GROUP BY 1",
    "token_idf": f"WITH {R}, t AS (SELECT rid, unnest(list_distinct({telling('name_key')})) AS token FROM r) SELECT token, count(*) AS df, ln((SELECT count(*) FROM r) / count(*)) AS idf FROM t GROUP BY 1",
    "geo_profile": """SELECT round(avg(CASE WHEN coalesce(trim(physical_address_line_1), '') <> '' THEN 1.0 ELSE 0 END), 6) AS street, round(avg(CASE WHEN coalesce(trim(physical_address_line_2), '') <> '' THEN 1.0 ELSE 0 END), 6) AS unit,
        round(avg(CASE WHEN coalesce(trim(physical_address_city), '') <> '' THEN 1.0 ELSE 0 END), 6) AS city, round(avg(CASE WHEN coalesce(trim(physical_address_province_or_state), '') <> '' THEN 1.0 ELSE 0 END), 6) AS state,
        round(avg(CASE WHEN coalesce(trim(physical_address_zip_postal_code), '') <> '' THEN 1.0 ELSE 0 END), 6) AS zip5 FROM df_source""",
    "block_exact": f"WITH {Q}, {R} SELECT DISTINCT id, ein FROM q JOIN r USING (state, name_key) WHERE state <> '' AND name_key <> ''",
    "block_cross_column": f"WITH {Q}, {R} SELECT DISTINCT q.id, r.ein FROM q JOIN r ON q.state = r.state AND q.dba_key = r.name_key WHERE q.state <> '' AND q.dba_key <> ''",
    "block_token": f"WITH {Q}, {R}, {_TOKENS} SELECT DISTINCT qt.id, rt.ein FROM qt JOIN rt USING (state, token) WHERE state <> ''",
    "block_union": f"WITH {Q}, {R} SELECT id, ein FROM q JOIN r USING (state, name_key) WHERE state <> '' AND name_key <> '' UNION SELECT q.id, r.ein FROM q JOIN r ON q.state = r.state AND q.dba_key = r.name_key WHERE q.state <> '' AND q.dba_key <> ''",
    "block_token_idf": f"""WITH {Q}, {R}, {_TOKENS}, w AS (SELECT q.id, q.name_key, q.dba_key, r.rid, r.ein, r.token, d.df FROM (SELECT id, state, name_key, dba_key, unnest({telling('name_key')}) AS token FROM q WHERE state <> '') q JOIN rt r USING (state, token) JOIN d USING (token) WHERE d.df <= 25000),
        x AS (SELECT id, name_key, dba_key, rid, any_value(ein) AS ein, sum(ln((SELECT count(*) FROM r) / df)) AS w FROM w GROUP BY id, name_key, dba_key, rid) SELECT DISTINCT id, ein FROM x WHERE w >= least(8, ln((SELECT count(*) FROM r))) - 1e-9""",
    "select_best": f"""WITH {_PICKS} SELECT id, overall_ein, round(overall_score, 6) AS overall_score, name_ein, addr_ein, n_close, n_close >= 2 AS tie, round(overall_score - coalesce(runner_up, 0), 6) AS overall_margin,
        name_ein = overall_ein AND addr_ein = overall_ein AS views_agree,
        CASE WHEN overall_score >= 0.78 AND overall_score - coalesce(runner_up, 0) >= 0.05 THEN 'YES' WHEN overall_score >= 0.65 THEN 'MAYBE' ELSE 'NO' END AS tier FROM o""",
    "candidates_topk": f"""WITH {_PICKS}, g AS (SELECT id, ein, CASE WHEN r <= 3 THEN 'top' || r END AS x, CASE WHEN n = 1 THEN 'best_name' END AS y, CASE WHEN a = 1 THEN 'best_addr' END AS z FROM w WHERE r <= 3 OR n = 1 OR a = 1),
        u AS (SELECT DISTINCT id, ein, unnest([x, y, z]) AS t FROM g) SELECT id, ein, string_agg(t, '+' ORDER BY t) AS candidate_type FROM u WHERE t IS NOT NULL GROUP BY 1, 2""",
    "auc": f"WITH {_LABELLED} SELECT round({_AUC}, 6) AS auc",
    "evaluate": f"""WITH {_LABELLED}, t AS (SELECT sum(n) AS n, sum(p) AS n_pos, sum(p) FILTER (s >= 0.65) AS tp, sum(n - p) FILTER (s >= 0.65) AS fp FROM k)
        SELECT n, n_pos, round({_AUC}, 6) AS auc, round(tp / (tp + fp), 6) AS precision, round(tp / n_pos, 6) AS recall, round(2 * tp / (tp + fp + n_pos), 6) AS f1, round((n - n_pos - fp + tp) / n, 6) AS accuracy FROM t""",
    "tune_thresholds": f"""WITH {_LABELLED}, c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k FROM k),
        t AS (SELECT coalesce(min(s) FILTER (tp >= 0.9 * k), max(s) + 1e-6) AS yes, max(s) FILTER (tp >= 0.95 * (SELECT sum(p) FROM k)) AS b FROM c) SELECT round(yes, 6) AS yes, round(least(coalesce(b, yes), yes), 6) AS maybe FROM t""",
    "diff_unmatched": "SELECT source_row_id, unique_entity_id FROM df_source WHERE unique_entity_id NOT IN (SELECT uei FROM match_labels WHERE gt_outcome_class = 'in_bmf_match')",
    "diff_counts": """WITH k AS (SELECT uei, bool_or(gt_outcome_class = 'in_bmf_match') AS m FROM match_labels GROUP BY 1) SELECT count(*) AS fresh, count(*) FILTER (coalesce(m, false)) AS already, count(*) FILTER (NOT coalesce(m, false)) AS retained,
        count(DISTINCT CASE WHEN uei IS NULL THEN unique_entity_id END) AS new_ids FROM df_source LEFT JOIN k ON uei = unique_entity_id""",
    "flag_membership": "SELECT db_row_id, ein IN (SELECT ein FROM candidate_pairs) AS active FROM df_db",
    "code_flags": "SELECT source_row_id, coalesce(contains(bus_type_string, 'A8') OR contains(bus_type_string, 'BZ') OR contains(bus_type_string, '2U') OR contains(bus_type_string, 'A7'), false) AS nonprofit, coalesce(list_contains(string_split(bus_type_string, '~'), 'M8'), false) AS educational FROM df_source",
    "clean_geo": f"""WITH c AS (SELECT db_row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({squish('org_addr_city')}), '^ST ', 'SAINT '), '^STE ', 'SAINTE '), '^FT ', 'FORT '), '^MT ', 'MOUNT ') AS c, {state('org_addr_state')} AS state FROM df_db)
        SELECT db_row_id, {_case('c', K.CITY_ALIASES, 'c')} AS city, state FROM c""",
    "refine_city": """WITH z AS (SELECT org_addr_zip5 AS zip5, min(upper(org_addr_city)) AS ref FROM df_db WHERE org_addr_city <> '' AND org_addr_zip5 <> '' GROUP BY 1)
        SELECT source_row_id, CASE WHEN ref IS NULL THEN upper(physical_address_city) WHEN coalesce(physical_address_city, '') = '' THEN ref WHEN levenshtein(upper(physical_address_city), ref) <= 2 THEN ref ELSE upper(physical_address_city) END AS city
        FROM df_source LEFT JOIN z ON zip5 = physical_address_zip_postal_code""",
    "dominant_geo": "WITH g AS (SELECT org_addr_zip5 AS zip5, org_addr_state AS state, count(*) AS n FROM df_db WHERE org_addr_zip5 <> '' AND org_addr_state <> '' GROUP BY 1, 2) SELECT zip5, state FROM g QUALIFY row_number() OVER (PARTITION BY zip5 ORDER BY n DESC, state) = 1",
    "augment_geo": """WITH c AS (SELECT org_addr_zip5 AS zip5, min(ntee_clean) AS ntee FROM df_db WHERE org_addr_zip5 <> '' GROUP BY 1) SELECT source_row_id, ntee FROM df_source LEFT JOIN c ON zip5 = physical_address_zip_postal_code""",
    "veto_audit": f"""WITH {_NAMED}, v AS (SELECT *, [CASE WHEN NOT list_has_any(string_split(na, ' '), string_split(nb, ' ')) THEN 'number_conflict' END, CASE WHEN oa <> ob THEN 'ordinal_conflict' END, CASE WHEN da <> db THEN 'direction_conflict' END,
             CASE WHEN regexp_matches(raw, '{K.FORPROFIT_PATTERN}') THEN 'forprofit_form' END] AS h, [CASE WHEN {_AFFILIATE} THEN 'affiliate_suffix' END, CASE WHEN regexp_matches(raw, '{K.GOVERNMENT_PATTERN}') THEN 'government_entity' END] AS w FROM j),
        {_RULED}""",
    "veto_optional": f"""WITH {_NAMED}, v AS (SELECT *, [CASE WHEN fa <> fb THEN 'legal_form_conflict' END, CASE WHEN ga <> gb THEN 'generation' END] AS h, [CASE WHEN (ga IS NULL) <> (gb IS NULL) THEN 'generation_asym' END] AS w FROM j),
        {_RULED}""",
    "select_ruled": f"""WITH {_PAIRS}, a AS (SELECT id, n, f FROM (SELECT DISTINCT unique_entity_id AS id, legal_business_name AS n, {full('legal_business_name')} AS f FROM df_source) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n NULLS FIRST) = 1),
        b AS (SELECT ein, m, g FROM (SELECT DISTINCT ein, org_name_raw AS m, {full('org_name_raw')} AS g FROM df_db) QUALIFY row_number() OVER (PARTITION BY ein ORDER BY m NULLS FIRST) = 1),
        j0 AS (SELECT s.*, n, m, {numbers('f')} AS na, {numbers('g')} AS nb, {mapped('f', K.ORDINAL_RANKS)} AS oa, {mapped('g', K.ORDINAL_RANKS)} AS ob, {mapped('f', K.NAME_DIRECTIONS)} AS da, {mapped('g', K.NAME_DIRECTIONS)} AS db,
               {_plain('n')} AS raw, {_plain('m')} AS other, name_sim AS sim FROM s JOIN a USING (id) JOIN b USING (ein)),
        j AS (SELECT *, coalesce(NOT list_has_any(string_split(na, ' '), string_split(nb, ' ')), false) OR coalesce(oa <> ob, false) OR coalesce(da <> db, false) OR regexp_matches(raw, '{K.FORPROFIT_PATTERN}') AS hard,
               {_AFFILIATE} OR regexp_matches(raw, '{K.GOVERNMENT_PATTERN}') AS soft FROM j0),
        w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ein, pair_id) AS r FROM j WHERE NOT hard),
        o AS (SELECT id, max(ein) FILTER (r = 1) AS overall_ein, max(score) FILTER (r = 1) AS top, max(score) FILTER (r = 2) AS next, bool_or(soft) FILTER (r = 1) AS soft FROM w GROUP BY 1)
        SELECT id, overall_ein, round(top, 6) AS overall_score, coalesce(soft, false) AS veto_soft,
               CASE WHEN top >= 0.78 AND top - coalesce(next, 0) >= 0.05 AND NOT soft THEN 'YES' WHEN top >= 0.65 THEN 'MAYBE' ELSE 'NO' END AS tier FROM (SELECT DISTINCT id FROM j) LEFT JOIN o USING (id)""",
    "geo_flags": f"WITH {_FLAGS} SELECT pair_id, geo_zip9, geo_zip5, geo_zip3, geo_state, geo_stnum, geo_pobox FROM g",
    "weighted_pairs": f"WITH {_FLAGS} SELECT pair_id, round(0.45 * name_sim + 0.25 * addr_sim + 0.15 * geo_zip5 + 0.15 * city_sim, 6) AS score FROM g",
    "hier_pairs": f"""WITH {_FLAGS}, h AS (SELECT *, 0.6 * name_sim + 0.4 * greatest(1.0 * geo_zip9, CASE WHEN geo_stnum = 1 AND addr_sim >= 0.9 AND geo_pobox = 0 THEN 0.95 ELSE 0 END, 0.9 * geo_zip5, CASE WHEN geo_pobox = 1 AND geo_stnum = 1 THEN 0.9 ELSE 0 END,
             0.55 * geo_zip3, 0.5 * city_sim, 0.2 * geo_state) AS base FROM g),
        i AS (SELECT *, CASE WHEN name_sim >= 0.95 AND freq <= 3 THEN greatest(base, CASE WHEN geo_state = 1 THEN 0.9 ELSE 0.72 END) ELSE base END AS lifted FROM h)
        SELECT pair_id, round(CASE WHEN name_sim < 0.85 THEN least(CASE WHEN name_sim >= 0.8 THEN greatest(lifted, 0.65) ELSE lifted END, 0.78 - 1e-6) ELSE lifted END, 6) AS score FROM i""",
    "review_fields": """SELECT unique_entity_id AS uei, entity_start_date AS SAM_entity_start_date, entity_structure AS SAM_entity_structure,
        CASE entity_structure WHEN '2J' THEN 'Sole Proprietorship' WHEN '2K' THEN 'Partnership or LLP' WHEN '2L' THEN 'Corporate Entity (Not Tax Exempt)' WHEN '8H' THEN 'Corporate Entity (Tax Exempt)' WHEN '2A' THEN 'U.S. Government Entity'
             WHEN 'CY' THEN 'Foreign Government' WHEN 'X6' THEN 'International Organization' WHEN 'ZZ' THEN 'Other' ELSE entity_structure END AS SAM_entity_structure_label,
        list_contains(string_split(coalesce(bus_type_string, ''), '~'), 'A8') AS SAM_bus_type_nonprofit, list_contains(string_split(coalesce(bus_type_string, ''), '~'), 'BZ') AS SAM_bus_type_foundation FROM df_source""",
    "registry_fields": """SELECT ein, ntee_clean AS BMF_ntee_clean, subsection AS BMF_subsection, try_cast(left(ruling_date, 4) AS INTEGER) AS BMF_rule_year, assets::DOUBLE AS BMF_assets, revenue::DOUBLE AS BMF_revenue,
        false AS BMF_is_foundation, NULL::VARCHAR AS BMF_form_990 FROM df_db""",
    "name_versions": f"""WITH {Q}, {R}, j AS (SELECT q.id, r.ein, q.name_key AS a, q.dba_key AS b, r.name_key AS c, r.dba_key AS d FROM q JOIN r USING (state) WHERE state <> '' AND ((q.name_key <> '' AND q.name_key IN (r.name_key, r.dba_key)) OR (q.dba_key <> '' AND q.dba_key IN (r.name_key, r.dba_key))))
        SELECT DISTINCT id, ein, CASE WHEN a <> '' AND a IN (c, d) THEN 'MAIN' ELSE 'DBA' END AS name_ver_x,
               CASE WHEN a <> '' AND a = c THEN 'MAIN' WHEN a <> '' AND a = d THEN 'DBA' WHEN b = c THEN 'MAIN' ELSE 'DBA' END AS name_ver_y, CASE WHEN a <> '' AND a = c THEN 'exact' ELSE 'dba' END AS name_match_type FROM j""",
    "rescale": """WITH v AS (SELECT pair_id, CASE WHEN isnan(total_score) THEN NULL ELSE total_score END AS s FROM candidate_pairs)
        SELECT pair_id, round((s - (SELECT min(s) FROM v)) / (SELECT max(s) - min(s) FROM v), 6) AS score FROM v""",
    "report_pairs": """WITH p AS (SELECT unique_entity_id AS id, count(DISTINCT ein) AS n FROM candidate_pairs GROUP BY 1)
        SELECT sum(n) AS unique_pairs, count(*) AS queries, round(avg(n), 6) AS per_query, max(n) AS most FROM p""",
    "screen": f"""WITH {Q}, {R}, qt AS (SELECT DISTINCT id, state, name_key, unnest(list_distinct({telling('name_key')})) AS token FROM q WHERE state <> ''), rt AS (SELECT DISTINCT rid, ein, state, unnest(list_distinct({telling('name_key')})) AS token FROM r WHERE state <> ''),
        n AS (SELECT id, state, name_key, count(*) AS n FROM qt GROUP BY ALL), h AS (SELECT id, state, name_key, rid, ein, count(*) AS k FROM qt JOIN rt USING (state, token) GROUP BY ALL)
        SELECT id, ein, max(k / n) AS share FROM h JOIN n USING (id, state, name_key) GROUP BY 1, 2 HAVING max(k / n) >= 0.5""",
}
SQL["label_frame"] = f"SELECT *, NULL::BOOLEAN AS label FROM ({SQL['candidates_topk']})"
