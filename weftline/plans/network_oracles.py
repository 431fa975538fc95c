"""Independent SQL for the network queries, as plain common table expressions for any engine with DuckDB's functions."""

from __future__ import annotations

import re


# Fixed values, stated here again and not taken from the operators, so that a wrong value there shows.
FIRST_YEAR, LAST_YEAR = 2010, 2025
VARIANTS = (
    "strict_primary", "broad_primary", "strict_preprint_sensitivity", "broad_preprint_sensitivity", "strict_expanded_sensitivity",
    "broad_expanded_sensitivity", "strict_all_versions_sensitivity", "broad_all_versions_sensitivity", "uncertain_topic_sensitivity",
)
PRIMARY_TYPES = ("article", "conference-paper", "review", "data-paper", "software-paper")
EXPANDED_TYPES = ("conference-abstract", "dataset", "software", "book", "book-chapter", "dissertation", "report", "standard")
EXCLUDED_TYPES = ("libguides", "other", "reference-entry", "peer-review", "paratext", "book-review", "editorial", "erratum", "supplementary-materials", "letter", "retraction")
INSTITUTION_TYPES = """('education', 'education', 'primary', true), ('government', 'government_research', 'primary', true), ('nonprofit', 'nonprofit_research', 'primary', true), ('facility', 'research_facility', 'primary', true), ('healthcare', 'healthcare', 'secondary', false),
    ('company', 'company', 'secondary', false), ('archive', 'archive', 'secondary', false), ('other', 'other', 'secondary', false), ('funder', 'funder', 'excluded', false)"""
# Countries by macro-region and subregion: those of the tables that the check runs on, and the larger others.
COUNTRIES = {
    ("Europe", "Western Europe"): "DE Germany, FR France, NL Netherlands (Kingdom of the), AT Austria, CH Switzerland, BE Belgium",
    ("Europe", "Northern Europe"): "GB United Kingdom of Great Britain and Northern Ireland, IE Ireland, SE Sweden, FI Finland, NO Norway, DK Denmark",
    ("Europe", "Southern Europe"): "IT Italy, ES Spain, PT Portugal, GR Greece",
    ("Europe", "Eastern Europe"): "PL Poland, CZ Czechia, RU Russian Federation, UA Ukraine",
    ("Asia", "Eastern Asia"): "CN China, JP Japan, KR Republic of Korea",
    ("Asia", "Southeastern Asia"): "TH Thailand, VN Viet Nam, ID Indonesia, MY Malaysia, SG Singapore",
    ("Asia", "Southern Asia"): "IN India, IR Iran (Islamic Republic of), PK Pakistan",
    ("Asia", "Western Asia"): "TR Türkiye, IL Israel, SA Saudi Arabia",
    ("Americas", "Northern America"): "US United States of America, CA Canada",
    ("Americas", "Central America"): "MX Mexico",
    ("Americas", "South America"): "BR Brazil, AR Argentina, CL Chile, CO Colombia",
    ("Africa", "Northern Africa"): "EG Egypt",
    ("Africa", "Sub-Saharan Africa"): "ZA South Africa, NG Nigeria, KE Kenya",
    ("Oceania", "Australia and New Zealand"): "AU Australia, NZ New Zealand",
}


def array_of(c: str, depth: int = 2) -> str:
    """The array in a JSON text: an object is an array of one, a string is read again."""
    inner = array_of(f"(({c})::JSON->>'$')", depth - 1) if depth > 1 else "NULL"
    return f"CASE WHEN json_valid({c}) THEN CASE json_type(({c})::JSON) WHEN 'ARRAY' THEN ({c})::JSON WHEN 'OBJECT' THEN json_array(({c})::JSON) WHEN 'VARCHAR' THEN {inner} END END"


def sid(c: str, letter: str = "A-Z") -> str:
    return f"nullif(regexp_extract({c}, '(?:^|/)\\s*([{letter}][0-9]+)\\s*/*\\s*$', 1), '')"


def elements(source: str, column: str, key: str = "work_id") -> str:
    """(key, i, x): the non-null elements of a JSON column with their positions."""
    return f"""SELECT {key}, i, x FROM (SELECT {key}, i, json_extract(arr, '$[' || i || ']') AS x FROM (SELECT {key}, arr, unnest(range(json_array_length(arr)::BIGINT)) AS i
    FROM (SELECT {key}, {array_of(column)} AS arr FROM {source}) AS e0 WHERE arr IS NOT NULL) AS e1) AS e2 WHERE json_type(x) <> 'NULL'"""


def joined(xs: str) -> str:
    return f"array_to_string(list_sort(list_distinct({xs})), ',')"


_types = ", ".join([*(f"('{t}', true, true, true)" for t in PRIMARY_TYPES), "('preprint', false, true, true)", *(f"('{t}', false, false, true)" for t in EXPANDED_TYPES), *(f"('{t}', false, false, false)" for t in EXCLUDED_TYPES)])
_countries = ", ".join(f"('{x[:2]}', '{x[3:]}', '{macro}', '{sub}')" for (macro, sub), names in COUNTRIES.items() for x in names.split(", "))
_clean = "NOT is_retracted AND NOT is_paratext"
_rep = "is_recommended_primary_representative"
_flags = {
    "strict_primary": f"s AND p1 AND {_clean} AND {_rep}", "broad_primary": f"b AND p1 AND {_clean} AND {_rep}", "strict_preprint_sensitivity": f"s AND p2 AND {_clean} AND {_rep}", "broad_preprint_sensitivity": f"b AND p2 AND {_clean} AND {_rep}",
    "strict_expanded_sensitivity": f"s AND p3 AND {_clean} AND {_rep}", "broad_expanded_sensitivity": f"b AND p3 AND {_clean} AND {_rep}", "strict_all_versions_sensitivity": f"s AND p1 AND {_clean}", "broad_all_versions_sensitivity": f"b AND p1 AND {_clean}", "uncertain_topic_sensitivity": f"u AND p1 AND {_clean} AND {_rep}",
}
_why = f"CASE WHEN NOT p1 THEN 'work_type_not_primary' END, CASE WHEN is_retracted THEN 'retracted' END, CASE WHEN is_paratext THEN 'paratext' END, CASE WHEN NOT {_rep} THEN 'non_representative_exact_doi_duplicate' END"
V = "year, corpus_view, hierarchy_view"

#: Named steps; a query names the steps it starts from and gets what these need, too.
STEPS: dict[str, str] = {
    "w": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY source_retrieved_at_utc ASC NULLS LAST, raw_record_hash ASC NULLS LAST) AS rn
        FROM works WHERE regexp_full_match(work_id, 'W[0-9]+') AND publication_year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}) AS d WHERE rn = 1""",
    "t0": elements("w", "topics_json"),
    "t1": f"SELECT work_id, i, {sid(chr(120) + '->>' + chr(39) + 'id' + chr(39))} AS topic_id, x->>'display_name' AS topic_name, TRY_CAST(x->>'score' AS DOUBLE) AS topic_score FROM t0 WHERE json_type(x) = 'OBJECT'",
    "topics": """SELECT t.work_id, t.topic_id, t.topic_name, t.topic_score, r.subfield_name, r.corpus_membership, r.method_family, t.topic_id = w.primary_topic_id AS is_primary_topic
        FROM (SELECT *, row_number() OVER (PARTITION BY work_id, topic_id ORDER BY i) AS k FROM t1 WHERE topic_id LIKE 'T%') AS t JOIN w ON w.work_id = t.work_id LEFT JOIN topic_registry AS r ON r.topic_id = t.topic_id WHERE k = 1""",
    "r0": elements("w", "referenced_works_json"),
    "refs": f"SELECT DISTINCT work_id, {sid('(x->>' + chr(39) + '$' + chr(39) + ')')} AS referenced_work_id FROM r0 WHERE json_type(x) = 'VARCHAR' AND {sid('(x->>' + chr(39) + '$' + chr(39) + ')')} LIKE 'W%'",
    "v0": """SELECT *, nullif(regexp_replace(lower(trim(doi)), '^https?://(dx\\.)?doi\\.[a-z]+/', ''), '') AS ndoi, nullif(regexp_replace(lower(trim(title)), '[^0-9A-Za-z]', '', 'g'), '') AS fp FROM w""",
    "v1": """SELECT v0.*, d.dn, t.tn FROM v0 LEFT JOIN (SELECT ndoi, count(*) AS dn FROM v0 WHERE ndoi IS NOT NULL GROUP BY 1 HAVING count(*) > 1) AS d USING (ndoi)
        LEFT JOIN (SELECT fp, count(*) AS tn FROM v0 WHERE length(fp) >= 20 GROUP BY 1 HAVING count(*) > 1 AND bool_or(work_type = 'preprint') AND bool_or(work_type <> 'preprint') AND max(publication_year) - min(publication_year) <= 3) AS t USING (fp)""",
    "versions": f"""SELECT work_id, ndoi AS normalized_doi, CASE WHEN dn > 1 THEN 'doi:' || md5(ndoi) END AS exact_doi_family_id, CASE WHEN tn > 1 THEN 'title:' || md5(fp) END AS possible_title_family_id,
        coalesce(CASE WHEN dn > 1 THEN 'doi:' || md5(ndoi) END, 'work:' || work_id) AS version_family_id, CASE WHEN dn > 1 THEN 'exact_normalized_doi' WHEN tn > 1 THEN 'possible_title_match_unresolved' ELSE 'singleton' END AS family_match_basis,
        coalesce(dn, 1) AS exact_doi_member_count, coalesce(tn, 0) AS possible_title_member_count, tn IS NOT NULL AND dn IS NULL AS ambiguous_possible_family, k = 1 AS is_recommended_primary_representative, k::INTEGER AS representative_rank, first_id AS primary_representative_work_id,
        CASE WHEN dn > 1 AND k = 1 THEN 'selected_deterministically_within_exact_doi_family' WHEN dn > 1 THEN 'non_representative_exact_doi_duplicate' WHEN tn > 1 THEN 'retained_because_title_only_family_is_ambiguous' ELSE 'singleton_record' END AS representative_reason
        FROM (SELECT *, row_number() OVER o AS k, first_value(work_id) OVER o AS first_id FROM v1 WINDOW o AS (PARTITION BY CASE WHEN dn > 1 THEN ndoi ELSE work_id END ORDER BY is_retracted NULLS LAST, is_paratext NULLS LAST,
        CASE WHEN work_type IN ({', '.join(map(repr, PRIMARY_TYPES))}) THEN 0 WHEN work_type = 'preprint' THEN 2 ELSE 1 END, cited_by_count DESC NULLS LAST, source_updated_date DESC NULLS LAST, work_id)) AS o""",
    "c0": f"""SELECT w.*, coalesce(t.s, false) AS s, coalesce(t.b, false) AS b, coalesce(t.u, false) AS u, coalesce(p.p1, false) AS p1, coalesce(p.p2, false) AS p2, coalesce(p.p3, false) AS p3, coalesce(t.fams, []) AS method_families, v.is_recommended_primary_representative
        FROM w JOIN versions AS v USING (work_id) LEFT JOIN (VALUES {_types}) AS p(work_type, p1, p2, p3) USING (work_type)
        LEFT JOIN (SELECT work_id, bool_or(corpus_membership = 'strict') AS s, bool_or(corpus_membership IN ('strict', 'broad_only')) AS b, bool_or(corpus_membership = 'uncertain') AS u,
          list_sort(list_distinct(list(method_family) FILTER (WHERE corpus_membership IN ('strict', 'broad_only', 'uncertain')))) AS fams FROM topics GROUP BY 1) AS t USING (work_id)""",
    "corpus": "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _flags.items()) + f", list_filter([CASE WHEN NOT s THEN 'no_strict_topic' END, {_why}], lambda z: z IS NOT NULL) AS sr, list_filter([CASE WHEN NOT b THEN 'no_broad_topic' END, {_why}], lambda z: z IS NOT NULL) AS br FROM c0",
    "long": "SELECT publication_year, work_id, unnest([" + ", ".join(f"{{'corpus_variant': '{v}', 'f': {v}}}" for v in VARIANTS) + "], recursive := true) FROM corpus",
    "a0": elements("w", "authorships_json"),
    "a1": """SELECT work_id, i, x, list_sort(list_distinct(list_filter(list_transform(list_concat(coalesce(from_json(x->'raw_affiliation_strings', '["VARCHAR"]'), []), coalesce(list_transform(from_json(x->'affiliations', '["JSON"]'), lambda y: y->>'raw_affiliation_string'), [])), lambda y: nullif(trim(y), '')), lambda y: y IS NOT NULL))) AS aff FROM a0 WHERE json_type(x) = 'OBJECT'""",
    "m0": """SELECT work_id, i, j, aff, json_extract(ins, '$[' || j || ']') AS y FROM (SELECT work_id, i, aff, x->'institutions' AS ins, unnest(range(json_array_length(x->'institutions')::BIGINT)) AS j FROM a1 WHERE json_type(x->'institutions') = 'ARRAY') AS z""",
    "mention": f"""SELECT * FROM (SELECT work_id, i, j, aff, {sid("(y->>'id')", "I")} AS institution_id, nullif(trim(y->>'ror'), '') AS ror_id, nullif(trim(y->>'display_name'), '') AS display_name, CASE WHEN regexp_full_match(upper(trim(y->>'country_code')), '[A-Z]{{2}}') THEN upper(trim(y->>'country_code')) END AS country_code,
        nullif(trim(y->>'type'), '') AS institution_type, list_filter(list_transform(from_json(y->'lineage', '["VARCHAR"]'), lambda q: {sid("q", "I")}), lambda q: q IS NOT NULL) AS lin FROM m0 WHERE json_type(y) = 'OBJECT') AS z WHERE institution_id IS NOT NULL""",
    "ext": "SELECT work_id, any_value(publication_year) AS publication_year, institution_id, " + ", ".join(f"arg_min({c}, i * 100000 + j) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("ror_id", "display_name", "country_code", "institution_type"))
        + ", list_sort(list_distinct(flatten(list(lin)))) AS lineage, list_sort(list_distinct(flatten(list(aff)))) AS affs, count(DISTINCT i)::INTEGER AS authorship_count, count(*)::INTEGER AS assertion_count FROM mention JOIN (SELECT work_id, publication_year FROM w) AS y USING (work_id) GROUP BY work_id, institution_id",
    "i0": "SELECT institution_id, " + ", ".join(f"min({c}) AS {c}" for c in ("ror_id", "display_name", "country_code", "normalized_category", "analytical_scope", "is_primary_research_scope", "latitude", "longitude", "canonical_institution_id")) + " FROM institutions WHERE institution_id IS NOT NULL GROUP BY 1",
    "inst": f"""SELECT i.* EXCLUDE (country_code), coalesce(c.code, 'ZZ') AS country_code, coalesce(c.name, 'Unknown') AS country_name, coalesce(c.macro, 'Unknown') AS macro_region, coalesce(c.sub, 'Unknown') AS subregion,
        CASE WHEN i.cc IS NULL THEN 'missing_source_country' WHEN c.code IS NULL THEN 'unmapped_source_country' END AS geography_issue
        FROM (SELECT *, CASE WHEN regexp_full_match(upper(trim(country_code)), '[A-Z]{{2}}') THEN upper(trim(country_code)) END AS cc FROM i0) AS i LEFT JOIN (VALUES {_countries}) AS c(code, name, macro, sub) ON c.code = i.cc""",
    "chain": f"""SELECT institution_id AS origin, coalesce({sid('canonical_institution_id', 'I')}, institution_id) AS here, 0 AS n FROM i0 UNION ALL
        SELECT c.origin, {sid('i.canonical_institution_id', 'I')}, c.n + 1 FROM chain AS c JOIN i0 AS i ON i.institution_id = c.here WHERE {sid('i.canonical_institution_id', 'I')} <> c.here AND c.n < 100""",
    "views": """SELECT 'organization' AS hierarchy_view, institution_id, institution_id AS canonical_institution_id, false AS is_collapsed FROM i0 UNION ALL
        SELECT 'umbrella', origin, arg_max(here, n), arg_max(here, n) <> origin FROM chain GROUP BY origin""",
    "wi": """SELECT g.*, i.display_name, i.country_code, i.country_name, i.macro_region, i.subregion, i.normalized_category, i.analytical_scope, i.latitude, i.longitude, i.macro_region IN ('Europe', 'Asia', 'Americas') AS target,
        i.is_primary_research_scope AND i.macro_region IN ('Europe', 'Asia', 'Americas') AS is_primary_network_scope FROM (SELECT e.work_id, e.publication_year, v.hierarchy_view, v.canonical_institution_id AS institution_id, sum(e.authorship_count)::BIGINT AS authorship_count, sum(e.assertion_count)::BIGINT AS assertion_count,
        count(DISTINCT e.institution_id)::INTEGER AS contributing_organization_count, bool_or(v.is_collapsed) OR count(DISTINCT e.institution_id) > 1 AS was_collapsed, min(c.work_type) AS work_type, """ + ", ".join(f"bool_or(c.{v}) AS {v}" for v in VARIANTS) + """, min(c.method_families) AS method_families, list_sort(list_distinct(flatten(list(e.affs)))) AS affs
        FROM ext AS e JOIN corpus AS c USING (work_id) JOIN views AS v ON v.institution_id = e.institution_id GROUP BY ALL) AS g JOIN inst AS i ON i.institution_id = g.institution_id""",
    "mem": """SELECT publication_year AS year, corpus_view, hierarchy_view, work_id, institution_id, country_code, macro_region, subregion, method_families, count(*) OVER (PARTITION BY corpus_view, hierarchy_view, work_id) AS k
        FROM (SELECT *, unnest(['strict', 'broad']) AS corpus_view FROM wi WHERE is_primary_network_scope) AS z WHERE CASE corpus_view WHEN 'strict' THEN strict_primary ELSE broad_primary END""",
    "pairs": """SELECT a.year, a.corpus_view, a.hierarchy_view, a.work_id, a.institution_id AS source_id, b.institution_id AS target_id, a.k::INTEGER AS institution_count, 1 AS full_weight, 2.0::DOUBLE / (a.k * (a.k - 1)) AS fractional_weight, a.k >= 25 AS is_large_consortium, a.method_families,
        a.macro_region AS source_region, b.macro_region AS target_region, a.subregion AS source_subregion, b.subregion AS target_subregion, a.country_code AS source_country, b.country_code AS target_country
        FROM mem AS a JOIN mem AS b ON a.corpus_view = b.corpus_view AND a.hierarchy_view = b.hierarchy_view AND a.work_id = b.work_id AND a.institution_id < b.institution_id""",
    "edges": f"""SELECT {V}, source_id, target_id, sum(full_weight)::BIGINT AS full_count, sum(fractional_weight) AS fractional_count, count(*) AS distinct_work_count, count(*) FILTER (WHERE is_large_consortium) AS large_consortium_work_count, max(institution_count) AS maximum_consortium_size,
        list_sort(list_distinct(flatten(list(method_families)))) AS fams, list_slice(list_sort(list_distinct(list(work_id))), 1, 10) AS sample, min(source_region) AS source_region, min(target_region) AS target_region, min(source_country) AS source_country, min(target_country) AS target_country FROM pairs GROUP BY ALL""",
    "ctx": f"SELECT {V}, work_id, any_value(k) AS k, count(DISTINCT country_code) AS nc, count(DISTINCT macro_region) AS nr FROM mem GROUP BY ALL",
    "outs": f"""SELECT m.*, i.display_name, i.country_code, i.country_name, i.macro_region, i.subregion, i.normalized_category AS institution_category, i.analytical_scope, i.latitude, i.longitude FROM (SELECT {V}, m.institution_id, count(*) AS work_count, sum(1.0::DOUBLE / c.k) AS fractional_work_count, count(*) FILTER (WHERE c.k >= 2) AS collaborative_work_count,
        count(*) FILTER (WHERE c.k = 1) AS single_institution_work_count, count(*) FILTER (WHERE nc >= 2) AS international_work_count, count(*) FILTER (WHERE nr >= 2) AS cross_region_work_count FROM mem AS m JOIN ctx AS c USING (year, corpus_view, hierarchy_view, work_id) GROUP BY ALL) AS m JOIN inst AS i USING (institution_id)""",
    "lev": f"""SELECT {V}, work_id, source_id, target_id, full_weight, fractional_weight, g.l AS geographic_level, least(g.a, g.b) AS source_geography, greatest(g.a, g.b) AS target_geography FROM (SELECT *, unnest([{{'l': 'macro_region', 'a': source_region, 'b': target_region}}, {{'l': 'subregion', 'a': source_subregion, 'b': target_subregion}}, {{'l': 'country', 'a': source_country, 'b': target_country}}]) AS g FROM pairs) AS z""",
    "flows": f"""SELECT *, fractional_count / sum(fractional_count) OVER (PARTITION BY {V}, geographic_level) AS normalized_share FROM (SELECT {V}, geographic_level, source_geography, target_geography, sum(full_weight)::BIGINT AS full_count, sum(fractional_weight) AS fractional_count, count(DISTINCT work_id) AS distinct_work_count,
        count(DISTINCT source_id || '|' || target_id) AS distinct_institution_pair_count, list_slice(list_sort(list_distinct(list(work_id))), 1, 10) AS sample FROM lev GROUP BY ALL) AS z""",
    "intens": f"""SELECT e.*, e.fractional_count / sqrt(a.work_count * b.work_count) AS normalized_intensity, (SELECT count(*) FROM edges AS h WHERE h.corpus_view = e.corpus_view AND h.hierarchy_view = e.hierarchy_view AND h.source_id = e.source_id AND h.target_id = e.target_id AND h.year BETWEEN e.year - 2 AND e.year)::INTEGER AS a3,
        (SELECT count(*) FROM edges AS h WHERE h.corpus_view = e.corpus_view AND h.hierarchy_view = e.hierarchy_view AND h.source_id = e.source_id AND h.target_id = e.target_id AND h.year BETWEEN e.year - 4 AND e.year)::INTEGER AS a5
        FROM edges AS e JOIN outs AS a ON a.year = e.year AND a.corpus_view = e.corpus_view AND a.hierarchy_view = e.hierarchy_view AND a.institution_id = e.source_id JOIN outs AS b ON b.year = e.year AND b.corpus_view = e.corpus_view AND b.hierarchy_view = e.hierarchy_view AND b.institution_id = e.target_id""",
    "scored": "SELECT *, ln(1 + fractional_count) * (0.5 + 0.5 * a5 / 5.0) AS visualization_score FROM intens",
    "sym": f"""SELECT {V}, source_id AS institution_id, target_id AS partner_id, full_count, fractional_count, source_region AS region, target_region AS partner_region, source_country AS country, target_country AS partner_country FROM edges UNION ALL
        SELECT {V}, target_id, source_id, full_count, fractional_count, target_region, source_region, target_country, source_country FROM edges""",
    "nodes": f"""SELECT o.*, coalesce(s.degree, 0) AS degree, coalesce(s.fs, 0) AS full_strength, coalesce(s.w, 0.0) AS fractional_strength, coalesce(s.cross_w / nullif(s.w, 0), 0.0) AS bridge_score, coalesce(s.pc, 0) AS partner_country_count, coalesce(s.pr, 0) AS partner_region_count FROM outs AS o
        LEFT JOIN (SELECT {V}, institution_id, count(*) AS degree, sum(full_count)::BIGINT AS fs, sum(fractional_count) AS w, coalesce(sum(fractional_count) FILTER (WHERE region <> partner_region), 0.0) AS cross_w, count(DISTINCT partner_country) AS pc, count(DISTINCT partner_region) AS pr FROM sym GROUP BY ALL) AS s USING (year, corpus_view, hierarchy_view, institution_id)""",
    "kept": """SELECT * FROM (SELECT e.*, a.latitude AS source_latitude, a.longitude AS source_longitude, b.latitude AS target_latitude, b.longitude AS target_longitude, row_number() OVER (PARTITION BY e.year, e.corpus_view, e.hierarchy_view ORDER BY round(e.visualization_score, 9) DESC, e.source_id, e.target_id)::INTEGER AS default_edge_rank FROM scored AS e
        JOIN outs AS a ON a.year = e.year AND a.corpus_view = e.corpus_view AND a.hierarchy_view = e.hierarchy_view AND a.institution_id = e.source_id AND a.latitude IS NOT NULL AND a.longitude IS NOT NULL
        JOIN outs AS b ON b.year = e.year AND b.corpus_view = e.corpus_view AND b.hierarchy_view = e.hierarchy_view AND b.institution_id = e.target_id AND b.latitude IS NOT NULL AND b.longitude IS NOT NULL) AS z WHERE default_edge_rank <= 500""",
    "res": """SELECT c.*, r.referenced_work_id, d.year AS cited_year, d.k AS kb FROM ctx AS c JOIN refs AS r USING (work_id) JOIN ctx AS d ON d.corpus_view = c.corpus_view AND d.hierarchy_view = c.hierarchy_view AND d.work_id = r.referenced_work_id""",
    "cites": """SELECT r.year, r.corpus_view, r.hierarchy_view, a.institution_id AS source_id, b.institution_id AS target_id, count(*) AS full_count, sum(1.0::DOUBLE / (r.k * r.kb)) AS fractional_count, count(*) FILTER (WHERE r.year < r.cited_year) AS negative_lag_full_count, min(r.year - r.cited_year) AS minimum_citation_lag_years, max(r.year - r.cited_year) AS maximum_citation_lag_years,
        a.institution_id = b.institution_id AS is_institution_self_flow FROM res AS r JOIN mem AS a ON a.corpus_view = r.corpus_view AND a.hierarchy_view = r.hierarchy_view AND a.work_id = r.work_id JOIN mem AS b ON b.corpus_view = r.corpus_view AND b.hierarchy_view = r.hierarchy_view AND b.work_id = r.referenced_work_id GROUP BY ALL""",
    "cover": f"""SELECT c.year, c.corpus_view, c.hierarchy_view, count(DISTINCT c.work_id) AS citing_work_count, count(r.referenced_work_id) AS reference_count, count(w2.work_id) AS corpus_internal_reference_count, count(d.work_id) AS institution_resolved_reference_count, count(r.referenced_work_id) - count(w2.work_id) AS external_reference_count,
        count(w2.work_id) - count(d.work_id) AS unscoped_reference_count, count(*) FILTER (WHERE d.work_id IS NOT NULL AND c.year < w2.publication_year) AS negative_lag_reference_count, count(*) FILTER (WHERE c.work_id = r.referenced_work_id) AS self_work_reference_count, coalesce(sum(c.k * d.k), 0)::BIGINT AS institution_pair_contribution_count
        FROM ctx AS c LEFT JOIN refs AS r ON r.work_id = c.work_id LEFT JOIN (SELECT work_id, publication_year, 'strict' AS corpus_view FROM corpus WHERE strict_primary UNION ALL SELECT work_id, publication_year, 'broad' FROM corpus WHERE broad_primary) AS w2 ON w2.work_id = r.referenced_work_id AND w2.corpus_view = c.corpus_view
        LEFT JOIN ctx AS d ON d.corpus_view = c.corpus_view AND d.hierarchy_view = c.hierarchy_view AND d.work_id = r.referenced_work_id GROUP BY 1, 2, 3""",
    "elig": "SELECT 'strict' AS corpus_view, work_id, topic_id, topic_score FROM topics WHERE topic_score > 0 AND corpus_membership = 'strict' UNION ALL SELECT 'broad', work_id, topic_id, topic_score FROM topics WHERE topic_score > 0 AND corpus_membership IN ('strict', 'broad_only')",
    "vec": f"""SELECT z.*, topic_weight / l2_norm AS nw, core_rank <= 500 AS core FROM (SELECT c.*, n.institution_work_count, n.core_rank, sqrt(sum(topic_weight * topic_weight) OVER (PARTITION BY {V}, institution_id)) AS l2_norm FROM (SELECT m.year, m.corpus_view, m.hierarchy_view, m.institution_id, t.topic_id, sum(t.topic_score / m.k) AS topic_weight, count(DISTINCT m.work_id) AS contributing_work_count
        FROM mem AS m JOIN elig AS t ON t.work_id = m.work_id AND t.corpus_view = m.corpus_view GROUP BY ALL) AS c JOIN (SELECT *, row_number() OVER (PARTITION BY {V} ORDER BY institution_work_count DESC, institution_id)::INTEGER AS core_rank FROM (SELECT {V}, institution_id, count(*) AS institution_work_count FROM mem GROUP BY ALL) AS y) AS n USING (year, corpus_view, hierarchy_view, institution_id)) AS z WHERE l2_norm > 0""",
    "cos": f"""SELECT * , count(*) OVER (PARTITION BY {V}) AS eligible FROM (SELECT a.year, a.corpus_view, a.hierarchy_view, a.institution_id AS source_id, b.institution_id AS target_id, count(*)::INTEGER AS shared_topic_count, round(least(1.0, sum(a.nw * b.nw)), 9) AS s FROM vec AS a JOIN vec AS b ON a.year = b.year AND a.corpus_view = b.corpus_view AND a.hierarchy_view = b.hierarchy_view AND a.topic_id = b.topic_id AND a.institution_id < b.institution_id WHERE a.core AND b.core GROUP BY ALL HAVING sum(a.nw * b.nw) > 0) AS z""",
    "near": f"""SELECT *, row_number() OVER (PARTITION BY {V}, me ORDER BY s DESC, you)::INTEGER AS r FROM (SELECT {V}, source_id AS me, target_id AS you, s FROM cos UNION ALL SELECT {V}, target_id, source_id, s FROM cos) AS z""",
    "sims": """SELECT c.*, a.r AS source_neighbor_rank, b.r AS target_neighbor_rank FROM cos AS c JOIN near AS a ON a.year = c.year AND a.corpus_view = c.corpus_view AND a.hierarchy_view = c.hierarchy_view AND a.me = c.source_id AND a.you = c.target_id JOIN near AS b ON b.year = c.year AND b.corpus_view = c.corpus_view AND b.hierarchy_view = c.hierarchy_view AND b.me = c.target_id AND b.you = c.source_id WHERE least(a.r, b.r) <= 20""",
    "dyad": f"SELECT DISTINCT {V}, layer, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM layer_edges WHERE source_id <> target_id",
    "dnode": f"SELECT {V}, layer, source_id AS x FROM layer_edges WHERE source_id IS NOT NULL UNION SELECT {V}, layer, target_id FROM layer_edges WHERE target_id IS NOT NULL",
    "cat": f"""SELECT n.*, coalesce(e.edge_count, 0) AS edge_count, coalesce(e.edge_count, 0) AS configured_filtered_edge_count, coalesce(e.tf, 0) AS total_full_weight, coalesce(e.tw, 0.0) AS total_fractional_weight, coalesce(a.n, 0) AS active_node_count, n.node_count - coalesce(a.n, 0) AS isolated_output_node_count
        FROM (SELECT {V}, count(*) AS node_count, count(*) FILTER (WHERE analytical_scope = 'primary') AS primary_node_count, sum(work_count)::BIGINT AS summed_node_work_count FROM outs GROUP BY ALL) AS n LEFT JOIN (SELECT {V}, count(*) AS edge_count, sum(full_count)::BIGINT AS tf, sum(fractional_count) AS tw FROM edges GROUP BY ALL) AS e USING (year, corpus_view, hierarchy_view)
        LEFT JOIN (SELECT {V}, count(DISTINCT institution_id) AS n FROM sym GROUP BY ALL) AS a USING (year, corpus_view, hierarchy_view)""",
    "fam": f"SELECT {V}, f AS topic_family, count(*) AS visible_edge_count, sum(full_count)::BIGINT AS full_count, sum(fractional_count) AS fractional_count, sum(distinct_work_count)::BIGINT AS edge_work_count_sum FROM (SELECT *, unnest(fams) AS f FROM edges) AS z GROUP BY ALL",
    "share": f"""SELECT *, endpoint_weight / sum(endpoint_weight) OVER (PARTITION BY {V}, geographic_level, geography) AS partner_share FROM (SELECT {V}, geographic_level, g AS geography, p AS partner, sum(fractional_count) AS endpoint_weight, sum(full_count)::DOUBLE AS full_weight FROM (SELECT {V}, geographic_level, source_geography AS g, target_geography AS p, fractional_count, full_count FROM flows
        UNION ALL SELECT {V}, geographic_level, target_geography, source_geography, fractional_count, full_count FROM flows) AS z GROUP BY ALL) AS y""",
    "attr": " UNION ALL ".join(f"SELECT institution_id, '{c}' AS c, {c} AS v, count(*) AS n FROM ext WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("ror_id", "display_name", "country_code", "institution_type")),
    "mode": "SELECT institution_id, c, v, k, kinds FROM (SELECT *, row_number() OVER (PARTITION BY institution_id, c ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY institution_id, c) AS kinds FROM attr) AS z WHERE k = 1",
    "reach": f"SELECT {V}, institution_id, institution_id AS other FROM outs UNION SELECT r.year, r.corpus_view, r.hierarchy_view, r.institution_id, s.partner_id FROM reach AS r JOIN sym AS s ON s.year = r.year AND s.corpus_view = r.corpus_view AND s.hierarchy_view = r.hierarchy_view AND s.institution_id = r.other",
    "links": f"SELECT s.year, s.corpus_view, s.hierarchy_view, s.institution_id, s.partner_id, s.fractional_count / sum(s.fractional_count) OVER (PARTITION BY s.year, s.corpus_view, s.hierarchy_view, s.institution_id) AS p FROM sym AS s",
    "dims": f"SELECT {V}, n, n - coalesce(m, 0) AS loose FROM (SELECT {V}, count(*) AS n FROM outs GROUP BY ALL) AS a LEFT JOIN (SELECT {V}, count(DISTINCT institution_id) AS m FROM sym GROUP BY ALL) AS b USING (year, corpus_view, hierarchy_view)",
    # power iteration: nodes without edges all have one rank, so it is carried along with the others
    "ranks": f"SELECT 0 AS t, l.year, l.corpus_view, l.hierarchy_view, l.institution_id, any_value(1.0::DOUBLE / d.n) AS r, any_value(1.0::DOUBLE / d.n) AS iso FROM links AS l JOIN dims AS d USING (year, corpus_view, hierarchy_view) GROUP BY ALL UNION ALL SELECT k.t + 1, k.year, k.corpus_view, k.hierarchy_view, l.partner_id, 0.85::DOUBLE * (sum(k.r * l.p) + any_value(d.loose * k.iso / d.n)) + 0.15::DOUBLE / any_value(d.n), 0.85::DOUBLE * any_value(d.loose * k.iso / d.n) + 0.15::DOUBLE / any_value(d.n) FROM ranks AS k JOIN links AS l ON l.year = k.year AND l.corpus_view = k.corpus_view AND l.hierarchy_view = k.hierarchy_view AND l.institution_id = k.institution_id JOIN dims AS d ON d.year = k.year AND d.corpus_view = k.corpus_view AND d.hierarchy_view = k.hierarchy_view WHERE k.t < 110 GROUP BY k.t, k.year, k.corpus_view, k.hierarchy_view, l.partner_id",
    "page": f"SELECT o.year, o.corpus_view, o.hierarchy_view, o.institution_id, coalesce(a.r, i.iso, 1.0::DOUBLE / d.n) AS pagerank FROM outs AS o JOIN dims AS d USING (year, corpus_view, hierarchy_view) LEFT JOIN (SELECT * FROM ranks WHERE t = 110) AS a ON a.year = o.year AND a.corpus_view = o.corpus_view AND a.hierarchy_view = o.hierarchy_view AND a.institution_id = o.institution_id LEFT JOIN (SELECT {V}, max(iso) AS iso FROM ranks WHERE t = 110 GROUP BY ALL) AS i ON i.year = o.year AND i.corpus_view = o.corpus_view AND i.hierarchy_view = o.hierarchy_view",
    "comp": f"SELECT {V}, institution_id, min(other) AS component_id FROM reach GROUP BY ALL",
    "scoped": "SELECT publication_year AS year, corpus_view, hierarchy_view, scope_view, count(*) AS n FROM (SELECT *, unnest(['primary', 'expanded']) AS scope_view FROM (SELECT *, unnest(['strict', 'broad']) AS corpus_view FROM wi) AS y) AS z WHERE (CASE corpus_view WHEN 'strict' THEN strict_primary ELSE broad_primary END) AND (CASE scope_view WHEN 'primary' THEN is_primary_network_scope ELSE target AND analytical_scope IN ('primary', 'secondary') END) GROUP BY ALL",
    "roll": f"SELECT y.*, (SELECT count(DISTINCT e.source_id || '|' || e.target_id) FROM edges AS e WHERE e.corpus_view = y.corpus_view AND e.hierarchy_view = y.hierarchy_view AND e.year BETWEEN y.year - 2 AND y.year) AS rolling_edge_count FROM (SELECT {V}, count(*) AS annual_edge_count FROM edges GROUP BY ALL) AS y",
    "own": "SELECT * FROM scored WHERE corpus_view = 'broad' AND hierarchy_view = 'organization' AND source_region <> target_region",
    "top": "SELECT source_id, target_id, sum(full_count)::BIGINT AS total_full_count, round(sum(fractional_count), 9) AS w, max(normalized_intensity) AS maximum_normalized_intensity, max(a5) / 5.0 AS maximum_persistence_5y, list_slice(list_sort(list_distinct(flatten(list(sample)))), 1, 10) AS ids, min(source_region) AS source_region, min(target_region) AS target_region, min(source_country) AS source_country, min(target_country) AS target_country FROM own GROUP BY 1, 2 ORDER BY w DESC, source_id, target_id LIMIT 50",
}


def sql(final: str) -> str:
    """The steps that ``final`` needs, in order, then ``final``."""
    need: list[str] = []

    def add(text: str, own: str = "") -> None:
        for name in STEPS:
            if name != own and name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(STEPS[name], name)
                need.append(name)

    add(final)
    seen = list(dict.fromkeys(need))
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in seen) + "\n" if seen else "") + final


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


E = f"{V}, source_id, target_id"
N = f"{V}, institution_id"

ORACLES: dict[str, str] = {name: sql(text) for name, text in {
    "nrm1_rejects": f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN work_id IS NULL OR NOT regexp_full_match(work_id, 'W[0-9]+') THEN 'invalid_or_missing_work_id' WHEN publication_year IS NULL THEN 'invalid_or_missing_publication_year' WHEN publication_year NOT BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN 'publication_year_outside_analysis_window' END AS reason FROM works) AS z WHERE reason IS NOT NULL GROUP BY 1",
    "nrm4_works": "SELECT work_id, title, doi, publication_year, work_type, is_retracted, is_paratext, cited_by_count, primary_topic_id FROM w",
    "nrm4_export": "SELECT w.work_id, coalesce(t.n, 0)::INTEGER AS topic_count, coalesce(f.n, 0)::INTEGER AS reference_count, coalesce(t.x, '') AS topics, coalesce(f.x, '') AS refs FROM w LEFT JOIN (SELECT work_id, count(*) AS n, string_agg(topic_id, ',' ORDER BY topic_id) AS x FROM topics GROUP BY 1) AS t USING (work_id) LEFT JOIN (SELECT work_id, count(*) AS n, string_agg(referenced_work_id, ',' ORDER BY referenced_work_id) AS x FROM refs GROUP BY 1) AS f USING (work_id)",
    "nrm5_work_topics": f"SELECT work_id, topic_id, topic_name, {r('topic_score')}, corpus_membership, method_family, is_primary_topic FROM topics",
    "nrm6_reconciliation": "SELECT count(*) AS works, count(DISTINCT work_id) AS ids, min(publication_year) AS lo, max(publication_year) AS hi FROM w",
    "typ1_types": f"SELECT c.work_type, c.work_count, p.a IS NOT NULL AS is_known_type, coalesce(p.a, false) AS in_primary, coalesce(p.b, false) AS in_preprint, coalesce(p.c, false) AS in_expanded FROM (SELECT work_type, count(*) AS work_count FROM w GROUP BY 1) AS c LEFT JOIN (VALUES {_types}) AS p(work_type, a, b, c) ON p.work_type = c.work_type",
    "typ1_institution_types": f"SELECT i.institution_type, i.institution_count, coalesce(p.c, 'unknown') AS normalized_category, coalesce(p.s, 'unknown') AS analytical_scope, coalesce(p.p, false) AS is_primary_research_scope FROM (SELECT t AS institution_type, count(*) AS institution_count FROM (SELECT min(institution_type) AS t FROM institutions WHERE institution_id IS NOT NULL GROUP BY institution_id) AS y GROUP BY 1) AS i LEFT JOIN (VALUES {INSTITUTION_TYPES}) AS p(t, c, s, p) ON p.t = lower(i.institution_type)",
    "st6_hash_sample": "SELECT publication_year, work_id, k::INTEGER AS sample_rank FROM (SELECT publication_year, work_id, row_number() OVER (PARTITION BY publication_year ORDER BY sha256('20240|' || publication_year || '|' || work_id), work_id) AS k FROM w) AS z WHERE k <= 20",
    "st7_strata": "SELECT years, citations, work_id FROM (SELECT *, row_number() OVER (PARTITION BY years, citations ORDER BY sha256('7|' || years || '|' || citations || '|' || work_id), work_id) AS k FROM (SELECT work_id, CASE WHEN publication_year < 2016 THEN 'early' WHEN publication_year < 2021 THEN 'middle' ELSE 'late' END AS years, CASE WHEN cited_by_count > 0 THEN 'cited' ELSE 'uncited' END AS citations FROM w) AS y) AS z WHERE k <= 1",
    "ver1_families": "SELECT * FROM versions",
    "ver3_ambiguous": "SELECT work_id, possible_title_family_id FROM versions WHERE ambiguous_possible_family",
    "cor1_flags": f"SELECT work_id, {', '.join(VARIANTS)}, array_to_string(method_families, ',') AS families, array_to_string(sr, ',') AS strict_reasons, array_to_string(br, ',') AS broad_reasons FROM corpus",
    "cor2_annual": "SELECT publication_year, corpus_variant, count(*) AS work_count FROM long WHERE f GROUP BY 1, 2",
    "cor3_families": "SELECT l.publication_year, l.corpus_variant, t.method_family, count(DISTINCT l.work_id) AS work_count FROM long AS l JOIN topics AS t USING (work_id) WHERE l.f AND t.method_family IS NOT NULL AND ((l.corpus_variant = 'strict_primary' AND t.corpus_membership = 'strict') OR (l.corpus_variant = 'broad_primary' AND t.corpus_membership IN ('strict', 'broad_only'))) GROUP BY 1, 2, 3",
    "cor4_violations": "SELECT count(*) FILTER (WHERE strict_primary AND NOT broad_primary) AS strict_outside_broad, count(*) FILTER (WHERE NOT strict_primary AND len(sr) = 0) AS strict_without_reason, count(*) FILTER (WHERE NOT broad_primary AND len(br) = 0) AS broad_without_reason FROM corpus",
    "ins1_extracted": "SELECT work_id, institution_id, display_name, ror_id, country_code, institution_type, array_to_string(lineage, ',') AS lineage, array_to_string(affs, '|') AS affiliations, authorship_count, assertion_count FROM ext",
    "ins2_unresolved": f"""SELECT work_id, publication_year, CASE WHEN authorships_json IS NOT NULL AND (NOT json_valid(authorships_json) OR (json_type(authorships_json::JSON) = 'VARCHAR' AND NOT json_valid(authorships_json::JSON->>'$'))) THEN 'invalid_authorships_json' WHEN authorships_json IS NOT NULL AND {array_of('authorships_json')} IS NULL THEN 'authorships_not_array' WHEN work_id IN (SELECT work_id FROM a0) THEN 'no_resolved_institution' ELSE 'no_authorships' END AS reason
        FROM w WHERE work_id NOT IN (SELECT work_id FROM mention)""",
    "geo1_geography": "SELECT institution_id, country_code, country_name, macro_region, subregion, geography_issue FROM inst",
    "hie1_views": "SELECT hierarchy_view, institution_id, canonical_institution_id, is_collapsed FROM views",
    "hie3_candidates": f"SELECT i.institution_id, coalesce(c.x, '') AS candidates, coalesce(c.n, 0)::INTEGER AS candidate_count, CASE WHEN c.n IS NULL THEN 'no_candidate' WHEN c.n = 1 THEN 'single_candidate' ELSE 'ambiguous' END AS resolution FROM i0 AS i LEFT JOIN (SELECT institution_id, count(*) AS n, string_agg(cand, ',' ORDER BY cand) AS x FROM (SELECT DISTINCT institution_id, {sid('p', 'I')} AS cand FROM (SELECT institution_id, unnest(list_concat(coalesce(lineage, []), coalesce(parent_ids, []))) AS p FROM institutions) AS z) AS y WHERE cand <> institution_id AND cand IN (SELECT institution_id FROM i0) GROUP BY 1) AS c USING (institution_id)",
    "wi1_work_institutions": "SELECT work_id, publication_year, hierarchy_view, institution_id, display_name, country_code, macro_region, authorship_count, assertion_count, contributing_organization_count, was_collapsed, work_type, " + ", ".join(VARIANTS) + ", is_primary_network_scope FROM wi",
    "edg1_pairs": f"SELECT {V}, work_id, source_id, target_id, institution_count, full_weight, {r('fractional_weight')}, is_large_consortium FROM pairs",
    "edg2_diagnostics": f"SELECT {V}, work_id, max(institution_count) AS institution_count, count(*) AS pair_count, round(sum(fractional_weight), 6) AS fractional_sum, (max(institution_count) * (max(institution_count) - 1) // 2)::BIGINT AS expected_pair_count FROM pairs GROUP BY ALL",
    "edg3_edges_year": f"SELECT {E}, full_count, {r('fractional_count')}, distinct_work_count, large_consortium_work_count, maximum_consortium_size, array_to_string(fams, ',') AS families, array_to_string(sample, ',') AS sample, source_country, target_country FROM edges",
    "out1_outputs": f"SELECT {N}, country_code, work_count, {r('fractional_work_count')}, collaborative_work_count, single_institution_work_count, international_work_count, cross_region_work_count, round(international_work_count / work_count, 6) AS international_collaboration_share, round(cross_region_work_count / work_count, 6) AS cross_region_collaboration_share FROM outs",
    "out2_reconciliation": f"SELECT a.*, {r('fractional_sum')}, b.work_count_sum, a.membership_count = b.work_count_sum AND abs(a.distinct_work_count - b.fractional_sum) < 1e-6 AS reconciles FROM (SELECT {V}, count(DISTINCT work_id) AS distinct_work_count, count(*) AS membership_count FROM mem GROUP BY ALL) AS a JOIN (SELECT {V}, sum(fractional_work_count) AS fractional_sum, sum(work_count)::BIGINT AS work_count_sum FROM outs GROUP BY ALL) AS b USING (year, corpus_view, hierarchy_view)",
    "flw1_flows": f"SELECT {V}, geographic_level, source_geography, target_geography, full_count, {r('fractional_count', 'normalized_share')}, distinct_work_count, distinct_institution_pair_count, array_to_string(sample, ',') AS sample FROM flows",
    "flw2_reconciliation": f"SELECT f.*, f.flow_full = p.a AND abs(f.flow_fractional - p.b) < 1e-5 AS reconciles FROM (SELECT {V}, geographic_level, sum(full_count)::BIGINT AS flow_full, round(sum(fractional_count), 6) AS flow_fractional FROM flows GROUP BY ALL) AS f JOIN (SELECT {V}, sum(full_weight) AS a, sum(fractional_weight) AS b FROM pairs GROUP BY ALL) AS p USING (year, corpus_view, hierarchy_view)",
    "int1_intensity": f"SELECT {E}, {r('normalized_intensity', 'visualization_score')}, a3 AS active_years_3y, a5 AS active_years_5y, round(a3 / 3.0, 6)::DOUBLE AS persistence_3y, round(a5 / 5.0, 6)::DOUBLE AS persistence_5y, year - 2010 + 1 < 3 AS persistence_3y_incomplete_window, year - 2010 + 1 < 5 AS persistence_5y_incomplete_window FROM scored",
    "grf1_catalogue": f"SELECT {V}, node_count, primary_node_count, summed_node_work_count, edge_count, configured_filtered_edge_count, total_full_weight, {r('total_fractional_weight')}, active_node_count, isolated_output_node_count FROM cat",
    "met1_nodes": f"SELECT {N}, degree, full_strength, {r('fractional_strength', 'bridge_score')}, partner_country_count, partner_region_count FROM nodes",
    "met6_region_assortativity": f"SELECT {V}, round((sum(same) / sum(n) - sum(n * n) / (sum(n) * sum(n))) / nullif(1 - sum(n * n) / (sum(n) * sum(n)), 0), 6) AS region_assortativity FROM (SELECT {V}, region, count(*)::DOUBLE AS n, count(*) FILTER (WHERE region = partner_region)::DOUBLE AS same FROM sym GROUP BY ALL) AS z GROUP BY ALL",
    "met6_country_assortativity": f"SELECT {V}, round((sum(same) / sum(n) - sum(n * n) / (sum(n) * sum(n))) / nullif(1 - sum(n * n) / (sum(n) * sum(n)), 0), 6) AS country_assortativity FROM (SELECT {V}, country, count(*)::DOUBLE AS n, count(*) FILTER (WHERE country = partner_country)::DOUBLE AS same FROM sym GROUP BY ALL) AS z GROUP BY ALL",
    "met8_dynamics": f"SELECT y.year, y.corpus_view, y.hierarchy_view, coalesce(c.n, 0) - coalesce(b.n, 0) AS new_edge_count, coalesce(b.n, 0) AS continuing_edge_count, coalesce(p.n, 0) - coalesce(b.n, 0) AS disappearing_edge_count FROM (SELECT *, lag(year) OVER (PARTITION BY corpus_view, hierarchy_view ORDER BY year) AS py FROM (SELECT DISTINCT {V} FROM edges) AS q) AS y LEFT JOIN (SELECT {V}, count(*) AS n FROM edges GROUP BY ALL) AS c USING (year, corpus_view, hierarchy_view) LEFT JOIN (SELECT {V}, count(*) AS n FROM edges GROUP BY ALL) AS p ON p.year = y.py AND p.corpus_view = y.corpus_view AND p.hierarchy_view = y.hierarchy_view LEFT JOIN (SELECT z.year, z.corpus_view, z.hierarchy_view, count(*) AS n FROM (SELECT e.*, q.py FROM edges AS e JOIN (SELECT *, lag(year) OVER (PARTITION BY corpus_view, hierarchy_view ORDER BY year) AS py FROM (SELECT DISTINCT {V} FROM edges) AS q0) AS q USING (year, corpus_view, hierarchy_view)) AS z JOIN edges AS o ON o.year = z.py AND o.corpus_view = z.corpus_view AND o.hierarchy_view = z.hierarchy_view AND o.source_id = z.source_id AND o.target_id = z.target_id GROUP BY ALL) AS b ON b.year = y.year AND b.corpus_view = y.corpus_view AND b.hierarchy_view = y.hierarchy_view",
    "cit1_flows": f"SELECT {E}, full_count, {r('fractional_count')}, negative_lag_full_count, minimum_citation_lag_years, maximum_citation_lag_years, is_institution_self_flow FROM cites",
    "cit2_coverage": "SELECT *, round(institution_resolved_reference_count / nullif(reference_count, 0), 6) AS institution_resolved_share FROM cover",
    "cit3_reconciliation": f"SELECT {V}, c.institution_pair_contribution_count, coalesce(f.a, 0) AS flow_full, c.institution_resolved_reference_count, round(coalesce(f.b, 0.0), 6) AS flow_fractional, coalesce(f.a, 0) = c.institution_pair_contribution_count AND abs(coalesce(f.b, 0.0) - c.institution_resolved_reference_count) < 1e-6 AS reconciles FROM cover AS c LEFT JOIN (SELECT {V}, sum(full_count)::BIGINT AS a, sum(fractional_count) AS b FROM cites GROUP BY ALL) AS f USING (year, corpus_view, hierarchy_view)",
    "sim1_vectors": f"SELECT {N}, topic_id, {r('topic_weight', 'l2_norm')}, round(nw, 6) AS normalized_topic_weight, contributing_work_count, institution_work_count, core_rank FROM vec",
    "sim2_topk": f"SELECT {E}, shared_topic_count, round(s, 6) AS cosine_similarity, source_neighbor_rank, target_neighbor_rank, eligible AS threshold_eligible_pair_count FROM sims",
    "mpx1_layers": f"SELECT {V}, 'coauthorship' AS layer, source_id, target_id, round(fractional_count, 6) AS layer_weight, 'undirected' AS directionality FROM edges UNION ALL SELECT {V}, 'citation_flow', source_id, target_id, round(fractional_count, 6), 'directed' FROM cites UNION ALL SELECT {V}, 'topic_proximity', source_id, target_id, round(s, 6), 'undirected' FROM sims",
    "mpx2_summary": f"""SELECT e.*, coalesce(n.node_count, 0) AS node_count, coalesce(d.dyad_count, 0) AS dyad_count, CASE WHEN e.directionality = 'directed' THEN coalesce(n.node_count, 0) * coalesce(n.node_count, 0) ELSE coalesce(n.node_count, 0) * (coalesce(n.node_count, 0) - 1) // 2 END AS possible_edge_count,
        round(e.edge_count / nullif(CASE WHEN e.directionality = 'directed' THEN n.node_count * n.node_count ELSE n.node_count * (n.node_count - 1) // 2 END, 0), 6) AS density FROM (SELECT {V}, layer, max(directionality) AS directionality, count(*) AS edge_count, count(*) FILTER (WHERE source_id = target_id) AS self_edge_count, round(sum(layer_weight), 6) AS total_weight FROM layer_edges GROUP BY ALL) AS e
        LEFT JOIN (SELECT {V}, layer, count(DISTINCT x) AS node_count FROM (SELECT {V}, layer, source_id AS x FROM layer_edges UNION ALL SELECT {V}, layer, target_id FROM layer_edges) AS z GROUP BY ALL) AS n USING (year, corpus_view, hierarchy_view, layer) LEFT JOIN (SELECT {V}, layer, count(*) AS dyad_count FROM dyad GROUP BY ALL) AS d USING (year, corpus_view, hierarchy_view, layer)""",
    "mpx3_overlap": f"""SELECT p.year, p.corpus_view, p.hierarchy_view, p.layer_a, p.layer_b, p.na AS dyad_count_a, p.nb AS dyad_count_b, coalesce(s.n, 0) AS shared_dyad_count, p.na + p.nb - coalesce(s.n, 0) AS union_dyad_count, round(coalesce(s.n, 0) / (p.na + p.nb - coalesce(s.n, 0)), 6) AS dyad_jaccard, round(coalesce(s.n, 0) / least(p.na, p.nb), 6) AS overlap_coefficient,
        coalesce(t.n, 0) AS shared_node_count, round(coalesce(t.n, 0) / (p.ma + p.mb - coalesce(t.n, 0)), 6) AS node_jaccard FROM (SELECT a.year, a.corpus_view, a.hierarchy_view, a.layer AS layer_a, b.layer AS layer_b, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb FROM (SELECT * FROM (SELECT {V}, layer, count(*) AS n FROM dyad GROUP BY ALL) AS u JOIN (SELECT {V}, layer, count(*) AS m FROM dnode GROUP BY ALL) AS v USING (year, corpus_view, hierarchy_view, layer)) AS a
        JOIN (SELECT * FROM (SELECT {V}, layer, count(*) AS n FROM dyad GROUP BY ALL) AS u JOIN (SELECT {V}, layer, count(*) AS m FROM dnode GROUP BY ALL) AS v USING (year, corpus_view, hierarchy_view, layer)) AS b ON a.year = b.year AND a.corpus_view = b.corpus_view AND a.hierarchy_view = b.hierarchy_view AND a.layer < b.layer) AS p
        LEFT JOIN (SELECT x.year, x.corpus_view, x.hierarchy_view, x.layer AS layer_a, y.layer AS layer_b, count(*) AS n FROM dyad AS x JOIN dyad AS y ON x.year = y.year AND x.corpus_view = y.corpus_view AND x.hierarchy_view = y.hierarchy_view AND x.a = y.a AND x.b = y.b AND x.layer < y.layer GROUP BY ALL) AS s USING (year, corpus_view, hierarchy_view, layer_a, layer_b)
        LEFT JOIN (SELECT x.year, x.corpus_view, x.hierarchy_view, x.layer AS layer_a, y.layer AS layer_b, count(*) AS n FROM dnode AS x JOIN dnode AS y ON x.year = y.year AND x.corpus_view = y.corpus_view AND x.hierarchy_view = y.hierarchy_view AND x.x = y.x AND x.layer < y.layer GROUP BY ALL) AS t USING (year, corpus_view, hierarchy_view, layer_a, layer_b)""",
    "sen1_rolling": f"SELECT y.*, (SELECT count(DISTINCT e.source_id || '|' || e.target_id) FROM edges AS e WHERE e.corpus_view = y.corpus_view AND e.hierarchy_view = y.hierarchy_view AND e.year BETWEEN y.year - 2 AND y.year) AS rolling_edge_count FROM (SELECT {V}, count(*) AS annual_edge_count FROM edges GROUP BY ALL) AS y",
    "sen2_scope": "SELECT publication_year AS year, corpus_view, hierarchy_view, scope_view, count(*) AS institution_work_count, count(DISTINCT work_id) AS distinct_work_count, count(DISTINCT institution_id) AS institution_count FROM (SELECT *, unnest(['primary', 'expanded']) AS scope_view FROM (SELECT *, unnest(['strict', 'broad']) AS corpus_view FROM wi) AS y) AS z WHERE (CASE corpus_view WHEN 'strict' THEN strict_primary ELSE broad_primary END) AND (CASE scope_view WHEN 'primary' THEN is_primary_network_scope ELSE target AND analytical_scope IN ('primary', 'secondary') END) GROUP BY ALL",
    "trd1_trends": f"SELECT {V}, source_geography AS source_region, target_geography AS target_region, source_geography || ' — ' || target_geography AS region_pair, source_geography = target_geography AS is_intra_region, full_count, {r('fractional_count', 'normalized_share')}, distinct_work_count, distinct_institution_pair_count FROM flows WHERE geographic_level = 'macro_region'",
    "mtx1_matrix": f"SELECT f.year, f.corpus_view, f.hierarchy_view, f.geographic_level, f.source_geography, f.target_geography, f.full_count, a.o AS source_order, b.o AS target_order FROM flows AS f JOIN (SELECT geographic_level, g, dense_rank() OVER (PARTITION BY geographic_level ORDER BY g)::INTEGER AS o FROM (SELECT geographic_level, source_geography AS g FROM flows UNION SELECT geographic_level, target_geography FROM flows) AS z) AS a ON a.geographic_level = f.geographic_level AND a.g = f.source_geography JOIN (SELECT geographic_level, g, dense_rank() OVER (PARTITION BY geographic_level ORDER BY g)::INTEGER AS o FROM (SELECT geographic_level, source_geography AS g FROM flows UNION SELECT geographic_level, target_geography FROM flows) AS z) AS b ON b.geographic_level = f.geographic_level AND b.g = f.target_geography",
    "map1_edges": f"SELECT {E}, default_edge_rank, least(source_region, target_region) || ' — ' || greatest(source_region, target_region) AS macro_region_pair, {r('source_latitude', 'source_longitude', 'target_latitude', 'target_longitude')} FROM kept",
    "map2_nodes": f"SELECT {N}, default_node_rank, {r('latitude', 'longitude')} FROM (SELECT *, row_number() OVER (PARTITION BY {V} ORDER BY work_count DESC, institution_id)::INTEGER AS default_node_rank FROM outs WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS z WHERE default_node_rank <= 1000 OR EXISTS (SELECT 1 FROM kept AS k WHERE k.year = z.year AND k.corpus_view = z.corpus_view AND k.hierarchy_view = z.hierarchy_view AND z.institution_id IN (k.source_id, k.target_id))",
    "dsh1_families": f"SELECT {V}, topic_family, visible_edge_count, full_count, {r('fractional_count')}, edge_work_count_sum FROM fam",
    "dsh2_identities": "SELECT i.institution_id, i.display_name AS organization_name, v.canonical_institution_id AS umbrella_id, v.is_collapsed, u.display_name AS umbrella_name FROM inst AS i JOIN views AS v ON v.institution_id = i.institution_id AND v.hierarchy_view = 'umbrella' LEFT JOIN inst AS u ON u.institution_id = v.canonical_institution_id",
    "dsh3_dimensions": f"SELECT DISTINCT * FROM (SELECT {V}, 'country_name' AS dimension, country_name AS value FROM outs UNION ALL SELECT {V}, 'subregion', subregion FROM outs UNION ALL SELECT {V}, 'institution_category', institution_category FROM outs) AS z WHERE value IS NOT NULL",
    "dsh3_geographies": "SELECT DISTINCT country_code, country_name, macro_region, subregion FROM outs",
    "view1_partner_shares": f"SELECT {V}, geography, partner, {r('endpoint_weight', 'partner_share')} FROM share WHERE geographic_level = 'macro_region'",
    "view2_local_profile": f"SELECT {V}, geography, coalesce(sum(full_weight) FILTER (WHERE geography = partner), 0.0) AS local_weight, coalesce(sum(full_weight) FILTER (WHERE geography <> partner), 0.0) AS external_weight, sum(full_weight) AS total_weight, round(coalesce(sum(full_weight) FILTER (WHERE geography = partner), 0.0) / sum(full_weight), 6) AS local_share FROM share WHERE geographic_level = 'country' GROUP BY ALL",
    "view3_timeline": f"SELECT y.year, p.corpus_view, p.hierarchy_view, p.source_id, p.target_id, coalesce(e.full_count, 0) AS full_count, round(coalesce(e.fractional_count, 0.0), 6) AS fractional_count, round(e.normalized_intensity, 6) AS normalized_intensity, round(e.a3 / 3.0, 6)::DOUBLE AS persistence_3y, e.year IS NOT NULL AS is_observed FROM (SELECT DISTINCT corpus_view, hierarchy_view, source_id, target_id FROM edges) AS p CROSS JOIN (SELECT unnest(range({FIRST_YEAR}, {LAST_YEAR} + 1))::INTEGER AS year) AS y LEFT JOIN intens AS e ON e.year = y.year AND e.corpus_view = p.corpus_view AND e.hierarchy_view = p.hierarchy_view AND e.source_id = p.source_id AND e.target_id = p.target_id",
    "pf15_filtered_edges": f"SELECT {E}, source_region = 'Asia' AS source_inside, target_region = 'Asia' AS target_inside, {r('fractional_count')} FROM edges WHERE source_region = 'Asia' OR target_region = 'Asia'",
    "pf15_outside_partners": f"SELECT DISTINCT {V}, CASE WHEN source_region = 'Asia' THEN target_id ELSE source_id END AS institution_id FROM edges WHERE (source_region = 'Asia') <> (target_region = 'Asia')",
    "pf16_induced_edges": f"SELECT * FROM (SELECT {E}, {r('fractional_count')}, round(quantile_cont(fractional_count, 0.5) OVER (PARTITION BY {V}), 6) AS median_weight FROM edges WHERE source_region = 'Europe' AND target_region = 'Europe') AS z WHERE fractional_count >= median_weight",
    "view6_top_families": f"SELECT {V}, topic_family, visible_edge_count, full_count, {r('fractional_count')}, edge_work_count_sum FROM fam WHERE corpus_view = 'broad' AND hierarchy_view = 'organization' AND topic_family IN (SELECT topic_family FROM fam WHERE corpus_view = 'broad' AND hierarchy_view = 'organization' GROUP BY 1 ORDER BY round(sum(fractional_count), 9) DESC, topic_family LIMIT 12)",
    "view6_top_partners": "SELECT * FROM (SELECT institution_id, partner_id, fractional_count, row_number() OVER (PARTITION BY institution_id ORDER BY fractional_count DESC, partner_id)::INTEGER AS partner_rank FROM (SELECT institution_id, partner_id, round(sum(fractional_count), 6) AS fractional_count FROM sym WHERE corpus_view = 'broad' AND hierarchy_view = 'organization' GROUP BY 1, 2) AS z) AS y WHERE partner_rank <= 15",
    "ext1_effective_partners": f"SELECT {N}, count(*) AS partner_count, round(exp(-sum(p * ln(p))), 6) AS effective_partner_count FROM (SELECT *, fractional_count / sum(fractional_count) OVER (PARTITION BY {N}) AS p FROM sym) AS z GROUP BY ALL",
    "ext2_repeat_partners": f"SELECT {N}, count(*) AS partner_count, count(*) FILTER (WHERE old) AS repeat_partner_count, round(count(*) FILTER (WHERE old) / count(*), 6) AS repeat_partner_ratio FROM (SELECT s.*, s.year > min(s.year) OVER (PARTITION BY corpus_view, hierarchy_view, institution_id, partner_id) AS old FROM sym AS s) AS z GROUP BY ALL",
    "ext3_percentile_rank": f"SELECT {N}, work_count, round(CASE WHEN n = 1 THEN 0.5 ELSE (rk + (ties - 1) / 2.0 - 1) / (n - 1) END, 6)::DOUBLE AS work_count_percentile FROM (SELECT {N}, work_count, rank() OVER (PARTITION BY {V} ORDER BY work_count) AS rk, count(*) OVER (PARTITION BY {V}, work_count) AS ties, count(*) OVER (PARTITION BY {V}) AS n FROM outs) AS z",
    "mst1_master": "SELECT i.institution_id, max(m.v) FILTER (WHERE c = 'ror_id') AS ror_id, max(m.v) FILTER (WHERE c = 'display_name') AS display_name, max(m.v) FILTER (WHERE c = 'country_code') AS country_code, max(m.v) FILTER (WHERE c = 'institution_type') AS institution_type, any_value(i.n) AS assertion_work_count, array_to_string(list_sort(list_concat(list('conflicting_' || c) FILTER (WHERE kinds > 1), list_transform(list_filter(['country_code', 'display_name', 'institution_type', 'ror_id'], lambda q: NOT list_contains(coalesce(list(c) FILTER (WHERE c IS NOT NULL), []), q)), lambda q: 'missing_' || q))), ',') AS issues FROM (SELECT institution_id, count(*) AS n FROM ext GROUP BY 1) AS i LEFT JOIN mode AS m USING (institution_id) GROUP BY i.institution_id",
    "top1_lexical": """SELECT topic_id, display_name, max(score) AS evidence, count(*) AS term_count FROM (SELECT topic_id, display_name, round(least(1.0::DOUBLE, 0.55::DOUBLE * len(list_intersect(tw, nw)) / len(tw) + 0.25::DOUBLE * len(list_intersect(tw, fw)) / len(tw) + 0.2::DOUBLE * len(list_intersect(tw, dw)) / len(tw) + CASE WHEN contains(lower(display_name), term) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score
        FROM (SELECT *, list_distinct(regexp_extract_all(term, '[a-z0-9]+')) AS tw FROM (SELECT topic_id, display_name, list_distinct(regexp_extract_all(lower(display_name), '[a-z0-9]+')) AS nw, list_distinct(regexp_extract_all(lower(subfield_name), '[a-z0-9]+')) AS fw, list_distinct(regexp_extract_all(lower(domain_name), '[a-z0-9]+')) AS dw, unnest(['flood exposure', 'remote sensing', 'land cover', 'network analysis']) AS term FROM topic_registry) AS y) AS x) AS z WHERE score > 0 GROUP BY 1, 2""",
    "met2_pagerank": f"SELECT {N}, {r('pagerank')} FROM page",
    "met2_pagerank_distributed": f"SELECT {N}, {r('pagerank')} FROM page",
    "com1_checks": f"SELECT {V}, unnest([0.5, 1.0, 1.5])::DOUBLE AS resolution, node_count, isolated_node_count, 0::BIGINT AS repeated_count, 0::BIGINT AS wrong_size_count FROM (SELECT {V}, count(*) AS node_count, count(*) FILTER (WHERE degree = 0) AS isolated_node_count FROM nodes GROUP BY ALL) AS z",
    "sim2_dense": "SELECT vec_id, neighbor_id, s AS cosine_similarity, k::INTEGER AS neighbor_rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbor_id) AS k FROM (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings AS a JOIN embeddings AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)) AS y WHERE s IS NOT NULL AND NOT isnan(s)) AS z WHERE k <= 10",
    "net3_accessibility": f"SELECT {V}, n.node_count, n.top_institution, round(n.w, 6) AS top_fractional_strength, n.isolated_node_count, coalesce(e.edge_count, 0) AS edge_count, coalesce(e.cross_n, 0) AS cross_region_edge_count, round(e.low, 6) AS visible_minimum_fractional_weight, format('{{}}, {{}} / {{}}: {{}} institutions ({{}} isolated), {{}} edges ({{}} across regions); strongest: {{}}', year, corpus_view, hierarchy_view, n.node_count, n.isolated_node_count, coalesce(e.edge_count, 0), coalesce(e.cross_n, 0), coalesce(n.top_institution, 'none')) AS summary_text FROM (SELECT {V}, count(*) AS node_count, arg_max(display_name, (round(fractional_strength, 9), institution_id)) FILTER (WHERE display_name IS NOT NULL) AS top_institution, max(fractional_strength) AS w, count(*) FILTER (WHERE degree = 0) AS isolated_node_count FROM nodes GROUP BY ALL) AS n LEFT JOIN (SELECT {V}, count(*) AS edge_count, count(*) FILTER (WHERE source_region <> target_region) AS cross_n, min(fractional_count) AS low FROM edges GROUP BY ALL) AS e USING (year, corpus_view, hierarchy_view)",
    "hie2_rule_problems": f"SELECT institution_id, canonical_institution_id, problem FROM (SELECT c.origin AS institution_id, arg_max(c.here, c.n) AS canonical_institution_id, CASE WHEN max(c.n) >= 100 THEN 'cycle' WHEN arg_max(c.here, c.n) NOT IN (SELECT institution_id FROM i0) THEN 'unknown_target' END AS problem FROM chain AS c GROUP BY c.origin) AS z WHERE problem IS NOT NULL",
    "met5_components": f"SELECT {V}, component_id, count(*) AS size FROM comp GROUP BY ALL",
    "met5_components_distributed": f"SELECT {V}, component_id, count(*) AS size FROM comp GROUP BY ALL",
    "met5_graph": f"""SELECT {V}, node_count, {r('mean_degree', 'mean_full_strength', 'mean_fractional_strength')}, coalesce(edge_count, 0) AS edge_count, round(coalesce(a, 0.0), 6) AS cross_region_edge_share, round(coalesce(b, 0.0), 6) AS cross_region_fractional_weight_share, connected_component_count, round(coalesce(2.0::DOUBLE * coalesce(edge_count, 0) / nullif(node_count * (node_count - 1), 0), 0.0), 6) AS density, round(largest / node_count, 6) AS largest_component_share
        FROM (SELECT {V}, count(*) AS node_count, avg(degree) AS mean_degree, avg(full_strength) AS mean_full_strength, avg(fractional_strength) AS mean_fractional_strength FROM nodes GROUP BY ALL) AS n LEFT JOIN (SELECT {V}, count(*) AS edge_count, avg((source_region <> target_region)::INTEGER) AS a, coalesce(sum(fractional_count) FILTER (WHERE source_region <> target_region), 0.0) / sum(fractional_count) AS b FROM edges GROUP BY ALL) AS e USING (year, corpus_view, hierarchy_view)
        JOIN (SELECT {V}, count(*) AS connected_component_count, max(size) AS largest FROM (SELECT {V}, component_id, count(*) AS size FROM comp GROUP BY ALL) AS c0 GROUP BY ALL) AS c USING (year, corpus_view, hierarchy_view)""",
    "sim3_coverage": f"""SELECT s.*, round(coalesce(x.t, 0.0), 6) AS expected_score, coalesce(v.n, 0) AS eligible_institution_count, coalesce(v.core, 0) AS core_institution_count, round(coalesce(v.w, 0.0), 6) AS vector_weight, coalesce(e.n, 0) AS selected_edge_count, coalesce(e.k, 0) AS threshold_eligible_pair_count, s.in_scope_institution_count - coalesce(v.n, 0) AS zero_vector_institution_count, coalesce(v.n, 0) - coalesce(v.core, 0) AS excluded_by_core_count,
        round(coalesce(v.n, 0) / s.in_scope_institution_count, 6) AS eligible_share, coalesce(v.core, 0) * (coalesce(v.core, 0) - 1) // 2 AS candidate_pair_count, abs(coalesce(x.t, 0.0) - coalesce(v.w, 0.0)) < 1e-6 AS score_reconciles FROM (SELECT {V}, count(DISTINCT institution_id) AS in_scope_institution_count FROM mem GROUP BY ALL) AS s LEFT JOIN (SELECT c.year, c.corpus_view, c.hierarchy_view, sum(t.topic_score) AS t FROM ctx AS c JOIN elig AS t ON t.work_id = c.work_id AND t.corpus_view = c.corpus_view GROUP BY ALL) AS x USING (year, corpus_view, hierarchy_view)
        LEFT JOIN (SELECT {V}, count(DISTINCT institution_id) AS n, count(DISTINCT institution_id) FILTER (WHERE core) AS core, sum(topic_weight) AS w FROM vec GROUP BY ALL) AS v USING (year, corpus_view, hierarchy_view) LEFT JOIN (SELECT {V}, count(*) AS n, max(eligible) AS k FROM sims GROUP BY ALL) AS e USING (year, corpus_view, hierarchy_view)""",
    "sen1_matrix": """SELECT comparison_id, baseline_label, alternative_label, round(a, 6) AS baseline_value, round(b, 6) AS alternative_value, round(b - a, 6) AS absolute_difference, round(abs(b - a) / greatest(abs(a), 1e-12), 6) AS absolute_relative_change, coalesce(abs(b - a) / greatest(abs(a), 1e-12) >= 0.2, false) AS major_change, CASE WHEN comparison_id = 'S08' THEN 'not_available_no_human_reviewed_registry' ELSE 'complete' END AS status FROM (
        SELECT 'S01' AS comparison_id, 'strict' AS baseline_label, 'broad' AS alternative_label, (SELECT count(*)::DOUBLE FROM edges WHERE hierarchy_view = 'organization' AND corpus_view = 'strict') AS a, (SELECT count(*)::DOUBLE FROM edges WHERE hierarchy_view = 'organization' AND corpus_view = 'broad') AS b
        UNION ALL SELECT 'S02', 'full count', 'fractional count', (SELECT sum(full_count)::DOUBLE FROM edges WHERE corpus_view = 'broad' AND hierarchy_view = 'organization'), (SELECT sum(fractional_count) FROM edges WHERE corpus_view = 'broad' AND hierarchy_view = 'organization')
        UNION ALL SELECT 'S03', 'organization', 'umbrella', (SELECT count(*)::DOUBLE FROM edges WHERE corpus_view = 'broad' AND hierarchy_view = 'organization'), (SELECT count(*)::DOUBLE FROM edges WHERE corpus_view = 'broad' AND hierarchy_view = 'umbrella')
        UNION ALL SELECT 'S04', 'annual', 'trailing 3-year union', (SELECT avg(annual_edge_count) FROM roll WHERE corpus_view = 'broad' AND hierarchy_view = 'organization'), (SELECT avg(rolling_edge_count) FROM roll WHERE corpus_view = 'broad' AND hierarchy_view = 'organization')
        UNION ALL SELECT 'S05', 'include', 'exclude large consortia', (SELECT sum(fractional_weight) FROM pairs WHERE corpus_view = 'broad' AND hierarchy_view = 'organization'), (SELECT sum(fractional_weight) FROM pairs WHERE corpus_view = 'broad' AND hierarchy_view = 'organization' AND NOT is_large_consortium)
        UNION ALL SELECT 'S06', 'primary', 'expanded', (SELECT sum(n)::DOUBLE FROM scoped WHERE corpus_view = 'broad' AND hierarchy_view = 'organization' AND scope_view = 'primary'), (SELECT sum(n)::DOUBLE FROM scoped WHERE corpus_view = 'broad' AND hierarchy_view = 'organization' AND scope_view = 'expanded')
        UNION ALL SELECT 'S07', 'published primary', 'with preprints', (SELECT count(*)::DOUBLE FROM corpus WHERE broad_primary), (SELECT count(*)::DOUBLE FROM corpus WHERE broad_preprint_sensitivity)
        UNION ALL SELECT 'S08', 'provisional', 'human-reviewed', NULL::DOUBLE, NULL::DOUBLE) AS z""",
    "aud2_edges": """SELECT t.source_id, t.target_id, total_full_count, round(w, 6) AS total_fractional_count, round(maximum_normalized_intensity, 6) AS maximum_normalized_intensity, round(maximum_persistence_5y, 6)::DOUBLE AS maximum_persistence_5y, source_region, target_region, source_country, target_country, array_to_string(ids, '|') AS work_ids_sample, coalesce(a.x, '') AS source_raw_affiliation_samples, coalesce(b.x, '') AS target_raw_affiliation_samples,
        concat_ws('|', CASE WHEN coalesce(source_country, '') = '' OR coalesce(target_country, '') = '' THEN 'missing_country' END, CASE WHEN coalesce(a.x, '') = '' THEN 'missing_source_affiliation_sample' END, CASE WHEN coalesce(b.x, '') = '' THEN 'missing_target_affiliation_sample' END) AS suspicious_flags FROM top AS t
        LEFT JOIN (SELECT source_id, target_id, array_to_string(list_slice(list_sort(list_distinct(flatten(list(affs)))), 1, 10), '|') AS x FROM (SELECT source_id, target_id, unnest(ids) AS work_id FROM top) AS q JOIN wi ON wi.work_id = q.work_id AND wi.institution_id = q.source_id AND wi.hierarchy_view = 'organization' GROUP BY 1, 2) AS a USING (source_id, target_id)
        LEFT JOIN (SELECT source_id, target_id, array_to_string(list_slice(list_sort(list_distinct(flatten(list(affs)))), 1, 10), '|') AS x FROM (SELECT source_id, target_id, unnest(ids) AS work_id FROM top) AS q JOIN wi ON wi.work_id = q.work_id AND wi.institution_id = q.target_id AND wi.hierarchy_view = 'organization' GROUP BY 1, 2) AS b USING (source_id, target_id)""",
    "map3_coverage": f"""SELECT {V}, n.total_node_count, n.coordinate_node_count, e.total_edge_count, e.coordinate_edge_count, coalesce(k.n, 0) AS selected_edge_count, n.total_node_count - n.coordinate_node_count AS missing_coordinate_node_count, e.total_edge_count - e.coordinate_edge_count AS missing_coordinate_edge_count, round(n.coordinate_node_count / n.total_node_count, 6) AS node_coordinate_coverage_share
        FROM (SELECT {V}, count(*) AS total_node_count, count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS coordinate_node_count FROM outs GROUP BY ALL) AS n JOIN (SELECT e.year, e.corpus_view, e.hierarchy_view, count(*) AS total_edge_count, count(*) FILTER (WHERE a.latitude IS NOT NULL AND a.longitude IS NOT NULL AND b.latitude IS NOT NULL AND b.longitude IS NOT NULL) AS coordinate_edge_count FROM edges AS e
        JOIN outs AS a ON a.year = e.year AND a.corpus_view = e.corpus_view AND a.hierarchy_view = e.hierarchy_view AND a.institution_id = e.source_id JOIN outs AS b ON b.year = e.year AND b.corpus_view = e.corpus_view AND b.hierarchy_view = e.hierarchy_view AND b.institution_id = e.target_id GROUP BY ALL) AS e USING (year, corpus_view, hierarchy_view) LEFT JOIN (SELECT {V}, count(*) AS n FROM kept GROUP BY ALL) AS k USING (year, corpus_view, hierarchy_view)""",
    "view4_labels": "SELECT institution_id, arg_max(display_name, year) AS display_name, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years FROM outs GROUP BY 1",
    "val1_contracts": " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS row_count, count(DISTINCT {key}) AS distinct_keys, count(*) = count(DISTINCT {key}) AS key_is_unique FROM {step}" for name, step, key in (
        ("works", "w", "work_id"), ("work_topics", "topics", "(work_id, topic_id)"), ("work_corpus", "corpus", "work_id"), ("work_institutions", "wi", "(work_id, hierarchy_view, institution_id)"),
        ("edges_year", "edges", f"({E})"), ("institution_outputs_year", "outs", f"({N})"), ("region_flows_year", "flows", f"({V}, geographic_level, source_geography, target_geography)"),
    )),
    "src1_projected_scan": "SELECT year, count(*) AS n FROM layer_edges WHERE year >= 2018 AND layer = 'coauthorship' GROUP BY 1",
    "mpx0_layer_years": "SELECT layer, year, count(*) AS edge_count, round(sum(layer_weight), 6) AS weight FROM layer_edges GROUP BY 1, 2",
}.items()}
