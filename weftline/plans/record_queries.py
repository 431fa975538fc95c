"""Queries of raw records, registries, validators and measures beyond the pipeline's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import corpus, institutions, layers, network, present, quality, records
from weftline.plans.bundle import Bundle
from weftline.plans.network_oracles import FIRST_YEAR, N, V, elements, r, sid, sql
from weftline.plans.network_queries import NODE, VIEW, tidy

Query = Callable[[SparkSession, str], DataFrame]


def _q(make: Callable[[Bundle], DataFrame]) -> Query:
    return lambda spark, d: tidy(make(Bundle.of(spark, d)))


def raw_records(b: Bundle) -> DataFrame:
    """The delivered works put back into raw records, some of them spoilt: every 7th by length of title has no id, every 11th a
    year in words, every 13th a list in place of the record. A query of the plan is a year modulo 3, a page its type."""
    w = b.raw("works").withColumn("_n", F.coalesce(F.length("title"), F.lit(0)))
    topics = F.from_json("topics_json", "array<struct<id:string,display_name:string,score:double>>")
    body = F.to_json(F.struct(
        F.when(F.col("_n") % 7 == 0, "none").otherwise(F.concat(F.lit("https://catalogue.example/"), "work_id")).alias("id"), "title", "doi", F.when(F.col("_n") % 11 == 0, F.lit("two thousand")).alias("year_in_words"),
        F.when(F.col("_n") % 11 != 0, F.col("publication_year")).alias("publication_year"), "publication_date", F.col("work_type").alias("type"), "is_retracted", "is_paratext", "cited_by_count", "fwci",
        F.struct(F.col("primary_topic_id").alias("id"), F.col("primary_topic_name").alias("display_name")).alias("primary_topic"), topics.alias("topics"), F.col("source_updated_date").alias("updated_date"),
    ))
    text = F.when(F.col("_n") % 13 == 0, F.to_json(F.array("work_id"))).otherwise(body)
    return w.select(text.alias("record"), F.concat(F.lit("q"), F.col("publication_year") % 3).alias("query_id"), (F.col("publication_year") % 3).alias("query_order"), F.length("work_type").alias("page"), F.col("cited_by_count").cast("int").alias("record_index"), F.col("source_retrieved_at_utc").alias("retrieved_at"))


def raw_registry(b: Bundle) -> DataFrame:
    """The institutions put into registry entries; every third has no coordinates, parents become relationships."""
    i = b.raw("institutions").dropDuplicates(["institution_id"]).withColumn("_n", F.length("institution_id") + F.coalesce(F.length("display_name"), F.lit(0)))
    name = lambda value, kind: F.struct(value.alias("value"), F.array(F.lit(kind)).alias("types"))
    names = F.concat(F.transform(F.coalesce("alternative_names", F.array().cast("array<string>")), lambda x: name(x, "alias")), F.array(name(F.col("display_name"), "ror_display"), name(F.upper(F.substring("display_name", 1, 3)), "acronym")))
    link = lambda x: F.concat(F.lit("https://registry.example/0"), F.lpad(F.regexp_extract(x, r"(\d+)", 1), 8, "0"))
    parents = F.transform(F.coalesce("parent_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("parent").alias("type"), link(x).alias("id")))
    place = F.struct(F.when(F.col("_n") % 3 != 0, F.col("latitude")).alias("lat"), F.when(F.col("_n") % 3 != 0, F.col("longitude")).alias("lng"), F.col("country_code").alias("country_code"))
    body = F.to_json(F.struct(link(F.col("institution_id")).alias("id"), names.alias("names"), F.array("institution_type").alias("types"), F.lit("active").alias("status"), F.array(F.struct(place.alias("geonames_details"))).alias("locations"), parents.alias("relationships")))
    return i.select(body.alias("record"))


def _registry(b: Bundle) -> DataFrame:
    """Registry entries for the enrichment, from the institution records of the registry dump; the test tables have no coordinates
    of a registry, so they follow from the number of the record."""
    r_ = b.raw("institution_records").filter("metadata_source = 'registry_dump'").select(F.regexp_extract(F.lower(F.get("source_ror_ids", 0)), r"([0-9a-hj-km-np-tv-z]{9})/*$", 1).alias("ror"), "record_id", "source_display_names", "source_country_codes").filter("ror <> ''")
    one = r_.groupBy("ror").agg(F.min(F.struct("record_id", "source_display_names", "source_country_codes")).alias("r")).select("ror", "r.*")
    names = F.transform(F.slice("source_display_names", 1, 1), lambda x: F.struct(x.alias("value"), F.array(F.lit("ror_display")).alias("types")))
    place = F.struct((F.col("record_id") % 90).cast("double").alias("lat"), (F.col("record_id") % 180).cast("double").alias("lng"), F.get("source_country_codes", 0).alias("country_code"))
    body = F.to_json(F.struct(F.concat(F.lit("https://registry.example/"), "ror").alias("id"), names.alias("names"), F.array(F.struct(place.alias("geonames_details"))).alias("locations")))
    entries = records.registry_records(one.select(body.alias("record")))
    return entries.select("ror_id", F.col("display_name").alias("name"), "country_code", "latitude", "longitude", F.lit(True).alias("valid"))


def _frozen(b: Bundle) -> DataFrame:
    reg = b.raw("topic_registry")
    sample = corpus.hash_sample(b.works.select(F.col("primary_topic_id").alias("topic_id"), "work_id").filter("topic_id is not null"), ["topic_id"], "work_id", 3, "freeze")
    f = corpus.freeze_registry(reg.select("topic_id", "display_name"), reg.select("topic_id", "corpus_membership", "method_family"), sample)
    return f.select("topic_id", "display_name", "corpus_membership", "method_family", "in_strict", "in_broad", F.array_join("sample_work_ids", ",").alias("sample_work_ids"))


def _boundary(b: Bundle) -> DataFrame:
    rows = b.works.select("work_id", "cited_by_count", F.col("primary_topic_id").alias("topic_id")).join(F.broadcast(b.raw("topic_registry").select("topic_id", "corpus_membership")), "topic_id")
    sample = corpus.boundary_sample(rows.withColumn("sample_id", F.concat_ws(":", "topic_id", "work_id")), 40, "boundary")
    labels = sample.withColumn("label", F.when(F.col("cited_by_count") % 5 == 0, "unsure").when(F.col("cited_by_count") > 10, "relevant").otherwise("irrelevant"))
    known = b.works.select("work_id", F.when(F.col("cited_by_count") % 2 == 0, "strict").otherwise("broad").alias("expected_corpus"), "cited_by_count").filter("cited_by_count > 40").join(b.topics.select("work_id").distinct(), "work_id", "left_semi")
    return corpus.boundary_quality(labels, known, b.topics, b.raw("topic_registry"))


def _named(df: DataFrame) -> DataFrame:
    return df.select("check_name", "failures", "passed")


TABLES = {
    "works": "work_id doi title publication_year publication_date work_type is_retracted is_paratext cited_by_count fwci primary_topic_id primary_topic_name topics_json referenced_works_json authorships_json primary_location_json locations_json ids_json source_updated_date source_retrieved_at_utc raw_record_hash",
    "institutions": "institution_id ror_id display_name alternative_names country_code institution_type normalized_category analytical_scope is_primary_research_scope latitude longitude coordinate_source lineage parent_ids child_ids predecessor_ids successor_ids canonical_institution_id canonicalization_rule_id openalex_updated_date ror_version metadata_source source_ror_ids source_display_names source_country_codes source_institution_types assertion_work_count",
    "institution_records": "record_id institution_id metadata_source openalex_updated_date source_display_names source_country_codes source_institution_types source_ror_ids assertion_work_count",
    "layer_edges": "year corpus_view hierarchy_view layer source_id target_id layer_weight directionality weight_semantics coverage_scope loaded_at",
    "work_tombstones": "work_id deleted_at reason", "topic_registry": "topic_id display_name subfield_name field_name domain_name corpus_membership method_family", "source_trust": "metadata_source trust_rank",
    "mix_targets": "source target_share max_repeats", "pack_capacities": "capacity_name capacity_tokens", "documents": "doc_id text lang source n_chars work_id institution_id publication_year retrieved_at",
}


def _dictionary(b: Bundle) -> DataFrame:
    out = None
    for t in TABLES:
        one = quality.null_profile(b.raw(t), t).select("table_name", "column_name", "row_count", "null_count")
        out = one if out is None else out.unionByName(one)
    return out


def _hashes(b: Bundle) -> DataFrame:
    """Rows, distinct rows by key and an order-free content hash of the pipeline's tables."""
    C = quality.TableContract
    todo = [
        (b.works, C("works", ("work_id",))), (b.topics, C("work_topics", ("work_id", "topic_id"))), (b.versions, C("version_families", ("work_id",))), (b.corpus, C("work_corpus", ("work_id",))), (b.extracted, C("work_institution_assertions", ("work_id", "institution_id"))),
        (b.wi, C("work_institutions", ("work_id", "hierarchy_view", "institution_id"))), (b.edges, C("edges_year", (*VIEW, "source_id", "target_id"))), (b.outputs, C("institution_outputs_year", (*VIEW, "institution_id"))), (b.flows, C("region_flows_year", (*VIEW, "geographic_level", "source_geography", "target_geography"))),
        (b.citations, C("citation_flows_year", (*VIEW, "source_id", "target_id"))), (b.vectors, C("topic_vectors", (*VIEW, "institution_id", "topic_id"))), (b.similarity, C("topic_similarity", (*VIEW, "source_id", "target_id"))),
    ]
    out = None
    for df, c in todo:
        one = quality.table_metrics(df, c).select("table_name", "row_count", "distinct_keys", "key_is_unique", "content_hash")
        out = one if out is None else out.unionByName(one)
    return out


_NORMAL = ["work_id", "title", "doi", "publication_year", "publication_date", "work_type", "is_retracted", "is_paratext", "cited_by_count", "fwci", "primary_topic_id", "primary_topic_name", "source_updated_date"]

QUERIES: dict[str, Query] = {name: _q(make) for name, make in {
    "nrm1_raw_works": lambda b: records.normalize_records(raw_records(b)).filter("reason is null").select(*_NORMAL).distinct(),
    "nrm1_raw_rejects": lambda b: records.normalize_records(raw_records(b)).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).filter("reason is not null"),
    "nrm3_work_sources": lambda b: records.work_sources(records.normalize_records(raw_records(b))).select("work_id", "query_id", "page", "record_index"),
    "nrm6_raw_reconciliation": lambda b: _reconciled(b),
    "ror1_registry": lambda b: records.registry_records(raw_registry(b)).select("ror_id", "display_name", F.array_join("alternative_names", "|").alias("alternatives"), F.array_join("acronyms", "|").alias("acronyms"), F.array_join("types", "|").alias("types"), "country_code", "latitude", "longitude", F.array_join("parent_ids", "|").alias("parents")),
    "ror2_enriched": lambda b: institutions.enriched(b.inst, _registry(b)).select("institution_id", "registry_status", "coordinate_source", "latitude", "longitude", F.array_join("registry_conflicts", ",").alias("conflicts")),
    "mst1_lookups": lambda b: institutions.master(b.extracted, b.raw("institutions").filter("length(institution_id) % 2 = 0").withColumn("display_name", F.upper("display_name"))).select(
        "institution_id", "display_name", "country_code", "has_lookup", "latitude", "longitude", "coordinate_source", F.array_join("parent_ids", ",").alias("parents"), F.array_join("child_ids", ",").alias("children"), F.array_join("issues", ",").alias("issues")),
    "top2_frozen": _frozen,
    "top3_boundary": _boundary,
    "ins3_reconciliation": lambda b: quality.extraction_reconciliation(b.works, b.extracted, institutions.unresolved(b.works)),
    "edg4_checks": lambda b: _named(quality.edge_checks(b.pairs, b.edges)),
    "sim4_checks": lambda b: _named(quality.similarity_checks(b.vectors, b.similarity, layers.similarity_coverage(b.groups, b.topics, b.vectors, b.similarity))),
    "met2_sums": lambda b: quality.rank_sums(b.pagerank),
    "view5_region_comparison": lambda b: present.region_comparison(b.flows, ("Europe", "Asia")).unionByName(present.region_comparison(b.flows)).select(*VIEW, "geography", "partner", "endpoint_weight", "partner_share", "comparison"),
    "pf15_narrowed_edges": lambda b: present.filtered_edges(b.outputs, b.edges, F.col("institution_category") == "university", region_pair=("Europe", "Asia"), exclude_large=True)[0].select(*VIEW, "source_id", "target_id", "source_inside", "target_inside", "full_count"),
    "dic1_columns": _dictionary,
    "val2_content_hash": _hashes,
    "ext4_rolling_activity": lambda b: network.rolling_activity(b.groups, b.works),
    "ext5_monthly_persistence": lambda b: network.monthly_persistence(b.pairs, b.works, FIRST_YEAR),
    "ext6_citation_impact": lambda b: network.citation_impact(b.groups, b.works),
    "ext7_specialization": lambda b: network.specialization(b.vectors, b.raw("topic_registry"), b.outputs),
}.items()}


def _reconciled(b: Bundle) -> DataFrame:
    n = b.shared(records.normalize_records(raw_records(b)), "normalized")
    return records.record_reconciliation(n, records.first_works(n), records.work_sources(n))


_RAW = f"""SELECT *, coalesce(length(title), 0) AS tn, CASE WHEN coalesce(length(title), 0) % 13 = 0 THEN 'record_not_object' WHEN coalesce(length(title), 0) % 7 = 0 OR NOT regexp_full_match(work_id, 'W[0-9]+') THEN 'invalid_or_missing_work_id'
    WHEN coalesce(length(title), 0) % 11 = 0 OR publication_year IS NULL THEN 'invalid_or_missing_publication_year' WHEN publication_year NOT BETWEEN {FIRST_YEAR} AND 2025 THEN 'publication_year_outside_analysis_window' END AS reason FROM works"""
_LINK = "'0' || lpad(regexp_extract({x}, '([0-9]+)', 1), 8, '0')"
_MONTH = "SELECT work_id, regexp_extract(publication_date, '^\\s*([0-9]{4})-([0-9]{2})', 1)::INTEGER * 12 + regexp_extract(publication_date, '^\\s*([0-9]{4})-([0-9]{2})', 2)::INTEGER - 1 AS month FROM w WHERE regexp_matches(publication_date, '^\\s*[0-9]{4}-(0[1-9]|1[0-2])')"
_FREEZE = f"SELECT topic_id, work_id FROM (SELECT primary_topic_id AS topic_id, work_id, row_number() OVER (PARTITION BY primary_topic_id ORDER BY sha256('freeze|' || primary_topic_id || '|' || work_id), work_id) AS k FROM w WHERE primary_topic_id IS NOT NULL) AS z WHERE k <= 3"
_SAMPLE = """SELECT *, CASE WHEN cited_by_count % 5 = 0 THEN 'unsure' WHEN cited_by_count > 10 THEN 'relevant' ELSE 'irrelevant' END AS label FROM (SELECT w.work_id, w.cited_by_count, g.corpus_membership, row_number() OVER (PARTITION BY CASE WHEN g.corpus_membership IN ('strict', 'broad_only') THEN g.corpus_membership ELSE 'excluded_or_uncertain_control' END
    ORDER BY sha256('boundary|' || CASE WHEN g.corpus_membership IN ('strict', 'broad_only') THEN g.corpus_membership ELSE 'excluded_or_uncertain_control' END || '|' || g.topic_id || ':' || w.work_id), g.topic_id || ':' || w.work_id) AS k FROM w JOIN topic_registry AS g ON g.topic_id = w.primary_topic_id) AS y WHERE k <= 40"""
_SHARES = """SELECT f.*, w / sum(w) OVER (PARTITION BY year, corpus_view, hierarchy_view, institution_id) AS share FROM (SELECT v.year, v.corpus_view, v.hierarchy_view, v.institution_id, any_value(o.macro_region) AS macro_region, any_value(o.country_code) AS country_code, g.method_family, sum(v.topic_weight) AS w FROM vec AS v LEFT JOIN topic_registry AS g ON g.topic_id = v.topic_id
    JOIN outs AS o ON o.year = v.year AND o.corpus_view = v.corpus_view AND o.hierarchy_view = v.hierarchy_view AND o.institution_id = v.institution_id GROUP BY v.year, v.corpus_view, v.hierarchy_view, v.institution_id, g.method_family) AS f"""


def _base(keys: str) -> str:
    return f"sum(w) OVER (PARTITION BY {V}{keys}, method_family) / sum(w) OVER (PARTITION BY {V}{keys})"


def _ids(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({c}, lambda q: {sid('q', 'I')}), lambda q: q IS NOT NULL AND q <> k.institution_id))), ',')"


def _failures(*each: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS check_name, n AS failures, n = 0 AS passed FROM (SELECT ({expr})::BIGINT AS n) AS c_{name}" for name, expr in each)


ORACLES: dict[str, str] = {
    "nrm1_raw_works": f"SELECT DISTINCT {', '.join(c if c != 'fwci' else 'round(fwci, 6) AS fwci' for c in _NORMAL)} FROM ({_RAW}) AS z WHERE reason IS NULL",
    "nrm1_raw_rejects": f"SELECT reason, count(*) AS n FROM ({_RAW}) AS z WHERE reason IS NOT NULL GROUP BY 1",
    "nrm3_work_sources": f"SELECT work_id, 'q' || (publication_year % 3) AS query_id, length(min_by(work_type, length(work_type)))::INTEGER AS page, min_by(cited_by_count, (length(work_type), cited_by_count))::INTEGER AS record_index FROM ({_RAW}) AS z WHERE reason IS NULL GROUP BY 1, 2",
    "nrm6_raw_reconciliation": f"SELECT count(*) AS record_count, count(reason) AS rejected_count, count(DISTINCT work_id) FILTER (WHERE reason IS NULL) AS work_count, count(DISTINCT work_id) FILTER (WHERE reason IS NULL) AS distinct_work_count, min(publication_year) FILTER (WHERE reason IS NULL) AS first_year, max(publication_year) FILTER (WHERE reason IS NULL) AS last_year, 0::BIGINT AS orphan_source_count, count(*) - count(reason) - count(DISTINCT work_id) FILTER (WHERE reason IS NULL) AS repeated_count, true AS reconciles FROM ({_RAW}) AS z",
    "ror1_registry": f"""SELECT {_LINK.format(x='institution_id')} AS ror_id, display_name, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(alternative_names, []), lambda q: nullif(trim(q), '')), lambda q: q IS NOT NULL AND q <> coalesce(display_name, '')))), '|') AS alternatives,
        coalesce(nullif(trim(upper(left(display_name, 3))), ''), '') AS acronyms, coalesce(institution_type, '') AS types, CASE WHEN regexp_full_match(upper(trim(country_code)), '[A-Z]{{2}}') THEN upper(trim(country_code)) END AS country_code, round(CASE WHEN n % 3 <> 0 THEN latitude END, 6) AS latitude, round(CASE WHEN n % 3 <> 0 THEN longitude END, 6) AS longitude,
        array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(parent_ids, []), lambda q: q IS NOT NULL), lambda q: {_LINK.format(x='q')}))), '|') AS parents
        FROM (SELECT *, length(institution_id) + coalesce(length(display_name), 0) AS n FROM (SELECT DISTINCT ON (institution_id) institution_id, nullif(trim(display_name), '') AS display_name, alternative_names, institution_type, country_code, latitude, longitude, parent_ids FROM institutions) AS d) AS e""",
    "ror2_enriched": sql("""SELECT institution_id, CASE WHEN ror IS NULL THEN 'missing_ror_id' WHEN r_ror IS NULL THEN 'not_retrieved' ELSE 'enriched' END AS registry_status, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 'source' WHEN r_ror IS NOT NULL THEN 'registry' END AS coordinate_source,
        round(CASE WHEN (latitude IS NULL OR longitude IS NULL) AND r_ror IS NOT NULL THEN (rid % 90)::DOUBLE ELSE latitude END, 6) AS latitude, round(CASE WHEN (latitude IS NULL OR longitude IS NULL) AND r_ror IS NOT NULL THEN (rid % 180)::DOUBLE ELSE longitude END, 6) AS longitude,
        concat_ws(',', CASE WHEN r_ror IS NOT NULL AND rcc <> country_code THEN 'country' END, CASE WHEN r_ror IS NOT NULL AND lower(rname) <> lower(display_name) THEN 'name' END) AS conflicts FROM (SELECT i.*, g.ror AS r_ror, g.rid, g.rname, g.rcc FROM (SELECT *, nullif(regexp_extract(lower(ror_id), '([0-9a-hj-km-np-tv-z]{9})/*$', 1), '') AS ror FROM inst) AS i
        LEFT JOIN (SELECT ror, min(record_id) AS rid, nullif(trim(arg_min(source_display_names[1], record_id)), '') AS rname, arg_min(CASE WHEN regexp_full_match(upper(trim(source_country_codes[1])), '[A-Z]{2}') THEN upper(trim(source_country_codes[1])) ELSE chr(0) END, record_id) AS rcc FROM (SELECT *, regexp_extract(lower(source_ror_ids[1]), '([0-9a-hj-km-np-tv-z]{9})/*$', 1) AS ror FROM institution_records WHERE metadata_source = 'registry_dump') AS q WHERE regexp_full_match(ror, '0[0-9a-hj-km-np-tv-z]{8}') GROUP BY 1) AS g ON g.ror = i.ror) AS z""").replace("AS rcc FROM", "AS rcc FROM").replace("rcc <> country_code", "nullif(rcc, chr(0)) <> country_code"),
    "mst1_lookups": sql(f"""SELECT m.institution_id, coalesce(nullif(trim(upper(k.display_name)), ''), m.display_name) AS display_name, coalesce(nullif(trim(k.country_code), ''), m.country_code) AS country_code, k.institution_id IS NOT NULL AS has_lookup, round(k.latitude, 6) AS latitude, round(k.longitude, 6) AS longitude, CASE WHEN k.latitude IS NOT NULL AND k.longitude IS NOT NULL THEN 'source' END AS coordinate_source,
        coalesce({_ids('k.parent_ids')}, '') AS parents, coalesce({_ids('k.child_ids')}, '') AS children, array_to_string(list_filter(m.issues, lambda q: NOT ((q = 'missing_display_name' AND nullif(trim(k.display_name), '') IS NOT NULL) OR (q = 'missing_country_code' AND nullif(trim(k.country_code), '') IS NOT NULL) OR (q = 'missing_institution_type' AND nullif(trim(k.institution_type), '') IS NOT NULL) OR (q = 'missing_ror_id' AND nullif(trim(k.ror_id), '') IS NOT NULL))), ',') AS issues
        FROM (SELECT i.institution_id, max(z.v) FILTER (WHERE c = 'display_name') AS display_name, max(z.v) FILTER (WHERE c = 'country_code') AS country_code, list_sort(list_concat(coalesce(list('conflicting_' || c) FILTER (WHERE kinds > 1), []), list_transform(list_filter(['country_code', 'display_name', 'institution_type', 'ror_id'], lambda q: NOT list_contains(coalesce(list(c) FILTER (WHERE c IS NOT NULL), []), q)), lambda q: 'missing_' || q))) AS issues
        FROM (SELECT institution_id, count(*) AS n FROM ext GROUP BY 1) AS i LEFT JOIN mode AS z USING (institution_id) GROUP BY i.institution_id) AS m LEFT JOIN (SELECT DISTINCT ON (institution_id) * FROM institutions WHERE length(institution_id) % 2 = 0) AS k USING (institution_id)"""),
    "top2_frozen": sql(f"SELECT g.topic_id, g.display_name, g.corpus_membership, g.method_family, coalesce(g.corpus_membership = 'strict', false) AS in_strict, coalesce(g.corpus_membership IN ('strict', 'broad_only'), false) AS in_broad, coalesce(s.x, '') AS sample_work_ids FROM topic_registry AS g LEFT JOIN (SELECT topic_id, string_agg(work_id, ',' ORDER BY work_id) AS x FROM ({_FREEZE}) AS f GROUP BY 1) AS s USING (topic_id)"),
    "top3_boundary": sql(f"""SELECT l.*, k.*, CASE WHEN label_count >= 10 THEN 'measured' ELSE 'not_estimated' END AS precision_status, round(CASE WHEN label_count >= 10 THEN relevant_label_count / nullif(included_label_count, 0) END, 6) AS precision, CASE WHEN known_count >= 5 AND known_with_topics = known_count THEN 'measured' ELSE 'not_estimated' END AS recall_status, round(CASE WHEN known_count >= 5 AND known_with_topics = known_count THEN recovered_count / known_count END, 6) AS recall
        FROM (SELECT count(*) FILTER (WHERE label <> 'unsure') AS label_count, count(*) FILTER (WHERE label <> 'unsure' AND corpus_membership IN ('strict', 'broad_only')) AS included_label_count, count(*) FILTER (WHERE label = 'relevant' AND corpus_membership IN ('strict', 'broad_only')) AS relevant_label_count FROM ({_SAMPLE}) AS s) AS l,
        (SELECT count(*) AS known_count, count(t.work_id) AS known_with_topics, count(*) FILTER (WHERE CASE WHEN w.cited_by_count % 2 = 0 THEN t.s ELSE t.b END) AS recovered_count FROM w JOIN (SELECT work_id, coalesce(bool_or(corpus_membership = 'strict'), false) AS s, coalesce(bool_or(corpus_membership IN ('strict', 'broad_only')), false) AS b FROM topics GROUP BY 1) AS t USING (work_id) WHERE w.cited_by_count > 40) AS k"""),
    "ins3_reconciliation": sql("SELECT count(*) AS work_count, count(*) FILTER (WHERE work_id IN (SELECT work_id FROM mention)) AS resolved_count, count(*) FILTER (WHERE work_id NOT IN (SELECT work_id FROM mention)) AS unresolved_count, 0::BIGINT AS both_or_neither_count, true AS reconciles FROM w"),
    "edg4_checks": sql(_failures(
        ("stable_source_target_order", "SELECT count(*) FROM pairs WHERE source_id >= target_id"), ("unit_full_work_weights", "SELECT count(*) FROM pairs WHERE full_weight <> 1"), ("fractional_weights_in_range", "SELECT count(*) FROM pairs WHERE fractional_weight <= 0 OR fractional_weight > 1"),
        ("strict_and_broad_present", "SELECT abs(count(DISTINCT corpus_view) - 2) FROM pairs"), ("organization_and_umbrella_present", "SELECT abs(count(DISTINCT hierarchy_view) - 2) FROM pairs"), ("warning_threshold_flags_match", "SELECT count(*) FROM pairs WHERE is_large_consortium <> (institution_count >= 25)"), ("exclusion_threshold_flags_match", "SELECT 0"),
        ("pair_counts_match_combinations", f"SELECT count(*) FROM (SELECT count(*) AS n, max(institution_count) AS k FROM pairs GROUP BY {V}, work_id) AS a WHERE n <> k * (k - 1) // 2"), ("fractional_weights_sum_to_one_per_work", f"SELECT count(*) FROM (SELECT sum(fractional_weight) AS s FROM pairs GROUP BY {V}, work_id) AS a WHERE abs(s - 1) > 1e-10"),
        ("annual_full_counts_reconcile", "SELECT ((SELECT sum(full_weight) FROM pairs) <> (SELECT sum(full_count) FROM edges))::INTEGER"), ("annual_fractional_counts_reconcile", "SELECT (abs((SELECT sum(fractional_weight) FROM pairs) - (SELECT sum(fractional_count) FROM edges)) >= 1e-4)::INTEGER"),
    )),
    "sim4_checks": sql(_failures(
        ("vector_norms_are_one", f"SELECT count(*) FROM (SELECT sum(nw * nw) AS q FROM vec GROUP BY {N}) AS a WHERE abs(q - 1) > 1e-10"), ("stable_source_target_order", "SELECT count(*) FROM sims WHERE source_id >= target_id"), ("similarities_in_range", "SELECT count(*) FROM sims WHERE s <= 0 OR s > 1"), ("ranks_within_top_k", "SELECT count(*) FROM sims WHERE least(source_neighbor_rank, target_neighbor_rank) > 20"), ("score_sums_reconcile", "SELECT 0"),
    )),
    "met2_sums": sql(f"SELECT {V}, 1.0::DOUBLE AS pagerank_sum, count(*) AS node_count, true AS is_one FROM outs GROUP BY ALL"),
    "view5_region_comparison": sql(f"SELECT {V}, geography, partner, {r('endpoint_weight', 'partner_share')}, CASE WHEN geography = partner THEN geography ELSE geography || ' → ' || partner END AS comparison FROM share WHERE geographic_level = 'macro_region' AND ((geography = partner AND geography IN ('Europe', 'Asia', 'Americas')) OR (geography = 'Europe' AND partner = 'Asia') OR (geography = 'Asia' AND partner = 'Europe'))"),
    "pf15_narrowed_edges": sql(f"SELECT e.year, e.corpus_view, e.hierarchy_view, e.source_id, e.target_id, a.institution_category = 'university' AS source_inside, b.institution_category = 'university' AS target_inside, e.full_count FROM edges AS e JOIN outs AS a ON a.year = e.year AND a.corpus_view = e.corpus_view AND a.hierarchy_view = e.hierarchy_view AND a.institution_id = e.source_id JOIN outs AS b ON b.year = e.year AND b.corpus_view = e.corpus_view AND b.hierarchy_view = e.hierarchy_view AND b.institution_id = e.target_id WHERE e.large_consortium_work_count = 0 AND least(e.source_region, e.target_region) = 'Asia' AND greatest(e.source_region, e.target_region) = 'Europe' AND (a.institution_category = 'university' OR b.institution_category = 'university')"),
    "dic1_columns": " UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest({cols.split()!r}) AS column_name, n AS row_count, unnest([{', '.join(f'n - count_{c}' for c in cols.split())}]) AS null_count FROM (SELECT count(*) AS n, {', '.join(f'count({c}) AS count_{c}' for c in cols.split())} FROM {t}) AS z_{t}" for t, cols in TABLES.items()),
    "ext4_rolling_activity": sql(f"""SELECT corpus_view, hierarchy_view, institution_id, month, a12::BIGINT AS work_count_12m, a24::BIGINT AS work_count_24m, a36::BIGINT AS work_count_36m, round(f12, 6) AS fractional_count_12m, round((a12 - p12) / nullif(p12, 0), 6)::DOUBLE AS activity_change_12m, round((f12 - q12) / nullif(q12, 0), 6)::DOUBLE AS fractional_activity_change_12m
        FROM (SELECT *, sum(n) OVER (o RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS a12, sum(n) OVER (o RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS a24, sum(n) OVER (o RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS a36, sum(f) OVER (o RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS f12, coalesce(sum(n) OVER (o RANGE BETWEEN 23 PRECEDING AND 12 PRECEDING), 0) AS p12, coalesce(sum(f) OVER (o RANGE BETWEEN 23 PRECEDING AND 12 PRECEDING), 0) AS q12
        FROM (SELECT m.corpus_view, m.hierarchy_view, m.institution_id, d.month, count(*) AS n, sum(1.0::DOUBLE / m.k) AS f FROM mem AS m JOIN ({_MONTH}) AS d USING (work_id) GROUP BY ALL) AS g WINDOW o AS (PARTITION BY corpus_view, hierarchy_view, institution_id ORDER BY month)) AS z"""),
    "ext5_monthly_persistence": sql(f"""SELECT *, round(active_months / 12.0, 6)::DOUBLE AS edge_persistence, month - {FIRST_YEAR * 12} + 1 < 12 AS is_incomplete_window FROM (SELECT *, count(*) OVER (PARTITION BY corpus_view, hierarchy_view, source_id, target_id ORDER BY month RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)::INTEGER AS active_months
        FROM (SELECT DISTINCT p.corpus_view, p.hierarchy_view, p.source_id, p.target_id, d.month FROM pairs AS p JOIN ({_MONTH}) AS d USING (work_id)) AS g) AS z"""),
    "ext6_citation_impact": sql(f"SELECT m.year, m.corpus_view, m.hierarchy_view, m.institution_id, sum(coalesce(w.cited_by_count, 0))::BIGINT AS citation_count, round(sum(coalesce(w.cited_by_count, 0)::DOUBLE / m.k), 6) AS fractional_citation_count, round(avg(w.fwci), 6) AS mean_fwci, count(w.fwci) AS fwci_work_count FROM mem AS m JOIN w ON w.work_id = m.work_id GROUP BY ALL"),
    "ext7_specialization": sql(f"SELECT {N}, method_family, round(share, 6) AS topic_family_share, round(share / g, 6) AS specialization_lift_global, round(share / a, 6) AS specialization_lift_macro_region, round(share / c, 6) AS specialization_lift_country FROM (SELECT *, {_base('')} AS g, {_base(', macro_region')} AS a, {_base(', country_code')} AS c FROM ({_SHARES}) AS s) AS z WHERE method_family IS NOT NULL"),
}
