"""Queries of the analytics pipeline, named after what they compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import corpus, graphs, institutions, layers, network, present, quality
from weftline.plans.bundle import Bundle
from weftline.plans.tables import table

VIEW = network.VIEW
Make = Callable[[Bundle], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 digits, decimals as doubles: results that do not depend on the order of summation."""
    out = []
    for f in df.schema:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append(F.round(c, 6).alias(f.name) if t in ("double", "float") else F.round(c.cast("double"), 6).alias(f.name) if t == "decimal" else c)
    return df.select(*out)


def _q(make: Make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: tidy(make(Bundle.of(spark, d)))


def _table_checks(b: Bundle) -> DataFrame:
    """The contract of every pipeline table: key, nulls of the key, rows."""
    C = quality.TableContract
    todo = [
        (b.works, C("works", ("work_id",))), (b.topics, C("work_topics", ("work_id", "topic_id"))), (b.corpus, C("work_corpus", ("work_id",))), (b.wi, C("work_institutions", ("work_id", "hierarchy_view", "institution_id"))),
        (b.edges, C("edges_year", (*VIEW, "source_id", "target_id"))), (b.outputs, C("institution_outputs_year", (*VIEW, "institution_id"))), (b.flows, C("region_flows_year", (*VIEW, "geographic_level", "source_geography", "target_geography"))),
    ]
    out = None
    for df, c in todo:
        one = quality.table_metrics(df, c).select("table_name", "row_count", "distinct_keys", "key_is_unique")
        out = one if out is None else out.unionByName(one)
    return out


EDGE = [*VIEW, "source_id", "target_id"]
NODE = [*VIEW, "institution_id"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _q(make) for name, make in {
    # normalization and corpus
    "nrm1_rejects": lambda b: corpus.quarantine(b.raw("works")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "nrm4_works": lambda b: b.works.select("work_id", "title", "doi", "publication_year", "work_type", "is_retracted", "is_paratext", "cited_by_count", "primary_topic_id"),
    "nrm4_export": lambda b: corpus.export_works(b.works, b.raw("topic_registry")).select("work_id", F.size("topic_ids").alias("topic_count"), F.size("referenced_work_ids").alias("reference_count"), F.array_join("topic_ids", ",").alias("topics"), F.array_join("referenced_work_ids", ",").alias("refs")),
    "nrm5_work_topics": lambda b: b.topics.select("work_id", "topic_id", "topic_name", "topic_score", "corpus_membership", "method_family", "is_primary_topic"),
    "nrm6_reconciliation": lambda b: b.works.agg(F.count(F.lit(1)).alias("works"), F.count_distinct("work_id").alias("ids"), F.min("publication_year").alias("lo"), F.max("publication_year").alias("hi")),
    "typ1_types": lambda b: corpus.type_profile(b.works),
    "typ1_institution_types": lambda b: institutions.institution_type_profile(institutions.institution_rows(b.raw("institutions"))),
    "top1_lexical": lambda b: corpus.lexical_topic_scores(b.raw("topic_registry"), ["flood exposure", "remote sensing", "land cover", "network analysis"]),
    "st6_hash_sample": lambda b: corpus.hash_sample(b.works.select("publication_year", "work_id"), ["publication_year"], "work_id", 20, "20240").select("publication_year", "work_id", "sample_rank"),
    "st7_strata": lambda b: corpus.hash_sample(b.works.select("work_id", F.when(F.col("publication_year") < 2016, "early").when(F.col("publication_year") < 2021, "middle").otherwise("late").alias("years"), F.when(F.col("cited_by_count") > 0, "cited").otherwise("uncited").alias("citations")), ["years", "citations"], "work_id", 1, "7").select("years", "citations", "work_id"),
    "ver1_families": lambda b: b.versions,
    "ver3_ambiguous": lambda b: b.versions.filter("ambiguous_possible_family").select("work_id", "possible_title_family_id"),
    "cor1_flags": lambda b: b.corpus.select("work_id", *corpus.VARIANTS, F.array_join("method_families", ",").alias("families"), F.array_join("strict_exclusion_reasons", ",").alias("strict_reasons"), F.array_join("broad_exclusion_reasons", ",").alias("broad_reasons")),
    "cor2_annual": lambda b: corpus.annual_counts(b.corpus),
    "cor3_families": lambda b: corpus.family_counts(b.corpus, b.topics),
    "cor4_violations": lambda b: corpus.corpus_violations(b.corpus),
    # institutions
    "ins1_extracted": lambda b: b.extracted.select("work_id", "institution_id", "display_name", "ror_id", "country_code", "institution_type", F.array_join("lineage", ",").alias("lineage"), F.array_join("raw_affiliation_strings", "|").alias("affiliations"), "authorship_count", "assertion_count"),
    "ins2_unresolved": lambda b: institutions.unresolved(b.works),
    "mst1_master": lambda b: institutions.master(b.extracted).select("institution_id", "ror_id", "display_name", "country_code", "institution_type", "assertion_work_count", F.array_join("issues", ",").alias("issues")),
    "geo1_geography": lambda b: b.inst.select("institution_id", "country_code", "country_name", "macro_region", "subregion", "geography_issue"),
    "hie1_views": lambda b: b.views.select("hierarchy_view", "institution_id", "canonical_institution_id", "is_collapsed"),
    "hie2_rule_problems": lambda b: institutions.rule_problems(b.inst),
    "hie3_candidates": lambda b: institutions.umbrella_candidates(b.raw("institutions")).select("institution_id", F.array_join("candidate_ids", ",").alias("candidates"), "candidate_count", "resolution"),
    "wi1_work_institutions": lambda b: b.wi.select("work_id", "publication_year", "hierarchy_view", "institution_id", "display_name", "country_code", "macro_region", "authorship_count", "assertion_count", "contributing_organization_count", "was_collapsed", "work_type", *corpus.VARIANTS, "is_primary_network_scope"),
    # network tables
    "edg1_pairs": lambda b: b.pairs.select(*VIEW, "work_id", "source_id", "target_id", "institution_count", "full_weight", "fractional_weight", "is_large_consortium"),
    "edg2_diagnostics": lambda b: network.pair_diagnostics(b.pairs).drop("fractional_error"),
    "edg3_edges_year": lambda b: b.edges.select(*EDGE, "full_count", "fractional_count", "distinct_work_count", "large_consortium_work_count", "maximum_consortium_size", F.array_join("topic_families", ",").alias("families"), F.array_join("work_ids_sample", ",").alias("sample"), "source_country", "target_country"),
    "out1_outputs": lambda b: b.outputs.select(*NODE, "country_code", "work_count", "fractional_work_count", "collaborative_work_count", "single_institution_work_count", "international_work_count", "cross_region_work_count", "international_collaboration_share", "cross_region_collaboration_share"),
    "out2_reconciliation": lambda b: network.output_reconciliation(b.groups, b.outputs),
    "flw1_flows": lambda b: b.flows.select(*VIEW, "geographic_level", "source_geography", "target_geography", "full_count", "fractional_count", "distinct_work_count", "distinct_institution_pair_count", F.array_join("work_ids_sample", ",").alias("sample"), "normalized_share"),
    "flw2_reconciliation": lambda b: network.flow_reconciliation(b.pairs, b.flows).select(*VIEW, "geographic_level", "flow_full", "flow_fractional", "reconciles"),
    "int1_intensity": lambda b: b.intensity.select(*EDGE, "normalized_intensity", "active_years_3y", "active_years_5y", "persistence_3y", "persistence_5y", "persistence_3y_incomplete_window", "persistence_5y_incomplete_window", "visualization_score"),
    "grf1_catalogue": lambda b: network.graph_catalogue(b.edges, b.outputs),
    # metrics
    "met1_nodes": lambda b: b.nodes.select(*NODE, "degree", "full_strength", "fractional_strength", "bridge_score", "partner_country_count", "partner_region_count"),
    "met2_pagerank": lambda b: b.pagerank,
    "met2_pagerank_distributed": lambda b: graphs.pagerank_distributed(b.edges, b.outputs),
    "met3_betweenness": lambda b: graphs.betweenness(b.graph),
    "met5_components": lambda b: b.components.groupBy(*VIEW, "component_id").agg(F.count(F.lit(1)).alias("size")),
    "met5_components_distributed": lambda b: graphs.components_distributed(b.edges, b.outputs).groupBy(*VIEW, "component_id").agg(F.count(F.lit(1)).alias("size")),
    "met5_graph": lambda b: _graph_metrics(b),
    "met6_region_assortativity": lambda b: network.assortativity(b.edges, "region"),
    "met6_country_assortativity": lambda b: network.assortativity(b.edges, "country"),
    "met8_dynamics": lambda b: network.edge_dynamics(b.edges),
    "com1_communities": lambda b: b.communities,
    "com1_checks": lambda b: graphs.community_checks(b.communities),
    "com2_summary": lambda b: graphs.community_summary(b.communities),
    "con1_overlaps": lambda b: graphs.community_overlaps(b.communities.filter("resolution = 1.0")),
    "con2_continuity": lambda b: graphs.continuity(b.communities.filter("resolution = 1.0")),
    "con3_disappearances": lambda b: graphs.disappearances(b.communities.filter("resolution = 1.0")),
    "lay1_layout": lambda b: b.layout,
    # layers
    "cit1_flows": lambda b: b.citations,
    "cit2_coverage": lambda b: layers.citation_coverage(b.groups, b.corpus, b.references),
    "cit3_reconciliation": lambda b: layers.citation_reconciliation(b.citations, layers.citation_coverage(b.groups, b.corpus, b.references)),
    "sim1_vectors": lambda b: b.vectors.select(*NODE, "topic_id", "topic_weight", "l2_norm", "normalized_topic_weight", "contributing_work_count", "institution_work_count", "core_rank"),
    "sim2_topk": lambda b: b.similarity.select(*EDGE, "shared_topic_count", "cosine_similarity", "source_neighbor_rank", "target_neighbor_rank", "threshold_eligible_pair_count"),
    "sim3_coverage": lambda b: layers.similarity_coverage(b.groups, b.topics, b.vectors, b.similarity),
    "sim2_dense": lambda b: layers.dense_neighbors(b.raw("embeddings")),
    "mpx1_layers": lambda b: layers.layer_union(b.edges, b.citations, b.similarity),
    "mpx2_summary": lambda b: layers.layer_summary(b.raw("layer_edges")),
    "mpx3_overlap": lambda b: layers.layer_overlap(b.raw("layer_edges")),
    # audit, sensitivity, contracts
    "val1_contracts": _table_checks,
    "aud1_institutions": lambda b: quality.top_institutions(b.ranked_nodes, b.wi, b.views).withColumns({c: F.array_join(c, "|") for c in ("work_ids_sample", "raw_affiliation_samples", "suspicious_flags")}),
    "aud2_edges": lambda b: quality.top_edges(b.intensity, b.wi).withColumns({c: F.array_join(c, "|") for c in ("work_ids_sample", "source_raw_affiliation_samples", "target_raw_affiliation_samples", "suspicious_flags")}),
    "sen1_matrix": lambda b: quality.sensitivity(network.graph_catalogue(b.edges, b.outputs), b.edges, b.pairs, b.corpus, b.scope),
    "sen1_rolling": lambda b: quality.rolling_edges(b.edges),
    "sen2_scope": lambda b: b.scope,
    # presentation
    "trd1_trends": lambda b: present.trends(b.flows),
    "mtx1_matrix": lambda b: present.matrix(b.flows).select(*VIEW, "geographic_level", "source_geography", "target_geography", "full_count", "source_order", "target_order"),
    "map1_edges": lambda b: present.map_edges(b.intensity, b.outputs).select(*EDGE, "default_edge_rank", "macro_region_pair", "source_latitude", "source_longitude", "target_latitude", "target_longitude"),
    "map2_nodes": lambda b: present.map_nodes(b.outputs, present.map_edges(b.intensity, b.outputs)).select(*NODE, "default_node_rank", "latitude", "longitude"),
    "map3_coverage": lambda b: present.map_coverage(b.outputs, b.edges, present.map_edges(b.intensity, b.outputs)),
    "net1_nodes": lambda b: present.view_nodes(b.nodes, b.layout, b.communities).select(*NODE, "x", "y", "community_id", "community_size"),
    "net2_edges": lambda b: present.view_edges(b.edges, b.layout).select(*EDGE, "default_edge_rank", "source_x", "source_y", "target_x", "target_y"),
    "net3_accessibility": lambda b: present.accessibility(b.nodes, b.edges),
    "dsh1_families": lambda b: present.family_totals(b.edges),
    "dsh2_identities": lambda b: present.identities(b.inst, b.views),
    "dsh3_dimensions": lambda b: present.filter_dimensions(b.outputs),
    "dsh3_geographies": lambda b: present.geography_dimensions(b.outputs),
    "view1_partner_shares": lambda b: present.partner_shares(b.flows),
    "view2_local_profile": lambda b: present.local_profile(b.flows),
    "view3_timeline": lambda b: present.pair_timeline(b.intensity, corpus.FIRST_YEAR, corpus.LAST_YEAR),
    "view4_labels": lambda b: present.labels(b.outputs).withColumn("years", F.array_join(F.col("years").cast("array<string>"), ",")),
    "pf15_filtered_edges": lambda b: present.filtered_edges(b.outputs, b.edges, F.col("macro_region") == "Asia")[0].select(*EDGE, "source_inside", "target_inside", "fractional_count"),
    "pf15_outside_partners": lambda b: present.filtered_edges(b.outputs, b.edges, F.col("macro_region") == "Asia")[1],
    "pf16_induced_edges": lambda b: present.induced_edges(b.outputs.filter("macro_region = 'Europe'"), b.edges).select(*EDGE, "fractional_count", "median_weight"),
    "view6_top_families": lambda b: present.top_families(b.edges),
    "view6_top_partners": lambda b: present.top_partners(b.edges),
    # measures beyond the tables above
    "ext1_effective_partners": lambda b: network.effective_partners(b.edges),
    "ext2_repeat_partners": lambda b: network.repeat_partner_ratio(b.edges),
    "ext3_percentile_rank": lambda b: network.percentile_rank(b.outputs.select(*NODE, "work_count"), VIEW, "work_count", "work_count_percentile"),
}.items()}


def _graph_metrics(b: Bundle) -> DataFrame:
    """Density, means, components and cross-region shares of each view."""
    n = b.nodes.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("node_count"), F.avg("degree").alias("mean_degree"), F.avg("full_strength").alias("mean_full_strength"), F.avg("fractional_strength").alias("mean_fractional_strength"))
    cross = F.col("source_region") != F.col("target_region")
    e = b.edges.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("edge_count"), F.avg(cross.cast("double")).alias("cross_region_edge_share"), (F.sum(F.when(cross, F.col("fractional_count")).otherwise(0.0)) / F.sum("fractional_count")).alias("cross_region_fractional_weight_share"))
    c = b.components.groupBy(*VIEW, "component_id").agg(F.count(F.lit(1)).alias("s")).groupBy(*VIEW).agg(F.count(F.lit(1)).alias("connected_component_count"), F.max("s").alias("largest"))
    j = n.join(e, VIEW, "left").join(c, VIEW).fillna(0, ["edge_count"]).fillna(0.0, ["cross_region_edge_share", "cross_region_fractional_weight_share"])
    k = F.col("node_count")
    return j.withColumns({"density": F.coalesce(2 * F.col("edge_count") / F.nullif((k * (k - 1)).cast("double"), F.lit(0.0)), F.lit(0.0)), "largest_component_share": F.col("largest") / k}).drop("largest")


QUERIES |= {
    "src1_projected_scan": lambda s, d: table(s, d, "layer_edges").filter("year >= 2018 and layer = 'coauthorship'").groupBy("year").agg(F.count(F.lit(1)).alias("n")),
    "mpx0_layer_years": lambda s, d: tidy(table(s, d, "layer_edges").groupBy("layer", "year").agg(F.count(F.lit(1)).alias("edge_count"), F.sum("layer_weight").alias("weight"))),
}
