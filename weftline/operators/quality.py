"""Contracts, audits and sensitivity checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import compact_flags, sample_ids
from weftline.operators.network import EXCLUDED, LARGE, VIEW, bounded_sample, pair_diagnostics

MAJOR = 0.20


@dataclass(frozen=True)
class TableContract:
    name: str
    primary_key: tuple[str, ...]
    required: tuple[str, ...] = ()
    year: str | None = None


def table_metrics(df: DataFrame, c: TableContract) -> DataFrame:
    """One row: rows, distinct keys, null keys, nulls of required columns, years, content hash.

    Counts come from one aggregation; the key check groups by the key (null keys compare as
    values). The hash does not depend on the order of rows or files.
    """
    missing = [x for x in (*c.primary_key, *c.required) if x not in df.columns]
    if missing:
        raise ValueError(f"{c.name}: missing columns {missing}")
    nulls = [F.count_if(F.col(x).isNull()).alias(f"null_{x}") for x in dict.fromkeys((*c.primary_key, *c.required))]
    years = [F.min(c.year).cast("int").alias("min_year"), F.max(c.year).cast("int").alias("max_year")] if c.year else []
    hashed = F.coalesce(F.bit_xor(F.xxhash64(*[F.to_json(F.struct(x)) if d.startswith(("map", "variant")) else F.col(x) for x, d in df.dtypes])), F.lit(0)).alias("content_hash")
    keys = df.groupBy(*c.primary_key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.max("_n"), F.lit(0)).alias("most_rows_a_key"))
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *nulls, *years, hashed)
    return one.join(F.broadcast(keys)).withColumn("table_name", F.lit(c.name)).withColumn("key_is_unique", F.col("row_count") == F.col("distinct_keys"))


def null_profile(df: DataFrame, name: str) -> DataFrame:
    """Type, nulls and rows of every column, from one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"_c{i}").alias("null_count")) for i, (c, t) in enumerate(df.dtypes)]))
    return one.select(F.lit(name).alias("table_name"), F.col("_n").alias("row_count"), each.alias("x")).select("table_name", "row_count", "x.*")


def latest(value: str, year: str = "year"):
    """Value of the latest year in which it is not null; the smallest on ties."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(-F.col(year), F.col(value)))).alias(value)


def top_institutions(nodes: DataFrame, wi: DataFrame, views: DataFrame, n: int = 50) -> DataFrame:
    """The n first institutions by works and by PageRank, with samples and suspicious flags."""
    own = nodes.filter("corpus_view = 'broad' and hierarchy_view = 'organization'")
    a = own.groupBy("institution_id").agg(
        *[latest(c) for c in ("display_name", "country_code", "macro_region", "institution_category")], F.sum("work_count").alias("total_work_count"), F.max("pagerank").alias("maximum_pagerank"),
        F.count_distinct("display_name").cast("int").alias("observed_name_count"), F.count_distinct("country_code").cast("int").alias("observed_country_count"),
    )
    first = lambda *o: a.orderBy(*o).limit(n).withColumn("r", F.row_number().over(Window.orderBy(*o)))  # noqa: E731  (n rows: one small window)
    out = first(F.desc("total_work_count"), "institution_id").select("institution_id", F.col("r").alias("output_rank"))
    rank = first(F.desc_nulls_last("maximum_pagerank"), "institution_id").select("institution_id", F.col("r").alias("pagerank_rank"))
    s = out.join(rank, "institution_id", "full").join(a, "institution_id")
    rows = wi.filter("hierarchy_view = 'organization'").join(F.broadcast(s.select("institution_id")), "institution_id", "left_semi")
    works = bounded_sample(rows, ["institution_id"], "work_id", "work_ids_sample")
    texts = bounded_sample(rows.select("institution_id", F.explode_outer("raw_affiliation_strings").alias("t")), ["institution_id"], "t", "raw_affiliation_samples")
    h = views.filter("hierarchy_view = 'organization'").select("institution_id", "canonical_institution_id", "is_collapsed")
    j = s.join(works, "institution_id", "left").join(texts, "institution_id", "left").join(h, "institution_id", "left")
    cc, cat = F.col("country_code"), F.col("institution_category")
    flags = compact_flags((cc.isNull() | (cc == ""), "missing_country"), (cat.isNull() | (cat == "unknown"), "unknown_type"), (F.col("observed_name_count") > 1, "name_changed"), (F.col("observed_country_count") > 1, "country_changed"), (F.col("work_ids_sample").isNull(), "missing_affiliation_sample"))
    return j.withColumn("suspicious_flags", flags)


def top_edges(edges: DataFrame, wi: DataFrame, n: int = 50) -> DataFrame:
    """The n heaviest edges across regions with affiliation samples of both ends: one join, no look-ups."""
    own = edges.filter("corpus_view = 'broad' and hierarchy_view = 'organization' and source_region <> target_region")
    keys = ["source_id", "target_id"]
    a = own.groupBy(*keys).agg(F.sum("full_count").alias("total_full_count"), F.round(F.sum("fractional_count"), 9).alias("total_fractional_count"), F.max("normalized_intensity").alias("maximum_normalized_intensity"), F.max("persistence_5y").alias("maximum_persistence_5y"), *[latest(c) for c in ("source_region", "target_region", "source_country", "target_country")])
    top = a.orderBy(F.desc("total_fractional_count"), *keys).limit(n)
    works = own.join(F.broadcast(top.select(*keys)), keys, "left_semi").select(*keys, F.explode("work_ids_sample").alias("work_id")).groupBy(*keys).agg(sample_ids("work_id").alias("work_ids_sample"))
    out = top.join(works, keys)
    rows = wi.filter("hierarchy_view = 'organization'").select("work_id", "institution_id", "raw_affiliation_strings")
    for side in ("source", "target"):
        ask = works.select(*keys, F.explode("work_ids_sample").alias("work_id")).withColumn("institution_id", F.col(f"{side}_id"))
        got = ask.join(rows, ["work_id", "institution_id"]).select(*keys, F.explode("raw_affiliation_strings").alias("t")).groupBy(*keys).agg(sample_ids("t").alias(f"{side}_raw_affiliation_samples"))
        out = out.join(got, keys, "left").withColumn(f"{side}_raw_affiliation_samples", F.coalesce(f"{side}_raw_affiliation_samples", F.array().cast("array<string>")))
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    flags = compact_flags((missing("source_country") | missing("target_country"), "missing_country"), (F.size("source_raw_affiliation_samples") == 0, "missing_source_affiliation_sample"), (F.size("target_raw_affiliation_samples") == 0, "missing_target_affiliation_sample"))
    return out.withColumn("suspicious_flags", flags)


def rolling_edges(edges: DataFrame, years: int = 3) -> DataFrame:
    """Edges of each year and distinct pairs of the trailing window, by view.

    Each edge is copied to the years whose window holds it and joined to the years that exist: an
    equi-join in place of a range join.
    """
    e = edges.select(*VIEW, "source_id", "target_id")
    there = e.select(*VIEW).distinct()
    annual = e.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("annual_edge_count"))
    spread = e.withColumn("year", F.explode(F.sequence(F.col("year"), F.col("year") + years - 1))).join(there, VIEW)
    roll = spread.groupBy(*VIEW).agg(F.count_distinct(F.struct("source_id", "target_id")).alias("rolling_edge_count"))
    return annual.join(roll, VIEW)


def sensitivity(catalogue: DataFrame, edges: DataFrame, pairs: DataFrame, corpus: DataFrame, scope: DataFrame) -> DataFrame:
    """Eight comparisons of a baseline with an alternative; a relative change of 0.20 or more is major."""
    own, org, broad = "corpus_view = 'broad' and hierarchy_view = 'organization'", F.col("hierarchy_view") == "organization", F.col("corpus_view") == "broad"
    s = lambda c, p: F.sum(F.when(p, F.col(c))).cast("double")
    pick = lambda df, a, b: df.agg(a.alias("a"), b.alias("b"))
    strict = F.col("corpus_view") == "strict"
    r = rolling_edges(edges.filter(own))
    parts = [
        ("S01", "strict", "broad", pick(catalogue.filter(org), s("edge_count", strict), s("edge_count", broad))),
        ("S02", "full count", "fractional count", pick(edges.filter(own), F.sum("full_count").cast("double"), F.sum("fractional_count"))),
        ("S03", "organization", "umbrella", pick(catalogue.filter(broad), s("edge_count", org), s("edge_count", ~org))),
        ("S04", "annual", "trailing 3-year union", pick(r, F.avg("annual_edge_count"), F.avg("rolling_edge_count"))),
        ("S05", "include", "exclude large consortia", pick(pairs.filter(own), F.sum("fractional_weight"), s("fractional_weight", ~F.col("is_large_consortium")))),
        ("S06", "primary", "expanded", pick(scope.filter(own), s("institution_work_count", F.col("scope_view") == "primary"), s("institution_work_count", F.col("scope_view") == "expanded"))),
        ("S07", "published primary", "with preprints", pick(corpus, F.count_if("broad_primary").cast("double"), F.count_if("broad_preprint_sensitivity").cast("double"))),
        ("S08", "provisional", "human-reviewed", corpus.sparkSession.createDataFrame([(None, None)], "a double, b double")),
    ]
    out = None
    for name, base, alt, df in parts:
        df = df.select(F.lit(name).alias("comparison_id"), F.lit(base).alias("baseline_label"), F.lit(alt).alias("alternative_label"), F.col("a").alias("baseline_value"), F.col("b").alias("alternative_value"))
        out = df if out is None else out.unionByName(df)
    diff = F.col("alternative_value") - F.col("baseline_value")
    rel = F.abs(diff) / F.greatest(F.abs(F.col("baseline_value")), F.lit(1e-12))
    out = out.withColumns({"absolute_difference": diff, "absolute_relative_change": F.when(F.col("baseline_value").isNotNull(), rel)})
    return out.withColumns({"major_change": F.coalesce(F.col("absolute_relative_change") >= MAJOR, F.lit(False)), "status": F.when(F.col("comparison_id") == "S08", "not_available_no_human_reviewed_registry").otherwise("complete")})


def scope_sensitivity(wi: DataFrame) -> DataFrame:
    """Memberships in the primary and the expanded institution scope, by view."""
    scope = F.struct
    v = F.explode(F.array(
        scope(F.lit("strict").alias("corpus_view"), F.lit("primary").alias("scope_view"), (F.col("strict_primary") & F.col("is_primary_network_scope")).alias("inside")),
        scope(F.lit("strict").alias("corpus_view"), F.lit("expanded").alias("scope_view"), (F.col("strict_primary") & F.col("is_target_macro_region") & F.col("analytical_scope").isin("primary", "secondary")).alias("inside")),
        scope(F.lit("broad").alias("corpus_view"), F.lit("primary").alias("scope_view"), (F.col("broad_primary") & F.col("is_primary_network_scope")).alias("inside")),
        scope(F.lit("broad").alias("corpus_view"), F.lit("expanded").alias("scope_view"), (F.col("broad_primary") & F.col("is_target_macro_region") & F.col("analytical_scope").isin("primary", "secondary")).alias("inside")),
    ))
    m = wi.withColumn("v", v).filter("v.inside")
    return m.groupBy(F.col("publication_year").alias("year"), "v.corpus_view", "hierarchy_view", "v.scope_view").agg(F.count(F.lit(1)).alias("institution_work_count"), F.count_distinct("work_id").alias("distinct_work_count"), F.count_distinct("institution_id").alias("institution_count"))


def checks(**failures: DataFrame) -> DataFrame:
    """(check_name, failures, passed) of one-number tables, one row each."""
    out = None
    for name, df in failures.items():
        one = df.select(F.lit(name).alias("check_name"), F.coalesce(F.col(df.columns[0]).cast("long"), F.lit(0)).alias("failures"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("failures") == 0)


def _split(one: DataFrame) -> dict[str, DataFrame]:
    return {c: one.select(c) for c in one.columns}


def edge_checks(pairs: DataFrame, edges: DataFrame, large: int = LARGE, excluded: int = EXCLUDED) -> DataFrame:
    """Eleven checks of pairs and annual edges, with the number of rows (or missing views) that fail each.

    Ends in order, full weights 1, fractions in (0, 1], both corpora and both hierarchy views there,
    pair counts k (k - 1) / 2 and fractions summing to 1 by work, consortium flags as the thresholds
    have them, annual sums equal to the pairs' sums.
    """
    k = F.col("institution_count")
    rows = pairs.agg(
        F.count_if(~F.coalesce(F.col("source_id") < F.col("target_id"), F.lit(False))).alias("stable_source_target_order"), F.count_if(F.col("full_weight") != 1).alias("unit_full_work_weights"),
        F.count_if((F.col("fractional_weight") <= 0) | (F.col("fractional_weight") > 1)).alias("fractional_weights_in_range"), F.abs(F.count_distinct("corpus_view") - 2).alias("strict_and_broad_present"), F.abs(F.count_distinct("hierarchy_view") - 2).alias("organization_and_umbrella_present"),
        F.count_if(F.col("is_large_consortium") != (k >= large)).alias("warning_threshold_flags_match"), F.count_if(F.col("exceeds_consortium_exclusion_threshold") != (k >= excluded)).alias("exclusion_threshold_flags_match"),
        F.sum("full_weight").alias("_full"), F.sum("fractional_weight").alias("_fraction"),
    )
    d = pair_diagnostics(pairs).agg(F.count_if(F.col("pair_count") != F.col("expected_pair_count")).alias("pair_counts_match_combinations"), F.count_if(F.col("fractional_error") > 1e-10).alias("fractional_weights_sum_to_one_per_work"))
    e = edges.agg(F.sum("full_count").alias("_e_full"), F.sum("fractional_count").alias("_e_fraction"))
    both = rows.join(F.broadcast(e))  # one row each
    sums = both.select((~F.col("_full").eqNullSafe(F.col("_e_full"))).cast("int").alias("annual_full_counts_reconcile"), (F.abs(F.coalesce(F.col("_fraction"), F.lit(0.0)) - F.coalesce(F.col("_e_fraction"), F.lit(0.0))) >= 1e-4).cast("int").alias("annual_fractional_counts_reconcile"))
    return checks(**_split(rows.drop("_full", "_fraction")), **_split(d), **_split(sums))


def similarity_checks(vectors: DataFrame, edges: DataFrame, coverage: DataFrame, k: int = 20) -> DataFrame:
    """Vectors of norm 1, edges in order, in (0, 1] and among the best k of an end, score sums equal to weight sums."""
    n = vectors.groupBy(*VIEW, "institution_id").agg(F.sum(F.col("normalized_topic_weight") * F.col("normalized_topic_weight")).alias("q"))
    n = n.agg(F.count_if(F.abs(F.col("q") - 1) > 1e-10).alias("vector_norms_are_one"))
    s, r = F.col("cosine_similarity"), F.least("source_neighbor_rank", "target_neighbor_rank")
    e = edges.agg(F.count_if(F.col("source_id") >= F.col("target_id")).alias("stable_source_target_order"), F.count_if((s <= 0) | (s > 1 + 1e-12)).alias("similarities_in_range"), F.count_if(r > k).alias("ranks_within_top_k"))
    c = coverage.agg(F.count_if(F.abs(F.col("expected_score") - F.col("vector_weight")) > 1e-9 * F.greatest(F.col("expected_score"), F.lit(1.0))).alias("score_sums_reconcile"))
    return checks(**_split(n), **_split(e), **_split(c))


def extraction_reconciliation(works: DataFrame, extracted: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: works with an institution, works without, works in all, works in both or in neither."""
    a, b = extracted.select("work_id").distinct().withColumn("a", F.lit(1)), unresolved.select("work_id").distinct().withColumn("b", F.lit(1))
    j = works.select("work_id").distinct().join(a, "work_id", "full").join(b, "work_id", "full")
    out = j.agg(F.count(F.lit(1)).alias("work_count"), F.count("a").alias("resolved_count"), F.count("b").alias("unresolved_count"), F.count_if(F.col("a").isNotNull() == F.col("b").isNotNull()).alias("both_or_neither_count"))
    return out.withColumn("reconciles", (F.col("both_or_neither_count") == 0) & (F.col("resolved_count") + F.col("unresolved_count") == F.col("work_count")))


def rank_sums(ranked: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The sum of PageRank over each view, which must be 1."""
    g = ranked.groupBy(*VIEW).agg(F.sum("pagerank").alias("pagerank_sum"), F.count(F.lit(1)).alias("node_count"))
    return g.withColumn("is_one", F.abs(F.col("pagerank_sum") - 1) <= tolerance)
