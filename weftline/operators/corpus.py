"""Normalization of delivered works, version families, and corpus membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import compact_flags, sorted_set
from weftline.operators.nested import emit_tagged, flat_table
from weftline.operators.skew import join_unique, top_one

FIRST_YEAR, LAST_YEAR = 2010, 2025

# Fixed values: (work type, counts in the primary corpus, with preprints, in the expanded corpus). Any other type counts in none.
WORK_TYPES = [
    ("article", True, True, True), ("conference-paper", True, True, True), ("review", True, True, True), ("data-paper", True, True, True), ("software-paper", True, True, True),
    ("preprint", False, True, True),
    ("conference-abstract", False, False, True), ("dataset", False, False, True), ("software", False, False, True), ("book", False, False, True), ("book-chapter", False, False, True),
    ("dissertation", False, False, True), ("report", False, False, True), ("standard", False, False, True),
    ("libguides", False, False, False), ("other", False, False, False), ("reference-entry", False, False, False), ("peer-review", False, False, False), ("paratext", False, False, False),
    ("book-review", False, False, False), ("editorial", False, False, False), ("erratum", False, False, False), ("supplementary-materials", False, False, False), ("letter", False, False, False), ("retraction", False, False, False),
]
VARIANTS = (
    "strict_primary", "broad_primary", "strict_preprint_sensitivity", "broad_preprint_sensitivity", "strict_expanded_sensitivity",
    "broad_expanded_sensitivity", "strict_all_versions_sensitivity", "broad_all_versions_sensitivity", "uncertain_topic_sensitivity",
)


def reject_reason(first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """The first rule that a delivered row breaks; null for a good row."""
    return (
        F.when(F.col("work_id").isNull() | ~F.col("work_id").rlike(r"^W[0-9]+$"), "invalid_or_missing_work_id")
        .when(F.col("publication_year").isNull(), "invalid_or_missing_publication_year")
        .when(~F.col("publication_year").between(first, last), "publication_year_outside_analysis_window")
    )


def quarantine(works: DataFrame) -> DataFrame:
    """Rejected rows with their reason and a stable record key."""
    key = F.sha2(F.concat_ws(":", F.coalesce("work_id", F.lit("")), F.coalesce("source_retrieved_at_utc", F.lit("")), F.coalesce("raw_record_hash", F.lit(""))), 256)
    return works.withColumn("reason", reject_reason()).filter("reason is not null").select(key.alias("record_key"), "work_id", "publication_year", "reason")


def normalized_works(works: DataFrame) -> DataFrame:
    """One row for each valid work: of its deliveries the first by retrieval text, then by hash."""
    ok = works.filter(reject_reason().isNull())
    return top_one(ok, ["work_id"], F.asc_nulls_last("source_retrieved_at_utc"), F.asc_nulls_last("raw_record_hash"))


def work_topics(works: DataFrame, registry: DataFrame) -> DataFrame:
    """(work, topic) with score and the registry's membership; first mention of a topic in a work wins."""
    t = flat_table(emit_tagged(works, "work_id", kinds=["topic"], payload=True), "topic").filter(F.col("item_key").startswith("T"))
    t = top_one(t.select("work_id", F.col("item_key").alias("topic_id"), "item_index", F.col("display_name").alias("topic_name"), F.col("score").alias("topic_score")), ["work_id", "topic_id"], F.asc("item_index"))
    reg = registry.select("topic_id", "subfield_name", "field_name", "domain_name", "corpus_membership", "method_family")
    prim = works.select("work_id", "primary_topic_id")
    return t.drop("item_index").join(reg, "topic_id", "left").join(prim, "work_id").withColumn("is_primary_topic", F.col("topic_id") == F.col("primary_topic_id")).drop("primary_topic_id")


def work_references(works: DataFrame) -> DataFrame:
    """Distinct (work_id, referenced_work_id) with a valid short id."""
    r = emit_tagged(works, "work_id", kinds=["reference"]).filter(F.col("item_key").startswith("W"))
    return r.select("work_id", F.col("item_key").alias("referenced_work_id")).distinct()


def export_works(works: DataFrame, registry: DataFrame) -> DataFrame:
    """Normalized works with sorted arrays of topic ids and referenced ids; null lists become empty."""
    topics = work_topics(works, registry).groupBy("work_id").agg(sorted_set("topic_id").alias("topic_ids"))
    refs = work_references(works).groupBy("work_id").agg(sorted_set("referenced_work_id").alias("referenced_work_ids"))
    none = F.array().cast("array<string>")
    out = works.join(topics, "work_id", "left").join(refs, "work_id", "left")
    return out.withColumn("topic_ids", F.coalesce("topic_ids", none)).withColumn("referenced_work_ids", F.coalesce("referenced_work_ids", none))


def normalized_doi() -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim("doi")), r"^https?://(dx\.)?doi\.[a-z]+/", ""), F.lit(""))


def title_fingerprint() -> Column:
    """ASCII letters and digits of the lower-case title; null where none is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim("title")), r"[^\p{Alnum}]", ""), F.lit(""))


def version_families(works: DataFrame) -> DataFrame:
    """Exact-DOI families with their representative, and possible title families.

    A title family needs a fingerprint of 20 signs or more, a preprint and another record, and
    years at most 3 apart; it is only marked, never resolved. The representative of a DOI family is
    chosen by: not retracted, not paratext, kind of work, citations, date of update, id.
    """
    b = works.select("work_id", normalized_doi().alias("normalized_doi"), title_fingerprint().alias("fp"), "publication_year", "work_type", "is_retracted", "is_paratext", "cited_by_count", "source_updated_date")
    doi = b.filter("normalized_doi is not null").groupBy("normalized_doi").agg(F.count(F.lit(1)).alias("dn")).filter("dn > 1")
    pre, span = F.count_if(F.col("work_type") == "preprint"), F.max("publication_year") - F.min("publication_year")
    title = b.filter(F.length("fp") >= 20).groupBy("fp").agg(F.count(F.lit(1)).alias("tn"), pre.alias("p"), F.count_if(F.col("work_type") != "preprint").alias("q"), span.alias("span"))
    title = title.filter("tn > 1 and p > 0 and q > 0 and span between 0 and 3").select("fp", "tn")
    a = join_unique(join_unique(b, doi, "normalized_doi", "left"), title, "fp", "left")
    kind = F.when(F.col("work_type").isin([t for t, primary, *_ in WORK_TYPES if primary]), 0).when(F.col("work_type") == "preprint", 2).otherwise(1)
    order = (F.asc_nulls_last("is_retracted"), F.asc_nulls_last("is_paratext"), kind.asc(), F.desc_nulls_last("cited_by_count"), F.desc_nulls_last("source_updated_date"), F.asc("work_id"))
    w = Window.partitionBy(F.when(F.col("dn") > 1, F.col("normalized_doi")).otherwise(F.col("work_id"))).orderBy(*order)
    exact, maybe = F.col("dn").isNotNull(), F.col("tn").isNotNull()
    a = a.withColumn("representative_rank", F.row_number().over(w)).withColumn("primary_representative_work_id", F.first("work_id").over(w))
    family = F.when(exact, F.concat(F.lit("doi:"), F.md5("normalized_doi")))
    return a.select(
        "work_id", "normalized_doi", family.alias("exact_doi_family_id"), F.when(maybe, F.concat(F.lit("title:"), F.md5("fp"))).alias("possible_title_family_id"),
        F.coalesce(family, F.concat(F.lit("work:"), "work_id")).alias("version_family_id"),
        F.when(exact, "exact_normalized_doi").when(maybe, "possible_title_match_unresolved").otherwise("singleton").alias("family_match_basis"),
        F.coalesce("dn", F.lit(1)).cast("long").alias("exact_doi_member_count"), F.coalesce("tn", F.lit(0)).cast("long").alias("possible_title_member_count"),
        (maybe & ~exact).alias("ambiguous_possible_family"), (F.col("representative_rank") == 1).alias("is_recommended_primary_representative"), "representative_rank", "primary_representative_work_id",
        F.when(exact & (F.col("representative_rank") == 1), "selected_deterministically_within_exact_doi_family").when(exact, "non_representative_exact_doi_duplicate")
        .when(maybe, "retained_because_title_only_family_is_ambiguous").otherwise("singleton_record").alias("representative_reason"),
    )


def type_policy(spark) -> DataFrame:
    return spark.createDataFrame(WORK_TYPES, "work_type string, in_primary boolean, in_preprint boolean, in_expanded boolean")


def corpus_flags(works: DataFrame, topics: DataFrame, versions: DataFrame) -> DataFrame:
    """Nine membership flags and the reasons of exclusion, one row a work.

    Null flags stay null: a work with unknown retraction is in no corpus and has no reason for it.
    """
    m = F.col("corpus_membership")
    known = F.when(m.isin("strict", "broad_only", "uncertain"), F.col("method_family"))
    t = topics.groupBy("work_id").agg(
        F.bool_or(m == "strict").alias("s"), F.bool_or(m.isin("strict", "broad_only")).alias("b"), F.bool_or(m == "uncertain").alias("u"), sorted_set(known).alias("method_families")
    )
    v = versions.select("work_id", "version_family_id", "primary_representative_work_id", "is_recommended_primary_representative", "ambiguous_possible_family")
    keep = ["work_id", "title", "doi", "publication_year", "work_type", "primary_topic_id", "is_retracted", "is_paratext"]
    j = works.select(*keep).join(t, "work_id", "left").join(F.broadcast(type_policy(works.sparkSession)), "work_type", "left").join(v, "work_id")
    no = F.lit(False)
    for c in ("s", "b", "u", "in_primary", "in_preprint", "in_expanded"):
        j = j.withColumn(c, F.coalesce(c, no))
    j = j.withColumn("method_families", F.coalesce("method_families", F.array().cast("array<string>")))
    clean, rep = ~F.col("is_retracted") & ~F.col("is_paratext"), F.col("is_recommended_primary_representative")
    flags = {
        "strict_primary": F.col("s") & F.col("in_primary") & clean & rep, "broad_primary": F.col("b") & F.col("in_primary") & clean & rep,
        "strict_preprint_sensitivity": F.col("s") & F.col("in_preprint") & clean & rep, "broad_preprint_sensitivity": F.col("b") & F.col("in_preprint") & clean & rep,
        "strict_expanded_sensitivity": F.col("s") & F.col("in_expanded") & clean & rep, "broad_expanded_sensitivity": F.col("b") & F.col("in_expanded") & clean & rep,
        "strict_all_versions_sensitivity": F.col("s") & F.col("in_primary") & clean, "broad_all_versions_sensitivity": F.col("b") & F.col("in_primary") & clean,
        "uncertain_topic_sensitivity": F.col("u") & F.col("in_primary") & clean & rep,
    }
    why = [(~F.col("in_primary"), "work_type_not_primary"), (F.col("is_retracted"), "retracted"), (F.col("is_paratext"), "paratext"), (~rep, "non_representative_exact_doi_duplicate")]
    j = j.withColumns({**flags, "strict_exclusion_reasons": compact_flags((~F.col("s"), "no_strict_topic"), *why), "broad_exclusion_reasons": compact_flags((~F.col("b"), "no_broad_topic"), *why)})
    return j.drop("in_primary", "in_preprint", "in_expanded").withColumnsRenamed({"s": "has_strict_topic", "b": "has_broad_topic", "u": "has_uncertain_topic"})


def annual_counts(corpus: DataFrame) -> DataFrame:
    """Works by year and corpus variant, by unpivoting the nine flags in one pass."""
    long = corpus.select("publication_year", F.explode(F.array(*[F.struct(F.lit(v).alias("corpus_variant"), F.col(v).alias("included")) for v in VARIANTS])).alias("f"))
    return long.filter("f.included").groupBy("publication_year", "f.corpus_variant").agg(F.count(F.lit(1)).alias("work_count"))


def family_counts(corpus: DataFrame, topics: DataFrame) -> DataFrame:
    """Distinct works by year, primary variant and method family; membership of the topic depends on the variant."""
    rows = corpus.select("work_id", "publication_year", F.explode(F.array(*[F.struct(F.lit(v).alias("corpus_variant"), F.col(v).alias("included")) for v in VARIANTS[:2]])).alias("f"))
    rows = rows.filter("f.included").select("work_id", "publication_year", "f.corpus_variant")
    t = topics.filter("method_family is not null").select("work_id", "method_family", "corpus_membership").distinct()
    fits = (F.col("corpus_membership") == "strict") | ((F.col("corpus_variant") == "broad_primary") & (F.col("corpus_membership") == "broad_only"))
    return rows.join(t, "work_id").filter(fits).groupBy("publication_year", "corpus_variant", "method_family").agg(F.count_distinct("work_id").alias("work_count"))


def corpus_violations(corpus: DataFrame) -> DataFrame:
    """One row: works in strict but not broad, and excluded works without a reason (null flags apart)."""
    return corpus.agg(
        F.count_if(F.col("strict_primary") & ~F.col("broad_primary")).alias("strict_outside_broad"),
        F.count_if(~F.col("strict_primary") & (F.size("strict_exclusion_reasons") == 0)).alias("strict_without_reason"),
        F.count_if(~F.col("broad_primary") & (F.size("broad_exclusion_reasons") == 0)).alias("broad_without_reason"),
    )


def type_profile(works: DataFrame) -> DataFrame:
    """Works by type with the type's policy; unknown types take the policy of none."""
    c = works.groupBy("work_type").agg(F.count(F.lit(1)).alias("work_count")).join(F.broadcast(type_policy(works.sparkSession)), "work_type", "left")
    return c.select("work_type", "work_count", F.col("in_primary").isNotNull().alias("is_known_type"), *[F.coalesce(x, F.lit(False)).alias(x) for x in ("in_primary", "in_preprint", "in_expanded")])


def hash_sample(df: DataFrame, stratum: list[str], key: str, n: int, seed: str) -> DataFrame:
    """The first n rows of each stratum in the order of SHA-256 of seed, stratum and key (a sampling operator)."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *stratum, key), 256)
    rn = F.row_number().over(Window.partitionBy(*stratum).orderBy("sample_hash", key))
    return df.withColumn("sample_hash", h).withColumn("sample_rank", rn).filter(F.col("sample_rank") <= n)


def lexical_topic_scores(registry: DataFrame, terms: list[str]) -> DataFrame:
    """Topics by token overlap with search terms: 0.55 name + 0.25 field + 0.2 domain, + 0.25 if the name holds the term, at most 1."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1))
    asked = F.explode(F.array(*[F.lit(t) for t in terms])) if terms else F.explode(F.array().cast("array<string>"))
    r = registry.select("topic_id", "display_name", words("display_name").alias("nw"), words("subfield_name").alias("fw"), words("domain_name").alias("dw"), asked.alias("term"))
    r = r.withColumn("tw", words("term"))
    part = lambda c: F.size(F.array_intersect("tw", c)) / F.greatest(F.lit(1), F.size("tw"))
    exact = F.when(F.contains(F.lower("display_name"), F.lower("term")), 0.25).otherwise(0.0)
    score = F.least(F.lit(1.0), 0.55 * part("nw") + 0.25 * part("fw") + 0.2 * part("dw") + exact)
    s = r.withColumn("score", F.round(score, 6)).filter("score > 0")
    return s.groupBy("topic_id", "display_name").agg(F.max("score").alias("evidence"), F.count(F.lit(1)).alias("term_count"))


def decision_gaps(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(kind, topic_id): candidates without a decision, decisions without a candidate, topics decided twice."""
    c, d = candidates.select("topic_id").filter("topic_id is not null").distinct(), decisions.filter("topic_id is not null").select("topic_id")
    twice = d.groupBy("topic_id").count().filter("count > 1")
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "topic_id")
    return part(c.join(d, "topic_id", "left_anti"), "missing_decision").unionByName(part(d.distinct().join(c, "topic_id", "left_anti"), "unknown_topic")).unionByName(part(twice, "decided_twice"))


def freeze_registry(candidates: DataFrame, decisions: DataFrame, samples: DataFrame) -> DataFrame:
    """The topic registry as decided: candidates with membership, family, sampled works and both corpora's flags.

    ``candidates``: topic_id, display_name, evidence; ``decisions``: topic_id, corpus_membership,
    method_family; ``samples``: topic_id, work_id. Decisions must cover the candidates exactly, else
    nothing is frozen and the gaps are told. The broad corpus holds the strict topics and those that
    are broad only. A registry of settings: some hundred rows.
    """
    gaps = decision_gaps(candidates, decisions).limit(20).collect()
    if gaps:
        raise ValueError("decisions do not cover the candidates: " + ", ".join(f"{g.kind} {g.topic_id}" for g in gaps))
    s = samples.groupBy("topic_id").agg(sorted_set("work_id").alias("sample_work_ids"))
    j = candidates.join(decisions, "topic_id").join(s, "topic_id", "left")
    m = F.col("corpus_membership")
    return j.withColumns({"sample_work_ids": F.coalesce("sample_work_ids", F.array().cast("array<string>")), "in_strict": F.coalesce(m == "strict", F.lit(False)), "in_broad": F.coalesce(m.isin("strict", "broad_only"), F.lit(False))})


def boundary_sample(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """The first n works by hash of each group: strict, broad only, and all others as a control. ``rows``: topic_id, work_id, corpus_membership."""
    group = F.when(F.col("corpus_membership").isin("strict", "broad_only"), F.col("corpus_membership")).otherwise("excluded_or_uncertain_control")
    return hash_sample(rows.withColumn("sample_group", group), ["sample_group"], "sample_id", n, seed)


def boundary_quality(labels: DataFrame, known: DataFrame, work_topics: DataFrame, registry: DataFrame, min_labels: int = 10, min_known: int = 5) -> DataFrame:
    """One row: precision of the boundary from labels and recall from known works, each withheld where the evidence is too thin.

    ``labels``: label, corpus_membership; only ``relevant`` and ``irrelevant`` count. ``known``: work_id,
    expected_corpus (strict or broad); ``work_topics``: work_id, topic_id. Precision needs
    ``min_labels`` labels, recall ``min_known`` known works of which each has an observed topic. A value
    that is not measured is null, and its status says so.
    """
    inside = F.col("corpus_membership").isin("strict", "broad_only")
    told = labels.filter(F.col("label").isin("relevant", "irrelevant")).agg(
        F.count(F.lit(1)).alias("label_count"), F.count_if(inside).alias("included_label_count"), F.count_if(inside & (F.col("label") == "relevant")).alias("relevant_label_count")
    )
    t = work_topics.select("work_id", "topic_id").join(F.broadcast(registry.select("topic_id", "corpus_membership")), "topic_id", "left")
    own = t.join(known.select("work_id").distinct(), "work_id", "left_semi").groupBy("work_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("corpus_membership") == "strict", F.lit(False))).alias("strict"), F.bool_or(F.coalesce(inside, F.lit(False))).alias("broad")
    )
    found = F.when(F.col("expected_corpus") == "strict", F.col("strict")).otherwise(F.col("broad"))
    k = known.select("work_id", "expected_corpus").join(own, "work_id", "left").agg(F.count(F.lit(1)).alias("known_count"), F.count("n").alias("known_with_topics"), F.count_if(found).alias("recovered_count"))
    j = told.join(F.broadcast(k))  # one row each
    enough, seen = F.col("label_count") >= min_labels, (F.col("known_count") >= min_known) & (F.col("known_with_topics") == F.col("known_count"))
    status = lambda ok: F.when(ok, "measured").otherwise("not_estimated")
    ratio = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    return j.withColumns({"precision_status": status(enough), "precision": F.when(enough, ratio("relevant_label_count", "included_label_count")), "recall_status": status(seen), "recall": F.when(seen, ratio("recovered_count", "known_count"))})
