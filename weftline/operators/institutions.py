"""Institutions: extraction from authorships, master data, geography, registry, hierarchy views."""

from __future__ import annotations

import csv
import json
from importlib.resources import files

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import compact_flags, short_id, sorted_set, union_arrays
from weftline.operators.corpus import VARIANTS
from weftline.operators.hierarchy import walk
from weftline.operators.nested import emit_tagged, no_constant
from weftline.session import Scratch

TARGET_REGIONS = ("Europe", "Asia", "Americas")
UNKNOWN = ("ZZ", "Unknown", "Unknown", "Unknown")
# Fixed values: (source type, category, scope, counts as research performing in the primary scope). Any other type is unknown.
INSTITUTION_TYPES = [
    ("education", "education", "primary", True), ("government", "government_research", "primary", True), ("nonprofit", "nonprofit_research", "primary", True), ("facility", "research_facility", "primary", True),
    ("healthcare", "healthcare", "secondary", False), ("company", "company", "secondary", False), ("archive", "archive", "secondary", False), ("other", "other", "secondary", False),
    ("funder", "funder", "excluded", False),
]

_AUTHORSHIP = "author struct<id:string>, institutions array<struct<id:string,ror:string,display_name:string,country_code:string,type:string,lineage:array<string>>>, raw_affiliation_strings array<string>, affiliations array<struct<raw_affiliation_string:string>>"


def _clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def country(c: Column) -> Column:
    u = F.upper(F.trim(c))
    return F.when(u.rlike("^[A-Z]{2}$"), u)


def assertions(works: DataFrame) -> DataFrame:
    """Every mention of an institution with a short id: work, positions, metadata, the authorship's affiliations."""
    a = emit_tagged(works, "work_id", kinds=["authorship"], payload=True).select("work_id", F.col("item_index").alias("i"), F.from_json("payload", _AUTHORSHIP).alias("a"))
    lists = F.concat(F.coalesce("a.raw_affiliation_strings", F.array().cast("array<string>")), F.coalesce(F.transform("a.affiliations", lambda x: x["raw_affiliation_string"]), F.array().cast("array<string>")))
    texts = F.array_sort(F.array_distinct(F.filter(F.transform(lists, _clean), lambda x: x.isNotNull())))
    m = a.select("work_id", "i", texts.alias("affiliations"), F.posexplode("a.institutions").alias("j", "x")).filter("x is not null")
    return m.select(
        "work_id", "i", "j", short_id("x.id", "I").alias("institution_id"), _clean(F.col("x.ror")).alias("ror_id"), _clean(F.col("x.display_name")).alias("display_name"), country(F.col("x.country_code")).alias("country_code"),
        _clean(F.col("x.type")).alias("institution_type"), F.filter(F.transform("x.lineage", lambda y: short_id(y, "I")), lambda y: y.isNotNull()).alias("lineage"), "affiliations",
    ).filter("institution_id is not null")


def extracted(works: DataFrame) -> DataFrame:
    """(work, institution): first non-null metadata in document order, unions of lineage and affiliations, counts."""
    m = assertions(works)

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("i", "j"))).alias(c)

    g = m.groupBy("work_id", "institution_id").agg(
        *[first(c) for c in ("ror_id", "display_name", "country_code", "institution_type")], union_arrays("lineage").alias("lineage"), union_arrays("affiliations").alias("raw_affiliation_strings"),
        F.count_distinct("i").cast("int").alias("authorship_count"), F.count(F.lit(1)).cast("int").alias("assertion_count"),
    )
    return g.join(works.select("work_id", "publication_year"), "work_id")


@F.pandas_udf(T.StringType())
def _json_state(s: pd.Series) -> pd.Series:
    """``none``, ``invalid``, ``list`` (an object counts as a list of one) or ``other``; JSON text in a JSON string is read too.

    In Python, since Spark's own parser takes text with something behind the value for valid.
    """

    def one(t: str | None) -> str:
        if t is None:
            return "none"
        try:
            v: object = t
            while isinstance(v, str):
                v = json.loads(v, parse_constant=no_constant)
        except (ValueError, RecursionError):
            return "invalid"
        return "list" if isinstance(v, (list, dict)) else "other"

    return s.map(one, na_action=None)


def unresolved(works: DataFrame) -> DataFrame:
    """Works without any resolved institution, with the reason."""
    done = assertions(works).select("work_id").distinct()
    any_author = emit_tagged(works, "work_id", kinds=["authorship"]).select("work_id").distinct().withColumn("has", F.lit(True))
    rest = works.select("work_id", "publication_year", _json_state("authorships_json").alias("state")).join(done, "work_id", "left_anti").join(any_author, "work_id", "left")
    why = F.when(F.col("state") == "invalid", "invalid_authorships_json").when(F.col("state") == "other", "authorships_not_array").when(F.col("has"), "no_resolved_institution").otherwise("no_authorships")
    return rest.select("work_id", "publication_year", why.alias("reason"))


def modes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The most frequent value of each column and key, the smallest on ties, and the number of values seen.

    Grouped by key, column and value first, so that a hot key is compressed before it is ranked.
    """
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select(key, "x.*").filter("v is not null")
    n = long.groupBy(key, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key, "c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"), F.count(F.lit(1)).alias("k"))
    aggs = [x for c in columns for x in (F.max(F.when(F.col("c") == c, F.col("v"))).alias(c), F.coalesce(F.max(F.when(F.col("c") == c, F.col("k"))), F.lit(0)).cast("long").alias(f"{c}_values"))]
    return best.groupBy(key).agg(*aggs)


def master(ext: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Institution master from extracted mentions: modes, alternative names, lineage, issues.

    An institution none of whose attributes is ever given still has its row. ``lookups`` (one record
    an institution, looked up at the source) takes precedence: its name, country, type and registry
    id where it gives them, and it alone tells coordinates, alternative names beyond the mentions and
    relationships by kind (``parent_ids``, ``child_ids``, ``predecessor_ids``, ``successor_ids``).
    Issues are those of the mentions; of a missing attribute that the look-up gives there is none.
    """
    cols = ["ror_id", "display_name", "country_code", "institution_type"]
    sets = ext.groupBy("institution_id").agg(sorted_set("display_name").alias("names"), union_arrays("lineage").alias("lineage"), F.count(F.lit(1)).alias("assertion_work_count"))
    m = sets.join(modes(ext, "institution_id", cols), "institution_id", "left")
    m = m.withColumns({f"{c}_values": F.coalesce(f"{c}_values", F.lit(0)).cast("long") for c in cols})
    issues = compact_flags(*[x for c in sorted(cols) for x in ((F.col(f"{c}_values") > 1, f"conflicting_{c}"), (F.col(f"{c}_values") == 0, f"missing_{c}"))])
    other = F.filter("names", lambda x: x != F.col("display_name"))
    out = m.select("institution_id", *cols, F.coalesce(other, F.col("names")).alias("alternative_names"), "lineage", "assertion_work_count", F.array_sort(issues).alias("issues"))
    if lookups is None:
        return out
    links, none = ["parent_ids", "child_ids", "predecessor_ids", "successor_ids"], F.array().cast("array<string>")
    one = lookups.filter("institution_id is not null").dropDuplicates(["institution_id"])
    look = one.select("institution_id", *[_clean(F.col(c)).alias(f"_{c}") for c in cols], F.coalesce("alternative_names", none).alias("_names"), F.coalesce("lineage", none).alias("_lineage"), "latitude", "longitude", *links, F.lit(True).alias("has_lookup"))
    j = out.join(look, "institution_id", "left")
    ids = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, none), lambda x: short_id(x, "I")), lambda x: x.isNotNull() & (x != F.col("institution_id")))))
    j = j.withColumns({c: F.coalesce(f"_{c}", c) for c in cols})
    names = F.filter(F.array_sort(F.array_distinct(F.concat("alternative_names", F.coalesce("_names", none)))), lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("display_name")))
    whole = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    given = F.filter("issues", lambda x: ~F.coalesce(F.array_contains(F.array_compact(F.array(*[F.when(F.col(f"_{c}").isNotNull(), F.lit(f"missing_{c}")) for c in cols])), x), F.lit(False)))
    return j.withColumns({
        "alternative_names": names, "lineage": F.array_sort(F.array_distinct(F.concat("lineage", F.filter(F.transform(F.coalesce("_lineage", none), lambda x: short_id(x, "I")), lambda x: x.isNotNull())))), "issues": given,
        "coordinate_source": F.when(whole, "source"), "has_lookup": F.coalesce("has_lookup", F.lit(False)), **{c: ids(c) for c in links},
    }).drop(*[f"_{c}" for c in cols], "_names", "_lineage")


def region_rows() -> list[tuple[str, str, str, str]]:
    """All analytical country codes with name, macro-region and subregion, from the packaged table."""
    rows = csv.reader(files("weftline.operators").joinpath("regions.csv").read_text(encoding="utf-8").splitlines()[1:])
    return [tuple(r) for r in rows]


def typed(inst: DataFrame) -> DataFrame:
    """``normalized_category``, ``analytical_scope`` and ``is_primary_research_scope`` from ``institution_type``.

    Types are compared in lower case; a null, empty or unlisted type is ``unknown`` and outside the
    primary scope. Columns of these names are replaced.
    """
    names = ("normalized_category", "analytical_scope", "is_primary_research_scope")
    table = inst.sparkSession.createDataFrame(INSTITUTION_TYPES, "_type string, _c string, _s string, _p boolean")
    j = inst.drop(*names).withColumn("_type", F.lower("institution_type")).join(F.broadcast(table), "_type", "left")
    return j.withColumns({names[0]: F.coalesce("_c", F.lit("unknown")), names[1]: F.coalesce("_s", F.lit("unknown")), names[2]: F.coalesce("_p", F.lit(False))}).drop("_type", "_c", "_s", "_p")


def institution_type_profile(inst: DataFrame) -> DataFrame:
    """Institutions by source type with what the type is mapped to."""
    t = inst.groupBy("institution_type").agg(F.count(F.lit(1)).alias("institution_count"))
    return typed(t).select("institution_type", "institution_count", "normalized_category", "analytical_scope", "is_primary_research_scope")


def regions(spark) -> DataFrame:
    return spark.createDataFrame(region_rows(), "country_code string, country_name string, macro_region string, subregion string")


def institution_rows(institutions: DataFrame) -> DataFrame:
    """One row an institution of the master table: exact repeats taken once."""
    cols = ["ror_id", "display_name", "country_code", "institution_type", "normalized_category", "analytical_scope", "is_primary_research_scope", "latitude", "longitude", "canonical_institution_id", "canonicalization_rule_id", "metadata_source"]
    return institutions.filter("institution_id is not null").groupBy("institution_id").agg(*[F.min(c).alias(c) for c in cols])


def with_geography(inst: DataFrame, region_table: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """Country, macro-region and subregion of each institution, and the issue if any.

    ``manual`` (institution_id, country_code) overrides the source. A missing or unmapped country
    is ZZ / Unknown.
    """
    r = F.broadcast(region_table if region_table is not None else regions(inst.sparkSession)).withColumnRenamed("country_code", "_cc")
    d = inst.withColumn("_source", country(F.col("country_code")))
    if manual is not None:
        d = d.join(manual.select("institution_id", F.col("country_code").alias("_manual")), "institution_id", "left")
    else:
        d = d.withColumn("_manual", F.lit(None).cast("string"))
    d = d.drop("country_code", "country_name", "macro_region", "subregion").join(r, F.coalesce("_manual", "_source") == F.col("_cc"), "left")
    issue = F.when(F.col("_manual") != F.col("_source"), "manual_country_differs_from_source").when(F.coalesce("_manual", "_source").isNull(), "missing_source_country").when(F.col("_cc").isNull(), "unmapped_source_country")
    return d.withColumns({
        "country_code": F.coalesce("_cc", F.lit(UNKNOWN[0])), "country_name": F.coalesce("country_name", F.lit(UNKNOWN[1])), "macro_region": F.coalesce("macro_region", F.lit(UNKNOWN[2])), "subregion": F.coalesce("subregion", F.lit(UNKNOWN[3])),
        "geography_issue": issue,
    }).drop("_cc", "_source", "_manual")


def enriched(inst: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join to registry records (ror_id, name, country_code, latitude, longitude, valid) with a status.

    Coordinates come from the registry only where the source pair is incomplete and the registry's
    is complete; conflicts in country and name are told, never resolved.
    """
    bare = F.regexp_extract(F.lower("ror_id"), r"([0-9a-hj-km-np-tv-z]{9})/*$", 1)
    i = inst.withColumn("_ror", F.nullif(bare, F.lit("")))
    r = registry.select(F.lower("ror_id").alias("_ror"), F.col("name").alias("_name"), F.col("country_code").alias("_cc"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.coalesce("valid", F.lit(True)).alias("_valid")).dropDuplicates(["_ror"])
    j = i.join(r, "_ror", "left")
    status = F.when(F.col("_ror").isNull(), "missing_ror_id").when(F.col("_valid").isNull(), "not_retrieved").when(F.col("_valid"), "enriched").otherwise("invalid_record")
    fill = (F.col("latitude").isNull() | F.col("longitude").isNull()) & F.col("_lat").isNotNull() & F.col("_lon").isNotNull() & F.col("_valid")
    conflicts = compact_flags((F.col("_valid") & (F.col("_cc") != F.col("country_code")), "country"), (F.col("_valid") & (F.lower("_name") != F.lower("display_name")), "name"))
    return j.withColumns({
        "registry_status": status, "coordinate_source": F.when(fill, "registry").when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "source"),
        "latitude": F.when(fill, F.col("_lat")).otherwise(F.col("latitude")), "longitude": F.when(fill, F.col("_lon")).otherwise(F.col("longitude")), "registry_conflicts": conflicts,
    }).drop("_ror", "_name", "_cc", "_lat", "_lon", "_valid")


def _resolved(inst: DataFrame) -> DataFrame:
    """Each institution with what it is told to stand for (``told``), the end of that chain (``at``), whether it ends (``done``) and its rule ids."""
    scratch = Scratch(inst.sparkSession, "canonical")
    none = F.array().cast("array<string>")
    told = F.coalesce(short_id("canonical_institution_id", "I"), F.col("institution_id"))
    p = scratch.write(inst.select("institution_id", told.alias("told"), F.array_compact(F.array("canonicalization_rule_id")).alias("rules")), "told")
    alias, same = p.filter("told <> institution_id"), p.filter("told = institution_id")
    stops = alias.select(F.col("told").alias("node")).distinct().join(alias.select(F.col("institution_id").alias("node")), "node", "left_anti")
    walks = alias.select(F.col("institution_id").alias("node"), F.col("told").alias("at"), F.lit(1).alias("steps"), F.lit(False).alias("done"), F.col("rules").alias("path"))
    walks = walks.unionByName(stops.select("node", F.col("node").alias("at"), F.lit(0).alias("steps"), F.lit(True).alias("done"), none.alias("path")))
    ends = walk(scratch, walks, path=True).filter("steps > 0")
    ends = ends.select(F.col("node").alias("institution_id"), "at", "done", F.col("path").alias("rules")).join(alias.select("institution_id", "told"), "institution_id")
    return same.select("institution_id", "told", F.col("told").alias("at"), F.lit(True).alias("done"), none.alias("rules")).unionByName(ends)


def canonical_chain(inst: DataFrame) -> DataFrame:
    """(institution_id, canonical_institution_id, is_collapsed, rule ids) along chains of any length.

    Institutions on a cycle of rules or below one stand for themselves; ``rule_problems`` tells them.
    """
    r = _resolved(inst)
    at = F.when(F.col("done"), F.col("at")).otherwise(F.col("institution_id"))
    rules = F.when(F.col("done"), F.array_sort(F.array_distinct("rules"))).otherwise(F.array().cast("array<string>"))
    return r.select("institution_id", at.alias("canonical_institution_id"), (at != F.col("institution_id")).alias("is_collapsed"), rules.alias("canonicalization_rule_ids"))


def hierarchy_views(inst: DataFrame) -> DataFrame:
    """Two rows an institution: itself (organization) and what it is collapsed to (umbrella)."""
    own = inst.select(F.lit("organization").alias("hierarchy_view"), "institution_id", F.col("institution_id").alias("canonical_institution_id"), F.lit(False).alias("is_collapsed"), F.array().cast("array<string>").alias("canonicalization_rule_ids"))
    return own.unionByName(canonical_chain(inst).withColumn("hierarchy_view", F.lit("umbrella")))


def rule_problems(inst: DataFrame) -> DataFrame:
    """Rules whose chain ends at an id without a row (with that id), or runs into a cycle (with the rule's own target)."""
    r = _resolved(inst)
    ids = inst.select(F.col("institution_id").alias("at"), F.lit(True).alias("known"))
    j = r.filter("told <> institution_id").join(ids, "at", "left")
    why = F.when(~F.col("done"), "cycle").when(F.col("known").isNull(), "unknown_target")
    return j.select("institution_id", F.when(F.col("done"), F.col("at")).otherwise(F.col("told")).alias("canonical_institution_id"), why.alias("problem")).filter("problem is not null")


def umbrella_candidates(institutions: DataFrame) -> DataFrame:
    """For each institution the known ids among its lineage and parents, and how the choice stands."""
    rows = institutions.filter("institution_id is not null")
    none = F.array().cast("array<string>")
    told = rows.select("institution_id", F.explode(F.concat(F.coalesce("lineage", none), F.coalesce("parent_ids", none))).alias("x")).select("institution_id", short_id("x", "I").alias("candidate_id")).filter("candidate_id is not null and candidate_id <> institution_id").distinct()
    known = rows.select(F.col("institution_id").alias("candidate_id")).distinct()
    g = told.join(known, "candidate_id", "left_semi").groupBy("institution_id").agg(sorted_set("candidate_id").alias("candidate_ids"))
    out = rows.select("institution_id").distinct().join(g, "institution_id", "left").withColumn("candidate_ids", F.coalesce("candidate_ids", none))
    n = F.size("candidate_ids")
    return out.withColumn("candidate_count", n).withColumn("resolution", F.when(n == 0, "no_candidate").when(n == 1, "single_candidate").otherwise("ambiguous"))


def work_institutions(ext: DataFrame, corpus: DataFrame, inst_geo: DataFrame, views: DataFrame) -> DataFrame:
    """(work, hierarchy view, institution): both views in one pass; institutions without master row are left out.

    All nine corpus flags are kept, and the rules by which organizations were joined.
    """
    keep = ["method_families", *VARIANTS]
    c = corpus.select("work_id", "work_type", *keep)
    j = ext.select("work_id", "publication_year", "institution_id", "raw_affiliation_strings", "authorship_count", "assertion_count").join(views, "institution_id").join(c, "work_id")
    g = j.groupBy("work_id", "publication_year", "hierarchy_view", F.col("canonical_institution_id").alias("canonical")).agg(
        sorted_set("institution_id").alias("original_institution_ids"), union_arrays("raw_affiliation_strings").alias("raw_affiliation_strings"), F.sum("authorship_count").alias("authorship_count"), F.sum("assertion_count").alias("assertion_count"),
        F.bool_or("is_collapsed").alias("any_collapsed"), F.min("method_families").alias("method_families"), F.min("work_type").alias("work_type"), union_arrays("canonicalization_rule_ids").alias("canonicalization_rule_ids"), *[F.bool_or(k).alias(k) for k in keep[1:]],
    ).withColumnRenamed("canonical", "institution_id")
    i = inst_geo.select("institution_id", "ror_id", "display_name", "normalized_category", "analytical_scope", "is_primary_research_scope", "country_code", "country_name", "macro_region", "subregion", "latitude", "longitude")
    target = F.col("macro_region").isin(*TARGET_REGIONS)
    return g.join(i, "institution_id").withColumns({
        "contributing_organization_count": F.size("original_institution_ids"), "was_collapsed": F.col("any_collapsed") | (F.size("original_institution_ids") > 1),
        "is_target_macro_region": target, "is_primary_network_scope": F.col("is_primary_research_scope") & target,
    }).drop("any_collapsed")
