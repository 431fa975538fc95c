"""Collaboration networks: memberships, pairs, annual edges, outputs, flows, intensity, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import join_null_safe, safe_divide, sorted_set

VIEW = ["year", "corpus_view", "hierarchy_view"]
LARGE, EXCLUDED = 25, 100
LEVELS = ("macro_region", "subregion", "country")


def bounded_sample(df: DataFrame, keys: list[str], value: str, name: str, n: int = 10) -> DataFrame:
    """The n smallest distinct values of each key, sorted.

    The rank is cut before the shuffle (WindowGroupLimit), so no task or buffer holds a whole group.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    top = df.select(*keys, value).filter(F.col(value).isNotNull()).withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= n)
    return top.groupBy(*keys).agg(sorted_set(value).alias(name))


def work_groups(wi: DataFrame) -> DataFrame:
    """One row for each view and work: its institutions in scope, sorted by id, and its families.

    Both corpora come from one explosion; the hierarchy views are rows already.
    """
    views = F.explode(F.array(F.struct(F.lit("strict").alias("corpus_view"), F.col("strict_primary").alias("inside")), F.struct(F.lit("broad").alias("corpus_view"), F.col("broad_primary").alias("inside"))))
    m = wi.filter("is_primary_network_scope").withColumn("v", views).filter("v.inside")
    member = F.struct("institution_id", "country_code", "macro_region", "subregion")
    g = m.groupBy(F.col("publication_year").alias("year"), "v.corpus_view", "hierarchy_view", "work_id").agg(F.array_sort(F.collect_set(member)).alias("members"), F.min("method_families").alias("method_families"))
    return g.withColumn("institution_count", F.size("members"))


def memberships(groups: DataFrame) -> DataFrame:
    return groups.select(*VIEW, "work_id", "institution_count", F.explode("members").alias("m")).select(*VIEW, "work_id", "institution_count", "m.*")


def pairs(groups: DataFrame, large: int = LARGE, excluded: int = EXCLUDED) -> DataFrame:
    """All i < j institution pairs of each work of two or more; 1 in full, 2 / (k (k - 1)) as a fraction.

    Array form: pairs are generated inside the row that holds the work's members, without a
    self-join. Large consortia are flagged, never dropped.
    """
    k = F.col("institution_count")
    g = groups.filter(k >= 2).select(*VIEW, "work_id", "institution_count", "method_families", "members", F.posexplode("members").alias("i", "s"))
    g = g.select(*VIEW, "work_id", "institution_count", "method_families", "s", F.explode(F.slice("members", F.col("i") + 2, k)).alias("t"))
    return g.select(
        *VIEW, "work_id", F.col("s.institution_id").alias("source_id"), F.col("t.institution_id").alias("target_id"), "institution_count", "method_families",
        *[F.col(f"{e}.{a}").alias(f"{n}_{b}") for e, n in (("s", "source"), ("t", "target")) for a, b in (("macro_region", "region"), ("subregion", "subregion"), ("country_code", "country"))],
        F.lit(1).alias("full_weight"), (F.lit(2.0) / (k * (k - 1))).alias("fractional_weight"), (k >= large).alias("is_large_consortium"), (k >= excluded).alias("exceeds_consortium_exclusion_threshold"),
    )


def pair_diagnostics(p: DataFrame) -> DataFrame:
    """Per work: generated and expected pairs, and the error of the fractions' sum."""
    g = p.groupBy(*VIEW, "work_id").agg(F.max("institution_count").alias("institution_count"), F.count(F.lit(1)).alias("pair_count"), F.sum("fractional_weight").alias("fractional_sum"))
    k = F.col("institution_count")
    return g.withColumn("expected_pair_count", (k * (k - 1) / 2).cast("long")).withColumn("fractional_error", F.abs(F.col("fractional_sum") - 1))


def edges_year(p: DataFrame, inst: DataFrame) -> DataFrame:
    """Annual edges with sums, consortium counts, families, a sample of works and both ends' attributes.

    Sums are combined before the shuffle; attributes are joined after it, to far fewer rows.
    """
    keys = [*VIEW, "source_id", "target_id"]
    fams = F.array_sort(F.array_distinct(F.flatten(F.collect_set("method_families"))))
    e = p.groupBy(*keys).agg(
        F.sum("full_weight").alias("full_count"), F.sum("fractional_weight").alias("fractional_count"), F.count(F.lit(1)).alias("distinct_work_count"), F.count_if("is_large_consortium").alias("large_consortium_work_count"),
        F.count_if("exceeds_consortium_exclusion_threshold").alias("excluded_threshold_work_count"), F.max("institution_count").alias("maximum_consortium_size"), fams.alias("topic_families"),
    )
    e = e.join(bounded_sample(p, keys, "work_id", "work_ids_sample"), keys).withColumn("distinct_topic_family_count", F.size("topic_families"))
    for side in ("source", "target"):
        a = inst.select(F.col("institution_id").alias(f"{side}_id"), F.col("display_name").alias(f"{side}_name"), F.col("macro_region").alias(f"{side}_region"), F.col("subregion").alias(f"{side}_subregion"), F.col("country_code").alias(f"{side}_country"), F.col("normalized_category").alias(f"{side}_category"))
        e = e.join(a, f"{side}_id", "left")
    return e


def outputs(groups: DataFrame, inst: DataFrame) -> DataFrame:
    """Work counts of each institution and view; institutions without partners are kept."""
    distinct = lambda f: F.size(F.array_distinct(F.filter(F.transform("members", lambda x: x[f]), lambda x: x.isNotNull())))
    g = groups.withColumn("countries", distinct("country_code")).withColumn("regions", distinct("macro_region"))
    m = g.select(*VIEW, "work_id", "institution_count", "countries", "regions", F.explode("members.institution_id").alias("institution_id"))
    k = F.col("institution_count")
    o = m.groupBy(*VIEW, "institution_id").agg(
        F.count(F.lit(1)).alias("work_count"), F.sum(F.lit(1.0) / k).alias("fractional_work_count"), F.count_if(k >= 2).alias("collaborative_work_count"), F.count_if(k == 1).alias("single_institution_work_count"),
        F.count_if(F.col("countries") >= 2).alias("international_work_count"), F.count_if(F.col("regions") >= 2).alias("cross_region_work_count"),
    )
    o = o.withColumn("international_collaboration_share", safe_divide(F.col("international_work_count"), F.col("work_count"))).withColumn("cross_region_collaboration_share", safe_divide(F.col("cross_region_work_count"), F.col("work_count")))
    a = inst.select("institution_id", "display_name", "ror_id", "country_code", "country_name", "macro_region", "subregion", F.col("normalized_category").alias("institution_category"), "analytical_scope", "latitude", "longitude")
    return o.join(a, "institution_id", "left")


def output_reconciliation(groups: DataFrame, out: DataFrame) -> DataFrame:
    """Distinct works of the memberships against the outputs' fractional sum, by view."""
    a = groups.groupBy(*VIEW).agg(F.count_distinct("work_id").alias("distinct_work_count"), F.sum("institution_count").alias("membership_count"))
    b = out.groupBy(*VIEW).agg(F.sum("fractional_work_count").alias("fractional_sum"), F.sum("work_count").alias("work_count_sum"))
    return a.join(b, VIEW, "full").withColumn("reconciles", (F.abs(F.col("fractional_sum") - F.col("distinct_work_count")) < 1e-8 * F.greatest(F.lit(1), F.col("distinct_work_count"))) & (F.col("membership_count") == F.col("work_count_sum")))


def flows(p: DataFrame) -> DataFrame:
    """Geographic flows on three levels, undirected, with their share of the view and level."""
    level = lambda name, col: F.struct(F.lit(name).alias("geographic_level"), F.least(f"source_{col}", f"target_{col}").alias("source_geography"), F.greatest(f"source_{col}", f"target_{col}").alias("target_geography"))
    x = p.select(*VIEW, "work_id", "source_id", "target_id", "full_weight", "fractional_weight", F.explode(F.array(level("macro_region", "region"), level("subregion", "subregion"), level("country", "country"))).alias("g")).select("*", "g.*").drop("g")
    keys = [*VIEW, "geographic_level", "source_geography", "target_geography"]
    a = x.groupBy(*keys).agg(
        F.sum("full_weight").alias("full_count"), F.sum("fractional_weight").alias("fractional_count"), F.count_distinct("work_id").alias("distinct_work_count"), F.count_distinct(F.struct("source_id", "target_id")).alias("distinct_institution_pair_count"),
    )
    s = bounded_sample(x, keys, "work_id", "work_ids_sample")
    out = join_null_safe(a, s, keys, "left")
    return out.withColumn("normalized_share", F.col("fractional_count") / F.sum("fractional_count").over(Window.partitionBy(*VIEW, "geographic_level")))


def flow_reconciliation(p: DataFrame, f: DataFrame) -> DataFrame:
    """Sums of the pairs against the flows of each view and level."""
    a = p.groupBy(*VIEW).agg(F.sum("full_weight").alias("pair_full"), F.sum("fractional_weight").alias("pair_fractional"))
    b = f.groupBy(*VIEW, "geographic_level").agg(F.sum("full_count").alias("flow_full"), F.sum("fractional_count").alias("flow_fractional"), F.sum("normalized_share").alias("share_sum"))
    ok = (F.col("pair_full") == F.col("flow_full")) & (F.abs(F.col("pair_fractional") - F.col("flow_fractional")) < 1e-6) & (F.abs(F.col("share_sum") - 1) < 1e-10)
    return b.join(a, VIEW).withColumn("reconciles", ok)


def intensity(e: DataFrame, out: DataFrame, first_year: int = 2010) -> DataFrame:
    """Edges with normalized intensity, persistence over 3 and 5 years and a display score.

    Every end must have a positive work count in its view; a miss fails the query.
    """
    for side in ("source", "target"):
        d = out.select(*VIEW, F.col("institution_id").alias(f"{side}_id"), F.col("work_count").alias(f"{side}_work_count"))
        e = e.join(d, [*VIEW, f"{side}_id"], "left")
    den = F.when((F.col("source_work_count") > 0) & (F.col("target_work_count") > 0), F.sqrt(F.col("source_work_count").cast("double") * F.col("target_work_count"))).otherwise(F.raise_error(F.lit("missing positive output denominator")).cast("double"))
    w = Window.partitionBy("corpus_view", "hierarchy_view", "source_id", "target_id").orderBy("year")
    active = lambda n: F.count(F.lit(1)).over(w.rangeBetween(-(n - 1), 0)).cast("int")
    e = e.withColumns({"normalized_intensity": F.col("fractional_count") / den, "active_years_3y": active(3), "active_years_5y": active(5)})
    return e.withColumns({
        "persistence_3y": F.col("active_years_3y") / F.lit(3.0), "persistence_5y": F.col("active_years_5y") / F.lit(5.0),
        "persistence_3y_incomplete_window": F.col("year") - first_year + 1 < 3, "persistence_5y_incomplete_window": F.col("year") - first_year + 1 < 5,
        "visualization_score": F.log1p("fractional_count") * (F.lit(0.5) + F.lit(0.5) * F.col("active_years_5y") / F.lit(5.0)), "visualization_score_is_primary": F.lit(False),
    })


def endpoint_nodes(e: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys, institution_id) of both ends."""
    return e.select(*keys, F.explode(F.array("source_id", "target_id")).alias("institution_id")).distinct()


def graph_catalogue(e: DataFrame, out: DataFrame, minimum: float = 0.0) -> DataFrame:
    """One row a view: nodes, active nodes, isolates, edges, totals."""
    n = out.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("analytical_scope") == "primary").alias("primary_node_count"), F.sum("work_count").alias("summed_node_work_count"))
    g = e.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(F.col("fractional_count") >= minimum).alias("configured_filtered_edge_count"), F.sum("full_count").alias("total_full_weight"), F.sum("fractional_count").alias("total_fractional_weight"))
    a = endpoint_nodes(e, *VIEW).groupBy(*VIEW).agg(F.count(F.lit(1)).alias("active_node_count"))
    j = n.join(g, VIEW, "left").join(a, VIEW, "left").fillna(0).withColumn("total_fractional_weight", F.coalesce("total_fractional_weight", F.lit(0.0)))
    return j.withColumn("isolated_output_node_count", F.col("node_count") - F.col("active_node_count"))


def symmetric(e: DataFrame, *cols: str) -> DataFrame:
    """Each edge seen from both ends: VIEW, institution_id, partner_id, the columns, and both ends' region and country."""
    def end(a: str, b: str) -> Column:
        return F.struct(F.col(f"{a}_id").alias("institution_id"), F.col(f"{b}_id").alias("partner_id"), F.col(f"{a}_region").alias("region"), F.col(f"{b}_region").alias("partner_region"), F.col(f"{a}_country").alias("country"), F.col(f"{b}_country").alias("partner_country"))

    return e.select(*VIEW, *cols, F.explode(F.array(end("source", "target"), end("target", "source"))).alias("x")).select(*VIEW, *cols, "x.*")


def node_metrics(e: DataFrame, out: DataFrame) -> DataFrame:
    """Degree, strengths, bridge score and partner counts of every node, isolates with zeros."""
    s = symmetric(e, "full_count", "fractional_count")
    cross = F.col("region") != F.col("partner_region")
    m = s.groupBy(*VIEW, "institution_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("full_count").alias("full_strength"), F.sum("fractional_count").alias("fractional_strength"), F.sum(F.when(cross, F.col("fractional_count")).otherwise(0.0)).alias("_cross"),
        F.count_distinct("partner_country").alias("partner_country_count"), F.count_distinct("partner_region").alias("partner_region_count"),
    )
    j = out.join(m, [*VIEW, "institution_id"], "left").fillna(0, ["degree", "full_strength", "partner_country_count", "partner_region_count"]).fillna(0.0, ["fractional_strength", "_cross"])
    return j.withColumn("bridge_score", F.coalesce(safe_divide(F.col("_cross"), F.col("fractional_strength")), F.lit(0.0))).drop("_cross")


def edge_dynamics(e: DataFrame) -> DataFrame:
    """New, continuing and disappearing edges against the previous year present in the view."""
    view = ["corpus_view", "hierarchy_view"]
    years = e.select(*VIEW).distinct().withColumn("n", F.row_number().over(Window.partitionBy(*view).orderBy("year")))
    k = e.select(*VIEW, "source_id", "target_id").join(years, VIEW)
    now = k.select(*view, "n", "source_id", "target_id", F.lit(1).alias("here"))
    past = k.select(*view, (F.col("n") + 1).alias("n"), "source_id", "target_id", F.lit(1).alias("was"))
    j = now.join(past, [*view, "n", "source_id", "target_id"], "full").groupBy(*view, "n").agg(
        F.count_if(F.col("here").isNotNull() & F.col("was").isNull()).alias("new_edge_count"), F.count_if(F.col("here").isNotNull() & F.col("was").isNotNull()).alias("continuing_edge_count"), F.count_if(F.col("here").isNull()).alias("disappearing_edge_count")
    )
    return years.join(j, [*view, "n"]).drop("n")


def assortativity(e: DataFrame, attribute: str) -> DataFrame:
    """Nominal assortativity by view: (sum e_ii - sum a_i^2) / (1 - sum a_i^2), unweighted; null where undefined."""
    s = symmetric(e).select(*VIEW, F.col(attribute).alias("a"), F.col(f"partner_{attribute}").alias("b"))
    own = s.groupBy(*VIEW, "a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    v = own.groupBy(*VIEW).agg(F.sum("n").alias("m"), F.sum("same").alias("same"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    q = F.col("sq") / (F.col("m").cast("double") * F.col("m"))
    return v.select(*VIEW, F.when(F.abs(1 - q) > 1e-12, safe_divide(F.col("same") / F.col("m") - q, 1 - q)).alias(f"{attribute}_assortativity"))


def effective_partners(e: DataFrame) -> DataFrame:
    """exp of the entropy of an institution's partner weights, by view."""
    s = symmetric(e, "fractional_count")
    t = s.groupBy(*VIEW, "institution_id").agg(F.sum("fractional_count").alias("w"), F.sum(F.col("fractional_count") * F.log("fractional_count")).alias("wl"), F.count(F.lit(1)).alias("partner_count"))
    return t.select(*VIEW, "institution_id", "partner_count", F.exp(F.log("w") - F.col("wl") / F.col("w")).alias("effective_partner_count"))


def repeat_partner_ratio(e: DataFrame) -> DataFrame:
    """Share of an institution's partners of a year that it also had in an earlier year."""
    s = symmetric(e)
    first = F.min("year").over(Window.partitionBy("corpus_view", "hierarchy_view", "institution_id", "partner_id"))
    g = s.withColumn("first", first).groupBy(*VIEW, "institution_id").agg(F.count(F.lit(1)).alias("partner_count"), F.count_if(F.col("first") < F.col("year")).alias("repeat_partner_count"))
    return g.withColumn("repeat_partner_ratio", safe_divide(F.col("repeat_partner_count"), F.col("partner_count")))


def percentile_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(average rank - 1) / (n - 1) within the keys, ties averaged; 0.5 for a single row; nulls have none.

    Ranks are taken over distinct values with their counts, so ties of any number are one row.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    before, n = F.sum("_c").over(w.orderBy(value)) - F.col("_c"), F.sum("_c").over(w)
    r = c.withColumn(name, F.when(n == 1, F.lit(0.5)).otherwise((before + (F.col("_c") - 1) / 2) / (n - 1))).drop("_c")
    return df.join(r, [*keys, value], "left")


_HALVES = ["corpus_view", "hierarchy_view"]


def with_month(works: DataFrame) -> DataFrame:
    """work_id and the number of its month of publication (year * 12 + month - 1); works without a readable date are left out."""
    y, m = (F.regexp_extract("publication_date", r"^\s*(\d{4})-(\d{2})", i) for i in (1, 2))
    month = F.when(m.between("01", "12"), y.cast("int") * 12 + m.cast("int") - 1)
    return works.select("work_id", F.when(y != "", month).alias("month")).filter("month is not null")


def rolling_activity(groups: DataFrame, works: DataFrame) -> DataFrame:
    """Works of each institution in the 12, 24 and 36 months up to each of its active months, in full and as fractions.

    The change compares the last 12 months with the 12 before them; it is null where these have none.
    Months are summed first, so a window holds at most one row a month.
    """
    m = memberships(groups).join(with_month(works), "work_id")
    keys = [*_HALVES, "institution_id"]
    g = m.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("institution_count")).alias("f"))
    w = Window.partitionBy(*keys).orderBy("month")
    last = lambda c, a, b=0: F.coalesce(F.sum(c).over(w.rangeBetween(-a, -b)), F.lit(0))
    out = g.withColumns({f"work_count_{k}m": last("n", k - 1) for k in (12, 24, 36)} | {"fractional_count_12m": last("f", 11), "_n": last("n", 23, 12), "_f": last("f", 23, 12)})
    change = {"activity_change_12m": safe_divide(F.col("work_count_12m") - F.col("_n"), F.col("_n")), "fractional_activity_change_12m": safe_divide(F.col("fractional_count_12m") - F.col("_f"), F.col("_f"))}
    return out.withColumns(change).drop("n", "f", "_n", "_f")


def monthly_persistence(pairs: DataFrame, works: DataFrame, first_year: int, window: int = 12) -> DataFrame:
    """Share of the last ``window`` months in which a pair worked together, for each of its active months; too early windows are flagged."""
    keys = [*_HALVES, "source_id", "target_id"]
    m = pairs.select(*keys, "work_id").join(with_month(works), "work_id").select(*keys, "month").distinct()
    active = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("month").rangeBetween(1 - window, 0))
    return m.withColumns({"active_months": active.cast("int"), "edge_persistence": active / window, "is_incomplete_window": F.col("month") - first_year * 12 + 1 < window})


def citation_impact(groups: DataFrame, works: DataFrame) -> DataFrame:
    """Citations of each institution's works in full and as fractions, and the mean field-weighted impact of those that have one."""
    m = memberships(groups).join(works.select("work_id", "cited_by_count", "fwci"), "work_id")
    c = F.coalesce("cited_by_count", F.lit(0))
    return m.groupBy(*VIEW, "institution_id").agg(F.sum(c).alias("citation_count"), F.sum(c / F.col("institution_count")).alias("fractional_citation_count"), F.avg("fwci").alias("mean_fwci"), F.count("fwci").alias("fwci_work_count"))


def specialization(vectors: DataFrame, registry: DataFrame, out: DataFrame) -> DataFrame:
    """Share of each topic family in an institution's topic weight, and its ratio to the share in the world, the macro-region and the country.

    Topics without a family count in the total only.
    """
    fam = registry.filter("method_family is not null").select("topic_id", "method_family")
    place = out.select(*VIEW, "institution_id", "macro_region", "country_code")
    v = vectors.select(*VIEW, "institution_id", "topic_id", "topic_weight").join(F.broadcast(fam), "topic_id", "left").join(place, [*VIEW, "institution_id"])
    v = v.groupBy(*VIEW, "institution_id", "macro_region", "country_code", "method_family").agg(F.sum("topic_weight").alias("w"))
    v = v.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*VIEW, "institution_id")))
    for name, keys in (("global", []), ("macro_region", ["macro_region"]), ("country", ["country_code"])):
        base = v.groupBy(*VIEW, *keys, "method_family").agg(F.sum("w").alias("_b"))
        base = base.withColumn(f"_{name}", F.col("_b") / F.sum("_b").over(Window.partitionBy(*VIEW, *keys))).drop("_b")
        v = join_null_safe(v, base, [*VIEW, *keys, "method_family"])
    v = v.filter("method_family is not null")
    return v.select(*VIEW, "institution_id", "method_family", F.col("share").alias("topic_family_share"), *[(F.col("share") / F.col(f"_{n}")).alias(f"specialization_lift_{n}") for n in ("global", "macro_region", "country")])
