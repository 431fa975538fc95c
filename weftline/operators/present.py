"""Presentation tables: trends, matrices, maps, network views, dimensions, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import safe_divide, sorted_set
from weftline.operators.institutions import TARGET_REGIONS
from weftline.operators.network import VIEW, endpoint_nodes


def trends(flows: DataFrame) -> DataFrame:
    """Macro-region flows as annual series with pair label and intra-region flag."""
    s, t = F.col("source_geography"), F.col("target_geography")
    return flows.filter("geographic_level = 'macro_region'").select(*VIEW, s.alias("source_region"), t.alias("target_region"), F.concat(s, F.lit(" — "), t).alias("region_pair"), (s == t).alias("is_intra_region"), "full_count", "fractional_count", "normalized_share", "distinct_work_count", "distinct_institution_pair_count")


def matrix(flows: DataFrame) -> DataFrame:
    """Flows with stable positions of both geographies on their level; absent cells stay absent."""
    g = flows.select("geographic_level", F.explode(F.array("source_geography", "target_geography")).alias("g")).distinct().withColumn("o", F.dense_rank().over(Window.partitionBy("geographic_level").orderBy("g")))
    out = flows
    for side in ("source", "target"):
        out = out.join(g.select("geographic_level", F.col("g").alias(f"{side}_geography"), F.col("o").alias(f"{side}_order")), ["geographic_level", f"{side}_geography"])
    return out.withColumn("cell_status", F.lit("observed_nonzero"))


def located(nodes: DataFrame) -> DataFrame:
    return nodes.filter("latitude is not null and longitude is not null")


def map_edges(edges: DataFrame, nodes: DataFrame, limit: int = 500) -> DataFrame:
    """The edges of each view with coordinates at both ends, first ``limit`` by score."""
    out = edges
    for side in ("source", "target"):
        out = out.join(located(nodes).select(*VIEW, F.col("institution_id").alias(f"{side}_id"), F.col("latitude").alias(f"{side}_latitude"), F.col("longitude").alias(f"{side}_longitude")), [*VIEW, f"{side}_id"])
    rank = F.row_number().over(Window.partitionBy(*VIEW).orderBy(F.desc(F.round("visualization_score", 9)), "source_id", "target_id"))
    pair = F.concat(F.least("source_region", "target_region"), F.lit(" — "), F.greatest("source_region", "target_region"))
    return out.withColumn("default_edge_rank", rank).filter(F.col("default_edge_rank") <= limit).withColumn("macro_region_pair", pair)


def map_nodes(nodes: DataFrame, kept_edges: DataFrame, limit: int = 1000) -> DataFrame:
    """The first ``limit`` located nodes of each view by works, and the ends of the kept edges."""
    rank = F.row_number().over(Window.partitionBy(*VIEW).orderBy(F.desc("work_count"), "institution_id"))
    ends = endpoint_nodes(kept_edges, *VIEW).withColumn("on_edge", F.lit(True))
    return located(nodes).withColumn("default_node_rank", rank).join(ends, [*VIEW, "institution_id"], "left").filter((F.col("default_node_rank") <= limit) | F.col("on_edge")).drop("on_edge")


def map_coverage(nodes: DataFrame, edges: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """How many nodes and edges of each view have coordinates and are shown."""
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    n = nodes.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("total_node_count"), F.count_if(has).alias("coordinate_node_count"))
    flag = nodes.select(*VIEW, "institution_id", has.alias("has"))
    e = edges.select(*VIEW, "source_id", "target_id")
    for side in ("source", "target"):
        e = e.join(flag.select(*VIEW, F.col("institution_id").alias(f"{side}_id"), F.col("has").alias(f"{side}_has")), [*VIEW, f"{side}_id"], "left")
    e = e.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("total_edge_count"), F.count_if(F.col("source_has") & F.col("target_has")).alias("coordinate_edge_count"))
    k = kept_edges.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("selected_edge_count"))
    j = n.join(e, VIEW).join(k, VIEW, "left").fillna(0, ["selected_edge_count"])
    return j.withColumns({
        "missing_coordinate_node_count": F.col("total_node_count") - F.col("coordinate_node_count"), "missing_coordinate_edge_count": F.col("total_edge_count") - F.col("coordinate_edge_count"),
        "node_coordinate_coverage_share": safe_divide(F.col("coordinate_node_count"), F.col("total_node_count")),
    })


def view_nodes(nodes: DataFrame, layout: DataFrame, communities: DataFrame) -> DataFrame:
    """Core nodes of each view with fixed coordinates and community."""
    core = layout.filter("is_core").select("institution_id", "x", "y")
    c = communities.filter("resolution = 1.0").select(*VIEW, "institution_id", "community_id", "community_size")
    return nodes.join(F.broadcast(core), "institution_id").join(c, [*VIEW, "institution_id"], "left")


def view_edges(edges: DataFrame, layout: DataFrame, limit: int = 1000) -> DataFrame:
    """Edges among core institutions, first ``limit`` of each view by weight, with both ends' coordinates."""
    out = edges
    for side in ("source", "target"):
        out = out.join(F.broadcast(layout.filter("is_core").select(F.col("institution_id").alias(f"{side}_id"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))), f"{side}_id")
    rank = F.row_number().over(Window.partitionBy(*VIEW).orderBy(F.desc(F.round("fractional_count", 9)), "source_id", "target_id"))
    return out.withColumn("default_edge_rank", rank).filter(F.col("default_edge_rank") <= limit)


def accessibility(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row and a sentence for each view that say what its picture shows."""
    best = F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.struct(F.round("fractional_strength", 9), F.col("institution_id"))))
    n = nodes.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("node_count"), best.alias("top_institution"), F.max("fractional_strength").alias("top_fractional_strength"), F.count_if(F.col("degree") == 0).alias("isolated_node_count"))
    e = edges.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(F.col("source_region") != F.col("target_region")).alias("cross_region_edge_count"), F.min("fractional_count").alias("visible_minimum_fractional_weight"))
    j = n.join(e, VIEW, "left").fillna(0, ["edge_count", "cross_region_edge_count"])
    text = F.format_string("%d, %s / %s: %d institutions (%d isolated), %d edges (%d across regions); strongest: %s", "year", "corpus_view", "hierarchy_view", "node_count", "isolated_node_count", "edge_count", "cross_region_edge_count", F.coalesce("top_institution", F.lit("none")))
    return j.withColumn("summary_text", text)


def family_totals(edges: DataFrame) -> DataFrame:
    """Edge sums by topic family over the families of each edge."""
    return edges.select(*VIEW, F.explode("topic_families").alias("topic_family"), "full_count", "fractional_count", "distinct_work_count").groupBy(*VIEW, "topic_family").agg(
        F.count(F.lit(1)).alias("visible_edge_count"), F.sum("full_count").alias("full_count"), F.sum("fractional_count").alias("fractional_count"), F.sum("distinct_work_count").alias("edge_work_count_sum"))


def top_families(edges: DataFrame, n: int = 12) -> DataFrame:
    """Annual totals of the n families with most weight (a top-k report)."""
    t = family_totals(edges.filter("corpus_view = 'broad' and hierarchy_view = 'organization'"))
    top = t.groupBy("topic_family").agg(F.round(F.sum("fractional_count"), 9).alias("w")).orderBy(F.desc("w"), "topic_family").limit(n)
    return t.join(F.broadcast(top.select("topic_family")), "topic_family", "left_semi")


def identities(inst: DataFrame, views: DataFrame) -> DataFrame:
    """Organization and umbrella name of each institution."""
    u = views.filter("hierarchy_view = 'umbrella'").select("institution_id", F.col("canonical_institution_id").alias("umbrella_id"), "is_collapsed")
    names = inst.select(F.col("institution_id").alias("umbrella_id"), F.col("display_name").alias("umbrella_name"))
    return inst.select("institution_id", F.col("display_name").alias("organization_name")).join(u, "institution_id").join(names, "umbrella_id", "left")


def filter_dimensions(nodes: DataFrame) -> DataFrame:
    """Distinct values of the filter columns of each view, in long form."""
    cols = ["country_name", "subregion", "institution_category"]
    long = nodes.select(*VIEW, F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in cols])).alias("x")).select(*VIEW, "x.*")
    return long.filter("value is not null").distinct()


def geography_dimensions(nodes: DataFrame) -> DataFrame:
    return nodes.select("country_code", "country_name", "macro_region", "subregion").distinct()


def filtered_edges(nodes: DataFrame, edges: DataFrame, condition: Column, *, region_pair: tuple[str, str] | None = None, topic_family: str | None = None, exclude_large: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges with at least one end among the nodes of ``condition``, and the partners outside of it.

    Edges may be narrowed to a pair of regions (in any order), to a topic family, and to those
    without a large consortium, before their ends are looked at.
    """
    inside = nodes.filter(condition).select(*VIEW, "institution_id").distinct()
    e = edges
    if region_pair is not None:
        a, b = sorted(region_pair)
        e = e.filter((F.least("source_region", "target_region") == a) & (F.greatest("source_region", "target_region") == b))
    if topic_family is not None:
        e = e.filter(F.array_contains("topic_families", topic_family))
    if exclude_large:
        e = e.filter("large_consortium_work_count = 0")
    for side in ("source", "target"):
        e = e.join(inside.select(*VIEW, F.col("institution_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_inside")), [*VIEW, f"{side}_id"], "left")
    e = e.filter(F.col("source_inside") | F.col("target_inside")).withColumns({f"{s}_inside": F.coalesce(f"{s}_inside", F.lit(False)) for s in ("source", "target")})
    outside = e.select(*VIEW, F.explode(F.array(F.when(~F.col("source_inside"), F.col("source_id")), F.when(~F.col("target_inside"), F.col("target_id")))).alias("institution_id")).filter("institution_id is not null").distinct()
    return e, outside


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each view among ``nodes`` whose weight is at least the view's median (interpolated)."""
    e = edges
    for side in ("source", "target"):
        e = e.join(nodes.select(*VIEW, F.col("institution_id").alias(f"{side}_id")).distinct(), [*VIEW, f"{side}_id"], "left_semi")
    med = e.groupBy(*VIEW).agg(F.percentile("fractional_count", 0.5).alias("median_weight"))
    return e.join(med, VIEW).filter(F.round("fractional_count", 9) >= F.round("median_weight", 9))


def partner_shares(flows: DataFrame, weight: str = "fractional_count", level: str = "macro_region") -> DataFrame:
    """Row-normalized partner shares: each flow seen from both ends, an internal flow with both its ends.

    A negative weight fails the query.
    """
    w = F.when(F.col(weight) < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(F.col(weight).cast("double"))
    f = flows.filter(F.col("geographic_level") == level).select(*VIEW, F.col("source_geography").alias("a"), F.col("target_geography").alias("b"), w.alias("w"))
    x = f.select(*VIEW, "w", F.explode(F.array(F.struct(F.col("a").alias("geography"), F.col("b").alias("partner")), F.struct(F.col("b").alias("geography"), F.col("a").alias("partner")))).alias("x")).select(*VIEW, "w", "x.*")
    g = x.groupBy(*VIEW, "geography", "partner").agg(F.sum("w").alias("endpoint_weight"))
    return g.withColumn("partner_share", safe_divide(F.col("endpoint_weight"), F.sum("endpoint_weight").over(Window.partitionBy(*VIEW, "geography"))))


def local_profile(flows: DataFrame, weight: str = "full_count", level: str = "country") -> DataFrame:
    """Local, external and total endpoint weights of each geography; without local links the share is 0."""
    p = partner_shares(flows, weight, level)
    own = F.col("geography") == F.col("partner")
    g = p.groupBy(*VIEW, "geography").agg(F.sum(F.when(own, F.col("endpoint_weight")).otherwise(0.0)).alias("local_weight"), F.sum(F.when(own, 0.0).otherwise(F.col("endpoint_weight"))).alias("external_weight"))
    total = F.col("local_weight") + F.col("external_weight")
    return g.withColumns({"total_weight": total, "local_share": F.coalesce(safe_divide(F.col("local_weight"), total), F.lit(0.0))})


def pair_timeline(edges: DataFrame, first: int, last: int) -> DataFrame:
    """Every pair of a view over all years of the window: counts 0 and ratios null where it had no edge."""
    view = ["corpus_view", "hierarchy_view", "source_id", "target_id"]
    cal = edges.select(*view).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    j = cal.join(edges.select(*view, "year", "full_count", "fractional_count", "normalized_intensity", "persistence_3y"), [*view, "year"], "left")
    return j.withColumns({"is_observed": F.col("full_count").isNotNull(), "full_count": F.coalesce("full_count", F.lit(0)), "fractional_count": F.coalesce("fractional_count", F.lit(0.0))})


def top_partners(edges: DataFrame, n: int = 15) -> DataFrame:
    """The n strongest partners of each institution over all years of broad / organization (a top-k report)."""
    e = edges.filter("corpus_view = 'broad' and hierarchy_view = 'organization'")
    x = e.select("fractional_count", F.explode(F.array(F.struct(F.col("source_id").alias("institution_id"), F.col("target_id").alias("partner_id")), F.struct(F.col("target_id").alias("institution_id"), F.col("source_id").alias("partner_id")))).alias("x")).select("fractional_count", "x.*")
    g = x.groupBy("institution_id", "partner_id").agg(F.round(F.sum("fractional_count"), 6).alias("fractional_count"))
    rank = F.row_number().over(Window.partitionBy("institution_id").orderBy(F.desc("fractional_count"), "partner_id"))
    return g.withColumn("partner_rank", rank).filter(F.col("partner_rank") <= n)


def labels(nodes: DataFrame) -> DataFrame:
    """Name of each institution in its latest year, and the sorted years it appears in."""
    from weftline.operators.quality import latest

    return nodes.groupBy("institution_id").agg(latest("display_name"), sorted_set("year").alias("years"))


def region_comparison(flows: DataFrame, pair: tuple[str, str] | None = None, weight: str = "fractional_count") -> DataFrame:
    """Partner shares to compare: of a pair of regions in both directions, or without one the inner share of each target region."""
    s = partner_shares(flows, weight)
    if pair is None:
        return s.filter((F.col("geography") == F.col("partner")) & F.col("geography").isin(*TARGET_REGIONS)).withColumn("comparison", F.col("geography"))
    a, b = pair
    both = ((F.col("geography") == a) & (F.col("partner") == b)) | ((F.col("geography") == b) & (F.col("partner") == a))
    return s.filter(both).withColumn("comparison", F.concat_ws(" → ", "geography", "partner"))
