"""Directed citation flow, topic similarity, and the comparison of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import jaccard, overlap_coefficient, safe_divide
from weftline.operators.network import VIEW, endpoint_nodes, memberships

PAIR = ["source_id", "target_id"]
_CH = ["corpus_view", "hierarchy_view"]


def _resolved(groups: DataFrame, refs: DataFrame) -> DataFrame:
    """References whose both works are in the view, with years and institution counts of both."""
    w = groups.select(*VIEW, "work_id", "institution_count")
    a = refs.join(w.select(*_CH, "work_id", "year", F.col("institution_count").alias("a")), "work_id")
    b = w.select(*_CH, F.col("work_id").alias("referenced_work_id"), F.col("year").alias("cited_year"), F.col("institution_count").alias("b"))
    return a.join(b, [*_CH, "referenced_work_id"])


def citation_flows(groups: DataFrame, refs: DataFrame) -> DataFrame:
    """Directed flows from citing to cited institutions, 1 / (a b) of a reference to each pair; self flows kept.

    The citing side is summed by (institution, cited work) before it meets the cited work's
    institutions, so a work that is cited very often is expanded from its citing institutions and
    not from its single references.
    """
    m = memberships(groups).select(*_CH, "work_id", "institution_id")
    r = _resolved(groups, refs).withColumn("lag", F.col("year") - F.col("cited_year"))
    citing = r.join(m, [*_CH, "work_id"]).groupBy("year", *_CH, F.col("institution_id").alias("source_id"), "referenced_work_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.lit(1.0) / F.col("a")).alias("w"), F.max("b").alias("b"), F.max("lag").alias("lag")
    )
    cited = m.select(*_CH, F.col("work_id").alias("referenced_work_id"), F.col("institution_id").alias("target_id"))
    x = citing.join(cited, [*_CH, "referenced_work_id"])
    f = x.groupBy("year", *_CH, *PAIR).agg(
        F.sum("n").alias("full_count"), F.sum(F.col("w") / F.col("b")).alias("fractional_count"), F.sum(F.when(F.col("lag") < 0, F.col("n")).otherwise(0)).alias("negative_lag_full_count"),
        F.min("lag").alias("minimum_citation_lag_years"), F.max("lag").alias("maximum_citation_lag_years"),
    )
    return f.withColumn("is_institution_self_flow", F.col("source_id") == F.col("target_id"))


def citation_coverage(groups: DataFrame, corpus: DataFrame, refs: DataFrame) -> DataFrame:
    """What becomes of the references of the works with an institution in scope, by view and citing year.

    Works without references count as citing works; the share is null where there are none.
    """
    flags = F.explode(F.array(F.struct(F.lit("strict").alias("corpus_view"), F.col("strict_primary").alias("inside")), F.struct(F.lit("broad").alias("corpus_view"), F.col("broad_primary").alias("inside"))))
    c = corpus.select("work_id", "publication_year", flags.alias("v")).filter("v.inside").select("work_id", "publication_year", "v.corpus_view")
    w = groups.select(*VIEW, "work_id", F.col("institution_count").alias("a"))
    j = w.join(refs, "work_id", "left").join(c.select("corpus_view", F.col("work_id").alias("referenced_work_id"), F.col("publication_year").alias("cited_year")), ["corpus_view", "referenced_work_id"], "left")
    j = j.join(w.select(*_CH, F.col("work_id").alias("referenced_work_id"), F.col("a").alias("b")), [*_CH, "referenced_work_id"], "left")
    ref, inside, res = F.col("referenced_work_id").isNotNull(), F.col("cited_year").isNotNull(), F.col("b").isNotNull()
    g = j.groupBy(*VIEW).agg(
        F.count_distinct("work_id").alias("citing_work_count"), F.count_if(ref).alias("reference_count"), F.count_if(inside).alias("corpus_internal_reference_count"), F.count_if(res).alias("institution_resolved_reference_count"),
        F.count_if(ref & ~inside).alias("external_reference_count"), F.count_if(inside & ~res).alias("unscoped_reference_count"), F.count_if(res & (F.col("year") < F.col("cited_year"))).alias("negative_lag_reference_count"),
        F.count_if(F.col("work_id") == F.col("referenced_work_id")).alias("self_work_reference_count"), F.coalesce(F.sum(F.when(res, F.col("a").cast("long") * F.col("b"))), F.lit(0)).alias("institution_pair_contribution_count"),
    )
    return g.withColumn("institution_resolved_share", safe_divide(F.col("institution_resolved_reference_count"), F.col("reference_count")))


def citation_reconciliation(flows: DataFrame, coverage: DataFrame) -> DataFrame:
    f = flows.groupBy(*VIEW).agg(F.sum("full_count").alias("flow_full"), F.sum("fractional_count").alias("flow_fractional"))
    j = coverage.join(f, VIEW, "left").fillna(0, ["flow_full"]).fillna(0.0, ["flow_fractional"])
    a, b = F.col("flow_fractional"), F.col("institution_resolved_reference_count")
    return j.select(*VIEW, "institution_pair_contribution_count", "flow_full", "institution_resolved_reference_count", "flow_fractional", ((F.col("flow_full") == F.col("institution_pair_contribution_count")) & (F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), b))).alias("reconciles"))


def eligible_topics(topics: DataFrame) -> DataFrame:
    """Topic scores by corpus view: strict topics in both, broad-only topics in the broad one."""
    t = topics.filter("topic_score > 0")
    s = t.filter("corpus_membership = 'strict'").withColumn("corpus_view", F.explode(F.array(F.lit("strict"), F.lit("broad"))))
    return s.unionByName(t.filter("corpus_membership = 'broad_only'").withColumn("corpus_view", F.lit("broad")))


def topic_vectors(groups: DataFrame, topics: DataFrame, core: int = 500) -> DataFrame:
    """Sparse topic vectors of institutions: sums of score / k, L2-normalized; the core are the first by works."""
    m = memberships(groups)
    n = m.groupBy(*VIEW, "institution_id").agg(F.count(F.lit(1)).alias("institution_work_count"))
    n = n.withColumn("core_rank", F.row_number().over(Window.partitionBy(*VIEW).orderBy(F.desc("institution_work_count"), "institution_id")))
    c = m.join(eligible_topics(topics).select("corpus_view", "work_id", "topic_id", "topic_score"), ["corpus_view", "work_id"])
    c = c.groupBy(*VIEW, "institution_id", "topic_id").agg(F.sum(F.col("topic_score") / F.col("institution_count")).alias("topic_weight"), F.count_distinct("work_id").alias("contributing_work_count"))
    c = c.join(n, [*VIEW, "institution_id"]).withColumn("l2_norm", F.sqrt(F.sum(F.col("topic_weight") * F.col("topic_weight")).over(Window.partitionBy(*VIEW, "institution_id"))))
    return c.filter("l2_norm > 0").withColumns({"is_similarity_core": F.col("core_rank") <= core, "normalized_topic_weight": F.col("topic_weight") / F.col("l2_norm")})


def cosine_pairs(vectors: DataFrame, minimum: float = 0.0, digits: int | None = None) -> DataFrame:
    """Exact cosine of all core pairs of a view that share a topic, above ``minimum``.

    Bounded by the core: at most core (core - 1) / 2 pairs a view.
    """
    v = vectors.filter("is_similarity_core").select(*VIEW, "institution_id", "topic_id", F.col("normalized_topic_weight").alias("w"))
    a, b = v.withColumnsRenamed({"institution_id": "source_id", "w": "wa"}), v.withColumnsRenamed({"institution_id": "target_id", "w": "wb"})
    p = a.join(b, [*VIEW, "topic_id"]).filter("source_id < target_id").groupBy(*VIEW, *PAIR).agg(F.count(F.lit(1)).cast("int").alias("shared_topic_count"), F.sum(F.col("wa") * F.col("wb")).alias("raw"))
    p = p.filter(F.col("raw") > minimum).withColumn("cosine_similarity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw")))).drop("raw")
    return p if digits is None else p.withColumn("cosine_similarity", F.round("cosine_similarity", digits))


def union_top_k(p: DataFrame, keys: list[str], score: str, k: int) -> DataFrame:
    """Pairs that are among the k best of either end (ties by the other end's id), with both ranks."""
    both = p.select(*keys, *PAIR, score, F.explode(F.array(F.struct(F.col("source_id").alias("me"), F.col("target_id").alias("you"), F.lit(True).alias("s")), F.struct(F.col("target_id").alias("me"), F.col("source_id").alias("you"), F.lit(False).alias("s")))).alias("x")).select(*keys, *PAIR, score, "x.*")
    r = both.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "me").orderBy(F.desc(score), "you")))
    g = r.groupBy(*keys, *PAIR).agg(F.max(F.when(F.col("s"), F.col("r"))).alias("source_neighbor_rank"), F.max(F.when(~F.col("s"), F.col("r"))).alias("target_neighbor_rank"))
    return p.join(g.filter(F.least("source_neighbor_rank", "target_neighbor_rank") <= k), [*keys, *PAIR])


def topic_similarity(vectors: DataFrame, k: int = 20, minimum: float = 0.0, digits: int | None = None) -> DataFrame:
    p = cosine_pairs(vectors, minimum, digits)
    p = p.withColumn("threshold_eligible_pair_count", F.count(F.lit(1)).over(Window.partitionBy(*VIEW)))
    return union_top_k(p, VIEW, "cosine_similarity", k)


def similarity_coverage(groups: DataFrame, topics: DataFrame, vectors: DataFrame, edges: DataFrame, core: int = 500) -> DataFrame:
    """Institutions in scope, with a vector, in the core; candidate pairs, edges; score sums against weights."""
    m = memberships(groups)
    scope = m.groupBy(*VIEW).agg(F.count_distinct("institution_id").alias("in_scope_institution_count"))
    score = m.select(*VIEW, "work_id").distinct().join(eligible_topics(topics).select("corpus_view", "work_id", "topic_score"), ["corpus_view", "work_id"]).groupBy(*VIEW).agg(F.sum("topic_score").alias("expected_score"))
    v = vectors.groupBy(*VIEW).agg(F.count_distinct("institution_id").alias("eligible_institution_count"), F.count_distinct(F.when(F.col("is_similarity_core"), F.col("institution_id"))).alias("core_institution_count"), F.sum("topic_weight").alias("vector_weight"))
    e = edges.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("selected_edge_count"), F.max("threshold_eligible_pair_count").alias("threshold_eligible_pair_count"))
    counts = ["eligible_institution_count", "core_institution_count", "selected_edge_count", "threshold_eligible_pair_count"]
    j = scope.join(score, VIEW, "left").join(v, VIEW, "left").join(e, VIEW, "left").fillna(0, counts).fillna(0.0, ["expected_score", "vector_weight"])
    n = F.col("core_institution_count")
    return j.withColumns({
        "zero_vector_institution_count": F.col("in_scope_institution_count") - F.col("eligible_institution_count"), "excluded_by_core_count": F.col("eligible_institution_count") - n,
        "eligible_share": safe_divide(F.col("eligible_institution_count"), F.col("in_scope_institution_count")), "candidate_pair_count": (n * (n - 1) / 2).cast("long"), "score_reconciles": F.abs(F.col("expected_score") - F.col("vector_weight")) < 1e-9 * F.greatest(F.lit(1.0), F.col("expected_score")),
    })


def dense_neighbors(embeddings: DataFrame, k: int = 10, block_rows: int = 20_000, query_rows: int = 5_000, queries_mod: int = 20) -> DataFrame:
    """Exact cosine neighbours of every vector whose id is divisible by ``queries_mod``, against all vectors.

    Vectors and queries are both cut into blocks by hash, of about ``block_rows`` and ``query_rows``;
    each pair of blocks is a task of its own, one matrix product that keeps k candidates a query, and
    the best k of all remain. So no task holds more than two blocks, however large the tables are; the
    work is queries x vectors, as an exact answer needs. Ties go to the smaller id. Null, empty and
    zero vectors and vectors of another length than the query are left out.
    """
    import numpy as np
    import pandas as pd

    v = embeddings.select("vec_id", "embedding").filter("vec_id is not null and size(embedding) > 0")
    n = v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % queries_mod == 0).alias("q")).first()
    blocks, parts = max(1, -(-n.n // block_rows)), max(1, -(-n.q // query_rows))
    cut = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = v.filter(F.col("vec_id") % queries_mod == 0).select("vec_id", "embedding", F.lit(True).alias("is_query"), cut(parts).alias("p"), every(blocks).alias("b"))
    base = v.select("vec_id", "embedding", F.lit(False).alias("is_query"), cut(blocks).alias("b"), every(parts).alias("p"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(pdf["embedding"].map(len)):
            x = np.stack(own["embedding"].to_numpy()).astype(float)
            norm = np.sqrt((x**2).sum(1))
            ok, isq, ids = norm > 0, own["is_query"].to_numpy(), own["vec_id"].to_numpy()
            x = x / np.where(ok, norm, 1)[:, None]
            qi, bi = np.flatnonzero(isq & ok), np.flatnonzero(~isq & ok)
            most = min(k + 1, len(bi))
            for lo in range(0, len(qi) if most else 0, 256):
                part = qi[lo : lo + 256]
                s = np.round(x[part] @ x[bi].T, 6)
                least = np.partition(s, len(bi) - most, axis=1)[:, len(bi) - most]
                for row, low, i in zip(s, least, part):
                    near = np.flatnonzero(row >= low)
                    near = near[np.lexsort((ids[bi[near]], -row[near]))]
                    out += [(ids[i], ids[bi[j]], float(row[j])) for j in near[ids[bi[near]] != ids[i]][:k]]
        return pd.DataFrame(out, columns=["vec_id", "neighbor_id", "cosine_similarity"])

    near = q.unionByName(base).groupBy("p", "b").applyInPandas(run, "vec_id long, neighbor_id long, cosine_similarity double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine_similarity"), "neighbor_id"))
    return near.withColumn("neighbor_rank", rank).filter(F.col("neighbor_rank") <= k)


def layer_union(collaboration: DataFrame, citation: DataFrame, similarity: DataFrame) -> DataFrame:
    """The three layers in one long table with their weights and kinds."""
    def one(df: DataFrame, layer: str, weight: str, kind: str) -> DataFrame:
        return df.select(*VIEW, F.lit(layer).alias("layer"), *PAIR, F.col(weight).cast("double").alias("layer_weight"), F.lit(kind).alias("directionality"))

    return one(collaboration, "coauthorship", "fractional_count", "undirected").unionByName(one(citation, "citation_flow", "fractional_count", "directed")).unionByName(one(similarity, "topic_proximity", "cosine_similarity", "undirected"))


def layer_summary(layers: DataFrame) -> DataFrame:
    """Nodes, edges, self edges, dyads, possible edges, density and weight of each view and layer.

    Possible edges: n * n in a directed layer (self edges allowed), else n (n - 1) / 2. Edges with a
    null end count as edges, not as nodes or dyads.
    """
    keys = [*VIEW, "layer"]
    n = endpoint_nodes(layers, *keys).filter("institution_id is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("node_count"))
    e = layers.groupBy(*keys).agg(F.max("directionality").alias("directionality"), F.count(F.lit(1)).alias("edge_count"), F.count_if(F.col("source_id") == F.col("target_id")).alias("self_edge_count"), F.sum("layer_weight").alias("total_weight"))
    d = dyads(layers).groupBy(*keys).agg(F.count(F.lit(1)).alias("dyad_count"))
    j = e.join(n, keys, "left").join(d, keys, "left").fillna(0, ["node_count", "dyad_count"])
    k = F.col("node_count")
    j = j.withColumn("possible_edge_count", F.when(F.col("directionality") == "directed", k * k).otherwise((k * (k - 1) / 2).cast("long")))
    return j.withColumn("density", safe_divide(F.col("edge_count"), F.col("possible_edge_count")))


def dyads(layers: DataFrame) -> DataFrame:
    """Distinct unordered pairs of different institutions of each view and layer."""
    d = layers.filter("source_id <> target_id").select(*VIEW, "layer", F.least(*PAIR).alias("a"), F.greatest(*PAIR).alias("b"))
    return d.distinct()


def layer_overlap(layers: DataFrame) -> DataFrame:
    """Shared and united dyads and nodes of every two layers of a view that both have a dyad.

    Nodes are the ends of all edges, self edges among them; a null end is none. Each dyad becomes
    one row with the set of its layers, so layers are compared without a join of their edges.
    """
    def shared(items: DataFrame, keys: list[str], name: str) -> DataFrame:
        s = items.groupBy(*VIEW, *keys).agg(F.array_sort(F.collect_set("layer")).alias("ls"))
        s = s.groupBy(*VIEW, "ls").agg(F.count(F.lit(1)).alias("n"))
        p = s.select(*VIEW, "ls", "n", F.posexplode("ls").alias("i", "layer_a")).select(*VIEW, "n", "layer_a", F.explode(F.slice("ls", F.col("i") + 2, F.size("ls"))).alias("layer_b"))
        return p.groupBy(*VIEW, "layer_a", "layer_b").agg(F.sum("n").alias(name))

    d = dyads(layers)
    size = d.groupBy(*VIEW, "layer").agg(F.count(F.lit(1)).alias("n"))
    nodes = endpoint_nodes(layers, *VIEW, "layer").filter("institution_id is not null").withColumnRenamed("institution_id", "x")
    nsize = nodes.groupBy(*VIEW, "layer").agg(F.count(F.lit(1)).alias("m"))
    z = size.join(nsize, [*VIEW, "layer"])
    ab = z.withColumnsRenamed({"layer": "layer_a", "n": "na", "m": "ma"}).join(z.withColumnsRenamed({"layer": "layer_b", "n": "nb", "m": "mb"}), VIEW).filter("layer_a < layer_b")
    j = ab.join(shared(d, ["a", "b"], "shared_dyad_count"), [*VIEW, "layer_a", "layer_b"], "left").join(shared(nodes, ["x"], "shared_node_count"), [*VIEW, "layer_a", "layer_b"], "left").fillna(0, ["shared_dyad_count", "shared_node_count"])
    s, na, nb = F.col("shared_dyad_count"), F.col("na"), F.col("nb")
    return j.select(
        *VIEW, "layer_a", "layer_b", F.col("na").alias("dyad_count_a"), F.col("nb").alias("dyad_count_b"), "shared_dyad_count", (na + nb - s).alias("union_dyad_count"),
        jaccard(s, na, nb).alias("dyad_jaccard"), overlap_coefficient(s, na, nb).alias("overlap_coefficient"), "shared_node_count", jaccard(F.col("shared_node_count"), F.col("ma"), F.col("mb")).alias("node_jaccard"),
    )
