"""Network operators on small hand-written tables with known results."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus, graphs, institutions, layers, network, present, quality

V = dict(year=2020, corpus_view="broad", hierarchy_view="organization")
WI = ("work_id string, publication_year int, hierarchy_view string, institution_id string, country_code string, macro_region string, subregion string, method_families array<string>, strict_primary boolean, broad_primary boolean, "
      "is_primary_network_scope boolean, is_target_macro_region boolean, analytical_scope string, raw_affiliation_strings array<string>")
PLACE = {"I1": ("DE", "Europe", "Western Europe"), "I2": ("US", "Americas", "Northern America"), "I3": ("FR", "Europe", "Western Europe"), "I4": ("CN", "Asia", "Eastern Asia"), "I5": ("JP", "Asia", "Eastern Asia")}


def wi(spark, members, strict=True):
    rows = [(w, y, h, i, *PLACE[i], ["gis"], strict, True, True, True, "primary", [f"Dept {i}"]) for w, y, h, ids in members for i in ids]
    return spark.createDataFrame(rows, WI)


def inst(spark):
    rows = [(i, f"Name {i}", f"r{i}", c, c, m, s, "university", "primary", 1.0 if i != "I5" else None, 2.0) for i, (c, m, s) in PLACE.items()]
    return spark.createDataFrame(rows, "institution_id string, display_name string, ror_id string, country_code string, country_name string, macro_region string, subregion string, normalized_category string, analytical_scope string, latitude double, longitude double")


def broad(df):
    return df.filter("corpus_view = 'broad' and hierarchy_view = 'organization'")


def test_pairs_of_a_triangle_with_a_repeat(spark):
    g = network.work_groups(wi(spark, [("W1", 2020, "organization", ["I1", "I2", "I3", "I1"])]))
    p = broad(network.pairs(g)).collect()
    assert {(r.source_id, r.target_id) for r in p} == {("I1", "I2"), ("I1", "I3"), ("I2", "I3")} and all(abs(r.fractional_weight - 1 / 3) < 1e-12 for r in p)


def test_consortium_flags_and_umbrella_singleton(spark):
    g = network.work_groups(wi(spark, [("W2", 2020, "organization", ["I1", "I2"]), ("W5", 2020, "organization", list(PLACE)), ("W2", 2020, "umbrella", ["I2"])]))
    d = {r.work_id: r for r in network.pair_diagnostics(broad(network.pairs(g, 5, 5))).collect()}
    assert (d["W2"].pair_count, d["W5"].pair_count, d["W5"].expected_pair_count) == (1, 10, 10) and abs(d["W5"].fractional_sum - 1) < 1e-10
    assert network.pairs(g).filter("hierarchy_view = 'umbrella'").count() == 0
    assert all(r.is_large_consortium for r in network.pairs(g, 5, 5).filter("work_id = 'W5'").collect())


def test_outputs_keep_isolates(spark):
    g = network.work_groups(wi(spark, [("W1", 2020, "organization", ["I1", "I2"]), ("W2", 2020, "organization", ["I1"]), ("W3", 2020, "organization", ["I3"])]))
    o = {r.institution_id: (r.work_count, r.fractional_work_count, r.collaborative_work_count, r.single_institution_work_count, r.international_collaboration_share) for r in broad(network.outputs(g, inst(spark))).collect()}
    assert o == {"I1": (2, 1.5, 1, 1, 0.5), "I2": (1, 0.5, 1, 0, 1.0), "I3": (1, 1.0, 0, 1, 0.0)}
    assert all(r.reconciles for r in network.output_reconciliation(g, network.outputs(g, inst(spark))).collect())


def test_flows_and_shares(spark):
    g = network.work_groups(wi(spark, [("W1", 2020, "organization", ["I1", "I2"]), ("W2", 2020, "organization", ["I4", "I2"]), ("W3", 2020, "organization", ["I5", "I2"])]))
    p = network.pairs(g)
    f = network.flows(p)
    m = {(r.source_geography, r.target_geography): (r.full_count, round(r.normalized_share, 6)) for r in broad(f).filter("geographic_level = 'macro_region'").collect()}
    assert m == {("Americas", "Asia"): (2, 0.666667), ("Americas", "Europe"): (1, 0.333333)}
    assert all(r.reconciles for r in network.flow_reconciliation(p, f).collect())


def _edges(spark, rows):
    rows = [(y, "broad", "organization", a, b, 1, w, PLACE[a][1], PLACE[b][1], PLACE[a][0], PLACE[b][0], 1, ["gis"], ["W1"]) for y, a, b, w in rows]
    return spark.createDataFrame(rows, "year int, corpus_view string, hierarchy_view string, source_id string, target_id string, full_count long, fractional_count double, source_region string, target_region string, source_country string, target_country string, distinct_work_count long, topic_families array<string>, work_ids_sample array<string>")


def _outs(spark, rows):
    rows = [(y, "broad", "organization", i, n, f"Name {i}", PLACE[i][0], PLACE[i][1], "university", "primary", float(n), 1.0, 2.0) for y, i, n in rows]
    return spark.createDataFrame(rows, "year int, corpus_view string, hierarchy_view string, institution_id string, work_count long, display_name string, country_code string, macro_region string, institution_category string, analytical_scope string, fractional_work_count double, latitude double, longitude double")


def test_intensity_and_persistence(spark):
    e = _edges(spark, [(2010, "I1", "I2", 1.0), (2012, "I1", "I2", 1.0), (2013, "I1", "I2", 1.0)])
    o = _outs(spark, [(y, i, n) for y in (2010, 2012, 2013) for i, n in (("I1", 4), ("I2", 9))])
    r = {x.year: x for x in network.intensity(e, o).collect()}
    assert abs(r[2010].normalized_intensity - 1 / 6) < 1e-12
    assert [round(r[y].persistence_3y * 3) for y in (2010, 2012, 2013)] == [1, 2, 2] and [round(r[y].persistence_5y * 5) for y in (2010, 2012, 2013)] == [1, 2, 3]
    assert r[2010].persistence_3y_incomplete_window and not r[2012].persistence_3y_incomplete_window
    with pytest.raises(Exception, match="missing positive output denominator"):
        network.intensity(e, o.filter("institution_id = 'I1'")).collect()


def test_metrics_on_a_path_with_an_isolate(spark):
    e = _edges(spark, [(2019, "I1", "I2", 1.0), (2020, "I1", "I2", 1.0), (2020, "I2", "I3", 0.5)])
    o = _outs(spark, [(2019, "I1", 1), (2019, "I2", 1)] + [(2020, f"I{i}", i) for i in range(1, 5)])
    n = {r.institution_id: r for r in network.node_metrics(e, o).filter("year = 2020").collect()}
    assert [n[f"I{i}"].degree for i in range(1, 5)] == [1, 2, 1, 0] and n["I4"].bridge_score == 0.0 and n["I1"].bridge_score == 1.0
    d = {r.year: (r.new_edge_count, r.continuing_edge_count, r.disappearing_edge_count) for r in network.edge_dynamics(e).collect()}
    assert d == {2019: (1, 0, 0), 2020: (1, 1, 0)}
    g = graphs.graph_rows(e, o)
    a = {r.institution_id: r.pagerank for r in graphs.pagerank(g).filter("year = 2020").collect()}
    b = {r.institution_id: r.pagerank for r in graphs.pagerank_distributed(e, o, rounds=40).filter("year = 2020").collect()}
    assert abs(sum(a.values()) - 1) < 1e-10 and all(abs(a[k] - b[k]) < 2 * 0.85**40 for k in a)
    c = {(r.year, r.institution_id): r.component_id for r in graphs.components(g).collect()}
    assert c == {(r.year, r.institution_id): r.component_id for r in graphs.components_distributed(e, o).collect()} and len({v for k, v in c.items() if k[0] == 2020}) == 2
    t = {r.institution_id: r.betweenness for r in graphs.betweenness(g, block=2).filter("year = 2020").collect()}
    assert t == {"I1": 0.0, "I2": pytest.approx(1 / 3), "I3": 0.0, "I4": 0.0}
    cat = network.graph_catalogue(e, o).filter("year = 2020").first()
    assert (cat.node_count, cat.active_node_count, cat.isolated_output_node_count, cat.edge_count) == (4, 3, 1, 2)


def test_betweenness_against_brute_force():
    import itertools
    import random

    import numpy as np

    rnd = random.Random(9)
    n = 9
    edges = [(a, b, rnd.choice([0.5, 1.0, 2.0])) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.35]
    near = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, 1 / w))
        near[b].append((a, 1 / w))
    total = np.zeros(n)
    for s in range(n):
        graphs._brandes(s, near, float("inf"), total)
    dist = [[0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        dist[a][b] = dist[b][a] = 1 / w
    for k, i, j in itertools.product(range(n), repeat=3):
        dist[i][j] = min(dist[i][j], dist[i][k] + dist[k][j])

    def count(s, t, via=None):
        if s == t:
            return 1
        return sum(count(v, t) for v, length in near[s] if abs(length + dist[v][t] - dist[s][t]) < 1e-9)

    want = [0.0] * n
    for s, t in itertools.combinations(range(n), 2):
        if dist[s][t] < math.inf:
            for v in range(n):
                if v not in (s, t) and abs(dist[s][v] + dist[v][t] - dist[s][t]) < 1e-9:
                    want[v] += count(s, v) * count(v, t) / count(s, t)
    assert total / 2 == pytest.approx(want)


def test_communities_of_two_triangles(spark):
    rows = [("A", "B"), ("B", "C"), ("A", "C"), ("D", "E"), ("E", "F"), ("D", "F")]
    e = spark.createDataFrame([(2020, "broad", "organization", a, b, 1.0) for a, b in rows], "year int, corpus_view string, hierarchy_view string, source_id string, target_id string, fractional_count double")
    n = spark.createDataFrame([(2020, "broad", "organization", x) for x in "ABCDEFZ"], "year int, corpus_view string, hierarchy_view string, institution_id string")
    c = graphs.communities(graphs.graph_rows(e, n))
    one = {r.institution_id: (r.community_id, r.status) for r in c.filter("resolution = 1.0").collect()}
    assert {one[x][0] for x in "ABC"} == {"C0001"} and {one[x][0] for x in "DEF"} == {"C0002"} and one["Z"] == (None, "isolated")
    s = {r.resolution: r for r in graphs.community_summary(c).collect()}
    assert set(s) == set(graphs.RESOLUTIONS) and s[1.0].community_count == 2 and s[1.0].modularity == pytest.approx(0.5) and s[1.0].active_node_count == 6


def test_continuity(spark):
    rows = [(2010, f"n{i}", "A") for i in range(1, 5)] + [(2011, x, "B") for x in ("n1", "n5", "n6", "n7")] + [(2012, x, "C") for x in ("n1", "n5", "n6", "n7")] + [(2014, "n1", "D")]
    c = spark.createDataFrame([(y, "broad", "organization", i, k) for y, i, k in rows], "year int, corpus_view string, hierarchy_view string, institution_id string, community_id string")
    k = {r.community_id: r for r in graphs.continuity(c).collect()}
    assert k["A"].event == "birth" and k["B"].continuity_id == k["A"].continuity_id == "CT-BO-00001" and k["B"].is_uncertain and k["C"].event == "continuation" and not k["C"].is_uncertain
    assert k["D"].continuity_id == "CT-BO-00002"  # a gap year: a birth
    assert [r.community_id for r in graphs.disappearances(c).collect()] == ["C"]


def test_layout_is_fixed_and_bounded(spark):
    e = _edges(spark, [(2020, "I1", "I2", 1.0), (2020, "I2", "I3", 1.0)])
    n = spark.createDataFrame([(2020, "broad", "organization", f"I{i}", float(s)) for i, s in ((1, 1), (2, 2), (3, 1), (4, 0))], "year int, corpus_view string, hierarchy_view string, institution_id string, fractional_strength double")
    a, b = (sorted(map(tuple, graphs.layout(e, n, core=3, rounds=50).collect())) for _ in range(2))
    assert a == b and all(max(abs(r[3]), abs(r[4])) <= 1 + 1e-9 for r in a if r[2])
    assert 1.10 <= math.hypot(a[3][3], a[3][4]) <= 1.45


def test_citations_with_two_corpora(spark):
    wide = wi(spark, [("C1", 2020, "organization", ["I1", "I2"]), ("D1", 2019, "organization", ["I1", "I4"]), ("D2", 2022, "organization", ["I5"])]).unionByName(wi(spark, [("C2", 2021, "organization", ["I3"])], strict=False))
    g = network.work_groups(wide)
    refs = spark.createDataFrame([("C1", "D1"), ("C1", "D2"), ("C1", "D3"), ("C1", "X1"), ("C2", "D1")], "work_id string, referenced_work_id string")
    f = layers.citation_flows(g, refs)
    t = {r.corpus_view: (r.full, round(r.frac, 9), r.own, r.neg) for r in f.groupBy("corpus_view").agg(F.sum("full_count").alias("full"), F.sum("fractional_count").alias("frac"), F.sum(F.col("is_institution_self_flow").cast("int")).alias("own"), F.sum("negative_lag_full_count").alias("neg")).collect()}
    assert t == {"broad": (8, 3.0, 1, 2), "strict": (6, 2.0, 1, 2)}
    flags = spark.createDataFrame([("C1", 2020, True, True), ("C2", 2021, False, True), ("D1", 2019, True, True), ("D2", 2022, True, True), ("D3", 2018, True, True)], "work_id string, publication_year int, strict_primary boolean, broad_primary boolean")
    cov = layers.citation_coverage(g, flags, refs)
    c = {(r.corpus_view, r.year): (r.reference_count, r.corpus_internal_reference_count, r.institution_resolved_reference_count, r.external_reference_count, r.unscoped_reference_count, r.negative_lag_reference_count) for r in cov.collect()}
    assert c[("strict", 2020)] == (4, 3, 2, 1, 1, 1) and c[("broad", 2021)] == (1, 1, 1, 0, 0, 0)
    assert all(r.reconciles for r in layers.citation_reconciliation(f, cov).collect())


def test_similarity_top_k(spark):
    v = [("A", "t1", 1.0), ("B", "t1", 0.8), ("B", "t2", 0.6), ("C", "t2", 1.0), ("D", "t3", 1.0)]
    vec = spark.createDataFrame([(2020, "broad", "organization", i, t, w, True) for i, t, w in v], "year int, corpus_view string, hierarchy_view string, institution_id string, topic_id string, normalized_topic_weight double, is_similarity_core boolean")
    got = {(r.source_id, r.target_id): (round(r.cosine_similarity, 6), r.source_neighbor_rank, r.target_neighbor_rank) for r in layers.topic_similarity(vec, k=1).collect()}
    assert got == {("A", "B"): (0.8, 1, 1), ("B", "C"): (0.6, 2, 1)}


def test_dense_neighbours_equal_brute_force(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = e.toPandas()
    x = np.stack(pdf["embedding"].to_numpy()).astype(float)
    x /= np.sqrt((x**2).sum(1))[:, None]
    got = {}
    for r in layers.dense_neighbors(e, k=5, block_rows=20, query_rows=3).collect():
        got.setdefault(r.vec_id, []).append((r.neighbor_rank, r.neighbor_id))
    ids = pdf["vec_id"].to_numpy()
    for q in ids[ids % 20 == 0]:
        s = np.round(x @ x[ids == q][0], 6)
        order = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert [n for _, n in sorted(got[q])] == order


def test_multiplex(spark):
    rows = [("coauthorship", "A", "B", "undirected"), ("coauthorship", "B", "C", "undirected"), ("citation_flow", "A", "B", "directed"), ("citation_flow", "C", "A", "directed"), ("citation_flow", "A", "A", "directed"), ("topic_proximity", "A", "B", "undirected"), ("topic_proximity", "A", "C", "undirected"), ("topic_proximity", "A", None, "undirected")]
    m = spark.createDataFrame([(2020, "broad", "organization", layer, a, b, 1.0, d) for layer, a, b, d in rows], "year int, corpus_view string, hierarchy_view string, layer string, source_id string, target_id string, layer_weight double, directionality string")
    s = {r.layer: (r.node_count, r.edge_count, r.self_edge_count, r.dyad_count, r.possible_edge_count) for r in layers.layer_summary(m).collect()}
    assert s == {"coauthorship": (3, 2, 0, 2, 3), "citation_flow": (3, 3, 1, 2, 9), "topic_proximity": (3, 3, 0, 2, 3)}
    o = {(r.layer_a, r.layer_b): (round(r.dyad_jaccard, 6), r.node_jaccard) for r in layers.layer_overlap(m).collect()}
    assert o == {("citation_flow", "coauthorship"): (0.333333, 1.0), ("citation_flow", "topic_proximity"): (1.0, 1.0), ("coauthorship", "topic_proximity"): (0.333333, 1.0)}


def test_versions_and_flags(spark):
    title = "A sufficiently long shared title"
    rows = [("W1", "x", "https://doi.org/10.1/ABC", 2020, "preprint", 50), ("W2", "y", "10.1/abc", 2020, "article", 10), ("W3", title, None, 2020, "preprint", 0), ("W4", title.upper() + "!", "10.1/q", 2022, "article", 0)]
    w = spark.createDataFrame([(*r, "T1", False, False, "2024-01-01") for r in rows], "work_id string, title string, doi string, publication_year int, work_type string, cited_by_count long, primary_topic_id string, is_retracted boolean, is_paratext boolean, source_updated_date string")
    v = corpus.version_families(w)
    got = {r.work_id: r for r in v.collect()}
    assert got["W2"].is_recommended_primary_representative and not got["W1"].is_recommended_primary_representative and got["W1"].primary_representative_work_id == "W2"
    assert got["W3"].ambiguous_possible_family and got["W4"].ambiguous_possible_family and got["W4"].is_recommended_primary_representative
    t = spark.createDataFrame([("W1", "strict", "gis"), ("W2", "strict", "gis"), ("W3", "broad_only", "rs"), ("W4", "excluded", "none")], "work_id string, corpus_membership string, method_family string")
    c = {r.work_id: r for r in corpus.corpus_flags(w, t, v).collect()}
    assert c["W2"].strict_primary and not c["W1"].strict_primary and c["W3"].broad_preprint_sensitivity and not c["W3"].broad_primary
    assert c["W4"].strict_exclusion_reasons == ["no_strict_topic"] and c["W1"].strict_exclusion_reasons == ["work_type_not_primary", "non_representative_exact_doi_duplicate"]
    nulls = corpus.corpus_flags(w.withColumn("is_retracted", F.lit(None).cast("boolean")), t, v).filter("work_id = 'W2'").first()
    assert nulls.strict_primary is None and nulls.strict_exclusion_reasons == []


def test_geography_registry_and_master(spark):
    i = spark.createDataFrame([("I1", " de", "A", None, None, "https://x/0abcdefg1"), ("I2", None, "B", 1.0, 2.0, None), ("I3", "QQ", "C", None, 1.0, "0zzzzzzz9")], "institution_id string, country_code string, display_name string, latitude double, longitude double, ror_id string")
    g = {r.institution_id: (r.country_code, r.macro_region, r.geography_issue) for r in institutions.with_geography(i).collect()}
    assert g == {"I1": ("DE", "Europe", None), "I2": ("ZZ", "Unknown", "missing_source_country"), "I3": ("ZZ", "Unknown", "unmapped_source_country")}
    m = {r.institution_id: r.geography_issue for r in institutions.with_geography(i, manual=spark.createDataFrame([("I1", "FR")], "institution_id string, country_code string")).collect()}
    assert m["I1"] == "manual_country_differs_from_source"
    reg = spark.createDataFrame([("0abcdefg1", "a", "FR", 5.0, 6.0, True)], "ror_id string, name string, country_code string, latitude double, longitude double, valid boolean")
    r = {x.institution_id: (x.registry_status, x.latitude, x.coordinate_source) for x in institutions.enriched(i, reg).collect()}
    assert r == {"I1": ("enriched", 5.0, "registry"), "I2": ("missing_ror_id", 1.0, "source"), "I3": ("not_retrieved", None, None)}
    ext = spark.createDataFrame([("I1", None, n, "DE", None, []) for n in ("b", "a", "a", "b")] + [("I2", None, None, None, None, None)], "institution_id string, ror_id string, display_name string, country_code string, institution_type string, lineage array<string>")
    mst = {x.institution_id: (x.display_name, x.issues) for x in institutions.master(ext).collect()}
    assert mst["I1"] == ("a", ["conflicting_display_name", "missing_institution_type", "missing_ror_id"]) and len(mst["I2"][1]) == 4


def test_geography_knows_every_analytical_code(spark):
    codes = ["TW", "HU", "RO", "PE", "BD", "PH", "KZ", "TH", "XK", "AQ", "NA", "NG", "GH", "US"]
    i = spark.createDataFrame([(c, c) for c in codes], "institution_id string, country_code string")
    g = {r.institution_id: r for r in institutions.with_geography(i).collect()}
    assert all(g[c].country_code == c and g[c].geography_issue is None for c in codes)
    assert {c: g[c].macro_region for c in codes[:10]} == {"TW": "Asia", "HU": "Europe", "RO": "Europe", "PE": "Americas", "BD": "Asia", "PH": "Asia", "KZ": "Asia", "TH": "Asia", "XK": "Europe", "AQ": "Unknown"}
    assert g["PH"].subregion == g["TH"].subregion == "Southeastern Asia" and g["NG"].subregion == g["GH"].subregion == "Sub-Saharan Africa"
    rows = institutions.region_rows()
    assert len(rows) == len({r[0] for r in rows}) == 251


def test_type_policies_are_the_fixed_ones(spark):
    rows = {t: (a, b, c) for t, a, b, c in corpus.WORK_TYPES}
    assert len(rows) == 25 and rows["book-chapter"] == rows["dataset"] == (False, False, True) and rows["data-paper"] == rows["review"] == (True, True, True)
    assert rows["preprint"] == (False, True, True) and rows["letter"] == (False, False, False) and "article " not in rows
    i = spark.createDataFrame([("I1", "Education", "old"), ("I2", "funder", "old"), ("I3", None, "old"), ("I4", "guild", "old"), ("I5", "healthcare", "old")], "institution_id string, institution_type string, normalized_category string")
    t = {r.institution_id: (r.normalized_category, r.analytical_scope, r.is_primary_research_scope) for r in institutions.typed(i).collect()}
    assert t == {"I1": ("education", "primary", True), "I2": ("funder", "excluded", False), "I3": ("unknown", "unknown", False), "I4": ("unknown", "unknown", False), "I5": ("healthcare", "secondary", False)}


def test_layer_overlap_counts_nodes_of_self_links(spark):
    e = [(2020, "broad", "organization", "coauthorship", "A", "B"), (2020, "broad", "organization", "citation_flow", "B", "A"), (2020, "broad", "organization", "citation_flow", "C", "C"), (2020, "broad", "organization", "coauthorship", "B", None)]
    r = layers.layer_overlap(spark.createDataFrame(e, "year int, corpus_view string, hierarchy_view string, layer string, source_id string, target_id string")).first()
    assert (r.shared_dyad_count, r.shared_node_count, round(r.node_jaccard, 6)) == (1, 2, round(2 / 3, 6))


def test_distributed_pagerank_converges(spark):
    path = [(2020, "broad", "organization", f"I{k:02d}", f"I{k + 1:02d}", 1.0 + k % 3) for k in range(12)]
    e = spark.createDataFrame(path, "year int, corpus_view string, hierarchy_view string, source_id string, target_id string, fractional_count double")
    o = spark.createDataFrame([(2020, "broad", "organization", f"I{k:02d}") for k in range(14)], "year int, corpus_view string, hierarchy_view string, institution_id string")
    a = {r.institution_id: r.pagerank for r in graphs.pagerank(graphs.graph_rows(e, o)).collect()}
    b = {r.institution_id: r.pagerank for r in graphs.pagerank_distributed(e, o).collect()}
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-11 for k in a)


def test_distributed_pagerank_takes_few_jobs_and_any_blocks(spark):
    schema = "year int, corpus_view string, hierarchy_view string, source_id string, target_id string, fractional_count double"
    path = [(2020, "broad", "organization", f"I{k:02d}", f"I{k + 1:02d}", 1.0 + k % 3) for k in range(30)]
    star = [(2021, "broad", "organization", "I00", f"I{k:02d}", 0.01 * k) for k in range(1, 9)]
    e = spark.createDataFrame(path + star, schema)
    nodes = [(y, "broad", "organization", f"I{k:02d}") for y, n in ((2020, 33), (2021, 5), (2022, 2)) for k in range(n)]  # I05 to I08 of 2021 are only in edges, 2022 has none
    o = spark.createDataFrame(nodes, "year int, corpus_view string, hierarchy_view string, institution_id string")
    read = lambda df: {(r.year, r.institution_id): r.pagerank for r in df.collect()}
    want = read(graphs.pagerank(graphs.graph_rows(e, o)))
    spark.sparkContext.setJobGroup("pagerank", "pagerank")
    try:
        got = read(graphs.pagerank_distributed(e, o))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pagerank"))
    assert jobs < 100, f"{jobs} jobs"
    for some in (got, read(graphs.pagerank_distributed(e, o, block=4))):
        assert set(some) == set(want) and all(abs(some[k] - want[k]) < 1e-12 for k in want)
    assert read(graphs.pagerank_distributed(e.limit(0), o.filter("year = 2022"))) == {(2022, "I00"): 0.5, (2022, "I01"): 0.5}


def test_rule_chains_of_any_length_and_cycles(spark):
    n = 150
    rules = [(f"I{k}", f"I{k + 1}", f"r{k}") for k in range(n)] + [(f"I{n}", None, None), ("I900", "I901", "c0"), ("I901", "I902", "c1"), ("I902", "I901", "c2"), ("I950", "I999", "u")]
    i = spark.createDataFrame(rules, "institution_id string, canonical_institution_id string, canonicalization_rule_id string")
    u = {r.institution_id: r for r in institutions.hierarchy_views(i).filter("hierarchy_view = 'umbrella'").collect()}
    assert len(u) == len(rules) and {u[f"I{k}"].canonical_institution_id for k in range(n + 1)} == {f"I{n}"}
    assert u["I0"].canonicalization_rule_ids == sorted(f"r{k}" for k in range(n)) and not u[f"I{n}"].is_collapsed and u[f"I{n}"].canonicalization_rule_ids == []
    assert all(u[c].canonical_institution_id == c and not u[c].is_collapsed for c in ("I900", "I901", "I902"))
    assert {tuple(r) for r in institutions.rule_problems(i).collect()} == {("I900", "I901", "cycle"), ("I901", "I902", "cycle"), ("I902", "I901", "cycle"), ("I950", "I999", "unknown_target")}


def test_views_of_flows(spark):
    f = spark.createDataFrame([(2020, "broad", "organization", "macro_region", "Asia", "Asia", 4.0), (2020, "broad", "organization", "macro_region", "Asia", "Europe", 2.0), (2020, "broad", "organization", "macro_region", "Europe", "Europe", 1.0)], "year int, corpus_view string, hierarchy_view string, geographic_level string, source_geography string, target_geography string, fractional_count double")
    s = {(r.geography, r.partner): r.partner_share for r in present.partner_shares(f).collect()}
    assert s == {("Asia", "Asia"): 0.8, ("Asia", "Europe"): 0.2, ("Europe", "Asia"): 0.5, ("Europe", "Europe"): 0.5}
    c = spark.createDataFrame([(2020, "broad", "organization", "country", "CN", "CN", 3), (2020, "broad", "organization", "country", "CN", "FR", 2)], "year int, corpus_view string, hierarchy_view string, geographic_level string, source_geography string, target_geography string, full_count long")
    p = {r.geography: (r.local_share, r.total_weight) for r in present.local_profile(c).collect()}
    assert p == {"CN": (0.75, 8.0), "FR": (0.0, 2.0)}
    with pytest.raises(Exception, match="negative weight"):
        present.partner_shares(f.withColumn("fractional_count", F.lit(-1.0))).collect()


def test_contracts_and_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    m = quality.table_metrics(df, quality.TableContract("t", ("k",), ("v",))).first()
    assert (m.row_count, m.distinct_keys, m.key_is_unique, m.null_k, m.null_v) == (3, 2, False, 1, 0)
    again = quality.table_metrics(df.orderBy(F.desc("v")), quality.TableContract("t", ("k",), ("v",))).first()
    assert again.content_hash == m.content_hash
    with pytest.raises(ValueError):
        quality.table_metrics(df, quality.TableContract("t", ("nope",)))
    assert {r.column_name: r.null_count for r in quality.null_profile(df, "t").collect()} == {"k": 1, "v": 0}
    r = {x.work_count: round(x.p, 6) for x in network.percentile_rank(spark.createDataFrame([(1, 5), (1, 5), (1, 9), (1, None)], "g int, work_count int"), ["g"], "work_count", "p").filter("work_count is not null").collect()}
    assert r == {5: 0.25, 9: 1.0}


def test_large_views_go_by_joins_with_the_same_result(spark):
    e = [(y, "broad", "organization", f"I{k:02d}", f"I{k + 1 + k % 2:02d}", 1.0 + k % 3) for y, n in ((2020, 9), (2021, 3)) for k in range(n)]
    e = spark.createDataFrame(e, "year int, corpus_view string, hierarchy_view string, source_id string, target_id string, fractional_count double")
    o = spark.createDataFrame([(y, "broad", "organization", f"I{k:02d}") for y in (2020, 2021) for k in range(13)], "year int, corpus_view string, hierarchy_view string, institution_id string")
    for small, large, value in ((graphs.components, graphs.components_distributed, "component_id"), (graphs.pagerank, graphs.pagerank_distributed, "pagerank")):
        read = lambda df: {(r.year, r.institution_id): r[value] if isinstance(r[value], str) else round(r[value], 10) for r in df.collect()}  # noqa: B023, E731
        assert read(graphs.by_size(e, o, small, large, most=5)) == read(small(graphs.graph_rows(e, o)))


def test_master_takes_looked_up_records_first(spark):
    ext = spark.createDataFrame([("I1", None, "b", "DE", None, ["I9"]), ("I2", "r", "x", None, "education", [])], "institution_id string, ror_id string, display_name string, country_code string, institution_type string, lineage array<string>")
    look = [("I1", "R", "Name", " ", "funder", ["b", "Other", "Name"], ["https://x/I8"], 1.0, 2.0, ["https://x/I3", "I1", None, "bad"], None, [], ["I5"])] * 2
    cols = "institution_id string, ror_id string, display_name string, country_code string, institution_type string, alternative_names array<string>, lineage array<string>, latitude double, longitude double, parent_ids array<string>, child_ids array<string>, predecessor_ids array<string>, successor_ids array<string>"
    m = {r.institution_id: r for r in institutions.master(ext, spark.createDataFrame(look, cols)).collect()}
    a, b = m["I1"], m["I2"]
    assert (a.display_name, a.country_code, a.institution_type, a.alternative_names, a.lineage) == ("Name", "DE", "funder", ["Other", "b"], ["I8", "I9"])
    assert (a.parent_ids, a.child_ids, a.successor_ids, a.coordinate_source, a.issues, a.has_lookup) == (["I3"], [], ["I5"], "source", [], True)
    assert (b.display_name, b.has_lookup, b.latitude, b.issues) == ("x", False, None, ["missing_country_code"])
    assert institutions.master(ext, spark.createDataFrame([], cols)).filter("has_lookup").count() == 0


def test_state_of_a_json_column(spark):
    rows = [(None, "none"), ("[1", "invalid"), ("[]", "list"), ("{}", "list"), ('"[1]"', "list"), ('"x"', "invalid"), ("7", "other"), ("null", "other"), ('"5"', "other"), ("", "invalid"), ("{}x", "invalid"), ("[NaN]", "invalid")]
    df = spark.createDataFrame(rows, "j string, want string").withColumn("got", institutions._json_state("j"))
    assert df.filter("got <> want").collect() == []


def test_rewritten_input_is_read_again(spark, tmp_path):
    from weftline.plans import bundle

    (tmp_path / "works.parquet").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "works.parquet"))
    a = bundle.Bundle.of(spark, str(tmp_path))
    assert bundle.Bundle.of(spark, str(tmp_path)) is a
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "works.parquet"))
    assert bundle.Bundle.of(spark, str(tmp_path)) is not a
