"""Raw records, registries, validators and the measures beyond the pipeline's tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions.canonical import canonical_json
from weftline.operators import corpus, hotkeys, institutions, layers, network, present, quality, records

RAW = "record string, query_id string, query_order int, page int, record_index int, retrieved_at string, title int"
V = dict(year=2020, corpus_view="broad", hierarchy_view="organization")


def raw(spark, *texts):
    return spark.createDataFrame([(t, f"q{i % 2}", i % 2, 0, i, "2024-01-01", 1) for i, t in enumerate(texts)], RAW)


def test_raw_records_become_works(spark):
    good = {"id": "https://x/W1", "publication_year": 2020, "doi": 5, "title": "T", "type": "article", "is_retracted": "no", "is_paratext": False, "cited_by_count": True, "fwci": 2, "primary_topic": {"id": "https://x/T7", "display_name": "n"},
            "topics": [{"id": "T7", "b": 1, "a": 2}], "referenced_works": ["https://x/W9", "W2", None, "no", "W9"], "authorships": None, "primary_location": None, "ids": {}, "updated_date": "2024"}
    bad = ["[1]", None, "{", json.dumps({"id": "X1", "publication_year": 2020}), json.dumps({"id": "W3", "publication_year": "2020"}), json.dumps({"id": "W3", "publication_year": 1999}), json.dumps({"id": "W3"})]
    n = records.normalize_records(raw(spark, json.dumps(good), json.dumps(good | {"title": "later"}), *bad)).cache()
    w = {r.work_id: r for r in records.first_works(n).collect()}
    assert set(w) == {"W1"}
    r = w["W1"]
    assert (r.title, r.doi, r.is_retracted, r.is_paratext, r.cited_by_count, r.fwci, r.primary_topic_id) == ("T", None, None, False, None, 2.0, "T7")
    assert (r.topics_json, r.referenced_works_json, r.authorships_json, r.primary_location_json, r.ids_json) == ('[{"a":2,"b":1,"id":"T7"}]', '["W2","W9"]', "[]", "null", "{}")
    why = [x.reason for x in records.rejected_records(n).orderBy("record_index").collect()]
    assert why == ["record_not_object"] * 3 + ["invalid_or_missing_work_id", "invalid_or_missing_publication_year", "publication_year_outside_analysis_window", "invalid_or_missing_publication_year"]
    told = hashlib.sha256(json.dumps(good, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert r.raw_record_hash == told and r.record_key == hashlib.sha256(f"q0:0:0:{told}".encode()).hexdigest()
    s = records.work_sources(n)
    assert sorted((x.work_id, x.query_id) for x in s.collect()) == [("W1", "q0"), ("W1", "q1")]
    c = records.record_reconciliation(n, records.first_works(n), s).first()
    assert (c.record_count, c.rejected_count, c.work_count, c.repeated_count, c.reconciles) == (9, 7, 1, 1, True)
    assert records.first_works(records.normalize_records(raw(spark).filter("false"))).count() == 0


def test_canonical_json(spark):
    got = [r[0] for r in spark.createDataFrame([('{"b": 1, "a": [2, "é"]}',), ("{x",), (None,)], "s string").select(canonical_json("s")).collect()]
    assert got == ['{"a":[2,"é"],"b":1}', "{x", None]


def test_registry_records(spark):
    one = {"id": "https://x/0ABCDEFG1/", "names": [{"value": "Old", "types": ["ror_display"]}, {"value": " New ", "types": ["ror_display", "label"]}, {"value": "N", "types": ["acronym"]}, {"value": "New", "types": ["alias"]}, {"value": "Other"}, {"value": None}, None],
           "locations": [None, {"geonames_details": {"lat": 1.5, "lng": -2, "country_code": "de", "name": "Town"}}, {"geonames_details": {"lat": 9}}], "types": ["education", "education"], "status": "active",
           "relationships": [{"type": "parent", "id": "https://x/0aaaaaaa1"}, {"type": "parent", "id": "bad"}, {"type": "sibling", "id": "0aaaaaaa2"}, {"type": "child", "id": "0aaaaaaa3"}, None], "admin": {"last_modified": {"date": "2024-01-01", "schema_version": "2"}}}
    plain = {"id": "0bbbbbbb2", "names": [{"value": "b", "types": []}, {"value": "A", "types": ["acronym"]}]}
    df = spark.createDataFrame([(json.dumps(x), 1) for x in (one, plain, {"id": "nope"}, [1])] + [(None, 1), ("{", 1)], "record string, ror_id int")
    r = {x.ror_id: x for x in records.registry_records(df).collect()}
    a, b = r.pop("0abcdefg1"), r.pop("0bbbbbbb2")
    assert not r and (a.display_name, a.alternative_names, a.acronyms, a.types) == ("New", ["Other"], ["N"], ["education"])
    assert (a.country_code, a.latitude, a.longitude, a.city_name, a.parent_ids, a.child_ids, a.related_ids, a.last_modified_date) == ("DE", 1.5, -2.0, "Town", ["0aaaaaaa1"], ["0aaaaaaa3"], [], "2024-01-01")
    assert (b.display_name, b.alternative_names, b.acronyms, b.latitude, b.parent_ids) == ("A", ["b"], ["A"], None, [])


def test_frozen_registry_needs_every_decision(spark):
    c = spark.createDataFrame([("T1", "a"), ("T2", "b")], "topic_id string, display_name string")
    d = spark.createDataFrame([("T1", "strict", "m"), ("T2", "broad_only", None)], "topic_id string, corpus_membership string, method_family string")
    s = spark.createDataFrame([("T1", "W2"), ("T1", "W1"), ("T1", "W1")], "topic_id string, work_id string")
    f = {r.topic_id: r for r in corpus.freeze_registry(c, d, s).collect()}
    assert f["T1"].sample_work_ids == ["W1", "W2"] and f["T1"].in_strict and f["T2"].in_broad and not f["T2"].in_strict and f["T2"].sample_work_ids == []
    for bad in (d.filter("topic_id = 'T1'"), d.unionByName(d), d.unionByName(d.limit(1).withColumn("topic_id", F.lit("T9")))):
        with pytest.raises(ValueError, match="cover"):
            corpus.freeze_registry(c, bad, s)


def test_boundary_quality_withholds(spark):
    reg = spark.createDataFrame([("T1", "strict"), ("T2", "broad_only"), ("T3", "excluded")], "topic_id string, corpus_membership string")
    labels = [("relevant", "strict")] * 6 + [("irrelevant", "broad_only")] * 2 + [("relevant", "excluded")] * 2 + [("unsure", "strict"), (None, "strict")]
    known = [(f"W{i}", "strict" if i % 2 else "broad") for i in range(6)]
    topics = [(f"W{i}", "T2" if i == 1 else "T1") for i in range(6)] + [("W0", "T3")]
    L, K, T = (spark.createDataFrame(x, y) for x, y in ((labels, "label string, corpus_membership string"), (known, "work_id string, expected_corpus string"), (topics, "work_id string, topic_id string")))
    r = corpus.boundary_quality(L, K, T, reg).first()
    assert (r.precision_status, r.precision, r.recall_status, round(r.recall, 6)) == ("measured", 0.75, "measured", round(5 / 6, 6))
    r = corpus.boundary_quality(L.limit(9), K, T.filter("work_id <> 'W3'"), reg).first()
    assert (r.precision_status, r.precision, r.recall_status, r.recall) == ("not_estimated", None, "not_estimated", None)


def test_edge_checks_find_what_is_wrong(spark):
    g = spark.createDataFrame([(2020, c, h, "W1", [("I1", "DE", "Europe", "W"), ("I2", "FR", "Europe", "W"), ("I3", "US", "Americas", "N")], ["f"], 3) for c in ("strict", "broad") for h in ("organization", "umbrella")],
                              "year int, corpus_view string, hierarchy_view string, work_id string, members array<struct<institution_id:string,country_code:string,macro_region:string,subregion:string>>, method_families array<string>, institution_count int")
    p = network.pairs(g)
    e = p.groupBy("year", "corpus_view", "hierarchy_view", "source_id", "target_id").agg(F.sum("full_weight").alias("full_count"), F.sum("fractional_weight").alias("fractional_count"))
    c = {r.check_name: r for r in quality.edge_checks(p, e).collect()}
    assert len(c) == 11 and all(r.passed for r in c.values())
    spoilt = p.filter("corpus_view = 'broad'").withColumn("source_id", F.when(F.col("target_id") == "I2", "I9").otherwise(F.col("source_id"))).withColumn("fractional_weight", F.lit(0.5)).withColumn("is_large_consortium", F.lit(True))
    bad = {r.check_name for r in quality.edge_checks(spoilt, e).filter("not passed").collect()}
    assert bad == {"stable_source_target_order", "strict_and_broad_present", "fractional_weights_sum_to_one_per_work", "warning_threshold_flags_match", "annual_full_counts_reconcile", "annual_fractional_counts_reconcile"}
    assert quality.edge_checks(p.filter("false"), e.filter("false")).count() == 11


def test_rolling_measures(spark):
    inst = "array<struct<institution_id:string,country_code:string,macro_region:string,subregion:string>>"
    dates = ["2019-01-05", "2019-12-31", "2020-01-01", "2021-02", None, "2021-13-01"]
    g = spark.createDataFrame([(2020, "broad", "organization", f"W{i}", [("I1", "DE", "E", "W"), ("I2", "FR", "E", "W")], [], 2) for i in range(6)], f"year int, corpus_view string, hierarchy_view string, work_id string, members {inst}, method_families array<string>, institution_count int")
    w = spark.createDataFrame([(f"W{i}", d, i, 0.5 if i == 1 else None) for i, d in enumerate(dates)], "work_id string, publication_date string, cited_by_count int, fwci double")
    r = {x.month: x for x in network.rolling_activity(g, w).filter("institution_id = 'I1'").collect()}
    at = lambda y, m: r[y * 12 + m - 1]
    assert len(r) == 4 and at(2019, 12).work_count_12m == 2 and at(2020, 1).work_count_12m == 2 and at(2020, 1).activity_change_12m == 1.0 and at(2019, 1).activity_change_12m is None
    assert at(2021, 2).work_count_12m == 1 and at(2021, 2).work_count_24m == 3 and at(2021, 2).work_count_36m == 4 and at(2021, 2).fractional_count_12m == 0.5 and at(2021, 2).activity_change_12m == -0.5
    p = {x.month: (x.active_months, x.is_incomplete_window) for x in network.monthly_persistence(network.pairs(g), w, 2019).collect()}
    assert p == {2019 * 12: (1, True), 2019 * 12 + 11: (2, False), 2020 * 12: (2, False), 2021 * 12 + 1: (1, False)}
    c = network.citation_impact(g, w).filter("institution_id = 'I2'").first()
    assert (c.citation_count, c.fractional_citation_count, c.mean_fwci, c.fwci_work_count) == (15, 7.5, 0.5, 1)


def test_region_comparison_is_directional(spark):
    f = spark.createDataFrame([(2020, "broad", "organization", "macro_region", "Asia", "Europe", 3.0), (2020, "broad", "organization", "macro_region", "Asia", "Asia", 1.0), (2020, "broad", "organization", "macro_region", "Africa", "Africa", 1.0)], "year int, corpus_view string, hierarchy_view string, geographic_level string, source_geography string, target_geography string, fractional_count double")
    assert sorted((r.comparison, r.partner_share) for r in present.region_comparison(f, ("Europe", "Asia")).collect()) == [("Asia → Europe", 0.6), ("Europe → Asia", 1.0)]
    assert [(r.comparison, r.partner_share) for r in present.region_comparison(f).collect()] == [("Asia", 0.4)]


def test_percentiles_of_values_that_lie_close(spark):
    rows = [("a", 1.0 + i * 1e-9, 1 + i % 3) for i in range(900)] + [("b", float(x), 2) for x in (5, 5, 5)] + [("c", x, 1) for x in (float("-inf"), -1e308, 0.0, 1e308, float("inf"))] + [("d", None, 1), (None, 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = {r.k: r.v_p50 for r in hotkeys.weighted_percentile(df, ["k"], "v", 0.5, most=20).collect()}
    flat = sorted(v for k, v, n in rows if k == "a" for _ in range(n))
    assert got == {"a": flat[-(-len(flat) // 2) - 1], "b": 5.0, "c": 0.0, None: 2.0}


def test_dense_neighbours_in_blocks_are_exact(spark):
    import numpy as np

    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 8)).round(2)
    x[7] = x[11] = x[40]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [0.0] * 8), (1001, None), (1020, [1.0])]
    got = {}
    for r in layers.dense_neighbors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 5, block_rows=70, query_rows=4).collect():
        got.setdefault(r.vec_id, {})[r.neighbor_rank] = (r.neighbor_id, round(r.cosine_similarity, 6))
    u = x / np.sqrt((x**2).sum(1))[:, None]
    for q in range(0, 300, 20):
        s = (u @ u[q]).round(6)
        want = sorted(((-s[j], j) for j in range(300) if j != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(j, round(-m, 6)) for m, j in want]


def test_institutions_of_unknown_type_stay(spark):
    p = {r.institution_type: (r.institution_count, r.analytical_scope) for r in institutions.institution_type_profile(spark.createDataFrame([("education",), ("education",), (None,), ("guild",)], "institution_type string")).collect()}
    assert p == {"education": (2, "primary"), None: (1, "unknown"), "guild": (1, "unknown")}
