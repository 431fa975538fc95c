"""The general operators for training data: brute force on random input, and the defined odd cases."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import instant_micros, short_id
from weftline.operators import hierarchy, hotkeys, nested, orphans
from weftline.operators.skew import block_pairs, join_unique, top_one

INST = "institution_id string, canonical_institution_id string, parent_ids array<string>, child_ids array<string>, parent string, node int"
WORK = "work_id string, referenced_works_json string, source_retrieved_at_utc string, key string, status int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_forest(parent):
    out = {}
    for x in parent:
        y, n, seen = x, 0, {x}
        while y in parent:
            y, n = parent[y], n + 1
            if y in seen:
                y, n = "CYCLE", -1
                break
            seen.add(y)
        out[x] = (y, n)
    return out


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_forest_against_brute_force(spark, every):
    rnd = random.Random(every)
    parent = {f"I{i}": f"I{rnd.randrange(max(1, i - 9), i)}" for i in range(2, 300)}
    parent |= {f"C{i}": f"C{(i + 1) % 7}" for i in range(7)} | {f"B{i}": f"C{i % 7}" for i in range(20)} | {f"L{i}": f"L{i + 1}" for i in range(120)} | {"S": "S"}
    got = hierarchy.resolve_forest(spark.createDataFrame(list(parent.items()), "node string, parent string"), split_every=every, path=True)
    want = brute_forest(parent)
    for r in got.collect():
        assert (r.root, r.depth) == want.pop(r.node)
        assert r.path is None if r.depth < 0 else (len(r.path) == r.depth + 1 and r.path[0] == r.root and r.path[-1] == r.node and all(parent[b] == a for a, b in zip(r.path, r.path[1:])))
    assert not want


def test_institution_roots_odd_cases(spark):
    data = [
        ("I1", None, None, ["https://x/I2/", None, "n/a", "I1", "I99"], "a", 1), ("I1", None, None, ["https://x/I2/", None, "n/a", "I1", "I99"], "a", 1),  # repeat, self, unknown
        ("I2", "I2", [], None, None, None), ("I3", "I4", [" I9"], None, None, None), ("I4", "I5", None, None, None, None), ("I5", None, ["I1"], [], None, None),  # I3 -> I4 -> I5
        ("I9", "I9", ["I3"], None, None, None), ("I6", None, ["I7"], None, None, None), ("I7", None, ["I6"], None, None, None), ("I8", None, ["I7"], None, None, None), (None, None, ["I1"], None, None, None),
    ]
    got = rows(hierarchy.institution_roots(spark.createDataFrame(data, INST)))
    # I3 stands for I5; of I5's two parents, I1 and I9, the smaller id holds
    assert got == [("I2", "I1", 1), ("I5", "I1", 1), ("I6", "CYCLE", -1), ("I7", "CYCLE", -1), ("I8", "CYCLE", -1), ("I9", "I1", 2)]
    full = {r.institution_id: r for r in hierarchy.institution_hierarchy(spark.createDataFrame(data, INST)).collect()}
    assert full["I1"].descendant_count == 3 and full["I1"].depth == 0 and full["I2"].path == ["I1", "I2"] and full["I6"].path is None
    assert rows(hierarchy.institution_descendants(spark.createDataFrame(data, INST))) == [("I1", "I2", 1), ("I1", "I5", 1), ("I1", "I9", 2), ("I5", "I9", 1)]
    assert hierarchy.institution_roots(spark.createDataFrame([], INST)).count() == 0


def brute_orphans(works, gone):
    first, refs = {}, set()
    for w, j, t, *_ in works:
        if w is None:
            continue
        if w not in first or (t or "~") < (first[w] or "~"):
            first[w] = t
        for x in json.loads(j) if j and j[0] == "[" else []:
            if x and x.startswith("W"):
                refs.add((w, x))
    out = set()
    for w, x in refs:
        s = "deleted" if x in gone else "missing" if x not in first else "late" if first[x] and first[w] and first[x] > first[w] else None
        if s:
            out.add((w, x, s))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_orphans_any_cut_gives_the_same(spark, batches):
    rnd = random.Random(4)
    works = []
    for i in range(60):
        t = f"2024-01-{rnd.randrange(1, 28):02d}T00:00:00Z" if rnd.random() < 0.9 else None
        w = (f"W{i}", json.dumps([f"W{rnd.randrange(75)}" for _ in range(rnd.randrange(4))] + [None, "x"]), t, "k", 1)
        works += [w] * rnd.choice([1, 1, 2])
    works += [(None, '["W1"]', None, None, None), ("W3", "not json", "2023-12-31T00:00:00Z", None, None)]
    gone = [f"W{i}" for i in range(0, 75, 9)]
    tomb = spark.createDataFrame([(g, f"2024-01-{1 + i:02d} 00:00:00") for i, g in enumerate(gone)] + [(gone[0], None), (None, None), ("bad", None)], "work_id string, d string").select("work_id", F.col("d").cast("timestamp_ntz").alias("deleted_at"), F.lit("x").alias("key"))
    got = rows(orphans.orphan_references(spark.createDataFrame(works, WORK), tomb, batches))
    assert got == brute_orphans(works, set(gone))


def test_orphans_empty_and_counts(spark):
    tomb = spark.createDataFrame([], "work_id string, deleted_at timestamp")
    assert orphans.orphan_references(spark.createDataFrame([], WORK), tomb).count() == 0
    one = spark.createDataFrame([("W1", '["W2","W2"]', "2024-03-05", None, None)], WORK)
    assert rows(orphans.orphan_counts(one, tomb)) == [("2024-03", "missing", 1, 1, 1)]
    assert {r.period for r in orphans.track_works(one, tomb, 3, snapshots=True).collect()} <= {1, 2, 3}


EDGE = "source_id string, target_id string, layer_weight double, n int, endpoint string"


def test_hot_keys_profile_against_brute_force(spark):
    rnd = random.Random(1)
    data = []
    for _ in range(600):
        s = "HOT" if rnd.random() < 0.4 else rnd.choice(["A", "B", None])
        data.append((s, rnd.choice(["P", "Q", "HOT", None]), rnd.choice([None, float("nan"), -2.5, 0.0, 1e-9, 0.25, 0.25, 7.0, 1e300]), 1, "x"))
    got = {(r.endpoint, r.institution_id): r for r in hotkeys.endpoint_profile(spark.createDataFrame(data, EDGE)).collect()}
    for end, me, you in (("source_id", 0, 1), ("target_id", 1, 0)):
        for key in {d[me] for d in data}:
            own = [d for d in data if d[me] == key]
            r = got.pop((end, key))
            ws = sorted(d[2] for d in own if d[2] is not None and d[2] == d[2])
            partners = Counter(d[you] for d in own if d[you] is not None)
            best = min(partners, key=lambda p: (-partners[p], p))
            assert (r.edge_count, r.partner_count, r.top_partner_id, r.top_partner_edge_count) == (len(own), len(partners), best, partners[best])
            assert r.weight_p50 == ws[-(-len(ws) // 2) - 1] and r.weighted_edge_count == sum(d[2] is not None for d in own)
    assert not got
    assert {tuple(r) for r in hotkeys.hot_endpoints(spark.createDataFrame(data, EDGE), 0.3).collect()} >= {("source_id", "HOT")}


def test_hot_keys_empty_and_exact_share(spark):
    assert hotkeys.endpoint_profile(spark.createDataFrame([], EDGE)).count() == 0
    data = [("A", None, None, 1, "x")] + [(f"k{i}", None, 1.0, 1, "x") for i in range(49)]
    assert len(rows(hotkeys.hot_endpoints(spark.createDataFrame(data, EDGE)))) == 50  # one fiftieth counts


WORKS = "work_id string, authorships_json string, topics_json string, locations_json string, referenced_works_json string, child_kind string, item_key int"


def test_nested_odd_cases(spark):
    a = json.dumps([None, {"author": {"id": "https://x/A1/"}, "institutions": [{"id": "I1"}, None, {"id": None}]}, {"institutions": json.dumps({"id": " I2"})}, 5, "s"])
    data = [
        ("W1", a, json.dumps(json.dumps([{"id": "T1"}])), '{"source": {"id": "S1"}}', '["W1", null, "none", 3]', "x", 1), ("W1", a, json.dumps(json.dumps([{"id": "T1"}])), '{"source": {"id": "S1"}}', '["W1", null, "none", 3]', "x", 1),
        ("W2", "[{", "", "{}x", "null", None, None), ("W3", None, '"text"', "7", "[]", None, None), ("W4", None, None, "[NaN]", '"[\\"W9\\"]"', None, None), ("W5", None, None, None, json.dumps(["W1"] * 3 + ["x" * 300_000]), None, None),
    ]
    got = rows(nested.flat_rows(spark.createDataFrame(data, WORKS)))
    want = [
        ("W1", "authorship", 1, -1, "A1"), ("W1", "authorship", 2, -1, ""), ("W1", "authorship", 3, -1, ""), ("W1", "authorship", 4, -1, ""), ("W1", "authorship_institution", 1, 0, "I1"), ("W1", "authorship_institution", 1, 2, ""),
        ("W1", "authorship_institution", 2, 0, "I2"), ("W1", "topic", 0, -1, "T1"), ("W1", "location", 0, -1, "S1"), ("W1", "reference", 0, -1, "W1"), ("W1", "reference", 2, -1, ""), ("W1", "reference", 3, -1, ""),
        ("W4", "reference", 0, -1, "W9"), ("W5", "reference", 0, -1, "W1"), ("W5", "reference", 1, -1, "W1"), ("W5", "reference", 2, -1, "W1"), ("W5", "reference", 3, -1, ""),
    ]
    assert got == sorted(want, key=repr)
    assert nested.flat_rows(spark.createDataFrame([], WORKS)).count() == 0
    tagged = nested.flat_rows(spark.createDataFrame(data, WORKS), payload=True)
    inst = nested.flat_table(tagged, "authorship_institution").collect()
    assert {r.raw_id for r in inst} == {"I1", None, " I2"} and {r.work_id for r in inst} == {"W1"}


def test_flat_tables_drop_nothing(spark):
    author = {"author": {"id": "A1", "orcid": "o"}, "affiliations": [None, {"raw_affiliation_string": "x", "institution_ids": ["I1"], "n": 1}], "institutions": [{"id": "I1"}], "is_corresponding": True, "raw_affiliation_strings": "one"}
    topic = {"id": "T1", "score": "high", "field": {"id": "f", "display_name": "F"}, "domain": {"id": "d"}, "subfield": "s"}
    df = spark.createDataFrame([("W1", json.dumps([author, 5, {"institutions": "no JSON", "affiliations": 7}]), json.dumps([topic, {"id": "T2", "score": 1}]), None, None, None, None)], WORKS)
    tagged = nested.flat_rows(df, nests=nested.FLAT_NESTS, payload=True)
    kept = lambda r: None if r.rest is None else json.loads(r.rest)
    a = {r.item_index: r for r in nested.flat_table(tagged, "authorship").collect()}
    assert a[0].author_id == "A1" and kept(a[0]) == {"author": {"orcid": "o"}, "is_corresponding": True, "raw_affiliation_strings": "one"}
    assert kept(a[1]) == 5 and kept(a[2]) == {"institutions": "no JSON", "affiliations": 7}
    f = nested.flat_table(tagged, "authorship_affiliation").collect()
    assert [(r.item_index, r.sub_index, r.raw_affiliation_string, r.institution_ids, kept(r)) for r in f] == [(0, 1, "x", ["I1"], {"n": 1})]
    t = {r.item_index: r for r in nested.flat_table(tagged, "topic").collect()}
    assert (t[0].field_id, t[0].field_display_name, t[0].domain_id, t[0].score) == ("f", "F", "d", None) and kept(t[0]) == {"score": "high", "subfield": "s"}
    assert t[1].score == 1.0 and t[1].rest is None
    assert "authorship_affiliation" not in {r.child_kind for r in nested.flat_rows(df).collect()}


def test_write_tagged_reads_back_by_tag(spark, tmp_path):
    df = nested.flat_rows(spark.createDataFrame([("W1", None, '[{"id":"T1"}]', None, '["W2"]', None, None)], WORKS))
    nested.write_tagged(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("child_kind = 'topic'").count() == 1 and back.count() == 2


def test_join_unique_with_hot_keys_is_the_plain_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)] + [(None, 7)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    for how in ("left", "inner"):
        assert rows(join_unique(left, right, "k", how, min_rows=10)) == rows(left.join(right, "k", how))


def test_block_pairs_equal_all_pairs(spark):
    m = [("a", f"m{i:03d}", i % 3) for i in range(60)] + [("b", "x", 1), ("b", "y", 1), (None, "q", 1), ("c", None, 1)]
    df = spark.createDataFrame(m + m[:5], "k string, m string, d int")
    want = sorted((k, a, b) for k, a, _ in m for k2, b, _ in m if k and a and b and k == k2 and a < b)
    assert rows(block_pairs(df, "k", "m", block=7)) == want
    differ = sorted((k, a, b) for k, a, x in m for k2, b, y in m if k and a and b and k == k2 and a < b and x != y)
    assert rows(block_pairs(df, "k", "m", block=7, differ="d")) == differ


def test_top_one_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, 9), (1, 1, 8), (2, None, 7)], "k int, v int, _rn int")
    assert rows(top_one(df, ["k"], F.asc_nulls_last("v"))) == [(1, 1, 8), (2, None, 7)]


def test_times_and_ids(spark):
    c = [("2024-01-08T02:00:00+02:00",), ("2024/01/08",), ("2024-01-08 00:00:00",), ("20240108T000000Z",), ("2024-01-08T00:00Z",)]
    got = {r[0] for r in spark.createDataFrame(c, "s string").select(instant_micros("s")).collect()}
    assert got == {1704672000000000}
    bad = [(None,), ("",), ("unknown",), ("2024-13-01",)]
    assert {r[0] for r in spark.createDataFrame(bad, "s string").select(instant_micros("s")).collect()} == {None}
    ids = [("https://x/W1/",), (" W1",), ("w1",), ("xW1",), (None,), ("W",)]
    assert [r[0] for r in spark.createDataFrame(ids, "s string").select(short_id("s")).collect()] == ["W1", "W1", None, None, None, None]


