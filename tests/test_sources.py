"""Sources, sinks, plans, streams and the driver contract."""

import datetime
import gzip
import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import orphans
from weftline.operators.quality import TableContract
from weftline.sources import cursor, pages, plan, sinks
from weftline.streaming import incremental


def fetch_pages(query, at):
    """A service of three pages for tests."""
    n = 0 if at == "*" else int(at)
    return {"meta": {"next_cursor": str(n + 1) if n < 2 else None}, "results": [{"id": f"{query}-{n}-{i}"} for i in range(2)]}


def test_cursor_paging_and_errors():
    got = list(cursor.pages(fetch_pages, "q"))
    assert [n for n, *_ in got] == [0, 1, 2]
    with pytest.raises(ValueError, match="cursor loop"):
        list(cursor.pages(lambda q, c: {"meta": {"next_cursor": "*"}, "results": []}, "q"))
    with pytest.raises(ValueError, match="repeated page"):
        list(cursor.pages(lambda q, c: {"meta": {"next_cursor": c + "x"}, "results": [1]}, "q"))
    tries = []

    def flaky(q, c):
        tries.append(c)
        if len(tries) < 3:
            raise cursor.FetchError(503)
        return {"results": []}

    assert cursor.with_retries(flaky, "q", "*", sleep=lambda s: None) == {"results": []} and len(tries) == 3
    with pytest.raises(cursor.FetchError):
        cursor.with_retries(lambda q, c: (_ for _ in ()).throw(cursor.FetchError(403)), "q", "*", sleep=lambda s: None)


def test_cursor_data_source(spark):
    spark.dataSource.register(cursor.CursorSource)
    import os
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in sys.path:
        sys.path.insert(0, root)
    r = cursor.CursorReader({"fetch": "tests.test_sources:fetch_pages", "queries": '["a", "b"]'})
    rows = [x for p in r.partitions() for x in r.read(p)]
    assert len(rows) == 12 and rows[0][:4] == ("a", 0, "*", 0)
    assert cursor.CursorSource.name() == "cursor_pages"


def test_page_cache_quarantine_and_explode(spark, tmp_path):
    body = {"a.json.gz": '{"meta": {}, "results": [{"id": 1}, {"id": 2}]}', "b.json.gz": '{"results": [{"id": 3}]}', "c.json.gz": "{broken", "d.json.gz": '{"results": []}'}
    sums = []
    for name, text in body.items():
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
        sums.append((name, hashlib.sha256(text.encode()).hexdigest() if name != "b.json.gz" else "0"))
    good, bad = pages.verify_pages(pages.read_pages(spark, f"{tmp_path}/*.gz"), spark.createDataFrame(sums, "name string, sha256 string"))
    assert {r.path.rpartition("/")[2]: r.reason for r in bad.collect()} == {"b.json.gz": "checksum_mismatch", "c.json.gz": "no_results"}
    assert sorted((r.record_index, json.loads(r.record)["id"]) for r in pages.explode_results(good).collect()) == [(0, 1), (1, 2)]


def test_registries(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "r1", "n": 1}, {"id": "r2", "n": 2}, {"id": "r1", "n": 3}]')
    (tmp_path / "b.json").write_text('{"id": "r1", "n": 1}\n{bad\n{"id": "r1", "n": 3}\n{"id": "r2", "n": 2}\n')
    for f in ("a.json", "b.json"):
        assert sorted(map(tuple, pages.read_registry_dump(spark, str(tmp_path / f), "id string, n int").collect())) == [("r1", 3), ("r2", 2)]
    (tmp_path / "c.csv").write_text("rule_id,action\nR1,collapse\n")
    assert pages.read_registry_csv(spark, str(tmp_path / "c.csv"), "rule_id string, action string").count() == 1
    with pytest.raises(ValueError):
        pages.read_registry_csv(spark, str(tmp_path / "c.csv"), "action string, rule_id string")
    rec = lambda *x: spark.createDataFrame(list(x), "id string, record string")
    got = pages.keyed_lookup(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), ("cache", rec(("a", "1"))), ("dump", rec(("a", "2"), ("b", "3"))))
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", "1", "cache"), ("b", "3", "dump"), ("c", None, None)]
    b = pages.lookup_batches(spark.range(500).select(F.concat(F.lit("I"), "id").alias("id")), 3).collect()
    assert sum(len(r.ids.split("|")) for r in b) == 500 and max(len(r.ids.split("|")) for r in b) <= 3
    n = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("a", "tie", 2)], "id string, record string, retrieved_at int")
    assert pages.newest_per_id(n).first().record == "tie"


def test_plan(spark):
    t = spark.createDataFrame([(f"T{i}",) for i in range(23)], "topic_id string")
    c = spark.createDataFrame([(x,) for x in ("DE", "FR", None)], "country_code string")
    p = plan.query_plan(t, c, 2020, 2021)
    assert p.count() == 6 and p.select("query_id").distinct().count() == 6
    assert plan.plan_gaps(p, t, c).count() == 0
    assert {r.kind for r in plan.plan_gaps(p.filter("topic_shard > 0"), t, c).collect()} == {"missing_topic_id"}
    v = plan.plan_preview(p, p.select("query_id", F.lit(201).alias("result_count"))).collect()
    assert all((r.query_count, r.page_count) == (3, 6) for r in v)


def test_publish_is_atomic(spark, tmp_path):
    path, c = f"file://{tmp_path}/t", TableContract("t", ("k",), ("v",))
    m = sinks.publish(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, c)
    assert m["row_count"] == 2
    with pytest.raises(ValueError):
        sinks.publish(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), path, c)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir() if "tmp" in p.name and not p.name.startswith(".")] == []
    assert not sinks.changed(spark.read.parquet(path), m, c) and sinks.changed(spark.read.parquet(path).limit(1), m, c)
    sinks.publish(spark.createDataFrame([(9, "z")], "k int, v string"), path, c)
    assert spark.read.parquet(path).count() == 1
    assert sinks.write_csv(spark.range(3), f"file://{tmp_path}/s") == 3


def test_streams(spark, tmp_path):
    schema = "work_id string, publication_year int, source_retrieved_at_utc string, referenced_works_json string"
    src = tmp_path / "in"
    first = [("W1", 2020, "2024-01-01T00:00:00Z", '["W2","W3"]'), ("X", 2020, "2024-01-01T00:00:00Z", None)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(str(src))
    spark.createDataFrame([("W2", 2020, "2024-01-03T00:00:00Z", "[]"), ("W1", 2020, "2024-01-04T00:00:00Z", '["W2","W3"]')], schema).coalesce(1).write.mode("append").parquet(str(src))
    incremental.run_quarantine(incremental.stream_tables(spark, str(src), spark.read.parquet(str(src)).schema), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).first().reason == "invalid_or_missing_work_id"
    q = incremental.first_deliveries(incremental.stream_tables(spark, str(src), spark.read.parquet(str(src)).schema)).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 2


def test_orphan_stream_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(6)
    day = lambda: f"2024-01-{rnd.randrange(1, 28):02d}T00:00:00Z" if rnd.random() < 0.9 else None
    works = [(f"W{i}", json.dumps(["W1"] * (rnd.random() < 0.5) + [f"W{rnd.randrange(70)}" for _ in range(rnd.randrange(4))]), day()) for i in range(50)]
    schema, src, dead = "work_id string, referenced_works_json string, source_retrieved_at_utc string", tmp_path / "works", tmp_path / "gone"
    tomb = [(f"W{i}", None) for i in (2, 8, 33, 69)]
    parts = [works[:20], works[20:30] + works[:3], works[30:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        if k != 1:
            spark.createDataFrame(tomb[2 * (k > 0) :][:2], "work_id string, deleted_at timestamp").coalesce(1).write.mode("append").parquet(str(dead))
        works_in = incremental.stream_tables(spark, str(src), spark.read.parquet(str(src)).schema)
        gone_in = incremental.stream_tables(spark, str(dead), spark.read.parquet(str(dead)).schema)
        q = incremental.run_orphans(incremental.orphan_events(works_in, gone_in), str(tmp_path / "log"), str(tmp_path / "state"))  # a new query each time
        q.awaitTermination(300)
    got = sorted((r.citing, r.ref, r.status) for r in incremental.orphan_ledger(spark, str(tmp_path / "log")).collect())
    whole = orphans.orphan_references(spark.read.parquet(str(src)), spark.read.parquet(str(dead)))
    assert got == sorted((r.work_id, r.referenced_work_id, r.status) for r in whole.collect()) and {s for *_, s in got} == {"missing", "deleted", "late"}


def test_late_rows_are_counted(spark, tmp_path):
    src, schema = tmp_path / "events", "ts timestamp, event_type string, value double"
    at = lambda *hours: [(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), "a", 1.0) for h in hours]
    for part in (at(0, 1), at(100), at(101), at(102, 2, 3)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)  # files are taken in the order of their times; a watermark holds from the batch after next
    q = incremental.event_windows(incremental.stream_tables(spark, str(src), spark.read.parquet(str(src)).schema)).writeStream.format("memory").outputMode("append").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert incremental.late_rows(q) >= 1


def test_driver_contract(spark, sf):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {"p2_found", "p4_found", "p5_found", "p7_found"} <= set(q)
    assert {r for n in ("p2_found",) for r in q[n](spark, sf).columns} == {"institution_id", "root_institution_id", "depth"}
    assert e.entry(spark).count() > 0


def test_core_queries_agree_with_sql(spark, sf):
    import duckdb

    from weftline.plans import catalog

    con = duckdb.connect()
    for t in ("works", "institutions", "institution_records", "layer_edges", "work_tombstones", "topic_registry", "source_trust", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    norm = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    for name in ("p5_found", "p7_found", "nrm5_work_topics", "cor1_flags", "edg3_edges_year", "flw1_flows", "int1_intensity", "cit1_flows", "sim2_topk", "mpx3_overlap", "view1_partner_shares"):
        df = catalog.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        b = sorted((tuple(map(norm, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]}) AS q").fetchall()), key=repr)
        assert a == b, name
