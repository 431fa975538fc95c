"""Queries of sources, plans and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.tables import table
from weftline.sources import pages, plan
from weftline.streaming import incremental


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return plan.query_plan(table(spark, d, "topic_registry"), table(spark, d, "institutions"), 2010, 2025)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The windowed stream run to its end: the events file is one bounded stream."""
    return incremental.event_windows(table(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "event_count", F.round("value_sum", 4).alias("value_sum"))


QUERIES = {
    "src9_plan": lambda s, d: _plan(s, d).select("year", "topic_ids", "country_codes"),
    # a plan of the topics with a family only: it must miss the others, and one country that is not asked for
    "src11_plan_gaps": lambda s, d: plan.plan_gaps(plan.query_plan(table(s, d, "topic_registry").filter("method_family is not null"), table(s, d, "institutions"), 2010, 2025), table(s, d, "topic_registry"), table(s, d, "institutions").filter("country_code <> 'DE'")),
    "src19_lookup_batches": lambda s, d: pages.lookup_batches(table(s, d, "institutions").select(F.col("institution_id").alias("id"))).select(F.size(F.split("ids", r"\|")).alias("n")).groupBy().agg(F.sum("n").alias("ids"), F.max("n").cast("int").alias("largest")).withColumn("fits", F.col("largest") <= 50).select("ids", "fits"),
    "str1_windows": _events,
    "str2_sessions": lambda s, d: incremental.event_sessions(table(s, d, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("session_count"), F.sum("event_count").alias("event_count")),
}

_SHARD = "SELECT string_agg(v, '|' ORDER BY v) AS vs FROM (SELECT v, (row_number() OVER (ORDER BY v) - 1) // {n} AS g FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL) AS a) AS b GROUP BY g"
ORACLES = {
    "src9_plan": f"SELECT y.year, t.vs AS topic_ids, c.vs AS country_codes FROM (SELECT unnest(range(2010, 2026))::INTEGER AS year) AS y CROSS JOIN ({_SHARD.format(n=10, c='topic_id', t='topic_registry')}) AS t CROSS JOIN ({_SHARD.format(n=25, c='country_code', t='institutions')}) AS c",
    "src11_plan_gaps": "SELECT 'missing_topic_id' AS kind, topic_id AS value FROM topic_registry WHERE method_family IS NULL UNION ALL SELECT DISTINCT 'unknown_country_code', 'DE' FROM institutions WHERE country_code = 'DE'",
    "src19_lookup_batches": "SELECT count(DISTINCT institution_id) AS ids, true AS fits FROM institutions",
    "str1_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS event_count, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2",
    "str2_sessions": "SELECT user_id, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)::BIGINT AS session_count, count(*) AS event_count FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) AS z GROUP BY 1",
}
