"""Download plans as tables: year, topic and country shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_PAGE = 200


def _shards(df: DataFrame, column: str, size: int, name: str) -> DataFrame:
    """Values in shards of at most ``size``, in order; a registry of settings, so one small window."""
    d = df.select(column).filter(F.col(column).isNotNull()).distinct()
    d = d.withColumn(name, ((F.row_number().over(Window.orderBy(column)) - 1) / size).cast("int"))
    return d.groupBy(name).agg(F.array_join(F.array_sort(F.collect_list(column)), "|").alias(f"{column}s"))


def query_plan(topics: DataFrame, countries: DataFrame, first_year: int, last_year: int, topic_shard: int = 10, country_shard: int = 25) -> DataFrame:
    """One row for each year x topic shard x country shard, with a deterministic id."""
    if first_year > last_year:
        raise ValueError("the first year is after the last")
    t, c = _shards(topics, "topic_id", topic_shard, "topic_shard"), _shards(countries, "country_code", country_shard, "country_shard")
    shards = c.limit(1001).collect()  # settings: a few hundred countries in shards
    if len(shards) > 1000:
        raise ValueError("more than 1,000 country shards")
    each = F.explode(F.array(*[F.struct(F.lit(r.country_shard).alias("country_shard"), F.lit(r.country_codes).alias("country_codes")) for r in shards]))
    p = t.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))).withColumn("c", each).select("year", "topic_shard", "topic_ids", "c.*")
    return p.withColumn("query_id", F.sha2(F.concat_ws("|", F.col("year").cast("string"), "topic_ids", "country_codes"), 256))


def plan_preview(plan: DataFrame, counts: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Predicted pages and requests by year from counted results (query_id, result_count)."""
    p = plan.join(counts, "query_id", "left").withColumn("pages", F.ceil(F.coalesce("result_count", F.lit(0)) / per_page))
    return p.groupBy("year").agg(F.count(F.lit(1)).alias("query_count"), F.sum(F.coalesce("result_count", F.lit(0))).alias("result_count"), F.sum("pages").alias("page_count"))


def plan_gaps(plan: DataFrame, topics: DataFrame, countries: DataFrame) -> DataFrame:
    """Topics and countries that the plan misses or invents, and repeated ids: (kind, value); empty for a good plan."""
    out = None
    for column, source in (("topic_id", topics), ("country_code", countries)):
        have = plan.select(F.explode(F.split(f"{column}s", r"\|")).alias("value")).distinct()
        want = source.select(F.col(column).alias("value")).filter("value is not null").distinct()
        for kind, a, b in ((f"missing_{column}", want, have), (f"unknown_{column}", have, want)):
            one = a.exceptAll(b).select(F.lit(kind).alias("kind"), "value")
            out = one if out is None else out.unionByName(one)
    twice = plan.groupBy("query_id").count().filter("count > 1").select(F.lit("repeated_query_id").alias("kind"), F.col("query_id").alias("value"))
    return out.unionByName(twice)


def execution_status(runs: DataFrame) -> DataFrame:
    """Status of each query from its attempts (query_id, attempt, state, pages, started_at, ended_at)."""
    return runs.groupBy("query_id").agg(F.max_by("state", "attempt").alias("state"), F.max("attempt").alias("attempts"), F.sum("pages").alias("pages"), F.min("started_at").alias("first_started_at"), F.max("ended_at").alias("last_ended_at"))
