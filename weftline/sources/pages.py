"""Semi-structured page caches and registries as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Cached response pages (JSON text, gzip or plain, one file a page): path, body.

    Bodies are kept as text; ``explode_results`` reads them.
    """
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def verify_pages(pages: DataFrame, checksums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) pages: a page is good if its SHA-256 is the recorded one and it is a JSON object with results.

    ``checksums``: name (end of the path), sha256. Pages without a record are quarantined too. The
    reason names the first check that fails.
    """
    p = pages.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(checksums, "name", "left")
    v = F.try_parse_json("body")
    why = F.when(F.col("sha256").isNull(), "no_checksum").when(F.sha2("body", 256) != F.col("sha256"), "checksum_mismatch").when(v.isNull() | F.try_variant_get(v, "$.results", "array<variant>").isNull(), "no_results")
    p = p.withColumn("reason", why)
    return p.filter("reason is null").select("path", "body"), p.filter("reason is not null").select("path", "reason")


def explode_results(pages: DataFrame) -> DataFrame:
    """(path, record_index, record) of each record of each page; a page without an array of results gives none."""
    records = F.from_json("body", "results array<string>", {"allowNonNumericNumbers": "false"})["results"]
    return pages.select("path", F.posexplode(records).alias("record_index", "record"))


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Upsert-ignore: the first row of each key in the order of the given ordinals, nulls last."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(o) for o in order]))
    return df.withColumn("__weftline_rank__", rn).filter("__weftline_rank__ = 1").drop("__weftline_rank__")


def read_registry_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry dump that is a JSON array or JSON lines; of repeated ids the last record wins.

    ``schema`` must have a string column ``id``. Spark reads an array as its elements in either
    layout; a damaged record is dropped.
    """
    struct = T.StructType.fromDDL(f"{schema}, _broken string")
    text = spark.read.text(path).filter("trim(value) <> ''").limit(1).select(F.substring(F.trim("value"), 1, 1)).first()
    multi = text is not None and text[0] == "["
    d = spark.read.schema(struct).option("columnNameOfCorruptRecord", "_broken").option("multiLine", multi).json(path)
    d = d.withColumn("_at", F.monotonically_increasing_id())  # grows with the position in each file
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at")))
    return d.withColumn("_n", last).filter("_n = 1 and id is not null and _broken is null").drop("_n", "_at", "_broken")


def read_registry_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV registry whose header must be exactly the schema's columns, in order."""
    want = [f.name for f in T.StructType.fromDDL(schema)]
    head = spark.read.text(path).first()
    got = [] if head is None else [x.strip().strip('"') for x in head[0].lstrip("﻿").split(",")]
    if got != want:
        raise ValueError(f"header {got} is not {want}")
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def keyed_lookup(ids: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """(id, record, lookup_source): the record of the first source that has the id; null where none has.

    Each source is (name, DataFrame of id, record); earlier sources take precedence.
    """
    ranked = None
    for i, (name, df) in enumerate(sources):
        one = df.select("id", "record", F.lit(name).alias("lookup_source"), F.lit(i).alias("_rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.filter("record is not null").groupBy("id").agg(F.min_by(F.struct("record", "lookup_source"), F.struct("_rank", "record")).alias("b"))
    return ids.select("id").distinct().join(best, "id", "left").select("id", "b.record", "b.lookup_source")


def newest_per_id(records: DataFrame) -> DataFrame:
    """(id, record, retrieved_at): the newest record of each id, the larger record on equal times."""
    return records.groupBy("id").agg(F.max_by("record", F.struct("retrieved_at", "record")).alias("record"), F.max("retrieved_at").alias("retrieved_at"))


def lookup_batches(ids: DataFrame, size: int = 50) -> DataFrame:
    """Distinct ids in batches of at most ``size`` for a look-up by list: batch, ids joined by '|'.

    Batches are cut inside hash groups, so no task sorts all ids.
    """
    d = ids.select("id").filter("id is not null").distinct().withColumn("g", F.pmod(F.xxhash64("id"), F.lit(4096)))
    d = d.withColumn("b", ((F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1) / size).cast("int"))
    return d.groupBy("g", "b").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids")).select(F.concat_ws("-", "g", "b").alias("batch"), "ids")
