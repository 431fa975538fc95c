"""Raw records to normalized rows: works of a catalogue, entries of an organization registry."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import canonical, json_hash
from weftline.operators.corpus import FIRST_YEAR, LAST_YEAR
from weftline.operators.nested import short
from weftline.operators.skew import top_one

_ORDER = ("query_order", "page", "record_index")
_KEYS = [pa.field("query_id", pa.string()), *[pa.field(x, pa.int32()) for x in _ORDER], pa.field("source_retrieved_at_utc", pa.string()), pa.field("record_key", pa.string()), pa.field("raw_record_hash", pa.string()), pa.field("reason", pa.string())]
_TEXT = ("doi", "title", "publication_date", "work_type", "source_updated_date")
_BOOL, _JSON = ("is_retracted", "is_paratext"), ("topics_json", "referenced_works_json", "authorships_json", "primary_location_json", "locations_json", "ids_json")
_WORK = [
    pa.field("work_id", pa.string()), *[pa.field(x, pa.string()) for x in _TEXT], pa.field("publication_year", pa.int32()), *[pa.field(x, pa.bool_()) for x in _BOOL], pa.field("cited_by_count", pa.int64()),
    pa.field("fwci", pa.float64()), pa.field("primary_topic_id", pa.string()), pa.field("primary_topic_name", pa.string()), *[pa.field(x, pa.string()) for x in _JSON],
]
_NORMALIZED = pa.schema([*_KEYS, *_WORK])
_DDL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}


def _a(kind: type, x: object) -> object:
    """The value if it is of this kind; a truth value is no number."""
    return x if isinstance(x, kind) and (kind is bool or not isinstance(x, bool)) else None


def _id(x: object, letter: str) -> str | None:
    s = short(x)
    return s if s[:1] == letter else None


def _work(r: dict) -> dict:
    topic = r.get("primary_topic") if isinstance(r.get("primary_topic"), dict) else {}
    refs = r.get("referenced_works") if isinstance(r.get("referenced_works"), list) else []
    score = _a((int, float), r.get("fwci"))
    lists = {c: r.get(n) if isinstance(r.get(n), list) else [] for c, n in (("topics_json", "topics"), ("authorships_json", "authorships"), ("locations_json", "locations"))}
    return {
        "work_id": _id(r.get("id"), "W"), "doi": _a(str, r.get("doi")), "title": _a(str, r.get("title")), "publication_year": _a(int, r.get("publication_year")), "publication_date": _a(str, r.get("publication_date")),
        "work_type": _a(str, r.get("type")), "is_retracted": _a(bool, r.get("is_retracted")), "is_paratext": _a(bool, r.get("is_paratext")), "cited_by_count": _a(int, r.get("cited_by_count")), "fwci": None if score is None else float(score),
        "primary_topic_id": _id(topic.get("id"), "T"), "primary_topic_name": _a(str, topic.get("display_name")), "source_updated_date": _a(str, r.get("updated_date")),
        "referenced_works_json": canonical(sorted({s for x in refs if (s := _id(x, "W"))})), "primary_location_json": canonical(r.get("primary_location")), "ids_json": canonical(r.get("ids") or {}), **{c: canonical(v) for c, v in lists.items()},
    }


def normalize_records(raw: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Every raw record of a catalogue as one row with the columns of works, or with the reason why it is none.

    ``raw``: record (JSON text), query_id, query_order, page, record_index, retrieved_at. The first of
    these reasons that holds: ``record_not_object`` (also text that is no JSON, and null),
    ``invalid_or_missing_work_id``, ``invalid_or_missing_publication_year``,
    ``publication_year_outside_analysis_window``. Values of another kind than their column are null.
    Nested values become canonical JSON, references sorted distinct short ids. ``raw_record_hash`` is
    the SHA-256 of the record's canonical JSON, ``record_key`` that of query, page, position and hash.
    """
    ddl = ", ".join(f"{f.name} {_DDL[f.type]}" for f in _NORMALIZED)

    def one(text: str | None, query: str | None, order: int | None, page: int | None, index: int | None, at: str | None) -> dict:
        try:
            r = json.loads(text) if text is not None else None
            told = json_hash(r)
        except (ValueError, RecursionError):
            r, told = None, hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
        out = {"query_id": query, "query_order": order, "page": page, "record_index": index, "source_retrieved_at_utc": at, "raw_record_hash": told, "reason": None}
        out["record_key"] = hashlib.sha256(f"{query}:{page}:{index}:{told}".encode()).hexdigest()
        if not isinstance(r, dict):
            return out | {"reason": "record_not_object"}
        w = _work(r)
        year = w["publication_year"]
        why = "invalid_or_missing_work_id" if w["work_id"] is None else "invalid_or_missing_publication_year" if year is None else "publication_year_outside_analysis_window" if not first <= year <= last else None
        return out | ({"reason": why} if why else w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(*x) for x in zip(*(c.to_pylist() for c in b.columns))], schema=_NORMALIZED)

    cols = [F.col("record").cast("string"), F.col("query_id").cast("string"), *[F.col(x).cast("int") for x in _ORDER], F.col("retrieved_at").cast("string")]
    return raw.select(*cols).mapInArrow(run, ddl)


def rejected_records(normalized: DataFrame) -> DataFrame:
    """The quarantine: a row for each record that is no work, repeats of one record once."""
    return normalized.filter("reason is not null").select("record_key", "query_id", "page", "record_index", "reason", "raw_record_hash").distinct()


def first_works(normalized: DataFrame) -> DataFrame:
    """One row a work: the first by order of query, page and position in the page."""
    ok = normalized.filter("reason is null")
    return top_one(ok, ["work_id"], *[F.asc_nulls_last(x) for x in _ORDER], F.asc("raw_record_hash"), F.asc_nulls_last("source_retrieved_at_utc")).drop("reason")


def work_sources(normalized: DataFrame) -> DataFrame:
    """Which query delivered which work first where: one row a (work_id, query_id)."""
    ok = normalized.filter("reason is null").select("work_id", "query_id", *_ORDER)
    return top_one(ok, ["work_id", "query_id"], *[F.asc_nulls_last(x) for x in _ORDER])


def record_reconciliation(normalized: DataFrame, works: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: records, rejects, works, repeated deliveries, sources without work, years, and whether all adds up."""
    n = normalized.agg(F.count(F.lit(1)).alias("record_count"), F.count("reason").alias("rejected_count"))
    w = works.agg(F.count(F.lit(1)).alias("work_count"), F.count_distinct("work_id").alias("distinct_work_count"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"))
    s = sources.join(works.select("work_id"), "work_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_source_count"))
    j = n.join(F.broadcast(w)).join(F.broadcast(s))  # one row each
    repeats = F.col("record_count") - F.col("rejected_count") - F.col("work_count")
    fine = (F.col("work_count") == F.col("distinct_work_count")) & (F.col("orphan_source_count") == 0) & (repeats >= 0)
    return j.withColumns({"repeated_count": repeats, "reconciles": fine})


_REGISTRY = (
    "id string, names array<struct<value: string, types: array<string>>>, types array<string>, status string, relationships array<struct<type: string, id: string>>, "
    "locations array<struct<geonames_details: struct<lat: double, lng: double, name: string, country_code: string, country_name: string>>>, admin struct<last_modified: struct<date: string, schema_version: string>>"
)
_RELATIONS = ("parent", "child", "related", "predecessor", "successor")


def registry_id(c: Column) -> Column:
    """The nine-character id at the end of an address, lower case; null if there is none. Never a guess from a name."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"(?:^|/)(0[0-9a-hj-km-np-tv-z]{8})/*$", 1), F.lit(""))


def _clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _texts(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _clean), lambda x: x.isNotNull())))


def registry_records(raw: DataFrame, column: str = "record") -> DataFrame:
    """Entries of an organization registry (JSON text) as flat rows; entries without a valid id give none.

    The name shown is the last one marked so, else the smallest of all; acronyms and other names are
    sorted sets without it. Place and coordinates are the first location's. Relationships are split by
    kind; those of another kind or without a valid id are left out. Missing lists are empty, values of
    another kind than expected null.
    """
    r = raw.select(F.from_json(F.col(column), _REGISTRY, {"allowNonNumericNumbers": "false"}).alias("r")).select("r.*").withColumn("_id", registry_id(F.col("id"))).filter("_id is not null")
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.col("names"), lambda x: F.struct(_clean(x["value"]).alias("value"), F.coalesce(x["types"], none).alias("types"))), lambda x: x["value"].isNotNull())
    r = r.withColumn("_names", F.coalesce(names, F.array().cast("array<struct<value:string,types:array<string>>>")))
    pick = lambda test: F.array_sort(F.array_distinct(F.transform(F.filter("_names", lambda x: test(x["types"])), lambda x: x["value"])))
    shown = lambda t: F.array_contains(t, "ror_display")
    short_name = lambda t: F.array_contains(t, "acronym")
    r = r.withColumns({"_shown": F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("_names", lambda x: shown(x["types"])), lambda x: x["value"])), -1), "_other": pick(lambda t: ~shown(t) & ~short_name(t)), "_short": pick(lambda t: ~shown(t) & short_name(t))})
    r = r.withColumn("display_name", F.coalesce("_shown", F.array_min(F.concat("_other", "_short"))))
    place = F.get(F.filter("locations", lambda x: x.isNotNull()), 0)["geonames_details"]
    code = F.upper(F.trim(place["country_code"]))
    related = lambda kind: F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(F.coalesce("relationships", F.array().cast("array<struct<type:string,id:string>>")), lambda x: x["type"] == kind), lambda x: registry_id(x["id"])), lambda x: x.isNotNull())))
    return r.select(
        F.col("_id").alias("ror_id"), "display_name", F.filter("_other", lambda x: x != F.coalesce("display_name", F.lit(""))).alias("alternative_names"), F.col("_short").alias("acronyms"), _texts(F.col("types")).alias("types"), _clean(F.col("status")).alias("status"),
        F.when(code.rlike("^[A-Z]{2}$"), code).alias("country_code"), _clean(place["country_name"]).alias("country_name"), _clean(place["name"]).alias("city_name"), place["lat"].alias("latitude"), place["lng"].alias("longitude"),
        *[related(k).alias(f"{k}_ids") for k in _RELATIONS], _clean(F.col("admin.last_modified.schema_version")).alias("schema_version"), _clean(F.col("admin.last_modified.date")).alias("last_modified_date"),
    )
