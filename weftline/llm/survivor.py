"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import instant_micros, short_id
from weftline.operators.skew import top_one

FIELDS = ("source_display_names", "source_country_codes", "source_institution_types", "source_ror_ids")

# Spellings (lower case, without punctuation and space) that stand for an unknown value.
STAND_INS = ("", "na", "nan", "nil", "none", "null", "notavailable", "notapplicable", "notknown", "notspecified", "unspecified",
             "unknown", "undefined", "missing", "pending", "tbd", "tba", "todo", "x", "xx", "xxx")
# Fixed value: the country code of an unknown country.
NO_COUNTRY = "zz"


def usable_element(field: str, x: Column) -> Column:
    """Whether an element says something: not null, blank, without letter or digit, or a stand-in."""
    if field == "source_ror_ids":  # an address needs an id behind the host
        x = F.regexp_replace(F.trim(F.lower(x)), r"^(?:[a-z]+://)?(?:www\.)?ror\.[a-z]+/*|^[a-z]+://[^/]*/*", "")
    bare = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")
    ok = ~bare.isin(*STAND_INS)
    if field == "source_country_codes":
        ok = ok & (bare != NO_COUNTRY)
    return F.coalesce(ok, F.lit(False))


def _keeper(field: str):
    return lambda x: usable_element(field, x)


def usable(field: str) -> Column:
    """Whether a list has at least one usable element; a null or empty list has none."""
    return F.coalesce(F.exists(field, _keeper(field)), F.lit(False))


def ranked_fields(records: DataFrame, trust: DataFrame) -> DataFrame:
    """The surviving record of each institution and field, for all institutions.

    Columns: institution_id, field_name, record_id, value (list). Records without record_id or
    without a short institution id do not compete; exact repeats change nothing. A source that is
    null or not in ``trust`` ranks last; of repeated rows of ``trust`` the lowest rank holds.
    """
    t = trust.filter("metadata_source is not null").groupBy(F.col("metadata_source").alias("_src")).agg(F.min("trust_rank").alias("_rank"))
    r = records.select(
        short_id("institution_id").alias("institution_id"), "record_id", F.col("metadata_source").alias("_src"),
        instant_micros("openalex_updated_date").alias("_at"), *FIELDS,
    ).filter("institution_id is not null and record_id is not null")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), usable(f).alias("ok")) for f in FIELDS]))
    r = r.join(t, "_src", "left").select("institution_id", "record_id", "_rank", "_at", each.alias("e")).select("institution_id", "record_id", "_rank", "_at", "e.*")
    best = top_one(r.filter("ok"), ["institution_id", "field_name"], F.asc_nulls_last("_rank"), F.desc_nulls_last("_at"), F.asc("record_id"), F.asc("value"))
    return best.select("institution_id", "field_name", "record_id", "value")


def field_survivors(records: DataFrame, trust: DataFrame) -> DataFrame:
    """The surviving record of each field, of institutions with two or more record_ids."""
    several = records.select(short_id("institution_id").alias("institution_id"), "record_id").groupBy("institution_id").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi")).filter("lo < hi").select("institution_id")
    return ranked_fields(records, trust).join(several, "institution_id", "left_semi").select("institution_id", "field_name", "record_id")


def surviving_records(records: DataFrame, trust: DataFrame) -> DataFrame:
    """One record for each institution, filled field by field, with the source record of each value.

    Values keep only their usable elements, in order and without repeats; fields without a usable
    value are null. ``completeness`` is the number of filled fields; institutions with no usable
    field at all still have their row.
    """
    all_ids = records.select(short_id("institution_id").alias("institution_id"), "record_id").filter("institution_id is not null and record_id is not null")
    counts = all_ids.distinct().groupBy("institution_id").agg(F.count(F.lit(1)).alias("record_count"))
    best = ranked_fields(records, trust)
    cols = []
    for f in FIELDS:
        mine = F.col("field_name") == f
        value = F.array_distinct(F.filter("value", _keeper(f)))
        cols += [F.first(F.when(mine, value), ignorenulls=True).alias(f), F.max(F.when(mine, F.col("record_id"))).alias(f"{f}_record_id")]
    wide = best.groupBy("institution_id").agg(*cols, F.count(F.lit(1)).alias("completeness"))
    return counts.join(wide, "institution_id", "left").withColumn("completeness", F.coalesce("completeness", F.lit(0)))
