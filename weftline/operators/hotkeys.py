"""Per-key results where a few keys hold most rows: value-frequency compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import join_null_safe
from weftline.session import Scratch


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): each distinct value of a key once, with its number of rows.

    Grouped by key AND value, with partial sums before the shuffle, so a hot key is spread over as
    many tasks as it has values. Nulls are a value of their own.
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def endpoints(edges: DataFrame, *values: str) -> DataFrame:
    """Both ends of each edge as rows: endpoint, institution_id, partner_id and the wanted columns."""
    ends = F.explode(F.array(
        F.struct(F.lit("source_id").alias("endpoint"), F.col("source_id").alias("institution_id"), F.col("target_id").alias("partner_id")),
        F.struct(F.lit("target_id").alias("endpoint"), F.col("target_id").alias("institution_id"), F.col("source_id").alias("partner_id")),
    ))
    return edges.select(ends.alias("e"), *values).select("e.*", *values)


def _slot(v: Column, fine: int) -> Column:
    """A bucket number that never falls as v rises; equal values share it."""
    up = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0)) * fine).cast("long") + 40_000 * fine
    return F.when(v == 0, F.lit(0)).when(v > 0, up).otherwise(-up)


def _within(rows: DataFrame, keys: list[str], q: float | None) -> DataFrame:
    """The rows (keys, value, _w, _s slot[, _want]) whose slot holds the wanted rank of their key.

    Only histograms are ranked, never values. ``_want`` is the rank within the rows that are left.
    """
    hist = rows.groupBy(*keys, "_s").agg(F.sum("_w").alias("_n"), *([] if q is not None else [F.max("_want").alias("_rank")]))
    w = Window.partitionBy(*keys)
    run = hist.withColumns({"_to": F.sum("_n").over(w.orderBy("_s")), "_all": F.sum("_n").over(w)})
    if q is not None:
        run = run.withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_all") * q)))
    pick = run.filter((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_n") < F.col("_rank")))
    pick = pick.select(*keys, "_s", (F.col("_rank") - (F.col("_to") - F.col("_n"))).alias("_want"))
    return join_null_safe(rows.drop("_want"), pick, [*keys, "_s"]).drop("_s")  # a null key is a key


def weighted_percentile(c: DataFrame, keys: list[str], value: str, q: float, n: str = "n", most: int = 100_000) -> DataFrame:
    """Exact lower percentile of each key from compressed rows: the smallest value with rank >= q * rows.

    Selection by histograms: one over value buckets (at most some 100,000 a key) names each key's
    bucket; as long as a key has more than ``most`` values left, a histogram of 4,096 slots between
    the smallest and the largest of them leaves one slot. Only then are values ranked, so no task
    ever ranks more than ``most`` values of a key, however close they are. Null values and NaN are
    left out; a key without values has no row.
    """
    scratch = Scratch(c.sparkSession, "percentile")
    v = F.col(value)
    ok = c.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, value, F.col(n).alias("_w"), _slot(v, 16).alias("_s"))
    left, ready = scratch.write(_within(ok, keys, q), "left"), []
    while True:
        span = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        wide = scratch.write(span.filter((F.col("_k") > most) & (F.col("_lo") < F.col("_hi"))).drop("_k"), "wide")
        if wide.isEmpty():
            ready.append(left)
            break
        ready.append(join_null_safe(left, wide.withColumn("_wide", F.lit(True)), keys, "left").filter("_wide is null").drop("_wide", "_lo", "_hi"))
        at = F.floor((v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * 4096)
        slot = F.when(v == F.col("_lo"), -1).when(v == F.col("_hi"), 4097).otherwise(F.coalesce(F.nanvl(at.cast("double"), F.lit(0.0)), F.lit(0.0))).cast("int")
        rows = join_null_safe(left, wide, keys).withColumn("_s", slot).drop("_lo", "_hi")
        left = scratch.write(_within(rows, keys, None), "left")
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    out = out.withColumn("_to", F.sum("_w").over(Window.partitionBy(*keys).orderBy(value)))
    return out.filter("_to >= _want").groupBy(*keys).agg(F.min(value).alias(f"{value}_p{round(q * 100)}"))


def endpoint_profile(edges: DataFrame) -> DataFrame:
    """Edge counts, weights and partners of each institution at each endpoint of the edges.

    All rows count, repeats and rows with a null partner or weight too; the key null is a key.
    ``partner_count`` is the exact number of distinct non-null partners, ``top_partner_id`` the one
    with most rows (smallest id on ties), ``weight_sum`` and ``weight_p50`` leave out null weights
    (NaN too for the median); ``share`` is of all rows of the table.
    """
    scratch = Scratch(edges.sparkSession, "p5")
    keys = ["endpoint", "institution_id"]
    pairs = edges.groupBy("source_id", "target_id", "layer_weight").agg(F.count(F.lit(1)).alias("m"))
    pairs = scratch.write(pairs, "pairs")  # each distinct edge value once
    ends = endpoints(pairs, "layer_weight", "m")
    by_partner = ends.groupBy(*keys, "partner_id").agg(
        F.sum("m").alias("n"), F.sum(F.col("layer_weight") * F.col("m")).alias("w"), F.sum(F.when(F.col("layer_weight").isNotNull(), F.col("m"))).alias("nw")
    )
    prof = by_partner.groupBy(*keys).agg(
        F.sum("n").alias("edge_count"), F.coalesce(F.sum("nw"), F.lit(0)).alias("weighted_edge_count"), F.sum("w").alias("weight_sum"),
        F.count("partner_id").alias("partner_count"), F.max(F.when(F.col("partner_id").isNotNull(), F.col("n"))).alias("top_partner_edge_count"),
        F.min_by("partner_id", F.when(F.col("partner_id").isNotNull(), F.struct(-F.col("n"), F.col("partner_id")))).alias("top_partner_id"),
    )
    med = weighted_percentile(ends.groupBy(*keys, "layer_weight").agg(F.sum("m").alias("n")), keys, "layer_weight", 0.5)
    total = pairs.agg(F.sum("m").alias("_rows"))  # one row
    out = join_null_safe(prof, med.withColumnRenamed("layer_weight_p50", "weight_p50"), keys, "left")
    rows = total.first()[0] or 0
    return out.withColumn("share", F.col("edge_count") / F.lit(float(max(1, rows))))


def hot_endpoints(edges: DataFrame, share: float = 1 / 50) -> DataFrame:
    """Institutions that stand at an endpoint in at least ``share`` of all rows; null is no institution."""
    c = endpoints(compress(edges, ["source_id"], "target_id"), "n")
    by_key = c.groupBy("endpoint", "institution_id").agg(F.sum("n").alias("n"))
    rows = edges.count()
    per = round(1 / share)
    return by_key.filter(F.col("institution_id").isNotNull() & (F.col("n") * per >= rows)).select("endpoint", "institution_id")
