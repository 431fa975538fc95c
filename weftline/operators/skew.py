"""Joins and aggregations that do not depend on how evenly keys are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch

HOT_SHARE = 1 / 1000  # so at most 1,000 keys can be hot: the proven bound of what is broadcast


def hot_keys(df: DataFrame, key: str, total: int, min_rows: int = 1_000_000) -> list:
    """Keys that hold at least ``HOT_SHARE`` of ``total`` rows and ``min_rows`` rows; at most 1,000 keys."""
    least = max(min_rows, int(total * HOT_SHARE))
    if total < least:
        return []
    big = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") >= least)
    return [r[0] for r in big.select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left", total: int | None = None, min_rows: int = 1_000_000) -> DataFrame:
    """Join to a table with one row a key, splitting off the left side's hot keys.

    Rows of hot keys meet a broadcast of the (at most 1,000) right rows of these keys; all others
    are shuffled. The result is the same as of a plain join. A null key matches nothing. A left
    side under ``min_rows`` rows can have no hot key and is joined plainly.
    """
    hot = hot_keys(left, key, left.count() if total is None else total, min_rows)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    some = F.broadcast(right.filter(F.col(key).isin(hot)))
    return left.filter(is_hot).join(some, key, how).unionByName(left.filter(~is_hot).join(right, key, how))


def block_pairs(members: DataFrame, key: str, member: str, block: int = 1000, differ: str | None = None) -> DataFrame:
    """Every pair (a < b) of different members of one key, without a task that holds a whole group.

    A group of m members is cut by hash into ceil(m / block) blocks; each pair of blocks is one
    join key of its own, so the work of a large group is spread over many tasks. With ``differ``
    only pairs whose values in that column differ are returned. Members are distinct by
    (key, member[, differ]); null keys and members give no pair.
    """
    scratch = Scratch(members.sparkSession, "pairs")
    m = members.select(key, member, *([differ] if differ else [])).filter(F.col(key).isNotNull() & F.col(member).isNotNull()).distinct()
    lo, hi = (F.min(differ), F.max(differ)) if differ else (F.min(member), F.max(member))
    sizes = m.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), lo.alias("_lo"), hi.alias("_hi")).filter("_lo < _hi").select(key, "_n")
    m = scratch.write(join_unique(m, sizes, key, "inner"), "members")  # only groups with a pair are left
    m = m.withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    m = m.withColumn("_b", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
    lhs = m.withColumn("_o", F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)))
    lhs = lhs.select(key, F.col("_b").alias("_i"), F.col("_o").alias("_j"), F.col(member).alias("_x"), *([F.col(differ).alias("_dx")] if differ else []))
    rhs = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b"))))
    rhs = rhs.select(key, F.col("_o").alias("_i"), F.col("_b").alias("_j"), F.col(member).alias("_y"), *([F.col(differ).alias("_dy")] if differ else []))
    on = F.col("_x") != F.col("_y")
    if differ:
        on = on & (F.col("_dx") != F.col("_dy"))
    same = (F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y"))  # within a block each pair once
    out = lhs.join(rhs, [key, "_i", "_j"]).filter(on & same)
    return out.select(key, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key by ``order``.

    ``row_number() = 1`` lets the planner keep one row a key and task before the shuffle
    (WindowGroupLimit), so a hot key costs no more than any other.
    """
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__weftline_rank__", rn).filter("__weftline_rank__ = 1").drop("__weftline_rank__")
