"""Filling fixed-capacity containers: variable-capacity best fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import RANKS, token_counts
from weftline.session import Scratch

SHARD_ITEMS = 50_000
_OUT = "packing string, container_id string, capacity_tokens int, doc_id {id}, piece_index int, piece_tokens int, container_tokens int"


def best_fit(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """(container of each item, (capacity, used) of each container), all sizes at most the largest capacity.

    Items come in falling size. Each goes where it leaves least room; if it fits nowhere, the
    capacity is opened that the items still to come would leave emptiest by share the least (they
    are tried on as counts of sizes, largest first). At the end each container takes the smallest
    capacity that holds its contents. Ties: lower position, larger capacity.
    """
    caps = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = Counter(sizes)
    avail = sorted(left)
    place, used, room_of = [0] * len(sizes), [], []
    rooms: list[int] = []  # distinct rooms of open containers, rising
    by_room: dict[int, list[int]] = {}

    def waste(c: int, s: int) -> float:
        room, hi = c - s, len(avail)
        while room and hi:
            hi = bisect_right(avail, room, 0, hi)
            if not hi:
                break
            x = avail[hi - 1]
            room -= x * min(left[x], room // x)
            hi -= 1
        return room / c

    for i in order:
        s = sizes[i]
        left[s] -= 1
        if not left[s]:
            avail.pop(bisect_left(avail, s))
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            stack = by_room[room]
            box = stack.pop()
            if not stack:
                del by_room[room], rooms[at]
        else:
            fits = caps[bisect_left(caps, s) :]
            cap = fits[0] if len(fits) == 1 else min(fits, key=lambda c: (waste(c, s), -c))
            box, room = len(used), cap
            used.append(0)
            room_of.append(0)
        place[i] = box
        used[box] += s
        room -= s
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(box)
    return place, [(caps[bisect_left(caps, u)], u) for u in used]


def pack(sizes: DataFrame, capacities: dict[str, int], *, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign every item of ``sizes`` (doc_id, tokens) to containers, once for each packing.

    A packing for each capacity alone (named as it is) and, with several, ``mixed``, which uses all
    capacities jointly. An item is split only if it exceeds the packing's largest capacity: into
    full pieces, which fill containers of their own, and a rest. Items are spread by hash over
    shards of about ``shard_items``, each packed by itself: memory is bounded and at most the last
    container of a shard stays unfilled. Items without tokens are left out; an empty table gives no
    rows. ``capacities`` must be positive.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    plans = {k: [c] for k, c in sorted(capacities.items())}
    if len(set(capacities.values())) > 1:
        plans["mixed"] = sorted(set(capacities.values()))
    n = max(1, -(-sizes.count() // shard_items))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("packing"), F.lit(max(c)).cast("int").alias("most")) for k, c in plans.items()]))
    s = sizes.filter("tokens > 0").select("doc_id", F.col("tokens").cast("int").alias("tokens"), each.alias("e")).select("doc_id", "tokens", "e.*")
    s = s.withColumn("piece_index", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("most")).cast("int") - 1)))
    s = s.withColumn("piece_tokens", F.least("most", F.col("tokens") - F.col("piece_index") * F.col("most")))
    full = s.filter("piece_tokens = most").select(
        "packing", F.concat_ws("-", F.lit("f"), "doc_id", "piece_index").alias("container_id"), F.col("most").alias("capacity_tokens"), "doc_id", "piece_index", "piece_tokens", F.col("most").alias("container_tokens")
    )
    rest = s.filter("piece_tokens < most").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    schema = _OUT.format(id=sizes.schema["doc_id"].dataType.simpleString())

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packing, shard = key
        pdf = pdf.sort_values(["doc_id", "piece_index"], ignore_index=True)
        place, boxes = best_fit(pdf["piece_tokens"].tolist(), plans[packing])
        return pd.DataFrame({
            "packing": packing, "container_id": [f"{shard}-{b}" for b in place], "capacity_tokens": [boxes[b][0] for b in place],
            "doc_id": pdf["doc_id"], "piece_index": pdf["piece_index"], "piece_tokens": pdf["piece_tokens"], "container_tokens": [boxes[b][1] for b in place],
        })

    packed = rest.select("packing", "shard", "doc_id", "piece_index", "piece_tokens").groupBy("packing", "shard").applyInPandas(one, schema)
    return packed.unionByName(full)


def _capacities(table: DataFrame) -> dict[str, int]:
    """The permitted capacities; a table of settings, at most 1,000 rows."""
    rows = table.filter("capacity_name is not null and capacity_tokens > 0").select("capacity_name", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 capacities")
    return {r[0]: int(r[1]) for r in rows}


def pack_documents(documents: DataFrame, capacities: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The containers of every document with content, for each capacity and for all jointly (``mixed``)."""
    sizes = Scratch(documents.sparkSession, "p8").write(token_counts(documents, "doc_id", "text", ranks=ranks), "sizes")
    caps = _capacities(capacities)
    name = F.coalesce(*[F.when(F.col("capacity_tokens") == c, F.lit(k)) for k, c in sorted(caps.items())])
    return pack(sizes, caps).withColumn("capacity_name", name)


def packing_summary(documents: DataFrame, capacities: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Containers, tokens and unused share by packing and capacity."""
    p = pack_documents(documents, capacities, ranks)
    boxes = p.groupBy("packing", "container_id", "capacity_name", "capacity_tokens").agg(F.sum("piece_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    out = boxes.groupBy("packing", "capacity_name").agg(F.count(F.lit(1)).alias("container_count"), F.sum("n").alias("piece_count"), F.sum("t").alias("token_count"), F.sum("capacity_tokens").alias("capacity"))
    return out.withColumn("unused_share", 1 - F.col("token_count") / F.col("capacity")).drop("capacity")


def packing_checks(documents: DataFrame, capacities: DataFrame, ranks: str = RANKS) -> DataFrame:
    """A row a packing: documents, and what must not be: containers overfull or larger than needed, pieces lost or too many, room wasted.

    Room is wasted if more than one largest container a shard and a hundredth of all tokens stay empty.
    """
    p = Scratch(documents.sparkSession, "p8").write(pack_documents(documents, capacities, ranks), "packed")
    caps = sorted(set(_capacities(capacities).values()))
    sizes = token_counts(documents, "doc_id", "text", ranks=ranks).select("doc_id", "tokens")
    most = F.when(F.col("packing") == "mixed", F.lit(caps[-1] if caps else 0)).otherwise(F.max("capacity_tokens").over(Window.partitionBy("packing")))
    own = p.withColumn("_most", most).groupBy("packing", "doc_id").agg(F.sum("piece_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("_most").alias("m"), F.count_distinct("piece_index").alias("k")).join(sizes, "doc_id", "full")
    wrong = ~((F.col("t") == F.col("tokens")) & (F.col("n") == F.ceil(F.col("tokens") / F.col("m"))) & (F.col("k") == F.col("n")))
    docs = own.groupBy("packing").agg(F.count(F.lit(1)).alias("document_count"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrong_document_count"))
    boxes = p.groupBy("packing", "container_id").agg(F.max("capacity_tokens").alias("c"), F.sum("piece_tokens").alias("t"), F.max("container_tokens").alias("told"))
    fits = F.array_min(F.filter(F.array(*map(F.lit, caps)), lambda x: x >= F.col("t"))) if caps else F.lit(None).cast("int")
    b = boxes.groupBy("packing").agg(
        F.count_if((F.col("t") > F.col("c")) | (F.col("t") != F.col("told"))).alias("overfull_count"), F.count_if((F.col("packing") == "mixed") & (F.col("c") > fits)).alias("oversized_count"),
        (F.sum("c") - F.sum("t")).alias("_empty"), F.sum("t").alias("_t"), F.max("c").alias("_c"), F.count_distinct(F.regexp_extract("container_id", r"^(\d+)-", 1)).alias("_shards"),
    )
    tight = F.col("_empty") <= F.col("_c") * F.col("_shards") + F.col("_t") / 100
    return docs.join(b, "packing").select("packing", "document_count", "wrong_document_count", "overfull_count", "oversized_count", tight.alias("is_tight"))
