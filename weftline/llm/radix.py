"""Duplicates hidden by formatting: radix partitioning on canonical bytes, tries with terminal counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.skew import block_pairs, join_unique
from weftline.session import Scratch

FIELD_END = "\x1f"
CAPACITY = 10_000  # most keys in a bucket that is not split further, whatever the size of the table
STEP = 6  # bytes that a split looks at


def canonical_text(c: Column | str) -> Column:
    """Text without white space, case and punctuation; accents, letters, marks and digits stay. Null stays null."""
    folded = F.translate(F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.regexp_replace(folded, r"[\p{P}\p{Z}\p{Cc}\p{Cf}\s$+<=>^`|~]", "")


def canonical_doi(c: Column | str) -> Column:
    """A DOI without resolver address or label, canonical as text; null and blank give the empty text."""
    bare = F.regexp_replace(F.lower(c), r"(?s)^.*?(?=10\.\d+)", "")
    return F.coalesce(canonical_text(bare), F.lit(""))


class Trie:
    """A byte trie with path compression; terminals count records and keep the smallest id."""

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        self.root: list = [b"", {}, 0, None]  # label, children by first byte, count, smallest id
        self.size = 0

    def add(self, key: bytes, n: int, who: str) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, n, who]
                self.size += 1
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            i, most = 1, min(len(label), end - at)
            while i < most and label[i] == key[at + i]:
                i += 1
            fork = [label[:i], {label[i]: child}, 0, None]
            child[0] = label[i:]
            node[1][key[at]] = fork
            node, at = fork, at + i
        if not node[2]:
            self.size += 1
        node[2] += n
        node[3] = who if node[3] is None else min(node[3], who)

    def terminals(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[2]:
                yield key, node[2], node[3]
            stack.extend((c, key) for c in node[1].values())


_COUNTED = "key binary, copies long, who string"


def _out(trie: Trie) -> Iterator[pa.RecordBatch]:
    rows = list(trie.terminals())
    for i in range(0, len(rows), 10_000):
        k, n, w = zip(*rows[i : i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(w, pa.string())], names=["key", "copies", "who"])


def _partial(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """One trie for what a task sees; emptied at ``most`` terminals, so memory is bounded."""
    trie = Trie()
    for b in batches:
        for key, n, who in zip(*(c.to_pylist() for c in b.columns)):
            trie.add(key, n, who)
        if trie.size >= most:
            yield from _out(trie)
            trie = Trie()
    yield from _out(trie)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: a trie for each bucket, emitted where the bucket ends."""
    trie, now = Trie(), None
    for b in batches:
        for bucket, key, n, who in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now:
                yield from _out(trie)
                trie, now = Trie(), bucket
            trie.add(key, n, who)
    yield from _out(trie)


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of bytes at the start that two keys have in common."""
    return pd.Series([next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))) for p, q in zip(a, b)], dtype="int32")


def radix_buckets(keys: DataFrame, scratch: Scratch, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """``keys`` (key, binary, and any other columns) with their ``bucket``, each of at most ``capacity`` rows.

    Starts with the first ``step`` bytes. Every bucket that is too large is split by ``step`` bytes
    from where its smallest and its largest key part, so that no round is spent on bytes that all its
    keys share, however long they are; again and again until each fits. A bucket of equal keys needs
    no split. What is too large is a table and not a list on the driver; only it is read again.
    """
    rows, ready = scratch.write(keys.withColumn("bucket", F.hex(F.substring("key", 1, step))), "split"), []
    while True:
        big = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > capacity).select("bucket")
        big = scratch.write(big, "big")
        if big.isEmpty():
            ready.append(rows)
            break
        ends = join_unique(rows, big, "bucket", "inner").groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi")
        ends = scratch.write(ends.select("bucket", _common("lo", "hi").alias("cut")), "ends")
        told = scratch.write(join_unique(rows, ends, "bucket", "left"), "told")
        ready.append(told.filter("cut is null").drop("cut"))
        if ends.isEmpty():
            break
        deeper = F.concat_ws("/", "bucket", "cut", F.hex(F.substring(F.col("key"), F.col("cut") + 1, F.lit(step))))
        rows = scratch.write(told.filter("cut is not null").withColumn("bucket", deeper).drop("cut"), "split")
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    return out


def canonical_classes(df: DataFrame, id_column: str, fields: list[Column], *, capacity: int = CAPACITY, step: int = STEP, name: str = "radix") -> tuple[DataFrame, DataFrame]:
    """(members: id, key; classes: key, copies, representative) of equal canonical fields.

    ``fields`` are canonical texts; they are joined to one key of bytes. Rows with a null id or a
    null field belong to no class; empty texts are values. An id counts once for a key however
    often it is delivered. ``copies`` is the number of ids, ``representative`` the smallest id.

    Keys are counted in a trie per task before anything else, so a key that holds a third of all
    rows is one row a task from then on; buckets are split by what is left, and merge in tries of
    their own.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, name)
    key = F.concat(*[x for f in fields for x in (f, F.lit(FIELD_END))]).cast("binary")
    members = df.select(F.col(id_column).alias("id"), key.alias("key")).filter("id is not null and key is not null").distinct()
    members = scratch.write(members, "members")
    counted = members.select("key", F.lit(1).cast("long").alias("copies"), F.col("id").cast("string").alias("who")).mapInArrow(_partial, _COUNTED)
    buckets = radix_buckets(counted, scratch, capacity, step).select("bucket", "key", "copies", "who")
    merged = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge, _COUNTED)
    return members, scratch.write(merged.withColumnRenamed("who", "representative"), "classes")


def _work_classes(works: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    rows = works.select("work_id", "title", "doi")
    return canonical_classes(rows, "work_id", [canonical_text("title"), canonical_doi("doi")], name="p1", **kw)


def duplicate_works(works: DataFrame, **kw) -> DataFrame:
    """One row for each record of ``works``: representative work_id, title and doi, and its number of work_ids.

    Works with null title or null work_id are no record here. Repeated deliveries do not count.
    """
    members, classes = _work_classes(works, **kw)
    first = works.groupBy("work_id").agg(F.min_by("title", F.struct("title", "doi")).alias("title"), F.min_by("doi", F.struct("title", "doi")).alias("doi"))
    one = classes.select(F.col("representative").alias("work_id"), "copies")
    return one.join(first, "work_id").select("work_id", "title", "doi", F.col("copies").alias("work_id_count"))


def duplicate_membership(works: DataFrame, **kw) -> DataFrame:
    """(work_id, representative_work_id, work_id_count) of every work with a title: classes, not pairs."""
    members, classes = _work_classes(works, **kw)
    out = join_unique(members, classes, "key", "inner")
    return out.select(F.col("id").alias("work_id"), F.col("representative").alias("representative_work_id"), F.col("copies").alias("work_id_count"))


def duplicate_pairs(works: DataFrame, **kw) -> DataFrame:
    """Every pair of work_ids of one record; large groups are paired in blocks."""
    members, classes = _work_classes(works, **kw)
    several = classes.filter("copies > 1").select("key", "representative")
    m = join_unique(members, several, "key", "inner").select("representative", "id")
    pairs = block_pairs(m, "representative", "id")
    return pairs.select(F.col("a").alias("work_id_a"), F.col("b").alias("work_id_b"))
