"""References to records that do not exist: an incrementally kept ledger of open references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import instant_micros, short_id
from weftline.operators.nested import emit_tagged
from weftline.operators.skew import join_unique
from weftline.session import Scratch

COMPACT = 8  # tables of an index before they are written as one


@dataclass
class Ledger:
    """Keyed state between batches; every table is written to the shared folder.

    parents: key, seen (the parent index). gone: key (deletions). refs: the log of known references
    (ref, citing, citing_seen), one table a batch. open: the pending orphans (missing, deleted) and
    the late references.
    """

    parents: DataFrame | None = None
    gone: DataFrame | None = None
    refs: DataFrame | None = None
    open: DataFrame | None = None


class OrphanTracker:
    """Ledger for a history that is at hand: a batch probes the whole index in one join.

    For streams, where a batch must not cost more than its own keys, see
    ``streaming.incremental.orphan_changes``. Apply batches of parents, references and deletions to a ``Ledger``.

    New references probe the parent index; arriving parents resolve waiting orphans (a parent that
    arrives after its reference leaves it ``late``); deletions reopen all references to the deleted
    key. Batches come in the order of arrival; any cut of the same history into batches ends in the
    same ledger. Repeats of references, parents and deletions, in one batch or over batches, change
    nothing. Null keys are ignored.
    """

    def __init__(self, spark, scratch: Scratch | None = None):
        self.spark, self.scratch, self.ledger = spark, scratch or Scratch(spark, "orphans"), Ledger()
        self._parts: dict[str, list[DataFrame]] = {"parents": [], "gone": [], "refs": []}

    def _add(self, name: str, new: DataFrame) -> DataFrame:
        """The index with one more table; after ``COMPACT`` tables they are written as one, so plans do not grow with the number of batches."""
        parts = self._parts[name] = [*self._parts[name], new]
        both = parts[0]
        for x in parts[1:]:
            both = both.unionByName(x)
        if len(parts) > COMPACT:
            both = self.scratch.write(both, name)
            self._parts[name] = [both]
        return both

    def step(self, parents: DataFrame, refs: DataFrame, gone: DataFrame) -> Ledger:
        """parents: key, seen; refs: ref, citing, citing_seen; gone: key."""
        s, w = self.ledger, self.scratch.write
        born = parents.filter("key is not null").groupBy("key").agg(F.min("seen").alias("seen"))
        lost = gone.filter("key is not null").select("key").distinct()
        new = refs.filter("ref is not null and citing is not null").groupBy("ref", "citing").agg(F.min("citing_seen").alias("citing_seen"))
        if s.parents is not None:
            born = born.join(s.parents.select("key"), "key", "left_anti")
        if s.gone is not None:
            lost = lost.join(s.gone, "key", "left_anti")
        if s.refs is not None:
            new = new.join(s.refs.select("ref", "citing"), ["ref", "citing"], "left_anti")
        born, lost, new = w(born, "parents"), w(lost, "gone"), w(new, "refs")
        index, dead = self._add("parents", born), self._add("gone", lost)

        probe = index.select(F.col("key").alias("ref"), "seen", F.lit(True).alias("there")).join(
            dead.select(F.col("key").alias("ref"), F.lit(True).alias("dead")), "ref", "full"
        )
        found = join_unique(new, probe, "ref", "left")
        late = F.col("seen") > F.col("citing_seen")
        status = F.when(F.col("dead"), "deleted").when(F.col("there").isNull(), "missing").when(late, "late")
        opened = found.withColumn("status", status).filter("status is not null").select("ref", "citing", "citing_seen", "status")
        if s.open is not None:
            came = born.select(F.col("key").alias("ref"), "seen", F.lit(True).alias("there")).join(
                lost.select(F.col("key").alias("ref"), F.lit(True).alias("dead")), "ref", "full"
            )
            kept = join_unique(s.open, came, "ref", "left")
            became = F.when(F.col("dead"), "deleted").when((F.col("status") == "missing") & F.col("there"), F.when(late, "late")).otherwise(F.col("status"))
            kept = kept.withColumn("status", became).filter("status is not null").select("ref", "citing", "citing_seen", "status")
            again = s.refs.join(lost.select(F.col("key").alias("ref")), "ref", "left_semi").join(s.open.select("ref", "citing"), ["ref", "citing"], "left_anti")
            opened = opened.unionByName(kept).unionByName(again.withColumn("status", F.lit("deleted")))
        opened = w(opened, "open")
        self.scratch.drop(s.open)
        self.ledger = Ledger(index, dead, self._add("refs", new), opened)
        return self.ledger

    def snapshot(self) -> DataFrame:
        """Open references by status and month of the citing record's arrival (null where unknown)."""
        return counts_by_month(self.ledger.open)


def counts_by_month(opened: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("citing_seen") / 86_400_000_000).cast("int"))  # in UTC, whatever the session's zone
    month = F.date_format(day, "yyyy-MM")
    return opened.groupBy(month.alias("arrival_month"), "status").agg(
        F.count(F.lit(1)).alias("reference_count"), F.count_distinct("citing").alias("citing_work_count"), F.count_distinct("ref").alias("referenced_work_count")
    )


def work_references(works: DataFrame) -> DataFrame:
    """(work_id, referenced) for every delivered reference with a short id, read by the tagged emission."""
    refs = emit_tagged(works.withColumn("work_id", short_id("work_id")), "work_id", kinds=["reference"])
    return refs.filter("work_id is not null and item_key <> ''").select("work_id", F.col("item_key").alias("referenced"))


def track_works(works: DataFrame, tombstones: DataFrame, batches: int = 2, snapshots: bool = False) -> DataFrame:
    """The ledger's open references after the whole history, fed in ``batches`` periods of arrival.

    Periods are cut at equal ranks of the works' earliest arrival, so that later batches never
    bring an earlier sighting; deletions fall into the period of ``deleted_at``. Unreadable or
    missing times belong to the last period, and a reference whose times are not both known is not
    late. With ``snapshots`` the counts after each period are returned instead.
    """
    spark = works.sparkSession
    scratch = Scratch(spark, "p4")
    seen = scratch.write(works.select(short_id("work_id").alias("key"), instant_micros("source_retrieved_at_utc").alias("seen")).filter("key is not null").groupBy("key").agg(F.min("seen").alias("seen")), "seen")
    refs = scratch.write(work_references(works).distinct().withColumnsRenamed({"work_id": "citing", "referenced": "ref"}), "read")  # the JSON is read once
    refs = scratch.write(join_unique(refs, seen.select(F.col("key").alias("citing"), F.col("seen").alias("citing_seen")), "citing", "left"), "told")
    gone = tombstones.select(short_id("work_id").alias("key"), F.unix_micros(F.col("deleted_at").cast("timestamp")).alias("at"))
    cuts = []
    if batches > 1:
        ranks = [i / batches for i in range(1, batches)]
        cuts = sorted(set(seen.agg(F.percentile_approx("seen", F.array(*map(F.lit, ranks)), 1000)).first()[0] or []))
    bounds = [None, *cuts, None]

    def part(df: DataFrame, c: str, lo: int | None, hi: int | None) -> DataFrame:
        if lo is not None:
            df = df.filter(F.col(c).isNull() | (F.col(c) >= lo)) if hi is None else df.filter(F.col(c) >= lo)
        return df if hi is None else df.filter(F.col(c) < hi)

    tracker, shots = OrphanTracker(spark, scratch), []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        tracker.step(part(seen, "seen", lo, hi), part(refs, "citing_seen", lo, hi), part(gone, "at", lo, hi).select("key"))
        if snapshots:
            shot = tracker.snapshot().withColumn("period", F.lit(i + 1)).withColumn("period_end", F.timestamp_micros(F.lit(hi).cast("long")))
            shots.append(scratch.write(shot, "snapshot"))
    if snapshots:
        out = shots[0]
        for x in shots[1:]:
            out = out.unionByName(x)
        return out
    return tracker.ledger.open


def orphan_references(works: DataFrame, tombstones: DataFrame, batches: int = 2) -> DataFrame:
    """Distinct references that lead nowhere, with their status: deleted, missing or late."""
    o = track_works(works, tombstones, batches)
    return o.select(F.col("citing").alias("work_id"), F.col("ref").alias("referenced_work_id"), "status")


def orphan_counts(works: DataFrame, tombstones: DataFrame, batches: int = 2) -> DataFrame:
    """Counts per status and month of the citing work's arrival."""
    return counts_by_month(track_works(works, tombstones, batches))
