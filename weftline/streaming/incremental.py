"""The incremental face: Structured Streaming over the same operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions import instant_micros, short_id
from weftline.operators.corpus import reject_reason
from weftline.operators.nested import emit_tagged

SALTS = 4  # parts of a referenced key in the orphan stream
_NEVER = (1 << 63) - 1  # a key that is there, but nobody knows since when


def stream_tables(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_deliveries(works: DataFrame, delay: str = "30 days") -> DataFrame:
    """Streaming first-wins: one row a work_id within the watermark; late repeats beyond it are dropped from state."""
    at = F.timestamp_micros(instant_micros("source_retrieved_at_utc"))
    return works.filter(reject_reason().isNull()).withColumn("delivered_at", at).withWatermark("delivered_at", delay).dropDuplicatesWithinWatermark(["work_id"])


def event_windows(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums of each event type over tumbling or sliding windows, late rows up to ``delay`` included."""
    w = F.window("ts", width, slide or width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("value_sum")).select(F.col("window.start").alias("window_start"), "event_type", "event_count", "value_sum")


def event_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events with no gap longer than ``gap``."""
    s = F.session_window("ts", gap)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(s, "user_id").agg(F.count(F.lit(1)).alias("event_count")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "event_count")


def run_quarantine(works: DataFrame, good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Split a stream of deliveries into good rows and rejects with reason; both sinks are written once a batch."""

    def both(batch: DataFrame, epoch: int) -> None:
        r = batch.withColumn("reason", reject_reason())
        r.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{good_path}/batch={epoch}")
        r.filter("reason is not null").write.mode("overwrite").parquet(f"{bad_path}/batch={epoch}")

    return works.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "seen long, gone boolean, citing array<string>, citing_seen array<long>, told array<string>"
_CHANGE = "ref string, citing string, citing_seen long, status string"


def orphan_events(works: DataFrame, tombstones: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Works (and tombstones) as events of the referenced keys: key, salt, kind, citing, seen.

    A reference goes to one of ``salts`` parts of its key, by its citing work; what happens to the key
    itself goes to all of them. So a key that a third of all references name is spread over tasks.
    """
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    seen = instant_micros("source_retrieved_at_utc")
    none = F.lit(None).cast("string")
    parents = works.select(short_id("work_id").alias("key"), everywhere.alias("salt"), F.lit("parent").alias("kind"), none.alias("citing"), seen.alias("seen"))
    told = works.withColumn("_seen", F.coalesce(seen.cast("string"), F.lit(""))).withColumn("work_id", F.concat_ws("|", short_id("work_id"), "_seen"))
    refs = emit_tagged(told, "work_id", kinds=["reference"]).filter("item_key <> ''")
    citing = F.split("work_id", r"\|")
    refs = refs.select(F.col("item_key").alias("key"), F.get(citing, 0).alias("citing"), F.nullif(F.get(citing, 1), F.lit("")).cast("long").alias("seen")).filter("citing <> ''")
    refs = refs.select("key", F.pmod(F.xxhash64("citing"), F.lit(salts)).cast("int").alias("salt"), F.lit("reference").alias("kind"), "citing", "seen")
    out = parents.unionByName(refs)
    if tombstones is not None:
        out = out.unionByName(tombstones.select(short_id("work_id").alias("key"), everywhere.alias("salt"), F.lit("deletion").alias("kind"), none.alias("citing"), F.lit(None).cast("long").alias("seen")))
    return out.filter("key is not null")


def orphan_changes(events: DataFrame) -> DataFrame:
    """Changes of status of references, as a stream: ref, citing, citing_seen, status (``resolved`` where it is no orphan any more).

    State is kept by key in the checkpoint of the stream: when the key was first seen, whether it is
    deleted, and who waits for it. A batch costs what its own keys cost, however long the history,
    and a restart goes on from the checkpoint. The status follows from the state alone (deleted, else
    missing, else late if the key's first sight is after the citing record's), so the order of events
    does not matter, and repeats change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, gone, citing, at, told = state.get if state.exists else (None, False, [], [], [])
        known = {c: [a, t] for c, a, t in zip(citing, at, told)}
        for pdf in batches:
            for kind, who, when in zip(pdf["kind"], pdf["citing"], pdf["seen"]):
                when = None if pd.isna(when) else int(when)
                if kind == "deletion":
                    gone = True
                elif kind == "parent":
                    seen = min((x for x in (seen, when) if x is not None), default=_NEVER)
                else:
                    own = known.setdefault(who, [when, "resolved"])
                    own[0] = min((x for x in (own[0], when) if x is not None), default=None)
        out = []
        for who, own in known.items():
            late = seen not in (None, _NEVER) and own[0] is not None and seen > own[0]
            now = "deleted" if gone else "missing" if seen is None else "late" if late else "resolved"
            if now != own[1]:
                own[1] = now
                out.append((key[0], who, own[0], now))
        state.update((seen, gone, list(known), [x[0] for x in known.values()], [x[1] for x in known.values()]))
        if out:
            yield pd.DataFrame(out, columns=["ref", "citing", "citing_seen", "status"]).astype({"citing_seen": "Int64"})

    return events.groupBy("key", "salt").applyInPandasWithState(step, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_orphans(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run ``orphan_changes`` over what is there and write the changes of each batch once, to be read by ``orphan_ledger``."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return orphan_changes(events).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The open references after all batches so far: ref, citing, citing_seen, status."""
    log = spark.read.schema(f"{_CHANGE}, epoch long").option("basePath", path).parquet(path)
    last = log.groupBy("ref", "citing").agg(F.max_by(F.struct("citing_seen", "status"), "epoch").alias("x"))
    return last.select("ref", "citing", "x.*").filter("status <> 'resolved'")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream dropped because they came behind its watermark, over the batches it still remembers."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
