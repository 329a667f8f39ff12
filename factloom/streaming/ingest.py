"""Streams into the store and into the orphan tracker: one commit or one step for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.bags import from_json_text
from factloom.operators import mutate
from factloom.operators.orphans import OrphanTracker, parent_rows, reference_rows
from factloom.runtime import Scratch
from factloom.sources.store import GraphStore


def ingest_entities(stream: DataFrame, store: GraphStore, types: list[str], checkpoint: str, **trigger):
    """Upserts streamed entity inputs (input_id, name, entity_type, properties, confidence); refused rows are left out.

    A micro-batch is one commit, noted with its number, so a batch that is delivered again after a failure is not stored twice.
    """
    store.initialize()

    def step(batch: DataFrame, number: int) -> None:
        if any(n.get("batch") == [checkpoint, number] for n in store.notes()):
            return
        rows = batch.select(F.col("input_id").alias("ord"), F.col("entity_type").alias("label"), "name", from_json_text(F.col("properties")).alias("properties"), "confidence")
        good = mutate.vertex_errors(rows, types).filter("error is null").drop("error")
        new = Scratch(batch.sparkSession, "ingest").write(mutate.upsert_vertices(store.graph().vertices, good))
        store.append(new, note={"batch": [checkpoint, number]})

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def track_orphans(stream: DataFrame, tracker: OrphanTracker, checkpoint: str, **trigger):
    """Feeds a stream of (kind, id, from_id, to_id, ingested_at, deleted_at) rows, kind `parent` or `reference`, to a tracker.

    A micro-batch is one step, committed with its number, so a batch that is delivered again is not taken twice. A tracker whose
    state is kept in a folder goes on after its driver was lost: make it anew with that folder and start the stream again.
    """

    def step(batch: DataFrame, number: int) -> None:
        refs = reference_rows(batch.filter("kind = 'reference'"), "relationships", ["from_id", "to_id"])
        tracker.advance(refs, parent_rows(batch.filter("kind = 'parent'")), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, event_type, n, total) of an event stream (ts, event_type, value); rows later than `late` are dropped by the watermark."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
