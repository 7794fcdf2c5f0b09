"""Continuous ingest and deletes from a folder of request files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill import schemas
from passagemill.config import IngestConfig
from passagemill.operators import ingest as ing
from passagemill.session import stage_table
from passagemill.sources.store import LogStore


def apply_batch(batch: DataFrame, notes: DataFrame, passages: DataFrame, cfg: IngestConfig, embed: ing.Embed, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, passages, results) after a batch of upserts and deletes: the last request of each identity counts. A batch that is replayed changes nothing, as its hashes are stored."""
    last = ing.latest_per_identity(ing.normal_requests(batch))
    gone = last.filter("op = 'delete'").join(notes.select(*ing.IDENTITY, F.col("id").alias("note_id")), ing.IDENTITY)
    kept_notes, kept_passages = ing.delete_notes(notes, passages, gone)
    return ing.ingest(last.filter("op <> 'delete'"), kept_notes, kept_passages, cfg, embed, now)


def batch_changes(batch: DataFrame, notes: DataFrame, passages: DataFrame, cfg: IngestConfig, embed: ing.Embed, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(notes written, keys of notes gone, passages of the notes written, results) of a batch, which is the same change as apply_batch makes. notes and passages need only be those of the batch's identities."""
    last = ing.latest_per_identity(ing.normal_requests(batch))
    gone = last.filter("op = 'delete'").select(*ing.IDENTITY).join(notes.select(*ing.IDENTITY, "id"), ing.IDENTITY)
    new_notes, new_passages, results = ing.changes(last.filter("op <> 'delete'"), notes, passages, cfg, embed, now)
    return ing.written_notes(notes, new_notes), gone, new_passages, results


def ingest_stream(spark: SparkSession, requests: str, store: str, checkpoint: str, cfg: IngestConfig, embed: ing.Embed, available_now: bool = True) -> StreamingQuery:
    """A query that applies the request files in requests, as they come, to the store (a LogStore in this folder). A batch reads the buckets of its identities and writes what it changes."""
    held = LogStore(spark, store)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if held.version() >= batch_id:
            return  # replayed after a failure
        batch = stage_table(batch, "feed-batch")  # its files are read once
        buckets = [r[0] for r in ing.normal_requests(batch).select(held.bucket().alias("bucket")).distinct().collect()]
        held.append(batch_id, *batch_changes(batch, *held.read(buckets), cfg, embed))
        held.merge()
        held.collect()

    writer = spark.readStream.schema(schemas.INGEST_REQUESTS).json(requests).writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
