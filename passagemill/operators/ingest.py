"""Ingest: skip what is unchanged, split and embed the rest, upsert notes and replace passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill import schemas
from passagemill.config import IngestConfig
from passagemill.functions import text as tx
from passagemill.functions import vectors as vf
from passagemill.operators.split import split_notes
from passagemill.session import stage_table

IDENTITY = ["client_name", "scope", "path_or_uri"]
MUTABLE = ["name", "description", "type", "provenance_kind", "provenance_date", "status", "content_hash", "pipeline_version", "body", "meta", "updated_at"]
#: Passages of a note with an id below SMALL have ids note_id * ROOM + ordinal, so that id order is (note, ordinal) order; those of other notes have hashes.
ROOM, SMALL = 1 << 20, 1 << 43
NOTE = ["client_name", "note_id"]


def note_id(client: Column, scope: Column, path: Column) -> Column:
    """The id of a new note: a stable hash of its identity, not below SMALL. Joins go by (client_name, note_id), so ids need only be unique within a tenant."""
    return F.xxhash64(client, scope, path).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(F.lit(SMALL))


def passage_id(note: Column, ordinal: Column) -> Column:
    return F.when(note < SMALL, note * ROOM + ordinal).otherwise(F.xxhash64(note, ordinal))


def normal_requests(requests: DataFrame) -> DataFrame:
    """requests with scope from its alias, defaults filled in, and op."""
    have = set(requests.columns)
    pick = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    return requests.select(
        pick("request_id", "long").alias("request_id"), pick("arrived_at", "timestamp").alias("arrived_at"), F.coalesce(pick("op", "string"), F.lit("upsert")).alias("op"),
        "client_name", F.coalesce(pick("scope", "string"), pick("repo_name", "string"), F.lit("")).alias("scope"), "path_or_uri", pick("content", "string").alias("content"),
        pick("status", "string").alias("status"), F.coalesce(pick("meta", "string"), F.lit("{}")).alias("meta"), F.coalesce(pick("force", "boolean"), F.lit(False)).alias("force"),
    )


def latest_per_identity(requests: DataFrame) -> DataFrame:
    """The last request of each identity."""
    w = Window.partitionBy(*IDENTITY).orderBy(F.col("arrived_at").desc_nulls_last(), F.col("request_id").desc_nulls_last())
    return requests.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def outcomes(requests: DataFrame, notes: DataFrame, cfg: IngestConfig) -> DataFrame:
    """requests with note_id, content_hash, pipeline_version and outcome: new, changed, forced or skipped. Only the notes' keys are joined, never their bodies."""
    keys = notes.select(*IDENTITY, F.col("id").alias("_id"), F.col("content_hash").alias("_hash"), F.col("pipeline_version").alias("_version"))
    hashed = requests if "content_hash" in requests.columns else requests.withColumn("content_hash", tx.content_hash(F.col("content")))
    both = hashed.withColumn("pipeline_version", tx.pipeline_version(cfg)).join(keys, IDENTITY, "left")
    same = (F.col("content_hash") == F.col("_hash")) & (F.col("pipeline_version") == F.col("_version"))
    outcome = F.when(F.col("_id").isNull(), "new").when(~same, "changed").when(F.col("force"), "forced").otherwise("skipped")
    own = F.coalesce("_id", note_id(*[F.col(c) for c in IDENTITY]))
    return both.withColumn("outcome", outcome).withColumn("note_id", own).drop("_id", "_hash", "_version")


def failed_notes(passages: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """keys and fault of notes of which any passage has a faulty vector."""
    faults = passages.select(*keys, "ordinal", vf.vector_fault(F.col("embedding").cast("array<double>"), width).alias("fault")).filter("fault IS NOT NULL")
    return faults.groupBy(*keys).agg(F.min_by("fault", "ordinal").alias("fault"))


def written_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new as they are written: an identity that is in notes keeps its id and created_at."""
    old = notes.select(*IDENTITY, F.col("id").alias("_id"), F.col("created_at").alias("_at"))
    written = new.join(old, IDENTITY, "left").withColumn("id", F.coalesce("_id", "id")).withColumn("created_at", F.coalesce("_at", "created_at"))
    return written.select(schemas.NOTES.fieldNames())


def upsert_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes with the rows of new written over."""
    kept = notes.join(new.select(*IDENTITY), IDENTITY, "left_anti")
    return kept.select(schemas.NOTES.fieldNames()).unionByName(written_notes(notes, new))


def replace_passages(passages: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """passages without those of the notes in changed (client_name, note_id), with new in their place."""
    return passages.join(changed.select("client_name", "note_id").distinct(), ["client_name", "note_id"], "left_anti").select(*new.columns).unionByName(new)


def delete_notes(notes: DataFrame, passages: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, passages) without the notes of keys (client_name, note_id) and their passages; another tenant's note of that id stays."""
    k = keys.select("client_name", "note_id").distinct()
    return notes.join(k.withColumnRenamed("note_id", "id"), ["client_name", "id"], "left_anti").select(*notes.columns), passages.join(k, ["client_name", "note_id"], "left_anti").select(*passages.columns)


def resolve_callers(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """requests (which have key_hash) with the caller's client_name; null for an unknown or revoked key."""
    live = api_keys.filter("revoked_at IS NULL").select("key_hash", "client_name").dropDuplicates(["key_hash"])
    return requests.join(live, "key_hash", "left")


def lookup_notes(notes: DataFrame, passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The notes of wanted (client_name, id) with passage_count; missing and foreign ids alike give nothing."""
    found = notes.join(wanted.select("client_name", "id").distinct(), ["client_name", "id"], "left_semi")
    counts = passage_counts(passages)
    return found.join(counts, [found["id"] == counts["note_id"], found["client_name"] == counts["client_name"]], "left").select(found["*"], F.coalesce("passages", F.lit(0)).alias("passage_count"))


def passage_counts(passages: DataFrame) -> DataFrame:
    return passages.groupBy("client_name", "note_id").agg(F.count("*").alias("passages"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row: considered, ingested, skipped, failed, total_passages of results (outcome, passages)."""
    is_ = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return results.agg(F.count("*").alias("considered"), is_("new", "changed", "forced").alias("ingested"), is_("skipped").alias("skipped"), is_("failed", "rejected").alias("failed"), F.coalesce(F.sum("passages"), F.lit(0)).alias("total_passages"))


Embed = Callable[[Column], Column]


def ingest(requests: DataFrame, notes: DataFrame, passages: DataFrame, cfg: IngestConfig, embed: Embed, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, passages, results) after requests."""
    new_notes, new_passages, results = changes(requests, notes, passages, cfg, embed, now)
    return upsert_notes(notes, new_notes), replace_passages(passages, new_notes.select("client_name", F.col("id").alias("note_id")), new_passages), results


def changes(requests: DataFrame, notes: DataFrame, passages: DataFrame, cfg: IngestConfig, embed: Embed, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new notes, their passages, results) of requests to a store that holds notes and passages. results: request_id, identity, note_id, outcome, fault, passages.

    The skip join comes before splitting and embedding, so that only new and changed notes pay for them. Requests are staged with their hashes, as they are read several times: what they are derived from runs once, and of their contents only the split reads any. Split notes and embedded passages are staged: each passage is embedded once, and the vectors that are stored are those that were checked. A note with a faulty vector fails as a whole and keeps what it had.
    """
    now = now if now is not None else F.current_timestamp()
    r = normal_requests(requests)
    r = r.withColumn("fault", tx.request_fault(F.col("scope"), F.col("path_or_uri"), F.col("content"), F.col("status"), cfg))
    r = stage_table(r.withColumn("content_hash", tx.content_hash(F.col("content"))), "ingest-requests")
    rejected = r.filter("fault IS NOT NULL")
    good = outcomes(latest_per_identity(r.filter("fault IS NULL")), notes, cfg)
    work = stage_table(split_notes(good.filter("outcome <> 'skipped'")).drop("content", "fault"), "ingest-notes")
    pieces = work.select("note_id", "client_name", "scope", "name", F.explode("passages").alias("p")).select("note_id", "client_name", "scope", "name", "p.*")
    # Long notes would pin one embedder; passages are dealt out evenly.
    pieces = pieces.repartition(F.xxhash64("note_id", "ordinal"))
    embedded = pieces.withColumn("embedding", embed(tx.embedding_input(F.col("name"), F.col("heading_path"), F.col("content"))))
    embedded = stage_table(embedded, "ingest-passages")
    bad = failed_notes(embedded, cfg.dimension, NOTE)
    fine = work.join(bad, NOTE, "left_anti")
    new_notes = fine.select(
        F.col("note_id").alias("id"), *IDENTITY, "name", "description", "type", "provenance_kind", "provenance_date", "status", "content_hash", "pipeline_version", "body", "meta",
        now.alias("created_at"), now.alias("updated_at"),
    )
    new_passages = embedded.join(bad, NOTE, "left_anti").select(
        passage_id(F.col("note_id"), F.col("ordinal")).alias("id"), "note_id", "client_name", "scope", "ordinal", "heading_path", "content", F.col("embedding").cast("array<float>").alias("embedding"),
        vf.degenerate(F.col("embedding").cast("array<float>")).alias("embedding_degenerate"),
    )
    stored = passage_counts(passages).select(*NOTE, F.col("passages").alias("stored"))
    results = (
        good.drop("fault").join(bad, NOTE, "left").join(work.select(*NOTE, F.size("passages").alias("made")), NOTE, "left").join(stored, NOTE, "left")
        .select("request_id", *IDENTITY, "note_id", F.when(F.col("fault").isNotNull(), "failed").otherwise(F.col("outcome")).alias("outcome"), "fault",
                F.when(F.col("fault").isNotNull(), F.lit(0)).when(F.col("outcome") == "skipped", F.coalesce("stored", F.lit(0))).otherwise(F.coalesce("made", F.lit(0))).cast("long").alias("passages"))
        .unionByName(rejected.select("request_id", *IDENTITY, F.lit(None).cast("long").alias("note_id"), F.lit("rejected").alias("outcome"), "fault", F.lit(0).cast("long").alias("passages")))
    )
    return new_notes, new_passages, results
