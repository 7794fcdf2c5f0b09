"""Queries of the store side: ingest, joins, audits, vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import schemas
from passagemill.config import IngestConfig
from passagemill.functions import vectors as vf
from passagemill.operators import audit, ingest
from passagemill.plans import tables as t
from passagemill.session import shared_folder, stage_table
from passagemill.sources import corpus
from passagemill.sources.store import LogStore
from passagemill.streaming import feed

WIDTH = 64
CFG = IngestConfig(dimension=16, backend="hash")
READ = f"WITH {t.RAW}, {t.READ}\n"


def _now():
    return F.lit("2026-11-01 00:00:00").cast("timestamp")


def _requests(s: SparkSession, d: str) -> DataFrame:
    """Requests for every note; every third content changes, every fifth is forced, every 17th has a path that is refused; every 4th note is asked for twice, the earlier time with other content."""
    n = t.raw_notes(s, d)
    path = F.when(F.col("id") % 17 == 3, F.concat(F.lit("/"), "path_or_uri")).otherwise(F.col("path_or_uri"))
    content = F.when(F.col("id") % 3 == 0, F.concat("content", F.lit("\n\nAn addition."))).otherwise(F.col("content"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    r = n.select(F.col("id").alias("request_id"), at.alias("arrived_at"), F.lit("upsert").alias("op"), "client_name", "scope", F.lit(None).cast("string").alias("repo_name"), path.alias("path_or_uri"), content.alias("content"), F.lit("new").alias("status"), F.lit(None).cast("string").alias("meta"), (F.col("id") % 5 == 0).alias("force"))
    early = r.filter("request_id % 4 = 0").withColumn("content", F.lit("an earlier text")).withColumn("arrived_at", F.timestamp_seconds(F.lit(1_600_000_000))).withColumn("request_id", -F.col("request_id") - 1)
    return r.unionByName(early)


def _notes(s: SparkSession, d: str) -> DataFrame:
    """The stored notes: those of even number, the tenth ones from an older pipeline."""
    n = t.read_notes(s, d).filter("id % 2 = 0")
    null = lambda k: F.lit(None).cast(k)
    version = F.when(F.col("id") % 10 == 0, F.lit("s2+fts1+ei1+hash+16")).otherwise(F.lit(CFG.pipeline_version))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return n.select("id", "client_name", "scope", "path_or_uri", "name", "description", "type", null("string").alias("provenance_kind"), null("date").alias("provenance_date"), null("string").alias("status"), F.sha2("content", 256).alias("content_hash"), version.alias("pipeline_version"), "body", F.lit("{}").alias("meta"), at.alias("created_at"), at.alias("updated_at"))


def _passages(s: SparkSession, d: str) -> DataFrame:
    """Two passages for each stored note: the halves of its body; every ninth has a scope that isn't its note's."""
    return _passages_of(_notes(s, d))


def _passages_of(n: DataFrame) -> DataFrame:
    halves = F.array(F.expr("substring(body, 1, length(body) div 2)"), F.expr("substring(body, length(body) div 2 + 1)"))
    p = n.select(F.col("id").alias("note_id"), "client_name", F.when(F.col("id") % 9 == 0, F.lit("elsewhere")).otherwise(F.col("scope")).alias("scope"), F.posexplode(halves).alias("ordinal", "content"))
    return p.select((F.col("note_id") * ingest.ROOM + F.col("ordinal")).alias("id"), "note_id", "client_name", "scope", "ordinal", F.lit(None).cast("string").alias("heading_path"), "content", F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("embedding_degenerate"))


def w2_latest_request(s, d):
    return ingest.latest_per_identity(ingest.normal_requests(_requests(s, d))).select("request_id", "client_name", "scope", "path_or_uri")


def f7_outcomes(s, d):
    o = ingest.outcomes(ingest.latest_per_identity(ingest.normal_requests(_requests(s, d))), _notes(s, d), CFG)
    return o.select("request_id", "outcome", "content_hash")


def j2_identity_lookup(s, d):
    r = ingest.normal_requests(_requests(s, d))
    return r.join(_notes(s, d).select(*ingest.IDENTITY, "id", "content_hash"), ingest.IDENTITY, "left").select("request_id", "id", "content_hash")


def _keys(s, d):
    c = t.table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("key_hash"), F.concat(F.lit("client"), F.col("c_custkey") % 7).alias("client_name"), F.when(F.col("c_custkey") % 5 == 0, F.lit("2026-01-01").cast("timestamp")).alias("revoked_at"))


def j3_callers(s, d):
    r = t.table(s, d, "orders").select("o_orderkey", F.sha2((F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 1_000_000_000).otherwise(0)).cast("string"), 256).alias("key_hash"))
    return ingest.resolve_callers(r, _keys(s, d)).select("o_orderkey", "client_name", F.col("client_name").isNull().alias("rejected"))


def j4_delete(s, d):
    """Deletes of every sixth note; every twelfth is asked for by another tenant."""
    n = _notes(s, d)
    keys = n.filter("id % 6 = 0").select(F.when(F.col("id") % 12 == 0, F.lit("nobody")).otherwise(F.col("client_name")).alias("client_name"), F.col("id").alias("note_id"))
    notes, passages = ingest.delete_notes(n, _passages(s, d), keys)
    return notes.select(F.col("id").alias("note_id"), F.lit("note").alias("kind")).unionByName(passages.select("note_id", F.lit("passage").alias("kind"))).groupBy("note_id", "kind").agg(F.count("*").alias("n"))


def j5_backfill(s, d):
    return audit.backfill_scope(_passages(s, d), _notes(s, d)).select("id", "scope")


def j6_orphans(s, d):
    return audit.orphans(_passages(s, d), _notes(s, d)).select("id", "note_id", "scope")


def u2_replace(s, d):
    n = _notes(s, d)
    changed = n.filter("id % 3 = 0")
    new = changed.select((F.col("id") * ingest.ROOM).alias("id"), F.col("id").alias("note_id"), "client_name", "scope", F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("heading_path"), F.col("body").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("embedding_degenerate"))
    out = ingest.replace_passages(_passages(s, d), changed.select("client_name", F.col("id").alias("note_id")), new)
    return out.groupBy("note_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def u3_upsert(s, d):
    n = _notes(s, d)
    more = t.read_notes(s, d).filter("id % 3 = 0")
    null = lambda k: F.lit(None).cast(k)
    new = more.select((F.col("id") + 1_000_000_000).alias("id"), "client_name", "scope", "path_or_uri", "name", "description", "type", null("string").alias("provenance_kind"), null("date").alias("provenance_date"), F.lit("upserted").alias("status"), F.sha2("content", 256).alias("content_hash"), F.lit(CFG.pipeline_version).alias("pipeline_version"), "body", F.lit("{}").alias("meta"), _now().alias("created_at"), _now().alias("updated_at"))
    return ingest.upsert_notes(n, new).select("id", "path_or_uri", "status", F.year("created_at").alias("created"), F.month("created_at").alias("month"), (F.col("updated_at") > F.col("created_at")).alias("updated"))


def a3_passage_counts(s, d):
    n = _notes(s, d).select("client_name", F.col("id").alias("note_id"))
    return n.join(ingest.passage_counts(_passages(s, d).filter("note_id % 4 = 0")), ["client_name", "note_id"], "left").select("note_id", F.coalesce("passages", F.lit(0)).alias("passage_count"))


def p7_get_notes(s, d):
    wanted = t.table(s, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.lit("nobody")).otherwise(F.col("lang")).alias("client_name"), F.col("doc_id").alias("id"))
    return ingest.lookup_notes(_notes(s, d), _passages(s, d), wanted).select("id", "client_name", "scope", "path_or_uri", "name", "content_hash", "passage_count")


def a5_uniqueness(s, d):
    r = ingest.normal_requests(_requests(s, d))
    return audit.duplicate_keys(r, *ingest.IDENTITY)


def a5_passage_ordinals(s, d):
    p = _passages(s, d)
    twice = p.unionByName(p.filter("note_id % 8 = 0 AND ordinal = 1"))
    return audit.duplicate_keys(twice, "note_id", "ordinal")


def _ingested(s, d):
    embed = lambda c: vf.hash_embedding(c, CFG.dimension).cast("array<double>")
    notes = stage_table(_notes(s, d), "stored-notes")  # stored, as a store is: the plans read it several times
    return ingest.ingest(_requests(s, d), notes, _passages_of(notes), CFG, embed, _now())


def p5_ingest_results(s, d):
    return _ingested(s, d)[2].select("request_id", "outcome", "fault")


def p5_ingested_notes(s, d):
    return _ingested(s, d)[0].select("client_name", "scope", "path_or_uri", "content_hash", "pipeline_version", F.year("created_at").alias("created"), F.month("created_at").alias("month"))


def p5_ingested_passages(s, d):
    return _ingested(s, d)[1].select("note_id", "client_name", "scope", "ordinal", "heading_path", F.md5("content").alias("h"), F.size("embedding").alias("width"), "embedding_degenerate")


def r1_ingest_stream(s, d):
    """The requests as files, taken in by the stream into an empty store; every 13th is followed by a delete."""
    folder = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    r = _requests(s, d)
    gone = r.filter("request_id > 0 AND request_id % 13 = 0").withColumn("op", F.lit("delete")).withColumn("arrived_at", F.timestamp_seconds(F.lit(1_800_000_000)))
    r.unionByName(gone).write.json(f"{folder}/in")
    embed = lambda c: vf.hash_embedding(c, CFG.dimension).cast("array<double>")
    feed.ingest_stream(s, f"{folder}/in", f"{folder}/store", f"{folder}/progress", CFG, embed).awaitTermination()
    return LogStore(s, f"{folder}/store").read()[0].select("client_name", "scope", "path_or_uri", "content_hash")


def r2_feed_deletes(s, d):
    """A batch of the feed with a delete of every sixth stored note; that of every twelfth is asked for by another tenant, and every 18th note is sent anew afterwards. What is left: all notes, and the passages of those not sent anew."""
    n = _notes(s, d).filter("id % 6 = 0")
    asks = lambda rows, k, op, tenant, at: rows.select((F.col("id") * 2 + k).alias("request_id"), F.timestamp_seconds(F.lit(at)).alias("arrived_at"), F.lit(op).alias("op"), tenant.alias("client_name"), "scope", F.lit(None).cast("string").alias("repo_name"), "path_or_uri", F.col("body").alias("content"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("meta"), F.lit(True).alias("force"))
    tenant = F.when(F.col("id") % 12 == 0, F.concat("client_name", F.lit("-other"))).otherwise(F.col("client_name"))
    batch = asks(n, 0, "delete", tenant, 1_700_000_000).unionByName(asks(n.filter("id % 18 = 0"), 1, "upsert", F.col("client_name"), 1_700_000_001))
    embed = lambda c: vf.hash_embedding(c, CFG.dimension).cast("array<double>")
    notes, passages, _ = feed.apply_batch(batch, _notes(s, d), _passages(s, d), CFG, embed, _now())
    return notes.select(F.col("id").alias("note_id"), F.lit("note").alias("kind"), F.lit(1).cast("long").alias("n")).unionByName(passages.filter("note_id % 18 <> 0").groupBy("note_id").agg(F.lit("passage").alias("kind"), F.count("*").alias("n")))


def _corpus(s, d):
    """A file for each document, in a folder of its source, some with Windows line ends, and some not UTF-8, of another kind, or with names that are excluded."""
    root = f"{shared_folder(s)}/corpus-{uuid.uuid4().hex}"
    k = F.col("doc_id")
    name = F.when(k % 7 == 3, F.concat(k, F.lit("/MEMORY.md"))).when(k % 13 == 4, F.concat(k, F.lit(".txt"))).otherwise(F.concat(k, F.lit(".md")))
    text = F.coalesce("text", F.lit(""))
    text = F.when(k % 5 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).cast("binary")
    bad = F.concat(F.lit(b"\xff\xfe").cast("binary"), text)
    corpus.write_files(t.table(s, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), name).alias("path_or_uri"), F.when(k % 11 == 5, bad).otherwise(text).alias("content")), root)
    return corpus.read_corpus(s, root)


def s1_corpus_files(s, d):
    return _corpus(s, d)[0].select("path_or_uri", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("content_hash"))


def s3_failed_files(s, d):
    return _corpus(s, d)[1].select("path_or_uri", "fault")


def s5_golden_files(s, d):
    """A golden file for each 50 benchmark items, of which every ninth has no expectation and every tenth a list of two; each sixth file lacks a number of its gate."""
    root = f"{shared_folder(s)}/golden-{uuid.uuid4().hex}"
    k = F.col("item_id")
    want = F.when(k % 9 == 8, F.array().cast("array<string>")).when(k % 10 == 9, F.array(F.concat(F.lit("docs/"), k), F.lit("x.md"))).otherwise(F.array(F.concat(F.lit("docs/"), k)))
    entry = F.concat(F.lit("- "), F.to_json(F.struct(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 .,]", " ").alias("query"), want.alias("expect_path_or_uri"), F.concat(F.lit("item "), k).alias("notes"))))
    files = t.table(s, d, "benchmark").select(F.floor(k / 50).alias("file"), k.alias("k"), entry.alias("entry")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "entry"))), lambda x: x["entry"]), "\n").alias("entries"))
    gate = F.concat(F.lit("version: 1\ngate: {top_k: 5, threshold: 3"), F.when(F.col("file") % 6 == 5, F.lit("")).otherwise(F.lit(", minimum_queries: 10")), F.lit("}\nqueries:\n"))
    corpus.write_files(files.select(F.concat(F.lit("golden-"), "file", F.lit(".yaml")).alias("path_or_uri"), F.concat(gate, "entries").cast("binary").alias("content")), root)
    return corpus.read_golden(s, root).select(F.element_at(F.split("path", "/"), -1).alias("file"), "position", "query", F.array_join("expect_path_or_uri", "|").alias("expected"), "notes", "top_k", "threshold", "minimum_queries", "fault")


def a4_summary(s, d):
    """The summary of a run, with what its total of passages differs by from those that are stored for the notes that it counts."""
    _, passages, results = _ingested(s, d)
    results = stage_table(results, "results")
    counted = results.filter("outcome IN ('new', 'changed', 'forced', 'skipped')").select("client_name", "note_id").distinct()
    stored = passages.join(counted, ["client_name", "note_id"], "left_semi").agg(F.count("*").alias("stored"))
    summary = ingest.run_summary(results).select("*", F.lit(1).alias("k"))
    return summary.join(stored.select("stored", F.lit(1).alias("k")), "k").select("considered", "ingested", "skipped", "failed", (F.col("total_passages") - F.col("stored")).alias("differs_by"), (F.col("total_passages") > F.col("considered") - F.col("failed")).alias("several"))


def _vectors(s, d):
    """The embeddings with faults put in by number: null, wrong width, NaN, too large, zero, subnormal."""
    e, v = F.col("embedding").cast("array<double>"), F.col("vec_id") % 10
    bad = F.when(v == 1, F.lit(None).cast("array<double>")).when(v == 2, F.slice(e, 1, WIDTH - 1)).when(v == 3, F.transform(e, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
    bad = bad.when(v == 4, F.transform(e, lambda x, i: F.when(i == 7, F.lit(1e39)).otherwise(x))).when(v == 5, F.transform(e, lambda x: F.lit(0.0))).when(v == 6, F.transform(e, lambda x: F.lit(1e-40))).otherwise(e)
    return t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), bad.alias("embedding"))


def v2_degenerate(s, d):
    return _vectors(s, d).select("id", vf.degenerate(F.col("embedding").cast("array<float>")).alias("embedding_degenerate"))


def v3_faults(s, d):
    return _vectors(s, d).select("id", vf.vector_fault(F.col("embedding"), WIDTH).alias("fault"))


def f6_eligible(s, d):
    """Vectors that the vector arm can rank: not degenerate, and at a distance from themselves."""
    e = F.col("embedding").cast("array<float>")
    return _vectors(s, d).filter(~vf.degenerate(e)).filter(~F.isnan(vf.cosine_distance(e, e))).select("id")


def a7_embedding_audit(s, d):
    return audit.embedding_faults(_vectors(s, d), WIDTH)


def a7_verdict(s, d):
    return audit.embedding_verdict(audit.embedding_faults(_vectors(s, d), WIDTH))


def a8_norms(s, d):
    """Norms of all vectors; one that isn't finite is null."""
    finite = lambda c, digits: F.when(~F.isnan(c) & (F.col(c) < float("inf")), F.round(c, digits)).alias(c)
    return audit.norm_report(_vectors(s, d), WIDTH).select("id", finite("norm64", 6), finite("norm32", 4), "accepted")


def a9_failed_notes(s, d):
    p = _vectors(s, d).select(F.floor(F.col("id") / 4).alias("note_id"), (F.col("id") % 4).cast("int").alias("ordinal"), "embedding")
    return ingest.failed_notes(p, WIDTH, ["note_id"])


def p2_hash_embedding(s, d):
    e = vf.hash_embedding(F.col("text"), 4)
    return t.table(s, d, "documents").select("doc_id", *[F.round(e[i].cast("double"), 5).alias(f"e{i}") for i in range(4)])


def p1_embed(s, d):
    """A model called in sub-batches: here, the lengths and blanks of texts."""
    from passagemill.functions.embed import embedder

    embed = embedder(lambda: lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts], 16)
    return t.table(s, d, "documents").select("doc_id", embed(F.col("text")).alias("e")).select("doc_id", F.col("e")[0].alias("chars"), F.col("e")[1].alias("blanks"))


def s6_store_layout(s, d):
    """The store written as a log of two runs (the second one of every tenth note anew), merged into one, and read back: passages by tenant."""
    notes, passages = _notes(s, d).select(schemas.NOTES.fieldNames()), _passages(s, d).select(schemas.PASSAGES.fieldNames())
    held = LogStore(s, f"{shared_folder(s)}/layout-{uuid.uuid4().hex}", 16, share=0.0)
    none = notes.limit(0)
    held.append(0, notes, none, passages)
    held.append(1, notes.filter("id % 10 = 0"), none, passages.filter("note_id % 10 = 0"))
    held.merge()
    return held.read()[1].groupBy("client_name").agg(F.count("*").alias("passages"), F.count_distinct("note_id").alias("notes"), F.sum(F.length("content")).alias("chars"))


_STORED = r""", stored AS (SELECT *, sha256(content) AS hash, CASE WHEN id % 10 = 0 THEN 's2+fts1+ei1+hash+16' ELSE 's3+fts1+ei1+hash+16' END AS version FROM read WHERE id % 2 = 0),
pass AS (
  SELECT id * 1048576 + o AS id, id AS note_id, client_name, CASE WHEN id % 9 = 0 THEN 'elsewhere' ELSE scope END AS scope, o AS ordinal,
         CASE WHEN o = 0 THEN substr(body, 1, length(body) // 2) ELSE substr(body, length(body) // 2 + 1) END AS content FROM stored, range(2) t(o)),
req0 AS (
  SELECT id AS request_id, client_name, scope, CASE WHEN id % 17 = 3 THEN '/' ELSE '' END || path_or_uri AS path_or_uri, CASE WHEN id % 3 = 0 THEN content || chr(10) || chr(10) || 'An addition.' ELSE content END AS content,
         id % 5 = 0 AS force, id + 1700000000 AS arrived FROM raw),
req AS (SELECT * FROM req0 UNION ALL SELECT -request_id - 1, client_name, scope, path_or_uri, 'an earlier text', force, 1600000000 FROM req0 WHERE request_id % 4 = 0),
last AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY client_name, scope, path_or_uri ORDER BY arrived DESC, request_id DESC) = 1),
outcomes AS (
  SELECT l.*, s.id AS note_id, sha256(l.content) AS content_hash,
         CASE WHEN s.id IS NULL THEN 'new' WHEN s.hash <> sha256(l.content) OR version <> 's3+fts1+ei1+hash+16' THEN 'changed' WHEN force THEN 'forced' ELSE 'skipped' END AS outcome
  FROM last l LEFT JOIN stored s ON s.client_name = l.client_name AND s.scope = l.scope AND s.path_or_uri = l.path_or_uri)
"""
STORE = READ.rstrip() + _STORED
_V = r"""WITH v AS (
  SELECT vec_id AS id, CASE vec_id % 10 WHEN 1 THEN NULL WHEN 2 THEN (embedding::DOUBLE[])[1:63] WHEN 3 THEN list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = 6 THEN 'nan'::DOUBLE ELSE x END)
    WHEN 4 THEN list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = 8 THEN 1e39 ELSE x END) WHEN 5 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE)
    WHEN 6 THEN list_transform(embedding::DOUBLE[], lambda x: 1e-40::DOUBLE) ELSE embedding::DOUBLE[] END AS e, vec_id % 10 AS k FROM embeddings),
f AS (SELECT *, CASE k WHEN 1 THEN 'missing' WHEN 2 THEN 'width' WHEN 3 THEN 'value' WHEN 4 THEN 'value' WHEN 5 THEN 'zero norm' WHEN 6 THEN 'zero norm' END AS fault FROM v)
"""

ALL = {
    "w2_latest_request": (w2_latest_request, STORE + "SELECT request_id, client_name, scope, path_or_uri FROM last"),
    "f7_outcomes": (f7_outcomes, STORE + "SELECT request_id, outcome, content_hash FROM outcomes"),
    "j2_identity_lookup": (j2_identity_lookup, STORE + "SELECT request_id, s.id, s.hash AS content_hash FROM req r LEFT JOIN stored s USING (client_name, scope, path_or_uri)"),
    "j3_callers": (j3_callers, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND c_custkey IS NOT NULL AND c_custkey % 5 <> 0 THEN 'client' || (c_custkey % 7) END AS client_name, NOT (o_orderkey % 4 <> 0 AND c_custkey IS NOT NULL AND c_custkey % 5 <> 0) AS rejected FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "j4_delete": (j4_delete, STORE + "SELECT id AS note_id, 'note' AS kind, 1 AS n FROM stored WHERE NOT (id % 6 = 0 AND id % 12 <> 0) UNION ALL SELECT note_id, 'passage', count(*) FROM pass WHERE NOT (note_id % 6 = 0 AND note_id % 12 <> 0) GROUP BY 1"),
    "j5_backfill": (j5_backfill, STORE + "SELECT p.id, s.scope FROM pass p JOIN stored s ON s.id = p.note_id"),
    "j6_orphans": (j6_orphans, STORE + "SELECT id, note_id, scope FROM pass WHERE note_id % 9 = 0"),
    "u2_replace": (u2_replace, STORE + "SELECT note_id, count(*) AS n, sum(length(content))::BIGINT AS chars FROM (SELECT note_id, content FROM pass WHERE note_id % 3 <> 0 UNION ALL SELECT id, body FROM stored WHERE id % 3 = 0) GROUP BY 1"),
    "u3_upsert": (u3_upsert, READ + "SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000000 END AS id, path_or_uri, CASE WHEN id % 3 = 0 THEN 'upserted' END AS status, 2026 AS created, CASE WHEN id % 2 = 0 THEN 1 ELSE 11 END AS month, id % 2 = 0 AND id % 3 = 0 AS updated FROM read WHERE id % 2 = 0 OR id % 3 = 0"),
    "a3_passage_counts": (a3_passage_counts, STORE + "SELECT id AS note_id, CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS passage_count FROM stored"),
    "p7_get_notes": (p7_get_notes, STORE + "SELECT id, client_name, scope, path_or_uri, name, hash AS content_hash, 2 AS passage_count FROM stored WHERE id % 7 <> 0"),
    "a4_summary": (a4_summary, STORE + "SELECT count(*) AS considered, count(*) FILTER (NOT bad AND outcome <> 'skipped') AS ingested, count(*) FILTER (NOT bad AND outcome = 'skipped') AS skipped, count(*) FILTER (bad) AS failed, 0::BIGINT AS differs_by, true AS several FROM (SELECT outcome, false AS bad FROM outcomes WHERE NOT starts_with(path_or_uri, '/') UNION ALL SELECT NULL, true FROM req WHERE starts_with(path_or_uri, '/'))"),
    "a5_uniqueness": (a5_uniqueness, STORE + "SELECT client_name, scope, path_or_uri, count(*) AS n FROM req GROUP BY ALL HAVING count(*) > 1"),
    "a5_passage_ordinals": (a5_passage_ordinals, STORE + "SELECT note_id, ordinal, 2 AS n FROM pass WHERE note_id % 8 = 0 AND ordinal = 1"),
    "p5_ingest_results": (p5_ingest_results, STORE + "SELECT request_id, outcome, NULL::VARCHAR AS fault FROM outcomes WHERE NOT starts_with(path_or_uri, '/') UNION ALL SELECT request_id, 'rejected', 'absolute path' FROM req WHERE starts_with(path_or_uri, '/')"),
    "p5_ingested_notes": (p5_ingested_notes, STORE + "SELECT client_name, scope, path_or_uri, content_hash, 's3+fts1+ei1+hash+16' AS pipeline_version, 2026 AS created, CASE WHEN note_id IS NULL THEN 11 ELSE 1 END AS month FROM outcomes WHERE NOT starts_with(path_or_uri, '/') UNION ALL SELECT client_name, scope, path_or_uri, hash, version, 2026, 1 FROM stored WHERE id % 17 = 3"),
    "p5_ingested_passages": (p5_ingested_passages, None),
    "r1_ingest_stream": (r1_ingest_stream, STORE + "SELECT client_name, scope, path_or_uri, sha256(content) AS content_hash FROM last WHERE NOT starts_with(path_or_uri, '/') AND NOT (request_id > 0 AND request_id % 13 = 0)"),
    "r2_feed_deletes": (r2_feed_deletes, STORE + "SELECT id AS note_id, 'note' AS kind, 1::BIGINT AS n FROM stored WHERE id % 6 <> 0 OR id % 12 = 0 OR id % 18 = 0 UNION ALL SELECT note_id, 'passage', count(*) FROM pass WHERE (note_id % 6 <> 0 OR note_id % 12 = 0) AND note_id % 18 <> 0 GROUP BY 1"),
    "s1_corpus_files": (s1_corpus_files, "SELECT coalesce(source, 'none') || '/' || doc_id || '.md' AS path_or_uri, length(t)::BIGINT AS chars, sha256(t) AS content_hash FROM (SELECT *, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM documents) WHERE doc_id % 7 <> 3 AND doc_id % 13 <> 4 AND doc_id % 11 <> 5"),
    "s3_failed_files": (s3_failed_files, "SELECT coalesce(source, 'none') || '/' || doc_id || '.md' AS path_or_uri, 'not UTF-8' AS fault FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 13 <> 4 AND doc_id % 11 = 5"),
    "s5_golden_files": (s5_golden_files, "SELECT 'golden-' || (item_id // 50) || '.yaml' AS file, position::INT AS position, CASE WHEN fault IS NULL THEN regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ', 'g') END AS query, CASE WHEN fault IS NULL THEN 'docs/' || item_id || CASE WHEN item_id % 10 = 9 THEN '|x.md' ELSE '' END END AS expected, CASE WHEN fault IS NULL THEN 'item ' || item_id END AS notes, 5 AS top_k, 3 AS threshold, 10 AS minimum_queries, fault FROM (SELECT *, CASE WHEN item_id % 9 = 8 THEN 'queries[' || position || ']: expect_path_or_uri must be a path or a list of paths' END AS fault FROM (SELECT *, row_number() OVER (PARTITION BY item_id // 50 ORDER BY item_id) - 1 AS position FROM benchmark)) WHERE item_id // 50 % 6 <> 5 UNION ALL SELECT DISTINCT 'golden-' || (item_id // 50) || '.yaml', -1, NULL, NULL, NULL, NULL::INT, NULL::INT, NULL::INT, 'gate.minimum_queries must be an integer' FROM benchmark WHERE item_id // 50 % 6 = 5"),
    "v2_degenerate": (v2_degenerate, _V + "SELECT id, CASE WHEN k <> 1 THEN k IN (5, 6) END AS embedding_degenerate FROM f"),
    "v3_faults": (v3_faults, _V + "SELECT id, fault FROM f"),
    "f6_eligible": (f6_eligible, _V + "SELECT id FROM f WHERE k NOT IN (1, 3, 4, 5, 6)"),
    "a7_embedding_audit": (a7_embedding_audit, _V + "SELECT coalesce(fault, 'ok') AS fault, count(*) AS n, min(len(e)) AS least, max(len(e)) AS most, array_to_string(list(id ORDER BY id)[1:3], ',') AS examples FROM f GROUP BY 1"),
    "a7_verdict": (a7_verdict, _V + "SELECT CASE WHEN bool_or(fault IN ('value', 'zero norm', 'missing')) THEN 'unusable' WHEN bool_or(fault = 'width') THEN 'width' ELSE 'ok' END AS verdict, count(*) AS vectors FROM f"),
    "a8_norms": (a8_norms, _V + "SELECT id, CASE WHEN k <> 3 THEN round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) END AS norm64, CASE WHEN k IN (5, 6) THEN 0.0::DOUBLE WHEN k NOT IN (3, 4) THEN round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) END AS norm32, fault IS NULL AS accepted FROM f"),
    "a9_failed_notes": (a9_failed_notes, _V + "SELECT id // 4 AS note_id, first(fault ORDER BY id) AS fault FROM f WHERE fault IS NOT NULL GROUP BY 1"),
    "p2_hash_embedding": (p2_hash_embedding, "WITH r AS (SELECT doc_id, list_transform(range(4), lambda i: ('0x' || substr(sha256(text || '#' || i), 1, 4))::BIGINT / 65535.0::DOUBLE - 0.5::DOUBLE) AS e FROM documents), n AS (SELECT doc_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM r) SELECT doc_id, round((e[1] / n)::FLOAT::DOUBLE, 5) AS e0, round((e[2] / n)::FLOAT::DOUBLE, 5) AS e1, round((e[3] / n)::FLOAT::DOUBLE, 5) AS e2, round((e[4] / n)::FLOAT::DOUBLE, 5) AS e3 FROM n"),
    "p1_embed": (p1_embed, "SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents"),
    "s6_store_layout": (s6_store_layout, STORE + "SELECT client_name, count(*) AS passages, count(DISTINCT note_id) AS notes, sum(length(content))::BIGINT AS chars FROM pass GROUP BY 1"),
}
