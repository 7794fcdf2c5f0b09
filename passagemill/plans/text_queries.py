"""Queries over raw notes: text functions, predicates, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.config import IngestConfig
from passagemill.functions import text as tx
from passagemill.operators import audit, split
from passagemill.plans import tables as t
from passagemill.session import stage_table
from passagemill.sources import corpus

RAW, READ = f"WITH {t.RAW}\n", f"WITH {t.RAW}, {t.READ}\n"
CFG = IngestConfig()


def c1_content_hash(s, d):
    return t.raw_notes(s, d).select("id", tx.content_hash(F.col("content")).alias("content_hash"))


def c2_pipeline_version(s, d):
    return t.raw_notes(s, d).groupBy("client_name").agg(F.count("*").alias("n")).withColumn("pipeline_version", tx.pipeline_version(CFG))


def c3_embedding_input(s, d):
    n = t.read_notes(s, d)
    return n.select("id", F.md5(tx.embedding_input(F.col("name"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit("Section 1")), F.col("body"))).alias("h"))


def c4_lead_a(s, d):
    return t.read_notes(s, d).select("id", tx.fts_lead_a(F.col("name"), F.when(F.col("id") % 3 == 0, F.col("scope"))).alias("lead"))


def c5_lead_c(s, d):
    return t.read_notes(s, d).select("id", tx.fts_lead_c(F.col("description")).alias("lead"))


def c6_frontmatter(s, d):
    c = tx.cut_frontmatter(F.col("content"))
    return t.raw_notes(s, d).select("id", c["block"].alias("block"), F.md5(c["rest"]).alias("rest"))


def c7_fields(s, d):
    return t.read_notes(s, d).select("id", "name", "description", "type")


def c7_yaml_fields(s, d):
    return split.split_notes(t.raw_notes(s, d)).select("id", "name", "description", "type")


def c8_body(s, d):
    return t.read_notes(s, d).select("id", F.md5("body").alias("body"), F.length("body").alias("chars"))


def c9_provenance(s, d):
    return t.read_notes(s, d).select("id", tx.provenance(F.col("body")).alias("p")).select("id", F.col("p.kind").alias("kind"), F.col("p.date").alias("date"))


def c11_keys(s, d):
    key = F.concat(F.lit("pm_"), F.sha2(F.col("c_custkey").cast("string"), 256))
    return t.table(s, d, "customer").select("c_custkey", tx.key_hash(key).alias("key_hash"), tx.key_prefix(key).alias("key_prefix"))


def c12_heading_path(s, d):
    return split.sections(t.read_notes(s, d)).select("id", "section", "heading_path")


def f1_path_rule(s, d):
    p = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("/"), "page_id")).when(F.col("page_id") % 5 == 2, F.concat(F.lit("docs/../"), "page_id")).when(F.col("page_id") % 5 == 3, F.concat(F.lit("docs/"), "page_id", F.lit("..md"))).otherwise(F.col("url"))
    return t.table(s, d, "pages").select("page_id", tx.path_fault(p).alias("fault"))


def f2_content_cap(s, d):
    cfg = IngestConfig(max_content_chars=1500)
    f = tx.request_fault(F.col("scope"), F.col("path_or_uri"), F.col("content"), F.lit(None).cast("string"), cfg)
    return t.raw_notes(s, d).select("id", f.alias("fault"))


def f3_field_bounds(s, d):
    n = t.raw_notes(s, d)
    scope, path, status = F.repeat("scope", (F.col("id") % 200).cast("int")), F.repeat("path_or_uri", (F.col("id") % 250).cast("int")), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int"))
    return n.select("id", tx.request_fault(scope, path, F.col("content"), status, CFG).alias("fault"))


def s2_excludes(s, d):
    p = F.when(F.col("doc_id") % 6 == 0, F.lit("MEMORY.md")).when(F.col("doc_id") % 6 == 1, F.concat("source", F.lit("/a/MEMORY.md"))).when(F.col("doc_id") % 6 == 2, F.concat("source", F.lit("/learning-log.md")))
    p = p.when(F.col("doc_id") % 6 == 3, F.concat(F.lit("drafts/"), "source", F.lit(".md"))).otherwise(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")))
    globs = corpus.resolve_excludes(["drafts/*.md"])
    return t.table(s, d, "documents").select("doc_id", p.alias("path")).select("doc_id", "path", corpus.is_excluded(F.col("path"), globs).alias("excluded"))


def s4_request_scope(s, d):
    from passagemill.operators.ingest import normal_requests

    r = t.raw_notes(s, d).select("client_name", F.when(F.col("id") % 3 == 0, F.col("scope")).alias("scope"), F.when(F.col("id") % 3 != 2, F.lit("alias")).alias("repo_name"), "path_or_uri", "content", F.col("id").alias("request_id"))
    return normal_requests(r).select("request_id", "scope", "op", "meta", "force")


def d1_sections(s, d):
    return split.sections(t.read_notes(s, d)).select("id", "section", "heading_path", F.md5("text").alias("text"))


def d2_split_decision(s, d):
    n = t.read_notes(s, d)
    h = split.section_lines(n).groupBy("id").agg(F.count("level").alias("headings"))
    return n.join(h, "id").select("id", "headings", split.split_by_sections(F.col("body"), F.col("headings")).alias("by_sections"))


def d4_hard_split(s, d):
    x = F.posexplode(split.hard_split(F.col("text")))
    return t.table(s, d, "documents").select("doc_id", x.alias("i", "piece")).select("doc_id", "i", F.length("piece").alias("chars"), F.md5("piece").alias("h"))


def _split(s, d):
    return split.split_notes(t.raw_notes(s, d))


def d6_passages(s, d):
    # Every note has a passage; a plain explode would have Spark filter on the array's size first, and so split each body several times.
    return _split(s, d).select("id", F.explode_outer("passages").alias("p")).select("id", "p.ordinal", "p.heading_path", F.length("p.content").alias("chars"), F.md5("p.content").alias("h"))


def d3_short_sections(s, d):
    """A note of one ## section for each turn of a conversation: runs of short sections."""
    line = F.concat(F.lit("## Turn "), "turn", F.lit("\n\n"), "text")
    n = t.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("body"))
    p = n.select("conv_id", F.explode(split.split_bodies(F.col("body"))).alias("p"))
    return p.select("conv_id", "p.ordinal", "p.heading_path", F.length("p.content").alias("chars"))


def d5_pack(s, d):
    """How the passages of every body come out: of those without headings, from packing alone."""
    p = t.read_notes(s, d).select("id", F.explode(split.split_bodies(F.col("body"))).alias("p"))
    return p.groupBy("id").agg(F.count("*").alias("passages"), F.max(F.length("p.content")).alias("longest"), F.count("p.heading_path").alias("headed"))


def d7_split_quality(s, d):
    n = stage_table(_split(s, d).select("id", "body", "passages"), "split-notes")  # read twice
    p = n.select(F.col("id").alias("note_id"), F.explode("passages").alias("p")).select("note_id", "p.ordinal", "p.content")
    return audit.split_quality(n, p).select("note_id", "contiguous", "same_text", "ok")


def d8_profile(s, d):
    return audit.corpus_profile(t.raw_notes(s, d))


_LINES = r""", lines AS (
  SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM read),
marked AS (
  SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM lines),
headed AS (
  SELECT *, CASE WHEN NOT fence AND sum(fence::INT) OVER w % 2 = 0 AND regexp_matches(line, '^(#{2,3})\s+(.+)$') THEN length(regexp_extract(line, '^(#{2,3})\s', 1)) END AS level FROM marked
  WINDOW w AS (PARTITION BY id ORDER BY pos)),
numbered AS (SELECT *, sum((level IS NOT NULL)::INT) OVER (PARTITION BY id ORDER BY pos) AS section FROM headed),
secs AS (
  SELECT id, section::BIGINT AS section, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN trim(regexp_extract(line, '^(#{2,3})\s+(.+)$', 2)) END) AS title,
         regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\s+$', '') AS text FROM numbered GROUP BY 1, 2),
paths AS (
  SELECT id, section, text, max(section) OVER (PARTITION BY id) > 0 AS many,
         CASE WHEN level = 2 THEN title WHEN level = 3 THEN concat_ws(' › ', last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY id ORDER BY section), title) END AS heading_path FROM secs)
"""
_PATH = "CASE WHEN page_id % 5 = 1 THEN '/' || page_id WHEN page_id % 5 = 2 THEN 'docs/../' || page_id WHEN page_id % 5 = 3 THEN 'docs/' || page_id || '..md' ELSE url END"

ALL = {
    "c1_content_hash": (c1_content_hash, RAW + "SELECT id, sha256(content) AS content_hash FROM raw"),
    "c2_pipeline_version": (c2_pipeline_version, "SELECT lang AS client_name, count(*) AS n, 's3+fts1+ei1+ollama+1024' AS pipeline_version FROM documents GROUP BY 1"),
    "c3_embedding_input": (c3_embedding_input, READ + "SELECT id, md5(concat_ws(chr(10), name, CASE WHEN id % 3 <> 0 THEN 'Section 1' END, nullif(body, ''))) AS h FROM read"),
    "c4_lead_a": (c4_lead_a, READ + "SELECT id, concat_ws(' ', name, CASE WHEN id % 3 = 0 THEN scope END) AS lead FROM read"),
    "c5_lead_c": (c5_lead_c, READ + "SELECT id, coalesce(description, '') AS lead FROM read"),
    "c6_frontmatter": (c6_frontmatter, READ + r"SELECT id, block, md5(CASE WHEN block IS NULL THEN content ELSE regexp_replace(content, '^---[^\S\n]*\n(?s:.*?)\n?---[^\S\n]*(?:\n|$)', '') END) AS rest FROM read"),
    "c7_fields": (c7_fields, READ + "SELECT id, name, description, type FROM read"),
    "c7_yaml_fields": (c7_yaml_fields, READ + "SELECT id, name, description, type FROM read"),
    "c8_body": (c8_body, READ + "SELECT id, md5(body) AS body, length(body) AS chars FROM read"),
    "c9_provenance": (c9_provenance, READ + r"SELECT id, CASE WHEN d IS NOT NULL THEN kind END AS kind, d AS date FROM (SELECT id, regexp_extract(body, '\[Source:\s*(user override|empirical|agent inference)\s*[—-]\s*(\d{4}-\d{2}-\d{2})\s*\]', 1) AS kind, try_strptime(regexp_extract(body, '\[Source:\s*(user override|empirical|agent inference)\s*[—-]\s*(\d{4}-\d{2}-\d{2})\s*\]', 2), '%Y-%m-%d')::DATE AS d FROM read)"),
    "c11_keys": (c11_keys, "SELECT c_custkey, sha256('pm_' || sha256(c_custkey::VARCHAR)) AS key_hash, substr('pm_' || sha256(c_custkey::VARCHAR), 1, 15) AS key_prefix FROM customer"),
    "c12_heading_path": (c12_heading_path, READ + _LINES + "SELECT id, section, heading_path FROM paths WHERE NOT (section = 0 AND text = '' AND many)"),
    "f1_path_rule": (f1_path_rule, f"SELECT page_id, CASE WHEN p IS NULL OR p = '' THEN 'path is empty' WHEN length(p) > 2048 THEN 'path too long' WHEN regexp_matches(p, '^[a-z][a-z0-9+.\\-]*://') THEN NULL WHEN starts_with(p, '/') THEN 'absolute path' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent component' END AS fault FROM (SELECT page_id, {_PATH} AS p FROM pages)"),
    "f2_content_cap": (f2_content_cap, RAW + "SELECT id, CASE WHEN length(content) > 1500 THEN 'content too long' END AS fault FROM raw"),
    "f3_field_bounds": (f3_field_bounds, RAW + "SELECT id, CASE WHEN length(scope) * (id % 200) > 512 THEN 'scope too long' WHEN id % 250 = 0 THEN 'path is empty' WHEN length(path_or_uri) * (id % 250) > 2048 THEN 'path too long' WHEN id % 300 > 256 THEN 'status too long' END AS fault FROM raw"),
    "s2_excludes": (s2_excludes, "SELECT doc_id, path, path = 'MEMORY.md' OR path LIKE '%/MEMORY.md' OR path LIKE '%/learning-log.md' OR regexp_matches(path, '(^|/)drafts/[^/]*\\.md$') AS excluded FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'MEMORY.md' WHEN 1 THEN source || '/a/MEMORY.md' WHEN 2 THEN source || '/learning-log.md' WHEN 3 THEN 'drafts/' || source || '.md' ELSE 'docs/' || doc_id || '.md' END AS path FROM documents)"),
    "s4_request_scope": (s4_request_scope, "SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'alias' ELSE '' END AS scope, 'upsert' AS op, '{}' AS meta, false AS force FROM documents"),
    "d1_sections": (d1_sections, READ + _LINES + "SELECT id, section, heading_path, md5(text) AS text FROM paths WHERE NOT (section = 0 AND text = '' AND many)"),
    "d2_split_decision": (d2_split_decision, READ + _LINES + "SELECT id, h AS headings, h > 0 AND length(body) > 1500 AS by_sections FROM (SELECT id, count(level) AS h FROM headed GROUP BY 1) JOIN read USING (id)"),
    "d3_short_sections": (d3_short_sections, None),
    "d4_hard_split": (d4_hard_split, "SELECT doc_id, i::INT AS i, length(substr(text, i * 4000 + 1, 4000)) AS chars, md5(substr(text, i * 4000 + 1, 4000)) AS h FROM documents, range(greatest((length(text) + 3999) // 4000, 1)) t(i)"),
    "d5_pack": (d5_pack, None),
    "d6_passages": (d6_passages, None),
    "d7_split_quality": (d7_split_quality, "SELECT doc_id AS note_id, true AS contiguous, true AS same_text, true AS ok FROM documents"),
    "d8_profile": (d8_profile, RAW + r"SELECT CASE WHEN length(content) <= 1500 THEN '1: to 1500' WHEN length(content) <= 4000 THEN '2: to 4000' ELSE '3: over 4000' END AS band, count(*) AS notes, count(*) FILTER (len(regexp_extract_all(content, '(?m)^##[ \t]+\S')) >= 3) AS sectioned, count(*) FILTER (NOT starts_with(content, '---' || chr(10))) AS plain, max(length(content)) AS largest FROM raw GROUP BY 1"),
}
