"""The store's tables derived from the test tables, in Spark and, for the SQL twins, in DuckDB.

A document becomes a Markdown note: frontmatter from its source and language, its
lines as paragraphs, and for even ids a heading before every fourth paragraph.
Its language is the tenant, its source the scope. A document that has an embedding
is a passage of its own for searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, client_name, scope, path_or_uri, content."""
    heading = lambda k: F.concat(F.when(k % 3 == 2, F.lit("### ")).otherwise(F.lit("## ")), F.lit("Section "), k.cast("string"), F.lit("\n\n"))
    lines = F.split("text", "\n", -1)
    headed = F.transform(lines, lambda x, i: F.concat(F.when((F.col("doc_id") % 2 == 0) & (i % 4 == 0), heading(F.floor(i / 4).cast("int"))).otherwise(F.lit("")), x))
    mark = F.when(F.col("doc_id") % 21 == 0, F.lit("[Source: empirical — 2026-02-30]\n\n")).when(F.col("doc_id") % 14 == 0, F.lit("[Source:user override—2026-04-05 ]\n\n")).when(F.col("doc_id") % 7 == 0, F.lit("[Source:  agent inference  -  2026-03-04]\n\n")).otherwise(F.lit(""))
    front = F.concat(F.lit("---\nname: note "), F.col("doc_id"), F.lit("\ndescription: from "), F.col("source"), F.lit("\ntype: "), F.col("lang"), F.lit("\n---\n"))
    front = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(front)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("client_name"), F.col("source").alias("scope"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path_or_uri"),
        F.concat(front, mark, F.array_join(headed, "\n\n")).alias("content"),
    )


RAW = r"""raw AS (
  SELECT doc_id AS id, lang AS client_name, source AS scope, 'docs/' || doc_id || '.md' AS path_or_uri,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE '---' || chr(10) || 'name: note ' || doc_id || chr(10) || 'description: from ' || source || chr(10) || 'type: ' || lang || chr(10) || '---' || chr(10) END
    || CASE WHEN doc_id % 21 = 0 THEN '[Source: empirical — 2026-02-30]' || chr(10) || chr(10) WHEN doc_id % 14 = 0 THEN '[Source:user override—2026-04-05 ]' || chr(10) || chr(10) WHEN doc_id % 7 = 0 THEN '[Source:  agent inference  -  2026-03-04]' || chr(10) || chr(10) ELSE '' END
    || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
         CASE WHEN doc_id % 2 = 0 AND (i - 1) % 4 = 0 THEN (CASE WHEN ((i - 1) // 4) % 3 = 2 THEN '### ' ELSE '## ' END) || 'Section ' || ((i - 1) // 4) || chr(10) || chr(10) ELSE '' END || x), chr(10) || chr(10)) AS content
  FROM documents)"""

#: cut: the frontmatter block and the rest of raw; read: with fields and body.
READ = r"""cut AS (
  SELECT *, CASE WHEN regexp_matches(content, '^---\s*?\n') AND regexp_matches(content, '^---[^\S\n]*\n(?s:.*?)(?:^|\n)---[^\S\n]*(?:\n|$)')
    THEN regexp_extract(content, '^---[^\S\n]*\n((?s:.*?))\n?---[^\S\n]*(?:\n|$)', 1) END AS block FROM raw),
read AS (
  SELECT *, nullif(regexp_extract(block, '(?m)^name:[ \t]*([^\r\n]*?)[ \t]*$', 1), '') AS name,
    nullif(regexp_extract(block, '(?m)^description:[ \t]*([^\r\n]*?)[ \t]*$', 1), '') AS description,
    nullif(regexp_extract(block, '(?m)^type:[ \t]*([^\r\n]*?)[ \t]*$', 1), '') AS type,
    regexp_replace(regexp_replace(CASE WHEN block IS NULL THEN content ELSE regexp_replace(content, '^---[^\S\n]*\n(?s:.*?)\n?---[^\S\n]*(?:\n|$)', '') END, '^(?:[^\S\n]*\n)+', ''), '\s+$', '') AS body
  FROM cut)"""


def read_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_notes with name, description, type and body (plain frontmatter)."""
    from passagemill.operators.split import read_note

    return raw_notes(spark, sf_dir).withColumn("n", read_note(F.col("content"))).select("*", "n.*").drop("n")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages for searches: documents that have an embedding."""
    from passagemill.functions.vectors import degenerate

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf_dir, "documents")
    return d.join(e, "doc_id").select(
        F.col("doc_id").alias("passage_id"), F.col("doc_id").alias("note_id"), F.col("lang").alias("client_name"), F.col("source").alias("scope"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("note "), "doc_id").alias("name"), F.concat(F.lit("from "), "source").alias("description"), F.lit(None).cast("string").alias("heading_path"),
        F.col("text").alias("content"), "embedding", degenerate(F.col("embedding")).alias("embedding_degenerate"),
    )


#: Folders of the stored postings, by session, tables and normalisation.
_indexes: dict[tuple[str, str, bool], DataFrame] = {}


def index(spark: SparkSession, sf_dir: str, stemmed: bool) -> DataFrame:
    """The postings of passages(), written when they are first asked for in a session, as ingest would, and read from then on."""
    from passagemill.operators import postings

    key = (spark.sparkContext.applicationId, sf_dir, stemmed)
    if key not in _indexes:
        _indexes[key] = postings.build(passages(spark, sf_dir), stemmed)
    return _indexes[key]


def search_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("client_name"), F.col("source").alias("scope"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path_or_uri"),
        F.concat(F.lit("note "), "doc_id").alias("name"), F.concat(F.lit("from "), "source").alias("description"), F.col("lang").alias("type"),
        F.lit(None).cast("string").alias("provenance_kind"), F.lit(None).cast("date").alias("provenance_date"), F.lit(None).cast("string").alias("status"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each benchmark item: its first word in English, asked of a tenant in turn, every fifth in one scope; items that have no embedding have no vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    b = table(spark, sf_dir, "benchmark")
    langs = F.array(*[F.lit(x) for x in ("en", "en", "fr", "de")])
    q = b.select(
        F.col("item_id").alias("query_id"), F.element_at(langs, (F.col("item_id") % 4 + 1).cast("int")).alias("client_name"),
        F.lower(F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0)).alias("q"), (F.col("item_id") % 7 + 3).cast("int").alias("top_k"),
        F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("src"), F.col("item_id") % 20)).alias("repo_filter"),
    )
    return q.join(e, "query_id", "left").withColumn("query_vector", F.when(F.col("query_id") % 9 != 8, F.col("query_vector")))


SEARCH = r"""p AS (
  SELECT d.doc_id AS passage_id, lang AS client_name, source AS scope, text AS content, 'note ' || d.doc_id AS name, 'from ' || source AS description,
         'docs/' || d.doc_id || '.md' AS path_or_uri, lang AS type, embedding::DOUBLE[] AS e, coalesce(list_sum(list_transform(embedding, lambda x: x * x)), 0) <= 0 AS degenerate
  FROM documents d JOIN embeddings ON vec_id = d.doc_id),
q AS (
  SELECT item_id AS query_id, (['en', 'en', 'fr', 'de'])[item_id % 4 + 1] AS client_name, lower(regexp_extract(text, '[\p{L}\p{N}_]+')) AS q, (item_id % 7 + 3)::INT AS top_k,
         CASE WHEN item_id % 5 = 0 THEN 'src' || (item_id % 20) END AS repo_filter, CASE WHEN item_id % 9 <> 8 THEN embedding::DOUBLE[] END AS v
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
toks AS (
  SELECT passage_id, client_name, scope, regexp_extract_all(lower(name), '[\p{L}\p{N}_]+') AS a, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS b,
         regexp_extract_all(lower(description), '[\p{L}\p{N}_]+') AS c FROM p),
posts AS (
  SELECT passage_id, client_name, scope, unnest(a || b || c) AS lexeme, unnest(range(1, len(a) + len(b) + len(c) + 1)) AS pos,
         unnest(list_transform(a, lambda x: 'A') || list_transform(b, lambda x: 'B') || list_transform(c, lambda x: 'C')) AS weight FROM toks),
fts0 AS (
  SELECT query_id, passage_id, sum(CASE weight WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.4 ELSE 0.2 END)::FLOAT AS rank, any_value(greatest(50, top_k)) AS n
  FROM q JOIN posts ON q.client_name = posts.client_name AND q.q = lexeme AND (coalesce(repo_filter, '') = '' OR repo_filter = scope) GROUP BY ALL),
fts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, passage_id) AS r FROM fts0) WHERE r <= n),
vec0 AS (
  SELECT query_id, passage_id, 1 - greatest(-1, least(1, list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))))) AS distance, greatest(50, top_k) AS n
  FROM q JOIN p ON q.client_name = p.client_name AND (coalesce(repo_filter, '') = '' OR repo_filter = scope) WHERE v IS NOT NULL AND NOT degenerate),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, passage_id) AS r FROM vec0) WHERE r <= n),
fused AS (
  SELECT query_id, passage_id, sum(1.0::DOUBLE / (60 + r)) AS score, min(r) FILTER (arm = 'fts') AS fts_rank, min(r) FILTER (arm = 'vec') AS vector_rank
  FROM (SELECT query_id, passage_id, r, 'fts' AS arm FROM fts UNION ALL SELECT query_id, passage_id, r, 'vec' FROM vec) GROUP BY 1, 2),
results AS (
  SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, f.passage_id) AS position, f.passage_id, p.name, p.path_or_uri, round(score, 9) AS score, fts_rank, vector_rank, v IS NULL AS degraded
  FROM fused f JOIN p USING (passage_id) JOIN q USING (query_id) QUALIFY position <= top_k)"""
