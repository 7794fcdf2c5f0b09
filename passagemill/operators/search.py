"""Hybrid search: both arms, fused by reciprocal ranks, with the notes' metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.config import SearchConfig
from passagemill.operators import fulltext, postings, vector
from passagemill.session import stage_table

RESULT = (
    "passage_id", "note_id", "ordinal", "name", "description", "type", "path_or_uri", "heading_path", "content", "provenance_kind", "provenance_date", "status",
    "score", "fts_rank", "vector_rank",
)


def arm_weights(queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """queries with w_fts, w_vec (null: arm off) and degraded. Without a vector the full-text arm alone runs, with weight 1 if it was off."""
    has = F.col("query_vector").isNotNull()
    fts = F.when(has, F.nullif(F.lit(float(cfg.fts_weight)), F.lit(0.0))).otherwise(F.lit(float(cfg.fts_weight or 1.0)))
    vec = F.when(has, F.nullif(F.lit(float(cfg.vector_weight)), F.lit(0.0)))
    return queries.withColumn("w_fts", fts).withColumn("w_vec", vec).withColumn("degraded", ~has & F.lit(cfg.vector_weight > 0))


def fuse(arms: DataFrame, rrf_k: int) -> DataFrame:
    """query_id, passage_id, score, fts_rank, vector_rank from rows (query_id, passage_id, arm, r, w)."""
    return arms.groupBy("query_id", "passage_id").agg(
        F.sum(F.col("w").cast("double") / (F.lit(float(rrf_k)) + F.col("r"))).alias("score"),
        F.min(F.when(F.col("arm") == "fts", F.col("r"))).alias("fts_rank"),
        F.min(F.when(F.col("arm") == "vec", F.col("r"))).alias("vector_rank"),
    )


def first_k(fused: DataFrame, queries: DataFrame, default_top_k: int = 5) -> DataFrame:
    """fused cut to each query's top_k by score, then id, with its position."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "passage_id")
    k = queries.select("query_id", F.coalesce("top_k", F.lit(default_top_k)).alias("k"))
    return fused.withColumn("position", F.row_number().over(w)).filter("position <= 50").join(k, "query_id").filter("position <= k").drop("k")


def with_metadata(cut: DataFrame, queries: DataFrame, passages: DataFrame, notes: DataFrame, *keep: str) -> DataFrame:
    """The result rows: passages and notes joined by id and tenant, the tenant checked again on both. keep: columns of cut and queries that tell a query's rows apart, and stay."""
    owner = cut.join(queries.select("query_id", *keep, "client_name", "degraded"), ["query_id", *keep]).alias("r")
    p, n = passages.alias("p"), notes.alias("n")
    both = p.join(owner, (F.col("p.passage_id") == F.col("r.passage_id")) & (F.col("p.client_name") == F.col("r.client_name")))
    both = both.join(n, (F.col("p.note_id") == F.col("n.id")) & (F.col("n.client_name") == F.col("r.client_name")))
    note_side = {"name", "description", "type", "path_or_uri", "provenance_kind", "provenance_date", "status"}
    cols = [F.col(f"n.{c}") if c in note_side else F.col(f"r.{c}") if c in ("score", "fts_rank", "vector_rank", "passage_id") else F.col(f"p.{c}") for c in RESULT]
    return both.select("r.query_id", "r.position", *cols, "r.degraded", *[f"r.{c}" for c in keep])


def text_candidates(index: DataFrame, queries: DataFrame, passages: DataFrame, cfg: SearchConfig, stemmed: bool) -> DataFrame:
    """query_id, passage_id, r of the full-text arm, from stored postings. The queries are parsed once, and their hits are staged, as matching and ranking both read them."""
    terms = stage_table(postings.needed_blocks(fulltext.query_terms(queries, stemmed), queries, cfg.candidates, cfg.default_top_k), "terms")
    found = stage_table(postings.hits(index, terms), "hits")
    return fulltext.top_candidates(fulltext.ranked(found, terms, passages), queries, cfg.candidates, cfg.default_top_k)


def hybrid_search(queries: DataFrame, passages: DataFrame, notes: DataFrame, cfg: SearchConfig = SearchConfig(), stemmed: bool = True, index: DataFrame | None = None) -> DataFrame:
    """query_id, position, the fields of RESULT and degraded. passages: passage_id, note_id, client_name, scope, ordinal, name, description, heading_path, content, embedding, embedding_degenerate. index: their stored postings (postings.build, with the same stemmed), else made here."""
    q = arm_weights(queries, cfg)
    by_text = q.filter("w_fts IS NOT NULL")
    fts = text_candidates(postings.build(passages, stemmed) if index is None else index, by_text, passages, cfg, stemmed)
    by_vector = q.filter("w_vec IS NOT NULL")
    vec = vector.nearest(passages, by_vector, cfg.candidates, cfg.default_top_k)
    arms = fts.join(q.select("query_id", F.col("w_fts").alias("w")), "query_id").withColumn("arm", F.lit("fts")).unionByName(
        vec.select("query_id", "passage_id", "r").join(q.select("query_id", F.col("w_vec").alias("w")), "query_id").withColumn("arm", F.lit("vec"))
    )
    return with_metadata(first_k(fuse(arms, cfg.rrf_k), q, cfg.default_top_k), q, passages, notes)


def hybrid_modes(queries: DataFrame, passages: DataFrame, notes: DataFrame, modes: dict[str, SearchConfig], stemmed: bool = True, index: DataFrame | None = None) -> DataFrame:
    """The rows of hybrid_search for each of modes, with its name in mode. Modes may differ in weights and rrf_k only: each arm is searched once, for all, and metadata is joined once."""
    cfg, *others = modes.values()
    if any((c.candidates, c.default_top_k) != (cfg.candidates, cfg.default_top_k) for c in others):
        raise ValueError("modes differ in candidates or default_top_k")
    queries = stage_table(queries, "queries")
    by_mode = {name: arm_weights(queries, c).withColumn("mode", F.lit(name)) for name, c in modes.items()}
    q = reduce(DataFrame.unionByName, by_mode.values())
    on = lambda w: queries.join(q.filter(F.col(w).isNotNull()).select("query_id").distinct(), "query_id", "left_semi")
    fts = text_candidates(postings.build(passages, stemmed) if index is None else index, on("w_fts"), passages, cfg, stemmed).withColumn("arm", F.lit("fts"))
    vec = vector.nearest(passages, on("w_vec"), cfg.candidates, cfg.default_top_k).select("query_id", "passage_id", "r").withColumn("arm", F.lit("vec"))
    arms = stage_table(fts.unionByName(vec), "arms")
    cuts = []
    for name, own in by_mode.items():
        weight = F.when(F.col("arm") == "fts", F.col("w_fts")).otherwise(F.col("w_vec"))
        weighed = arms.join(own.select("query_id", "w_fts", "w_vec"), "query_id").withColumn("w", weight).filter("w IS NOT NULL")
        cuts.append(first_k(fuse(weighed, modes[name].rrf_k), own, cfg.default_top_k).withColumn("mode", F.lit(name)))
    return with_metadata(reduce(DataFrame.unionByName, cuts), q, passages, notes, "mode")
