"""Audits over the store: keys, references, splits, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import vectors as vf
from passagemill.operators.split import MAX_CHARS


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(passages: DataFrame, notes: DataFrame) -> DataFrame:
    """Passages whose (note_id, client_name, scope) has no note."""
    return passages.join(notes.select(F.col("id").alias("note_id"), "client_name", "scope"), ["note_id", "client_name", "scope"], "left_anti")


def backfill_scope(passages: DataFrame, notes: DataFrame) -> DataFrame:
    """passages with the scope of their note."""
    return passages.drop("scope").join(notes.select(F.col("id").alias("note_id"), "client_name", "scope"), ["note_id", "client_name"])


def split_quality(notes: DataFrame, passages: DataFrame) -> DataFrame:
    """By note (id, body): longest passage, count, whether ordinals are contiguous from 0, whether the passages give the body but for blanks, and ok."""
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    each = passages.groupBy("note_id").agg(
        F.max(F.length("content")).alias("longest"), F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("ordinal").alias("distinct"),
        squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "")).alias("text"),
    )
    both = notes.select(F.col("id").alias("note_id"), "body").join(each, "note_id")
    contiguous = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("distinct") == F.col("n"))
    same = F.col("text") == squeeze(F.col("body"))
    return both.select("note_id", "longest", "n", contiguous.alias("contiguous"), same.alias("same_text"), (contiguous & same & (F.col("longest") <= MAX_CHARS)).alias("ok"))


def corpus_profile(notes: DataFrame, content: str = "content") -> DataFrame:
    """By size band: notes, notes with three or more ## headings, notes without frontmatter, largest."""
    size = F.length(content)
    band = F.when(size <= 1500, "1: to 1500").when(size <= 4000, "2: to 4000").otherwise("3: over 4000")
    h2 = F.regexp_count(content, F.lit(r"(?m)^##[ \t]+\S"))
    return notes.groupBy(band.alias("band")).agg(F.count("*").alias("notes"), F.count_if(h2 >= 3).alias("sectioned"), F.count_if(~F.col(content).startswith("---\n")).alias("plain"), F.max(size).alias("largest"))


def embedding_faults(rows: DataFrame, width: int) -> DataFrame:
    """By fault ('ok' without): count, least and greatest width, and the three least ids. rows: id, embedding (array<double>)."""
    f = rows.select("id", F.size("embedding").alias("size"), F.coalesce(vf.vector_fault(F.col("embedding"), width), F.lit("ok")).alias("fault"))
    first = f.withColumn("r", F.row_number().over(Window.partitionBy("fault").orderBy("id"))).filter("r <= 3").groupBy("fault").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return f.groupBy("fault").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).join(first, "fault")


def embedding_verdict(faults: DataFrame) -> DataFrame:
    """One row: what the audit finds first: unusable values, width mismatch, or ok."""
    has = lambda *x: F.coalesce(F.bool_or(F.col("fault").isin(*x)), F.lit(False))
    return faults.agg(F.when(has("value", "zero norm", "missing"), "unusable").when(has("width"), "width").otherwise("ok").alias("verdict"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"))


def norm_report(rows: DataFrame, width: int) -> DataFrame:
    """By id: the norm in double and in float32 steps, and whether the vector is accepted."""
    e = F.col("embedding")
    return rows.select("id", F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)).alias("norm64"), F.sqrt(vf.float32_square_norm(e).cast("double")).alias("norm32"), vf.vector_fault(e, width).isNull().alias("accepted"))
