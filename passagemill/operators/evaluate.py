"""Retrieval evaluation: first hits, the gate's verdict, misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(results: DataFrame, golden: DataFrame, top_k: int) -> DataFrame:
    """golden (query_id, expect_path_or_uri) with hit_rank (null: a miss), returned (the first top_k paths in order) and degraded."""
    r = results.join(golden.select("query_id", "expect_path_or_uri"), "query_id")
    hit = F.array_contains("expect_path_or_uri", F.col("path_or_uri")) & (F.col("position") <= top_k)
    each = r.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("position"))).alias("hit_rank"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("position") <= top_k, F.struct("position", "path_or_uri")))), lambda x: x["path_or_uri"]).alias("returned"),
        F.bool_or("degraded").alias("degraded"),
    )
    empty = F.array().cast("array<string>")
    return golden.join(each, "query_id", "left").withColumn("returned", F.coalesce("returned", empty)).withColumn("degraded", F.coalesce("degraded", F.lit(False)))


def gate(hits: DataFrame, threshold: int, minimum: int) -> DataFrame:
    """One row: hits, total, degraded, verdict (void, invalid, pass or fail) and passed (null unless pass or fail)."""
    one = hits.agg(F.count_if(F.col("hit_rank").isNotNull()).alias("found"), F.count("*").alias("total"), F.coalesce(F.bool_or("degraded"), F.lit(False)).alias("degraded"))
    verdict = F.when(F.col("total") < minimum, "void").when(F.col("degraded"), "invalid").when(F.col("found") >= threshold, "pass").otherwise("fail")
    one = one.withColumn("verdict", verdict)
    return one.select(F.when(F.col("verdict") == "void", 0).otherwise(F.col("found")).alias("hits"), "total", "degraded", "verdict", F.when(F.col("verdict").isin("pass", "fail"), F.col("verdict") == "pass").alias("passed"))
