"""The full-text arm's stored index: blocks of postings by (tenant, lexeme), in order of impact.

A passage's impact for a lexeme is what a query of that one term ranks it by: the sum of
its occurrences' weights. A lexeme's passages are dealt to shards by a hash of their id
(one shard, or SHARDS for a lexeme of more than HOT passages, so that no list is in one
task), ordered in each shard by falling impact, then id, and cut into blocks of
BLOCK passages; a block has its largest impact and its passages' postings. The
index's files are sorted by (tenant, lexeme), so that readers skip other row groups.

A search reads the blocks of its terms. For a query of one term without a scope, its
first n passages are among the first n of each shard, so it ends after ceil(n / BLOCK)
blocks of each; this changes no result. Other queries, whose rank depends on where terms
meet, read all blocks of their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators import fulltext
from passagemill.session import stage_table

BLOCK, HOT, SHARDS = 128, 4096, 16
LABELS = "".join(fulltext.WEIGHTS)
#: Distinct terms up to which the scan itself looks for them.
PUSHED_TERMS = 1000
SCHEMA = "client_name string, lexeme string, shard int, block int, top float, hits array<struct<passage_id: bigint, scope: string, pos: int, weight: string>>"


def tenths(weight: Column) -> Column:
    """A weight in tenths, so that sums are exact."""
    value = F.lit(None).cast("long")
    for label, w in fulltext.WEIGHTS.items():
        value = F.when(weight == label, F.lit(round(w * 10)).cast("long")).otherwise(value)
    return value


def lists(passages: DataFrame, stemmed: bool = True) -> DataFrame:
    """client_name, scope, passage_id, lexeme and places (4 * pos + the label's number in LABELS) of each lexeme of each passage. Texts are dealt by passage and cut once; a posting never leaves its task."""
    texts = passages.select("client_name", "scope", "passage_id", "name", "heading_path", "content", "description").repartition("passage_id")
    place = F.col("pos") * 4 + F.instr(F.lit(LABELS), F.col("weight")) - 1
    own = ["client_name", "scope", "passage_id"]
    by_token = fulltext.postings(texts, stemmed=stemmed).groupBy(*own, "token").agg(F.collect_list(place).alias("places"))
    if not stemmed:
        return by_token.withColumnRenamed("token", "lexeme")
    words = by_token.withColumn("lexeme", fulltext.lexemes(F.col("token"))).filter("lexeme IS NOT NULL")
    return words.groupBy(*own, "lexeme").agg(F.flatten(F.collect_list("places")).alias("places"))


def build(passages: DataFrame, stemmed: bool = True) -> DataFrame:
    """The index (SCHEMA) of passages (passage_id, client_name, scope, name, heading_path, content, description).

    The lists of passages are staged, then counted, and shuffled once by tenant, lexeme and shard.
    """
    held = stage_table(lists(passages, stemmed), "lists")
    key = ["client_name", "lexeme"]
    # Fewer than one in HOT lists.
    hot = held.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(*key, F.lit(True).alias("hot"))
    shard = F.when(F.coalesce("hot", F.lit(False)), F.pmod(F.xxhash64("passage_id"), F.lit(SHARDS))).otherwise(0).cast("int")
    own = held.join(F.broadcast(hot), key, "left").withColumn("shard", shard).drop("hot").repartition(*key, "shard")
    label = lambda x: F.substring(F.lit(LABELS), x % 4 + 1, F.lit(1))
    own = own.withColumn("impact", F.aggregate("places", F.lit(0).cast("long"), lambda n, x: n + tenths(label(x))))
    place = F.row_number().over(Window.partitionBy(*key, "shard").orderBy(F.col("impact").desc(), "passage_id"))
    own = own.withColumn("block", F.floor((place - 1) / BLOCK).cast("int"))
    hits = F.transform("places", lambda x: F.struct(F.col("passage_id").alias("passage_id"), F.col("scope").alias("scope"), F.floor(x / 4).cast("int").alias("pos"), label(x).alias("weight")))
    blocks = own.groupBy(*key, "shard", "block").agg((F.max("impact") / 10).cast("float").alias("top"), F.flatten(F.collect_list(hits)).alias("hits"))
    return stage_table(blocks.sortWithinPartitions(*key, "shard", "block"), "postings")


def needed_blocks(terms: DataFrame, queries: DataFrame, candidates: int, default_top_k: int = 5) -> DataFrame:
    """terms with most_blocks: how many blocks of each shard can hold a result of the query; null: all."""
    n = F.greatest(F.lit(candidates), F.coalesce(F.col("top_k"), F.lit(default_top_k)))
    own = terms.groupBy("query_id").agg(F.count("*").alias("many"), F.bool_or("negated").alias("without")).join(queries.select("query_id", n.alias("wanted")), "query_id")
    ends = (F.col("many") == 1) & ~F.col("without") & (F.coalesce("repo_filter", F.lit("")) == "")
    return terms.join(own, "query_id").withColumn("most_blocks", F.when(ends, F.ceil(F.col("wanted") / BLOCK))).drop("many", "without", "wanted")


def hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """As fulltext.hits, from the index's blocks. terms may have most_blocks."""
    t = terms if "most_blocks" in terms.columns else terms.withColumn("most_blocks", F.lit(None).cast("long"))
    t = t.withColumnRenamed("term", "lexeme")
    if terms.limit(fulltext.BROADCAST_TERMS + 1).count() <= fulltext.BROADCAST_TERMS:
        t = F.broadcast(t)
        few = [r[0] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        if len(few) <= PUSHED_TERMS:
            index = index.filter(F.col("lexeme").isin(few))  # reaches the scan
    both = index.join(t, ["client_name", "lexeme"]).filter(F.col("most_blocks").isNull() | (F.col("block") < F.col("most_blocks")))
    head = ["query_id", "clause", "item", "offset", "length", "negated", "lexeme"]
    each = both.select(*head, "repo_filter", F.explode("hits").alias("x")).filter(fulltext.in_scope("repo_filter", "x.scope"))
    return each.select("query_id", "clause", "item", "offset", "length", "negated", "x.passage_id", "x.pos", "x.weight", "lexeme")
