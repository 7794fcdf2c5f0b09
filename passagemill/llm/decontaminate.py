r"""Which words of documents lie in passages of a benchmark: a set join by prefix filter.

Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased. A benchmark
item's windows are its runs of `width` words, or all its words if it has fewer. A
window occurs in a document if the document has its words one after another.

A window is a set of shingles of SHINGLE words (or of all its words, if it has fewer).
To hold the window, a text must hold all its shingles, so one of them is prefix enough:
the rarest in the documents. Steps:

1. Rarity: the documents' shingles that a Bloom filter of the benchmark's shingles lets
   through are counted in tasks, summed by Spark, and joined to the windows' shingles. A
   window with a shingle that no document has occurs nowhere and goes.
2. Prefix: each window keeps its rarest shingle and the shingle's place in it.
3. Join: the documents' shingles that a filter of the prefix shingles lets through are
   staged with the words around them, and joined to the windows by shingle. Shingles on
   many rows are split over tasks.
4. Bounds: the window must begin and end within the document (the place of the shingle
   in both tells where).
5. Verification: the window's words and the document's words there must be equal.

No text is shuffled but the words around prefix shingles, and nothing is broadcast but
the filters, which have at most 16 MB whatever the benchmark's size.

Each row of documents is a document, also if its id or all of it is repeated. Items of
one id are one item; a null id counts as the empty string. Null and empty texts have no
words and no windows. Very long texts are kept whole; a text's hits are rows, not a
list. Ties between shingles go to the first in the window. Columns other than doc_id,
item_id and text are not looked at, whatever their names. Empty documents give an empty
result; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.llm.bytewords import bloom, lower_ascii, may_hold, parts, shingles, word_bytes, words_of
from passagemill.llm.common import bound_batches, hot_join, stage_table

WIDTH, SHINGLE = 10, 4
#: Bytes that are no part of a word: all of ASCII but digits and lower-case letters.
WORD_BYTES = word_bytes(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct shingles that a task counts before it hands them on.
HELD_COUNTS = 1 << 18


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item (its id as a string), words (the window's, joined by spaces) and len of each distinct window of items (item_id, text)."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    t = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return t.select("item", n.alias("len"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("words")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """words, len, off and h of each shingle of distinct windows (words, len)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words_of(b.column(0), WORD_BYTES)
            h, first = w.hashes(), np.cumsum(w.counts()) - w.counts()
            for k in range(1, SHINGLE + 1):
                place, key = shingles(h, w.row, k)
                keep = np.minimum(w.counts(), SHINGLE)[w.row[place]] == k
                place, key = place[keep], key[keep]
                row = w.row[place]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array((place - first[row]).astype(np.int32)), pa.array(key.view(np.int64))], names=["words", "len", "off", "h"])

    return windows.select("words", "len").mapInArrow(run, "words string, len int, off int, h long")


def _found(batch: pa.Array, sizes: list[int], table: Broadcast):
    """The batch's words, and the places and hashes of its shingles of these sizes that the filter lets through."""
    w = words_of(batch, WORD_BYTES)
    h = w.hashes()
    for k in sizes:
        place, key = shingles(h, w.row, k)
        ok = may_hold(table.value, key)
        yield w, place[ok], key[ok]


def shingle_counts(docs: DataFrame, sizes: list[int], table: Broadcast) -> DataFrame:
    """h and n: how often each shingle that the filter lets through occurs in docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64))], names=["h", "n"])

        for b in (p for b in batches for p in parts(b, 0)):
            for _, _, key in _found(b.column(0), sizes, table):
                key, n = np.unique(key, return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
            if held > HELD_COUNTS:
                yield flush()
                keys, counts, held = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def document_postings(docs: DataFrame, sizes: list[int], table: Broadcast, width: int) -> DataFrame:
    """Two kinds of rows: for each of docs rid (a number of its own), doc_id and n_words; for each of its shingles that the filter lets through rid, n_words, h, its place, and the words around it with the first one's place."""
    back, ahead = width - 1, width
    kind = docs.schema["doc_id"].dataType
    names = ["rid", "doc_id", "n_words", "h", "place", "low", "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 32
        for b in (p for b in batches for p in parts(b, 1)):
            n_words = None
            for w, place, key in _found(b.column(1), sizes, table):
                if n_words is None:
                    n_words = w.counts()
                    none = lambda t, n=len(n_words): pa.nulls(n, t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(n_words))), b.column(0), pa.array(n_words), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.string())], names=names)
                    first = np.cumsum(n_words) - n_words
                if not len(place):
                    continue
                row = w.row[place]
                low, high = np.maximum(first[row], place - back), np.minimum(first[row] + n_words[row], place + ahead)
                around = [w.text(a, z).decode() for a, z in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rid + row), pa.nulls(len(row), b.column(0).type), pa.array(n_words[row]), pa.array(key.view(np.int64)), pa.array(place - first[row]), pa.array(low - first[row]), pa.array(around, pa.string())], names=names)
            rid += b.num_rows

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("rid", LongType()).add("doc_id", kind)
    for name in names[2:-1]:
        schema = schema.add(name, LongType())
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("around", StringType()))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, places, windows): rid, doc_id, n_words of each document; rid, words, start and len of each occurrence of a window; item, words, len of the items' windows."""
    spark = docs.sparkSession
    bound_batches(spark)
    windows = stage_table(item_windows(items, width), "benchmark-windows")
    shingled = stage_table(window_shingles(windows.select("words", "len").distinct()), "benchmark-shingles")
    sizes = [r[0] for r in shingled.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect()] or [SHINGLE]  # at most SHINGLE
    n = shingled.count()
    seen = spark.sparkContext.broadcast(bloom(shingled, "h", n))
    counts = shingle_counts(docs, sizes, seen)
    w = Window.partitionBy("words")
    first = Window.partitionBy("words").orderBy("n", "off")
    rare = shingled.join(counts, "h", "left").withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(w)).filter("least > 0").withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    prefix = stage_table(rare.select("h", "off", "len", "words", F.col("n").alias("rows")), "benchmark-prefixes")
    table = spark.sparkContext.broadcast(bloom(prefix, "h", prefix.count()))
    staged = stage_table(document_postings(docs, sizes, table, width), "benchmark-postings")
    posts = staged.filter("h IS NOT NULL").drop("doc_id")
    start = F.col("place") - F.col("off")
    met = hot_join(posts, prefix, ["h"]).withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    there = F.slice(F.split("around", " "), (F.col("start") - F.col("low") + 1).cast("int"), F.col("len"))
    places = met.filter(F.array_join(there, " ") == F.col("words")).select("rid", "words", "start", "len")
    return staged.filter("h IS NULL").select("rid", "doc_id", "n_words"), stage_table(places, "benchmark-places"), windows


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_hit (words in windows of items), n_items, items_sha256 (of their ids), contaminated."""
    each, places, windows = occurrences(docs, items, width)
    # Words that a document's windows cover: each adds what lies behind the furthest end so far.
    w = Window.partitionBy("rid").orderBy("start")
    ends = places.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    upto = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = ends.withColumn("upto", upto).groupBy("rid").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "upto"), F.lit(0))).alias("n_hit"))
    found = places.select("rid", "words").distinct()
    rows = found.groupBy("words").agg(F.count("*").alias("rows"))
    named = hot_join(found, windows.select("item", "words").join(rows, "words"), ["words"]).select("rid", "item").distinct()
    ids = named.groupBy("rid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = each.join(hit, "rid", "left").join(ids, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS b FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, array_to_string(w[b:b + 9], ' ') AS g, least(len(w), 10) AS m FROM s),
m AS (SELECT DISTINCT m FROM g),
p AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS b FROM d, m),
x AS (SELECT doc_id, p.m, b, item_id FROM (SELECT doc_id, m, b, array_to_string(w[b:b + m - 1], ' ') AS g FROM p WHERE len(w) >= m) p JOIN g USING (g, m)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + m)) AS k FROM x) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM x) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
