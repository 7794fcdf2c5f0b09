"""Bottom-k sketches of word-shingle hashes.

A sketch is the k smallest hashes of a text's distinct shingles (5 words; with
fewer words the whole sequence is the one shingle). Sketches of parts merge into
the sketch of the whole, and estimate resemblance, containment and the number of
distinct shingles; below k shingles the estimates are exact.

A null text counts as empty; an empty text has the empty sketch, which resembles
only itself. Rows are told apart by doc_id, then by text, so that nulls (last), ties
and repeated rows have one defined order; an empty table gives an empty result.
Very long texts are sketched whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from passagemill.llm.common import bound_batches, free_name, shingle_set

SHINGLE_WORDS, K = 5, 128
#: Bits of a stored hash: six bytes keep a sketch short and still tell apart more shingles than a text holds.
HASH_BYTES = 6
SPACE = float(1 << (8 * HASH_BYTES))
#: Bytes of a part's texts, about: a part is one task's work. Parts at most, as their bounds are collected; beyond that many, parts grow instead.
PART_BYTES, MAX_PARTS = 8 << 20, 20_000


def sketch(text: str, k: int = K, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The k smallest hashes, ascending."""
    hashes = shingle_set(text.encode("utf-8", "surrogatepass").split(), width) >> np.uint64(64 - 8 * HASH_BYTES)
    return np.unique(hashes[: 2 * k])[:k] if len(hashes) > k else np.unique(hashes)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def to_string(a: np.ndarray) -> str:
    """A sketch as base64 of its hashes, big-endian."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    """The sketch that to_string wrote."""
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BYTES :] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with the columns fingerprint and distinct_shingles, by rows alone. Where docs has such columns, underscores are put before the new ones' names."""
    names = [free_name(docs.columns, c) for c in ("fingerprint", "distinct_shingles")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = [sketch(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(to_string, sketches), pa.string()), pa.array(map(distinct_count, sketches), pa.float64())], names=[*b.schema.names, *names])

    bound_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.mapInArrow(make, schema)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, next_contains double"
EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("distinct_shingles", pa.float64()), ("next_contains", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ghost, doc_id, text) in order; a row's next document is the row after it in its part. Ghosts stand for a next document that lies in another part."""
    before = None
    for b in batches:
        out = []
        for part, ghost, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            own = sketch(text)
            if before is not None and before[0] == part:
                _, old, old_text, old_sketch = before
                half = len(old_text) // 2
                edited = old_text[: len(old_text) - half] + text[:half]
                new = sketch(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((old, len(old_text), digest, to_string(old_sketch), to_string(new), resemblance(old_sketch, new), resemblance(old_sketch, own), distinct_count(old_sketch), containment(old_sketch, own)))
            before = None if ghost else (part, doc, text, own)
        columns = list(zip(*out, strict=True)) if out else [[] for _ in EDITED]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, EDITED, strict=True)], schema=EDITED)


def _part(d: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """d (doc_id, text, tie, bytes) with part, and the number of parts: ranges of falling doc_id of about equal rows, rows without an id last. An id that alone fills a range, and the rows without one, are dealt over several parts by ranges of tie."""
    quantiles = d.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted({*quantiles, *(c + 1 for c, after in zip(quantiles, quantiles[1:], strict=False) if c == after)}) or [0.0]
    ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range")
    ranked = ranges.transform(d.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))))
    ranked = ranked.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - F.col("range").cast("int")))
    held = ranked.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one")).collect()  # one row for each range
    usual = max(1, sum(r["bytes"] for r in held) // parts)
    rows, at = [], 0
    for r in sorted(held, key=lambda r: r["range"]):
        splits = -(-r["bytes"] // usual) if r["one"] and r["bytes"] > 2 * usual else 1
        rows.append((r["range"], at, splits))
        at += splits
    table = F.broadcast(d.sparkSession.createDataFrame(rows, "range int, first int, splits int"))  # as few rows
    share = (F.col("tie").cast("double") / float(1 << 64) + 0.5) * F.col("splits")
    part = F.col("first") + F.least(F.floor(share), F.col("splits") - 1).cast("int")
    return ranked.join(table, "range").select("doc_id", "text", "tie", part.alias("part")), at


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each of docs (doc_id, text): its fingerprint, that of its edited text, their likeness, its likeness to and the share of its shingles in the next document, and its distinct shingles; the next document is the one with the next lower doc_id, after the last the first.

    Texts are shuffled once, into parts by order (_part). Their number follows the bytes of the texts, and each is one task. The first document of a part goes to the part before it too, so that no part waits for another.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("bytes"))
    if parts is None:
        parts = min(max(1, -(-(d.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES)), MAX_PARTS)
    d, n = _part(d, parts)
    heads = d.groupBy("part").agg(F.min(F.struct((-F.col("doc_id")).alias("down"), "tie")).alias("head")).select("part", "head.*").collect()  # one row for each part
    if not heads:
        return spark.createDataFrame([], COMPARED)
    heads.sort(key=lambda h: h["part"])
    goes_to = [(h["part"], None if h["down"] is None else -h["down"], h["tie"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    first = F.broadcast(spark.createDataFrame(goes_to, "head_part int, head long, head_tie long, ghost_part int"))  # as few rows
    both = d.join(first, (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    own, ghost = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")), F.struct(F.col("ghost_part").alias("part"), F.lit(True).alias("ghost"))
    copies = F.when(F.col("ghost_part").isNotNull(), F.array(own, ghost)).otherwise(F.array(own))
    placed = both.select("doc_id", "text", "tie", F.explode(copies).alias("c")).select("c.part", "c.ghost", "doc_id", "text", "tie")
    placed = placed.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "tie", F.col("text").asc_nulls_first())
    return placed.select("part", "ghost", "doc_id", "text").mapInArrow(_compare, COMPARED)


def op10_fingerprints(spark, sf_dir):
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
