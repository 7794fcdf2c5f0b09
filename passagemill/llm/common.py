"""Helpers shared by the training-text operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.session import stage_table  # noqa: F401

#: Arrow batches are bounded by rows and, as texts can be long, by bytes.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20
#: The bytes where several operators follow each other in one session: workers stay between them, and keep what their largest batch took.
SMALL_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bound_batches(spark: SparkSession, most_bytes: int = ARROW_BYTES) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


#: Rows of one key from which it counts as hot, keys that are broadcast at most, and the salts beyond that.
HOT_ROWS, BROADCAST_KEYS, SALTS = 256, 1_000_000, 64


def hot_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """big with the columns of small by the keys on, inner or left. small has one row for each key, and rows: on how many rows of big the key stands (at least).

    Keys on HOT_ROWS rows or more are split over tasks: there is at most one for each HOT_ROWS rows, so few are broadcast (when they were counted to be at most BROADCAST_KEYS), and more are salted. The other keys go by a shuffle. big is read twice if any key is hot.
    """
    hot, cold = small.filter(F.col("rows") >= HOT_ROWS).drop("rows"), small.filter(F.col("rows") < HOT_ROWS).drop("rows")
    n = hot.count()
    if not n:
        return big.join(cold, on, how)
    keys = hot.select(*on)
    if n <= BROADCAST_KEYS:
        first = big.join(F.broadcast(hot), on)
        rest = big.join(F.broadcast(keys), on, "left_anti")
    else:
        each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        spread = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in big.columns if c not in on]), F.lit(SALTS)).cast("int"))
        first = spread.join(hot.select("*", each), [*on, "_salt"]).drop("_salt")
        rest = spread.join(keys.select(*on, each), [*on, "_salt"], "left_anti").drop("_salt")
    return first.unionByName(rest.join(cold, on, how))


def free_name(columns: list[str], want: str) -> str:
    """want, or want with as many underscores before it as it takes to differ from all columns whatever their case."""
    taken = {c.lower() for c in columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each window of width words, in text order; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix64(out ^ hashes[i : i + n])
    return out


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of width words; with fewer words the whole sequence is the one shingle, and no word gives none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))))
