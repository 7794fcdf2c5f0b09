"""Words of whole Arrow batches of texts by numpy, and a Bloom filter of bounded size.

Texts are UTF-8 and all separators are ASCII, so words are found on bytes, for all
texts of a batch at once. A word's hash is a polynomial over its bytes, finished by a
bijective mixer; two words of one hash are told apart only where a caller compares
the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import mix64

#: Bytes that are hashed at a time, and bytes of texts that are handled at a time (or one longer text).
CHUNK, PART = 1 << 20, 2 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(column):
    """column with A-Z in lower case, and null as empty."""
    return F.translate(F.coalesce(column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Words:
    """The words of a batch: data holds all its texts, A-Z in lower case; word i is data[start[i]:end[i]], of text row[i]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.row, minlength=len(self.offsets) - 1)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive), joined by spaces."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b))

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        out, powers = np.empty(len(self), np.uint64), np.cumprod(np.full(64, _FACTOR))
        length = self.end - self.start
        upto = np.cumsum(length)
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
            n = length[at:to]
            if n.max() > len(powers):
                powers = np.cumprod(np.full(int(n.max()), _FACTOR))
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            byte = self.data[np.repeat(self.start[at:to], n) + place].astype(np.uint64) + np.uint64(1)
            out[at:to] = mix64(np.add.reduceat(byte * powers[place], first))
            at = to
        return out


def word_bytes(separators: bytes) -> np.ndarray:
    """A table of 256 that holds for bytes of words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in pieces whose texts in column have PART bytes at most, or are one text."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART, "right")))
        yield batch.slice(at, to - at)
        at = to


def words_of(column: pa.Array, table: np.ndarray) -> Words:
    """The words of a column of texts; null has none."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = _LOWER[np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]] if body is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    offsets = ends - ends[0]
    inside = table[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return Words(data, offsets, start, end, np.searchsorted(offsets, start, "right") - 1)


def shingles(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of width words within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix64(out ^ hashes[i : i + n])
    place = np.flatnonzero(row[:n] == row[width - 1 :])
    return place, out[place]


# A Bloom filter. --------------------------------------------------------------

#: Bits of a filter: for each key, at least and at most (16 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 16, 27


def bloom(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A filter of the long keys in column, of which there are about n: a table of 64-bit words, of bounded size. Beyond its size it passes more, and never loses a key."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(n * BITS_A_KEY).bit_length()))
    mask = (1 << bits) - 1
    low, high = F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = keys.select(F.explode(F.array(low, high)).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
    words = bit.select(F.shiftright("bit", 6).alias("at"), one.alias("one")).groupBy("at").agg(F.bit_or("one").alias("value")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["at"].to_numpy()] = words["value"].to_numpy()
    return table.view(np.uint64)


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of keys (uint64)."""
    bits = len(table).bit_length() + 5
    out = np.ones(len(keys), bool)
    for bit in (keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)):
        out &= (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
    return out
