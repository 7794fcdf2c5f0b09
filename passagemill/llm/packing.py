"""Bounded-space online packing of tokenised documents into windows.

Each partition streams its documents: whole windows are cut off at once, and the
rest of a document goes to the open window that it fills best. A fixed number of
windows is open; when none has room, the fullest is emitted. Windows still open
at the end of a partition are merged in small groups of partitions: whole into
the window that they fill best, and what is left end to end, cut where a window is
full. A document ends with the separator id; each id lies in
exactly one piece.

A null text counts as empty (its one id is the separator). Null or repeated
doc_ids and repeated rows are packed one by one. An empty table gives no piece.
Ids of sequences come from partition numbers, so the same input files in the
same splits give the same result, also after a lost executor.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import SMALL_BYTES, bound_batches, stage_table
from passagemill.llm.tokens import SEPARATOR, SPECIAL, Encoder, vocabulary_paths

WINDOW, OPEN_WINDOWS = 1024, 64
#: Partitions whose leftover windows are merged together, and the room for sequences of one partition or group.
MERGED_PARTITIONS, ROOM = 16, 1 << 40
#: A merged window with more than this share free is loose.
LOOSE = 0.01

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("filled", pa.int64()), ("merge_group", pa.int64()), ("ids", pa.binary())]
)


class OpenWindows:
    """At most limit open windows of size tokens; best fit."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.pieces: dict[int, list] = {}
        self.next = 0

    def place(self, length: int, piece: list) -> list | None:
        """Put piece into a window; a window's pieces if one was emitted."""
        out = None
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, w = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                _, full = self.free.pop(0)
                out = self.pieces.pop(full)
            free, w = self.size, self.next
            self.next += 1
            self.pieces[w] = []
        self.pieces[w].append((piece, self.size - free))
        if free > length:
            insort(self.free, (free - length, w))
            return out
        done = self.pieces.pop(w)
        return done if out is None else out + [None] + done

    def rest(self) -> list[tuple[int, list]]:
        """(filled, pieces) of the windows still open, fullest first."""
        return [(self.size - free, self.pieces[w]) for free, w in self.free]


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, pattern: str, window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of one partition's documents (doc_id, text). filled is null for emitted windows, else how full the open window is."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    encoder, opened, sequence = Encoder.shared(path, pattern, SPECIAL), OpenWindows(window, limit), part * ROOM
    rows: list[tuple] = []

    def emit(pieces: list, filled: int | None = None) -> None:
        nonlocal sequence
        for p in pieces:
            if p is None:
                sequence += 1
                continue
            (doc, start, length, crc, tokens, ids), offset = p
            rows.append((doc, start, length, crc, tokens, sequence, offset, filled, part // MERGED_PARTITIONS, None if filled is None else ids))
        sequence += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in PIECES]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, PIECES, strict=True)], schema=PIECES)

    for batch in batches:
        for doc, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
            ids = np.append(found, np.uint32(SEPARATOR)).astype("<u4")
            n = len(ids)
            for start in range(0, n, window):
                length = min(window, n - start)
                raw = ids[start : start + length].tobytes()
                piece = (doc, start, length, zlib.crc32(raw), n, raw)
                if length == window:
                    emit([(piece, 0)])
                elif (done := opened.place(length, piece)) is not None:
                    emit(done)
            if len(rows) >= 20_000:
                yield flush()
    for filled, pieces in opened.rest():
        emit(pieces, filled)
    yield flush()


def merge_leftovers(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """Put the open windows of a few partitions together: the fullest first into the window that they fill best, then what is still loose end to end, cut at the windows' ends."""
    held = {k: g.sort_values("offset").to_dict("records") for k, g in group.groupby("sequence_id")}
    size = {k: sum(p["length"] for p in g) for k, g in held.items()}
    free: list[tuple[int, int]] = []
    for k in sorted(held, key=lambda k: (-size[k], k)):
        at = bisect_left(free, (size[k], -1))
        if at < len(free):
            room, to = free.pop(at)
            held[to] += held.pop(k)
        else:
            room, to = window, k
        if room > size[k]:
            insort(free, (room - size[k], to))
    loose = sorted(to for room, to in free if room > window * LOOSE)
    rest = [p for k in loose for p in held.pop(k)]
    out = []
    for k, g in held.items():
        offset = 0
        for p in g:
            out.append(p | {"sequence_id": k, "offset": offset})
            offset += p["length"]
    used, names = window, iter(loose)
    for p in rest:
        while p["length"]:
            if used == window:
                name, used = next(names), 0
            take = min(window - used, p["length"])
            raw = p["ids"][: 4 * take]
            out.append(p | {"sequence_id": name, "offset": used, "length": take, "ids": raw, "ids_crc32": zlib.crc32(raw)})
            p = p | {"start": p["start"] + take, "length": p["length"] - take, "ids": p["ids"][4 * take :]}
            used += take
    return pd.DataFrame(out, columns=group.columns)


def pack_documents(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bound_batches(docs.sparkSession, SMALL_BYTES)
    path, pattern = vocabulary_paths()
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: pack_partition(batches, path, pattern, window, open_windows),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, filled long, merge_group long, ids binary",
    )
    pieces = stage_table(pieces, "packed-pieces")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    merged = pieces.filter("filled IS NOT NULL").groupBy("merge_group").applyInPandas(lambda g: merge_leftovers(g, window), pieces.schema)
    return pieces.filter("filled IS NULL").select(*out).unionByName(merged.select(*out))


def op4_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
