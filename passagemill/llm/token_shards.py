"""Token ids in training order, as fixed-stride binary shards.

Documents are tokenised and strung together within a partition, each ended by the
separator id, and cut into sequences of one length (the last of a partition is
padded). A sequence's number is its place in its partition after room for all
that the partitions before could hold: a token is at least a byte, so bytes bound
sequences and nothing has to be tokenised twice. A keyed Feistel network over the
next power of four, walked until it lands below the end of the numbers, permutes
them; a sequence's global slot is the rank of its permuted number. Ranges of
permuted numbers are shards, each written in order with a fixed stride, so shard
sizes give every slot's place, and a reader can seek to any slot and go on.

A shard is written under another name and renamed, so a lost executor leaves no
half shard, and a repeated task writes the same bytes. A null or empty text gives
its separator alone. Null or repeated doc_ids and repeated rows are sequenced one
by one; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import bound_batches, stage_table
from passagemill.llm.tokens import SEPARATOR, SPECIAL, Encoder, vocabulary_paths
from passagemill.session import shared_folder

#: Ids of a sequence, their type on disk, permuted numbers of a shard (a third or so are taken), rounds and key of the Feistel network.
LENGTH, DTYPE, SHARD_NUMBERS, ROUNDS, KEY = 1024, "<u2", 1 << 16, 6, 20_240_229
PADDING = 0


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The permuted numbers x, all below n: a keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(rounds):
            z = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]  # walk the cycle on
    return out.astype(np.int64)


def sequences(batches: Iterator[pa.RecordBatch], path: str, pattern: str, length: int) -> Iterator[tuple[np.ndarray, int, object, object]]:
    """(ids, ids that are no padding, first doc_id, last doc_id) of each sequence of a partition's documents (doc_id, text)."""
    encoder = Encoder.shared(path, pattern, SPECIAL)
    held, docs, size = [], [], 0
    for b in batches:
        for doc, found in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
            ids = np.append(found, np.uint32(SEPARATOR))
            at = 0
            while at < len(ids):
                part = ids[at : at + length - size]
                held.append(part)
                docs.append(doc)
                size += len(part)
                at += len(part)
                if size == length:
                    yield np.concatenate(held), length, docs[0], docs[-1]
                    held, docs, size = [], [], 0
    if size:
        yield np.concatenate([*held, np.full(length - size, PADDING, np.uint32)]), size, docs[0], docs[-1]


def write_shards(docs: DataFrame, folder: str, length: int = LENGTH, shard_numbers: int = SHARD_NUMBERS, key: int = KEY, dtype: str = DTYPE) -> DataFrame:
    """Write docs (doc_id, text) as shards into folder (a URI that pyarrow.fs opens on every executor). Returns the index, one row for each sequence: slot, shard, byte_offset, sequence, n_tokens, first_doc_id, last_doc_id, ids_crc32."""
    bound_batches(docs.sparkSession)
    path, pattern = vocabulary_paths()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    most = F.ceil(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / length).cast("long")
    room = {r["part"]: r["n"] for r in d.groupBy(F.spark_partition_id().alias("part")).agg(most.alias("n")).collect()}  # one row for each partition
    offsets, total, most_id = {}, 0, int(np.iinfo(dtype).max)
    for part in sorted(room):
        offsets[part] = total
        total += room[part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        count, rows = 0, []

        def flush() -> pa.RecordBatch:
            seq = np.array([r[0] for r in rows], np.int64)
            placed = feistel(seq, total, key)
            out = pa.RecordBatch.from_arrays(
                [pa.array(placed // shard_numbers, pa.int32()), pa.array(placed), pa.array(seq), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                names=["shard", "placed", "sequence", "ids", "n_tokens", "first_doc_id", "last_doc_id"],
            )
            rows.clear()
            return out

        for ids, n, first, last in sequences(batches, path, pattern, length):
            if count >= room.get(part, 0):
                raise RuntimeError(f"partition {part} changed between the two readings")
            if int(ids.max()) > most_id:
                raise ValueError(f"an id above {most_id} does not fit {dtype}")
            rows.append((offsets[part] + count, ids.astype(dtype).tobytes(), n, first, last))
            count += 1
            if len(rows) == 500:
                yield flush()
        if rows:
            yield flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out = shard = name = None
        row = 0

        def close() -> None:
            out.close()
            store.move(name, f"{root}/shard-{shard:08d}.bin")

        for b in batches:
            shards_of = b.column(0).to_numpy()
            at = np.empty(len(shards_of), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(shards_of)) + 1), len(shards_of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if out is None or shards_of[lo] != shard:
                    if out is not None:
                        close()
                    store.create_dir(root, recursive=True)
                    shard, name, row = int(shards_of[lo]), f"{root}/.{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(name)
                for x in b.column(3)[lo:hi]:
                    out.write(x.as_buffer())
                at[lo:hi] = np.arange(row, row + hi - lo)
                row += hi - lo
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at), b.column(2), b.column(4), b.column(5), b.column(6), crc], names=["shard", "row", "sequence", "n_tokens", "first_doc_id", "last_doc_id", "ids_crc32"])
        if out is not None:
            close()

    cut_rows = d.mapInArrow(cut, "shard int, placed long, sequence long, ids binary, n_tokens int, first_doc_id long, last_doc_id long")
    ordered = cut_rows.repartitionById(max(1, -(-total // shard_numbers)), F.col("shard")).sortWithinPartitions("shard", "placed")
    index = stage_table(ordered.mapInArrow(write, "shard int, row long, sequence long, n_tokens int, first_doc_id long, last_doc_id long, ids_crc32 long"), "shard-index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    stride = length * np.dtype(dtype).itemsize
    return index.join(starts, "shard").select((F.col("start") + F.col("row")).alias("slot"), "shard", (F.col("row") * stride).alias("byte_offset"), "sequence", "n_tokens", "first_doc_id", "last_doc_id", "ids_crc32")


def read_slots(folder: str, first_slot: int = 0, length: int = LENGTH, dtype: str = DTYPE) -> Iterator[np.ndarray]:
    """The sequences of folder from first_slot on, in slot order, by sequential reads."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(dtype).itemsize
    skip = first_slot
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if not info.base_name.startswith("shard-"):
            continue
        held = info.size // stride
        if skip >= held:
            skip -= held
            continue
        with store.open_input_file(info.path) as f:
            f.seek(skip * stride)
            while raw := f.read(stride):
                yield np.frombuffer(raw, dtype)
        skip = 0


def op7_token_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return write_shards(docs, f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}")
