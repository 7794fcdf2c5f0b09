"""N-gram Jaccard join by count vectors and an R-tree.

A document is the set of its distinct 4-word shingles; two link when 100 times
the intersection is at least 85 times the union. Shingles are hashed into groups,
and the counts by group are the document's point: the overlap of two documents
is at most the sum of their points' coordinate minima.

1. Documents with equal sets are one node.
2. Points are dealt into cells. Within a band of sizes the shingles are dealt into
   blocks, and of two documents that link at most K shingles, and so K blocks,
   differ. A document is sent to the K + 1 blocks that hold most of its shingles, and
   in the next band too if a partner may lie there. Of the blocks with equal counts
   in both, the fullest is preceded by differing ones only, so both are sent to it.
   All that meet in a block are put into the cell that one of them names, so two
   documents that link share a cell; near copies meet in most of their blocks and
   share few cells. This is a partitioning alone: it compares nothing.
3. Each cell's points are an R-tree, bulk-loaded and searched for links (rtree.py).
   Pairs that pass the bounds of the boxes and of the points are verified on the
   sets. All links come from this search.
4. Components of the links.

A block that a sample shows to be common has its cell fixed beforehand, so that its
documents need not come together in one task; the sample changes the way, not the
result. A group of near copies costs about one link for each member, not all pairs.

Words are runs of other than blanks, ASCII-lower-cased. With fewer than 4 words
the whole sequence is one shingle; a null text or one without words has the empty
set and links with nothing. Rows with a null doc_id join only as equals of other
rows; rows that share a doc_id count as one document. An empty table gives an
empty result. Very long texts are taken whole. Columns other than doc_id and text
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import SMALL_BYTES, bound_batches, hot_join, mix64, shingle_set, stage_table
from passagemill.llm.rtree import LEAF, place_of, tree_components

WIDTH, PERCENT = 4, 85
#: Bands of sizes grow by this factor; blocks for each shingle of a band's largest set.
BAND, BLOCKS_EACH = 1.5, 0.2
#: Documents in the sample that shows common blocks, documents of it that make a block common, and rows of a block that are held together.
SAMPLE, COMMON, HELD = 1024, 8, 100_000
#: Ids that are broadcast for a semi-join at most; beyond that they are shuffled.
BROADCAST_IDS = 2_000_000


def text_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    return shingle_set((text or "").encode("utf-8", "surrogatepass").lower().split(), width)


def overlap_needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap with which sets of a and b shingles link."""
    return -(-percent * (a + b) // (100 + percent))


def differing(n: int, percent: int = PERCENT) -> int:
    """The most shingles in which a set of n and one that it links with differ."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def band_of(n: int) -> int:
    """The band of sizes that holds n."""
    band = int(np.floor(np.log(n) / np.log(BAND)))
    while band_start(band + 1) <= n:
        band += 1
    while band_start(band) > n:
        band -= 1
    return band


def band_start(band: int) -> int:
    return int(np.ceil(BAND**band))


def block_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the blocks to which a set is sent. A block's key stands for its band, its number and its counts by group (a sum of mixed group numbers, so that equal counts give equal keys)."""
    n = len(hashes)
    k = differing(n, percent)
    if n == 0 or k == 0:
        return np.empty(0, np.uint64)  # such a set links only with its equals
    own = band_of(n)
    bands = [own] + [own + 1] * (100 * n // percent >= band_start(own + 1))
    out = []
    for band in bands:
        largest = band_start(band + 1)
        blocks = max(differing(largest, percent) + 2, int(BLOCKS_EACH * largest) + 4)
        spread = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D + band))
        block = (spread >> np.uint64(40)) % np.uint64(blocks)
        group = mix64(spread)
        order = np.argsort(block, kind="stable")
        at = block[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums = np.add.reduceat(group[order], first)
        number, held = at[first], np.diff(np.append(first, n))
        if len(number) <= k:  # the empty ones are needed as well
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), number)
            number, sums, held = np.concatenate([number, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)]), np.concatenate([held, np.zeros(len(empty), np.int64)])
        best = np.lexsort((number, -held))[: k + 1]
        number, sums = number[best], sums[best]
        out.append(mix64(mix64(sums) ^ mix64(number + np.uint64(band << 40))))
    return np.concatenate(out)


def set_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest (k1, k2) of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, high, low = [], [], []
            for text in b.column(1).to_pylist():
                s = text_set(text, width)
                d = xxhash.xxh3_128_digest(s.astype("<u8").tobytes())
                sizes.append(len(s))
                high.append(int.from_bytes(d[:8], "big", signed=True))
                low.append(int.from_bytes(d[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["doc_id", "n_shingles", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


def block_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """key, doc_id, home (the document's least key) and placed for each block to which a document is sent. Of equal sets within a task only the first is sent.

    common: keys (sorted) whose cells are known already, and these cells. A document has one row for all its keys of one such cell, with placed true and the cell in home.
    """
    known, cells = common if common is not None else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, ids, homes, placed = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = text_set(text, width)
                d = xxhash.xxh3_128_digest(s.astype("<u8").tobytes())
                if d in seen:
                    continue
                seen.add(d)
                own = block_keys(s, percent)
                if not len(own):
                    continue
                home = np.full(len(own), own.min(), np.uint64).view(np.int64)
                direct = np.empty(0, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    there = known[at] == own
                    direct = np.unique(cells[at[there]])
                    own, home = own[~there], home[~there]
                spread = mix64(direct.view(np.uint64) ^ np.uint64(doc & 0xFFFFFFFFFFFFFFFF))
                keys += [own, spread]
                homes += [home, direct]
                ids.append(np.full(len(own) + len(direct), doc, np.int64))
                placed.append(np.repeat([False, True], [len(own), len(direct)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (ids, homes, placed)]], names=["key", "doc_id", "home", "placed"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "key long, doc_id long, home long, placed boolean")


def common_keys(docs: DataFrame, n: int, width: int = WIDTH, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys, cells) of the blocks that hold COMMON or more documents of a sample of about SAMPLE of the n docs. A cell's name is the least of them. A sampled document has a bounded number of keys, so the answer is bounded too."""
    rows = block_rows(docs.sample(min(1.0, SAMPLE / max(n, 1)), seed=7), width, percent)
    found = rows.groupBy("key").agg(F.min("doc_id").alias("cell"), F.count("*").alias("n")).filter(F.col("n") >= COMMON).select("key", "cell").toArrow()
    keys, cells = found["key"].to_numpy().view(np.uint64), found["cell"].to_numpy()
    order = np.argsort(keys)
    return keys[order], cells[order]


def cells_of(rows: DataFrame) -> DataFrame:
    """cell, doc_id: each document in the cells that its blocks name.

    A block's cell is named by one of its documents: the one with the least home, then id. Where all of a block's documents have one home and it is another block, they share that block's cell, and this block is passed over; a home itself is never passed over. Blocks come in sorted order, and a task holds one of them at a time, or of a very long one a run of HELD rows, from which on nothing is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in range(3))
        long_key = long_cell = None

        def out(cell: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(pd.DataFrame({"cell": cell, "doc_id": doc}, dtype=np.int64).drop_duplicates(), preserve_index=False)

        def whole(key: np.ndarray, doc: np.ndarray, home: np.ndarray, ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((doc, home, key))
            key, doc, home = key[order], doc[order], home[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.append(first, len(key)))
            low, high = home[first], home[first + times - 1]
            meets = ((times > 1) & ((low != high) | (low == key[first]))) if ended else np.ones(len(first), bool)
            keep = np.repeat(meets, times)
            return np.repeat(doc[first], times)[keep], doc[keep]

        for b in batches:
            key, doc, home = (b.column(i).to_numpy() for i in range(3))
            placed = b.column(3).to_numpy(zero_copy_only=False)
            cells, docs = [home[placed]], [doc[placed]]
            key, doc, home = key[~placed], doc[~placed], home[~placed]
            if long_key is not None:
                more = key == long_key
                cells.append(np.full(int(more.sum()), long_cell))
                docs.append(doc[more])
                if not more.all():
                    long_key = None
                key, doc, home = key[~more], doc[~more], home[~more]
            if len(key):
                key, doc, home = (np.concatenate(x) for x in zip(held, (key, doc, home), strict=True))
                last = np.searchsorted(key, key[-1])
                if last:
                    found = whole(key[:last], doc[:last], home[:last])
                    cells.append(found[0])
                    docs.append(found[1])
                held = key[last:], doc[last:], home[last:]
                if len(held[0]) > HELD:
                    found = whole(*held, ended=False)
                    cells.append(found[0])
                    docs.append(found[1])
                    long_key, long_cell = held[0][0], found[0][0]
                    held = tuple(np.empty(0, np.int64) for _ in range(3))
            yield out(np.concatenate(cells), np.concatenate(docs))
        if len(held[0]):
            yield out(*whole(*held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "cell long, doc_id long").distinct()


def _semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is in ids: by broadcast if ids are few, else by shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def tree_members(docs: DataFrame, members: DataFrame, repeated: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of members (cell, doc_id) with n, place (of the point on the R-tree's curve) and hashes (as bytes). repeated: ids that several of docs have, of which one counts.

    A text meets the list of its cells and is made a set where it is read, so neither texts nor sets are shuffled, unless members are too many to be broadcast. Its set is repeated for its cells by Spark.
    """
    kinds = [("doc_id", "long"), ("cells", "array<long>"), ("n", "long"), ("place", "long"), ("hashes", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [text_set(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(map(len, sets), pa.int64()), pa.array(map(place_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=[k for k, _ in kinds],
            )

    cells = members.groupBy("doc_id").agg(F.collect_list("cell").alias("cells"))
    few = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(cells) if few else cells, "doc_id").select("doc_id", "text", "cells")
    if not repeated.isEmpty():
        found = found.dropDuplicates(["doc_id"])
    made = found.mapInArrow(run, ", ".join(f"{k} {kind}" for k, kind in kinds))
    return made.select(F.explode("cells").alias("cell"), "doc_id", "n", "place", "hashes")


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles and component_id for each of docs (doc_id, text). leaf: points of an R-tree leaf at most."""
    bound_batches(docs.sparkSession, SMALL_BYTES)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = stage_table(set_digests(d, width), "set-digests")
    # Sets that several documents share; the least of these documents stands for them.
    shared = digests.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")).filter(F.col("rows") > 1)
    shared = stage_table(shared, "shared-sets")
    common = common_keys(d, digests.count(), width, percent)
    dealt = stage_table(cells_of(block_rows(d, width, percent, common)), "cells")
    sent = _semi(digests, dealt.select("doc_id").distinct()).select("doc_id", "k1", "k2").distinct()
    stands = sent.join(shared.select("k1", "k2", "node"), ["k1", "k2"], "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    members = stage_table(dealt.join(stands, "doc_id").select("cell", F.col("node").alias("doc_id")).distinct(), "cell-nodes")
    # Cells of one node hold nothing to compare.
    several = members.groupBy("cell").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("rows")).filter("a < b").select("cell", "rows")
    members = stage_table(hot_join(members, several, ["cell"]), "members")
    repeated = digests.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    found = stage_table(tree_components(stage_table(tree_members(d, members, repeated, width), "tree-members"), percent, leaf), "node-components")
    named = shared.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"), "rows")
    # Empty sets have one digest and nothing to be joined with; they stay out of the joins, as do ids that are null.
    some, none = digests.filter("n_shingles > 0"), digests.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = ["doc_id", "n_shingles", "component_id"]
    classes = stage_table(hot_join(some, stage_table(named, "shared-components"), ["k1", "k2"], "left").select(*out), "classes")
    alone = classes.filter("component_id IS NULL AND doc_id IS NOT NULL").drop("component_id").join(found.toDF("doc_id", "component"), "doc_id", "left")
    settled = classes.filter("component_id IS NOT NULL OR doc_id IS NULL")
    return settled.unionByName(alone.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))).unionByName(none)


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the one with the least doc_id; of rows that share that id, one. Rows without an id all stay, as there is nothing to name them by."""
    groups = stage_table(near_copies(docs, width, percent), "near-copies")
    kept = groups.filter("doc_id = component_id").select("doc_id")
    stay = _semi(docs, kept.distinct())
    if not kept.groupBy("doc_id").count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    if not groups.filter("doc_id IS NULL").isEmpty():
        stay = stay.unionByName(docs.filter("doc_id IS NULL"))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_join(spark, sf_dir):
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
"""
