"""Count-vector R-trees over cells of sets, and the search for linked pairs in them.

A set's point is how many of its shingle hashes fall into each of GROUPS groups.
The overlap of two sets is at most the sum of their points' coordinate minima, and
that of any two sets of two boxes at most the sum of the minima of the boxes'
upper corners; it is also at most half of what the two largest sizes come to less
the gaps between the boxes.

A tree is bulk-loaded by sorting a cell's points along a Z-order curve over sums
of their coordinates, and cutting the sorted run into leaves. The sort is a range
sort of the whole table, so one cell may be spread over any number of tasks, and a
task holds one leaf. The levels above are runs of a task's leaves, and a task's
part of a cell.

The search first joins each leaf with itself while it is being cut. Cells of one
leaf, nearly all, are done then. In larger cells one point stands for what is
already connected; these points are loaded into a tree of their own, again and
again while that joins more. Pairs of nodes whose boxes pass the bounds, and which
do not hold one component alone, are then followed from the top down to the leaves,
and pairs of points are verified on their sets. What is given is one link for each
two components that are joined, not every pair of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import mix64, stage_table
from passagemill.llm.components import components, joined

#: Coordinates of a point; sums of them that order points; points and shingles of a leaf at most; leaves of a node.
GROUPS, AXES, LEAF, LEAF_SHINGLES, FANOUT = 256, 8, 256, 1 << 20, 16
#: Stand-ins that are broadcast at most; beyond that they are shuffled.
BROADCAST_ROWS = 2_000_000
#: Rounds of joining stand-ins go on while they leave at most this share of them.
SHRINK = 0.8

MEMBERS = "cell long, doc_id long, n long, place long, hashes binary"
LEAVES = "cell long, part int, seq int, n_min long, n_max long, low binary, high binary, ids binary, sizes binary, sets binary, u binary, v binary"


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """The point of a set."""
    return np.bincount((mix64(hashes) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


def place_of(hashes: np.ndarray) -> int:
    """The place of a set's point on the Z-order curve."""
    sums = count_vector(hashes).reshape(AXES, -1).sum(axis=1)
    level = np.minimum((np.log2(1.0 + sums) * 6).astype(np.int64), 127)
    bits = (level[None, :] >> np.arange(6, -1, -1)[:, None]) & 1
    return int.from_bytes(np.packbits(bits.astype(np.uint8)).tobytes(), "big")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least percent times the union."""
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def search(sets: list[np.ndarray], points: np.ndarray, root: np.ndarray, first: int, percent: int) -> list[tuple[int, int]]:
    """Links (i, j), one for each two components (root) that are joined: of the points before first with those from it on, or of all with all if first is 0."""
    sizes = np.array(list(map(len, sets)), np.int64)
    root, links = root.copy(), []
    for i in range(first or len(sets)):
        at = np.arange(max(first, i + 1), len(sets))
        at = at[(root[at] != root[i]) & (100 * np.minimum(sizes[i], sizes[at]) >= percent * np.maximum(sizes[i], sizes[at]))]
        if not len(at):
            continue
        bound = np.minimum(points[i], points[at]).sum(axis=1, dtype=np.int64)
        fits = bound * (100 + percent) >= percent * (sizes[i] + sizes[at])
        at = at[fits][np.argsort(-bound[fits], kind="stable")]
        for j in at.tolist():
            if root[j] != root[i] and linked(sets[i], sets[j], percent):
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def ties(doc: np.ndarray, links: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) within doc as ties of ids: each linked id with the least of those that it reaches here, so that a leaf gives stars and no paths."""
    over = np.arange(len(doc))
    for i, j in links:
        a, b = over[i], over[j]
        if a != b:
            a, b = (a, b) if doc[a] <= doc[b] else (b, a)
            over[over == b] = a
    low = doc[over]
    tied = low != doc
    return doc[tied], low[tied]


def boxes_may_link(n_min: tuple, n_max: tuple, low: tuple, high: tuple, percent: int) -> bool:
    """Whether sets of two boxes can link by their sizes and both bounds on the overlap."""
    if 100 * n_max[0] < percent * n_min[1] or 100 * n_max[1] < percent * n_min[0]:
        return False
    gaps = np.maximum(low[0] - high[1], 0) + np.maximum(low[1] - high[0], 0)
    most = min(int(np.minimum(high[0], high[1]).sum()), (n_max[0] + n_max[1] - int(gaps.sum())) // 2)
    return most * (100 + percent) >= percent * (n_min[0] + n_min[1])


def load_leaves(members: DataFrame, percent: int, size: int = LEAF) -> DataFrame:
    """The leaves of members (MEMBERS), each joined with itself: u and v hold the ids that its links tie. sets is null where the cell has no other leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rows = TaskContext.get().partitionId(), 0, []
        cell, ids, sets, held, cells, cut = None, [], [], 0, 0, False

        def leaf(alone: bool) -> None:
            nonlocal seq, ids, sets, held
            points = np.stack([count_vector(s) for s in sets])
            doc = np.array(ids, np.int64)
            u, v = (x.tobytes() for x in ties(doc, search(sets, points, np.arange(len(sets)), 0, percent)))
            n = np.array(list(map(len, sets)), np.int64)
            corners = (None, None) if alone else (points.min(0).astype(np.int64).tobytes(), points.max(0).astype(np.int64).tobytes())
            rows.append((cell, part, seq, int(n.min()), int(n.max()), *corners, doc.tobytes(), n.tobytes(), None if alone else b"".join(s.tobytes() for s in sets), u, v))
            seq += 1
            ids, sets, held = [], [], 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in LEAVES.split(", ")])

        for b in batches:
            for c, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4), strict=True):
                if cell is not None and c != cell:
                    if ids:
                        leaf(alone=cells > 1 and not cut)  # a task's first and last cell may go on in other tasks
                    cells, cut = cells + 1, False
                elif cell is None:
                    cells = 1
                cell = c
                if len(ids) == size or held >= LEAF_SHINGLES:
                    leaf(alone=False)
                    cut = True
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                ids.append(doc)
                sets.append(s)
                held += len(s)
            # What is still open outlives its batch.
            sets = [s.copy() for s in sets]
            yield flush()
        if ids:
            leaf(alone=False)
        yield flush()

    order = ["cell", "place", "doc_id"]
    return members.repartitionByRange(*order).sortWithinPartitions(*order).select(*[x.split()[0] for x in MEMBERS.split(", ")]).mapInArrow(run, LEAVES)


def _longs(*names: str, keep: tuple[str, ...] = ()):
    """A mapInArrow function: rows of keep, and of the longs packed in names, one for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [[np.frombuffer(x.as_buffer(), np.int64) for x in b.column(b.schema.get_field_index(n))] for n in names]
            times = np.array(list(map(len, packed[0])), np.int64)
            again = pa.array(np.repeat(np.arange(len(times)), times))
            kept = [b.column(b.schema.get_field_index(k)).take(again) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(np.concatenate([np.empty(0, np.int64), *p])) for p in packed]], names=[*keep, *names])

    return run


def leaf_links(leaves: DataFrame) -> DataFrame:
    """u, v of the ties within leaves."""
    return leaves.select("u", "v").mapInArrow(_longs("u", "v"), "u long, v long")


def _box(keys: list[str]):
    """A grouped function: the box around some boxes."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        low, high = (np.stack([np.frombuffer(x, np.int64) for x in g[c]]) for c in ("low", "high"))
        row = {k: g[k].iloc[0] for k in keys} | {"n_min": g["n_min"].min(), "n_max": g["n_max"].max(), "c_min": g["c_min"].min(), "c_max": g["c_max"].max(), "low": low.min(0).tobytes(), "high": high.max(0).tobytes()}
        return pd.DataFrame([row])

    return run


_BOX = ("n_min", "n_max", "c_min", "c_max", "low", "high")


def _pairs(a: DataFrame, b: DataFrame, on: list[Column], ids: list[str], percent: int) -> DataFrame:
    """The node pairs (ids of a and b) whose boxes may link. a and b have the columns of ids and _BOX with the suffixes _a and _b."""
    both = a.join(b, on).filter("NOT (c_min_a = c_max_a AND c_min_b = c_max_b AND c_min_a = c_min_b)").filter(f"100 * n_max_a >= {percent} * n_min_b AND 100 * n_max_b >= {percent} * n_min_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = {n: i for i, n in enumerate(x.schema.names)}
            ints = {n: x.column(at[n]).to_pylist() for n in ("n_min_a", "n_min_b", "n_max_a", "n_max_b")}
            corner = lambda n, i: np.frombuffer(x.column(at[n])[i].as_buffer(), np.int64)
            keep = [
                boxes_may_link(*[(ints[f"{k}_a"][i], ints[f"{k}_b"][i]) for k in ("n_min", "n_max")], *[(corner(f"{k}_a", i), corner(f"{k}_b", i)) for k in ("low", "high")], percent)
                for i in range(x.num_rows)
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(at[n]).filter(mask) for n in ids], names=ids)

    kinds = ", ".join(f"{n} {'long' if n.startswith('cell') else 'int'}" for n in ids)
    columns = [*ids, *[f"{k}_{s}" for k in ("n_min", "n_max", "low", "high") for s in "ab"]]
    return both.select(*dict.fromkeys(columns)).mapInArrow(run, kinds)


def descend(leaves: DataFrame, inside: DataFrame, percent: int) -> DataFrame:
    """u, v: links between leaves of one cell, found from the top of its tree down. inside: cell, part, seq, c_min, c_max and comps (the components of the leaf's points, in their order)."""
    leaf_key, box = ["cell", "part", "seq"], [*_BOX]
    l0 = stage_table(leaves.select(*leaf_key, "n_min", "n_max", "low", "high").join(inside.select(*leaf_key, "c_min", "c_max"), leaf_key).withColumn("node", F.floor(F.col("seq") / FANOUT).cast("int")), "rtree-level0")
    kinds = "n_min long, n_max long, c_min long, c_max long, low binary, high binary"
    up = lambda t, keys: stage_table(t.groupBy(*keys).applyInPandas(_box(keys), "cell long, " + "".join(f"{k} int, " for k in keys[1:]) + kinds), "rtree-level")
    l1 = up(l0, ["cell", "part", "node"])
    l2 = up(l1, ["cell", "part"])
    side = lambda t, s: t.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in t.columns if c != "cell"])
    a, b = side(l2, "a"), side(l2, "b").withColumnRenamed("cell", "cell_b")
    tops = _pairs(a, b, [a["cell"] == b["cell_b"], a["part_a"] <= b["part_b"]], ["cell", "part_a", "part_b"], percent)
    a, b = tops.join(side(l1, "a"), ["cell", "part_a"]), side(l1, "b").withColumnRenamed("cell", "cell_b").withColumnRenamed("part_b", "part_bb")
    ordered = (a["part_a"] < a["part_b"]) | (a["node_a"] <= b["node_b"])
    nodes = _pairs(a, b, [a["cell"] == b["cell_b"], a["part_b"] == b["part_bb"], ordered], ["cell", "part_a", "part_b", "node_a", "node_b"], percent)
    a = nodes.join(side(l0, "a"), ["cell", "part_a", "node_a"])
    b = side(l0, "b").withColumnRenamed("cell", "cell_b").withColumnRenamed("part_b", "part_bb").withColumnRenamed("node_b", "node_bb")
    other = (a["part_a"] < a["part_b"]) | (a["seq_a"] < b["seq_b"])  # a leaf has been joined with itself
    open_pairs = stage_table(_pairs(a, b, [a["cell"] == b["cell_b"], a["part_b"] == b["part_bb"], a["node_b"] == b["node_bb"], other], ["cell", "part_a", "part_b", "seq_a", "seq_b"], percent), "rtree-pairs")
    packed = stage_table(leaves.select(*leaf_key, "ids", "sizes", "sets").join(inside.select(*leaf_key, "comps"), leaf_key), "rtree-open")
    rows = open_pairs.join(side(packed, "a"), ["cell", "part_a", "seq_a"]).join(side(packed, "b"), ["cell", "part_b", "seq_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row in zip(*x.columns, strict=True):
                ids, sizes, comps = (np.concatenate([np.frombuffer(row[k].as_buffer(), np.int64) for k in at]) for at in ((0, 4), (1, 5), (3, 7)))
                first = len(row[0].as_buffer()) // 8
                every = np.concatenate([np.frombuffer(row[k].as_buffer(), np.uint64) for k in (2, 6)])
                sets = np.split(every, np.cumsum(sizes)[:-1])
                found = search(sets, np.stack([count_vector(s) for s in sets]), comps, first, percent)
                us.append(np.array([ids[i] for i, _ in found], np.int64))
                vs.append(np.array([ids[j] for _, j in found], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return rows.select(*[f"{c}_{s}" for s in "ab" for c in ("ids", "sizes", "sets", "comps")]).mapInArrow(run, "u long, v long")


def tree_components(members: DataFrame, percent: int, size: int = LEAF) -> DataFrame:
    """node, component: for every doc_id of members (MEMBERS; each cell's points are searched for links) that links with another, the least doc_id that it reaches."""
    leaves = stage_table(load_leaves(members, percent, size), "rtree-leaves")
    found = stage_table(components(leaf_links(leaves)), "components")
    several = leaves.groupBy("cell").count().filter("count > 1").select("cell")
    if several.isEmpty():
        return found
    wide = stage_table(leaves.join(F.broadcast(several) if several.count() <= 1_000_000 else several, "cell", "left_semi"), "rtree-wide")
    points = wide.select("cell", "part", "seq", "ids").mapInArrow(_longs("ids", keep=("cell", "part", "seq")), "cell long, part int, seq int, ids long").withColumnRenamed("ids", "doc_id")
    points = stage_table(points, "rtree-points")
    before = None
    while True:
        named = points.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        stand_ins = named.groupBy("cell", "component").agg(F.min("doc_id").alias("doc_id"))
        still = stand_ins.groupBy("cell").count().filter("count > 1")
        open_cells = stage_table(still.select("cell"), "rtree-open-cells")
        n = still.agg(F.sum("count")).first()[0]
        if not n:
            return found
        if before is not None and n > SHRINK * before:
            break
        before = n
        few = stand_ins.join(open_cells, "cell", "left_semi").select("cell", "doc_id")
        few = F.broadcast(few) if n <= BROADCAST_ROWS else few  # members hold all sets, which would be shuffled
        upper = stage_table(load_leaves(few.join(members.select("cell", "doc_id", "n", "place", "hashes"), ["cell", "doc_id"]), percent, size), "rtree-upper")
        found = joined(found, leaf_links(upper))
    inside = (
        named.join(open_cells, "cell", "left_semi").groupBy("cell", "part", "seq")
        .agg(F.min("component").alias("c_min"), F.max("component").alias("c_max"), F.map_from_entries(F.collect_list(F.struct("doc_id", "component"))).alias("of"))
    )
    ids_of = wide.select("cell", "part", "seq", "ids").join(inside, ["cell", "part", "seq"])

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            comps = []
            for ids, of in zip(b.column(5), b.column(6).to_pylist(), strict=True):
                of = dict(of)
                comps.append(np.array([of[d] for d in np.frombuffer(ids.as_buffer(), np.int64).tolist()], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(comps, pa.binary())], names=["cell", "part", "seq", "c_min", "c_max", "comps"])

    inside = stage_table(ids_of.select("cell", "part", "seq", "c_min", "c_max", "ids", "of").mapInArrow(in_order, "cell long, part int, seq int, c_min long, c_max long, comps binary"), "rtree-inside")
    more = descend(wide, inside, percent)
    return joined(found, more)
