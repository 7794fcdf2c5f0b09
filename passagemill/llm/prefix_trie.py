r"""The trie of conversations' common beginnings, by digests of fixed-length blocks of turns.

A node is a distinct sequence of first d turns (role, text) of a conversation; its
members are the conversations that begin with it. Turns become 128-bit digests that
depend on their place; a prefix's digest is the exclusive or of its turns' digests, so
digests of parts of a conversation can be made in any task and put together.

1. Turns are range-sorted and numbered; what a task must know of the parts of its first
   conversation in earlier tasks is one row per task.
2. Each conversation is cut into blocks of BLOCK turns. Conversations are grouped by the
   digest before a block: where all that have the block agree on it, whole, its turns
   make one unit; where siblings diverge in it (or one ends in it), each turn is a unit.
   So copies of a conversation are compared block by block, and turn by turn only in
   the blocks where they part.
3. Units are grouped into unit nodes: members, the smallest member (the owner), parent.
   What a conversation owns is the lower end of its path, as a node's smallest member is
   the smallest of all its descendants that it is in. So a subtree's sum of a value is the
   sum, over the node's members, of what each owns, less what the node's owner owns above
   the node: one grouping by node of a value per conversation, and a running sum.
4. Unit nodes are written out as one row for each turn.

Keys on many rows (a first turn that many share, one very long conversation) are split
over tasks by hot_join; sums are combined before they are shuffled. The ids whose
digest a node carries are hashed as a stream, from chunks made in parallel, so no list
of them is held.

Turns are ordered by number (nulls first), then role, then the text's digest; repeated rows are
separate turns. A null role or text is empty. Rows with a null conv_id are one conversation, which
keeps its own turns; it comes after all others: conv_id is null where it is the only member, and it is
hashed as `null`. Very long texts are read once, for their digest and words. Columns other than the four named are not looked at, whatever their
names. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from passagemill.llm.common import bound_batches, hot_join, stage_table

BLOCK = 8
#: Characters of a chunk of ids.
CHUNK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]


#: Stands for a null conv_id.
NOBODY = (1 << 63) - 1


def running(rows: DataFrame, key: str, order: list[str], values: list[str], xor: bool, name: str) -> DataFrame:
    """rows, staged, with run_<value> for each of values (long), their sum (or exclusive or) over the rows of the same key (long, not null) up to and with this one in order, and run_rows, the number of these.

    Rows are range-sorted by key and order. A task adds up its own rows; only its first key can have rows in earlier tasks, and what those come to is sent to it: one row per task.
    """
    names = [f"run_{v}" for v in [*values, "rows"]]
    folds = [np.bitwise_xor if xor else np.add for _ in values] + [np.add]
    undo = [np.bitwise_xor if xor else np.subtract for _ in values] + [np.subtract]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, keys, row = TaskContext.get().partitionId(), None, [0] * len(names), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            k, at = b.column(key).to_numpy(), np.arange(b.num_rows)
            new = np.append([last is None or last != k[0]], k[1:] != k[:-1])
            group = np.cumsum(new)
            start = np.maximum.accumulate(np.where(new, at, 0))
            out = []
            for i, v in enumerate([*values, None]):
                total = folds[i].accumulate(np.ones(len(k), np.int64) if v is None else b.column(v).to_numpy())
                before = np.where(group == 0, np.int64(carry[i]), np.where(start > 0, total[start - 1], 0))
                out.append(np.where(group == 0, folds[i](total, before), undo[i](total, before)))
                carry[i] = out[-1][-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(np.full(len(k), part)), pa.array(row + at), pa.array(keys + group == 1)], names=[*b.schema.names, *names, "part", "row", "head"])
            last, keys, row = k[-1], keys + int(group[-1]), row + len(k)

    schema = StructType([*rows.schema.fields])
    for n in [*names, "part", "row"]:
        schema = schema.add(n, LongType())
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    t = stage_table(ranged.mapInArrow(run, schema.add("head", "boolean")), name)
    tasks = t.groupBy("part").agg(F.min_by(key, "row").alias("first"), F.max_by(F.struct(F.col(key).alias("key"), "head", *names), "row").alias("last")).orderBy("part").collect()  # one row per task
    carried, before = [], None
    for task in tasks:
        last, own = task["last"], [task["last"][n] for n in names]
        if before is not None and before[0] == task["first"]:
            carried.append((task["part"], *before[1]))
            if last["head"]:
                own = [x ^ y if f is np.bitwise_xor else x + y for f, x, y in zip(folds, own, before[1], strict=True)]
        before = (last["key"], own)
    if not carried:
        return t.drop("part", "row", "head")
    add = rows.sparkSession.createDataFrame(carried, ", ".join(f"{n} long" for n in ["part", *[f"add_{n}" for n in names]]))
    both = t.join(F.broadcast(add), "part", "left")

    def whole(n: str, fold) -> Column:
        more = F.when(F.col("head"), F.coalesce(f"add_{n}", F.lit(0))).otherwise(F.lit(0))
        return (F.col(n).bitwiseXOR(more) if fold is np.bitwise_xor else F.col(n) + more).alias(n)

    return both.select(*rows.columns, *map(whole, names, folds))


def prefix_length(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4)).cast("int")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): conv_id and len (turns) of each rebuilt conversation, and its turns: conv_id, d (from 1), x1 and x2 (digest of the turn at its place), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NOBODY)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit("|"), role).alias("t2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )  # fmt: skip
    t = running(t, "conv_id", ["turn", "role", "t1", "t2"], [], False, "trie-turns").withColumnRenamed("run_rows", "p")
    counted = t.groupBy("conv_id").agg(F.count("*").alias("n"))
    alone = F.col("conv_id") == NOBODY
    convs = counted.withColumn("h", F.when(alone, 0).otherwise(prefix_length(F.col("conv_id")))).withColumn("base", F.when(~alone, F.col("conv_id") - F.col("conv_id") % 20))
    convs = convs.join(counted.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").withColumn("pre", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stage_table(convs.select("conv_id", "n", "h", "base", "pre", (F.col("pre") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-conversations")
    own = hot_join(t, convs.select("conv_id", "h", "pre", F.col("n").alias("rows")), ["conv_id"]).filter(F.col("p") > F.col("h")).withColumn("d", F.col("p") - F.col("h") + F.col("pre"))
    heads = t.filter("p <= 3").withColumnRenamed("conv_id", "base").join(convs.select("base", "conv_id", "pre"), "base").filter(F.col("p") <= F.col("pre")).withColumn("d", F.col("p"))
    cols = ["conv_id", "d", "t1", "t2", "words"]
    rows = own.select(*cols).unionByName(heads.select(*cols))
    return convs.select("conv_id", "len"), rows.select("conv_id", "d", F.xxhash64("t1", "t2", "d").alias("x1"), F.xxhash64("t2", "d", "t1").alias("x2"), "words")


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """conv_id, j, turns (d, x1, x2, words) of each block of rows, with the digests before it (p1, p2) and after it (q1, q2)."""
    each = rows.groupBy("conv_id", F.floor((F.col("d") - 1) / block).alias("j")).agg(F.array_sort(F.collect_list(F.struct("d", "x1", "x2", "words"))).alias("turns"), F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    t = running(each, "conv_id", ["j"], ["b1", "b2"], True, "trie-blocks")
    return t.select("conv_id", "j", "turns", F.col("run_b1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("run_b2").bitwiseXOR(F.col("b2")).alias("p2"), F.col("run_b1").alias("q1"), F.col("run_b2").alias("q2"))


def units_of(blocks: DataFrame, block: int) -> DataFrame:
    """conv_id, the node it reaches (depth, k1, k2), the node before (pd, pk1, pk2) and words (of the turns between) of each unit: a block that is the same in all conversations that get to it and go on, or a turn of one that is not. Only one conversation's row has the words of a block."""
    groups = blocks.groupBy("j", "p1", "p2").agg(F.count("*").alias("rows"), F.min("conv_id").alias("first"), F.min(F.struct("q1", "q2", F.size("turns"))).alias("lo"), F.max(F.struct("q1", "q2", F.size("turns"))).alias("hi"))
    both = hot_join(blocks, groups.select("j", "p1", "p2", "rows", "first", (F.col("lo") != F.col("hi")).alias("parted")), ["j", "p1", "p2"])
    begin = F.col("j") * block
    unit = lambda depth, k1, k2, pd, pk1, pk2, words: F.struct(depth.cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"), pd.cast("long").alias("pd"), pk1.alias("pk1"), pk2.alias("pk2"), words.alias("words"))  # noqa: E731
    words = F.when(F.col("conv_id") == F.col("first"), F.col("turns.words")).otherwise(F.array().cast("array<long>"))
    whole = F.array(unit(begin + F.size("turns"), F.col("q1"), F.col("q2"), begin, F.col("p1"), F.col("p2"), words))
    upto = lambda x, i: F.aggregate(F.slice(f"turns.{x}", F.lit(1), i), F.col("p1" if x == "x1" else "p2"), lambda a, y: a.bitwiseXOR(y))  # noqa: E731
    single = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: unit(begin + i, upto("x1", i), upto("x2", i), begin + i - 1, upto("x1", i - 1), upto("x2", i - 1), F.slice("turns.words", i, F.lit(1))))
    return both.select("conv_id", F.explode(F.when(F.col("parted"), single).otherwise(whole)).alias("u")).select("conv_id", "u.*")


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256 of ends (conv_id and its node): of the ids in ascending order, joined by commas."""
    schema = "depth long, k1 long, k2 long, first long, ids string"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, size, first = None, [], 0, 0
        emit = lambda: pa.RecordBatch.from_pydict({"depth": [node[0]], "k1": [node[1]], "k2": [node[2]], "first": [first], "ids": [",".join(held)]})  # noqa: E731
        for b in batches:
            for d, k1, k2, conv in zip(*[b.column(c).to_pylist() for c in [*NODE, "conv_id"]], strict=True):
                if held and (node != (d, k1, k2) or size > CHUNK):
                    yield emit()
                    held, size = [], 0
                if not held:
                    node, first = (d, k1, k2), conv
                held.append("null" if conv == NOBODY else str(conv))
                size += len(held[-1]) + 1
        if held:
            yield emit()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        out = lambda: pa.RecordBatch.from_pydict({"depth": [node[0]], "k1": [node[1]], "k2": [node[2]], "ends_sha256": [sha.hexdigest()]})  # noqa: E731
        for b in batches:
            for d, k1, k2, ids in zip(*[b.column(c).to_pylist() for c in [*NODE, "ids"]], strict=True):
                if node == (d, k1, k2):
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    yield out()
                node, sha = (d, k1, k2), hashlib.sha256(ids.encode())
        if sha:
            yield out()

    ranged = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    return ranged.mapInArrow(chunks, schema).repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of turns (conv_id, turn, role, text) as they are rebuilt: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bound_batches(turns.sparkSession)
    convs, rows = rebuilt_turns(turns)
    blocks = blocks_of(rows, block)
    units = stage_table(units_of(blocks, block), "trie-units")
    nodes = units.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), *[F.min(c).alias(c) for c in ("pd", "pk1", "pk2")], F.min_by("words", "conv_id").alias("words"))
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)  # noqa: E731
    nodes = stage_table(nodes.withColumn("w", (F.col("n") - 1) * total(F.col("words"))), "trie-nodes")
    kids = nodes.groupBy("pd", "pk1", "pk2").agg(F.count("*").alias("kids")).select(F.col("pd").alias("depth"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2"), "kids")
    nodes = running(nodes.join(kids, NODE, "left").withColumn("kids", F.coalesce("kids", zero)), "owner", ["depth"], ["w"], False, "trie-owned").drop("run_rows")
    leaf = (F.col("kids") == 0).cast("long")
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("w").alias("all_w"), F.sum(leaf).alias("leaf"))
    spread = hot_join(units.select("conv_id", *NODE), owned.join(units.groupBy("conv_id").agg(F.count("*").alias("rows")), "conv_id"), ["conv_id"], "left")
    sums = spread.groupBy(*NODE).agg(F.sum(F.coalesce("all_w", zero)).alias("below"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"))
    one = lambda owner, n, w, leaf, kid: (owner.alias("owner"), n.alias("n"), w.alias("w"), leaf.alias("leaf"), kid.alias("kid"))  # noqa: E731
    root = convs.select(*one(F.col("conv_id"), F.lit(1), zero, zero, zero)).unionByName(nodes.select(*one(F.lit(None).cast("long"), F.lit(0), F.col("w"), leaf, (F.col("pd") == 0).cast("long"))))
    root = root.agg(F.min("owner").alias("owner"), F.sum("n").alias("n"), F.sum("w").alias("saved"), F.sum("leaf").alias("leaves"), F.sum("kid").alias("kids")).filter("n > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n", "owner", F.lit(None).cast("long").alias("parent"), F.array(zero).alias("words"), "kids", "saved", F.greatest("leaves", F.lit(1)).alias("n_leaves"))
    root = stage_table(root, "trie-root")
    parents = nodes.select("depth", "k1", "k2", "owner", "kids").unionByName(root.select("depth", "k1", "k2", "owner", "kids"))
    parents = parents.filter("kids > 0").select(F.col("depth").alias("pd"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("owner").alias("parent"), F.col("kids").alias("rows"))
    full = hot_join(nodes, parents, ["pd", "pk1", "pk2"]).join(sums, NODE)
    full = full.withColumn("saved", F.col("below") - (F.col("run_w") - F.col("w")))
    full = full.select("depth", "k1", "k2", "n", "owner", "parent", "words", "kids", "saved", "n_leaves").unionByName(root)
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct((F.col("j") * block + F.size("turns")).cast("long").alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")), "j").alias("e")).select("conv_id", "e.*")
    ends = last.unionByName(convs.filter("len = 0").select("conv_id", *[zero.alias(c) for c in NODE]))
    each = full.join(ends_digests(ends), NODE, "left").select("*", F.size("words").alias("many"), F.posexplode("words").alias("t", "turn_words"))
    final = F.col("t") == F.col("many") - 1
    named = lambda c: F.nullif(c, F.lit(NOBODY))  # noqa: E731
    return each.select(
        named(F.col("owner")).alias("conv_id"), (F.col("depth") - F.col("many") + F.col("t") + 1).alias("depth"),
        named(F.when(F.col("t") > 0, F.col("owner")).otherwise(F.col("parent"))).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(final, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n") - 1) * total(F.slice("words", F.lit(1), F.col("t")))).alias("saved_tokens"),
        F.when(final, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )  # fmt: skip


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
h AS (
  SELECT c, xor(list_reduce(list_transform(range(0, len(c::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii((c::VARCHAR)[i]) END),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT h.c, p AS o, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 WHERE p <= h
  UNION ALL SELECT h.c, p + 3, role, text FROM h JOIN t ON t.c = h.c WHERE p > h),
s AS (SELECT c, row_number() OVER w AS d, list(sha256(role || chr(31) || sha256(text))) OVER w AS k, len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM r WINDOW w AS (PARTITION BY c ORDER BY o)),
z AS (SELECT c, 0 AS d, []::VARCHAR[] AS k, 0 AS words FROM h UNION ALL SELECT c, d, k, words FROM s),
e AS (SELECT c, max(d) AS len FROM z GROUP BY 1),
n AS (
  SELECT k, any_value(d) AS d, min(z.c) AS owner, count(*) AS n, any_value(words) AS words, k[1:d - 1] AS pk,
    sha256(coalesce(string_agg(z.c::VARCHAR, ',' ORDER BY z.c) FILTER (d = len), '')) AS ends
  FROM z JOIN e ON e.c = z.c GROUP BY k, d),
kids AS (SELECT pk AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids ON kids.k = n.k),
sub AS (SELECT z.k, sum((m.n - 1) * m.words)::BIGINT AS saved, count(*) FILTER (m.kids = 0) AS leaves FROM z JOIN m ON m.owner = z.c AND m.d >= z.d GROUP BY z.k)
SELECT m.owner AS conv_id, m.d AS depth, p.owner AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN sub ON sub.k = m.k LEFT JOIN m p ON p.k = m.pk AND m.d > 0
"""
