"""Mixing sources to target weights by a low-discrepancy schedule.

Sources are grouped by the order of magnitude of their targets (powers of 16), and
each group is a row of equal slots over the whole length of the mix. Slot i of n has
the golden-ratio point frac(i * phi); the point's place among the group's cumulative
targets names the slot's source, and the slot's rank among that source's slots names
the block it takes. A source's blocks are equal runs of tokens (words) of its
documents in shuffled order, read again from the start after each pass. Slots of all
groups are merged by where they lie, so every prefix of the mix holds the sources
near their weights, and each takes near its target.

A target fills 512 to 8,192 blocks (of at least one word) whatever the other sources
and the input's size, and points leave a source a few blocks from its target at most.

A word is a run of other than blanks; a null text has none. Documents without
words take part in nothing but are reported with taken = 0. Null sources are one
source, last in order. Null doc_ids, repeated rows and ties are told apart by
their place in the shuffled order; an empty table gives an empty mix. Texts of any
length are counted and cut by Spark's own expressions. Other columns are passed over,
and mixed_documents() keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import quoted, stage_table

#: Passes over a source at most, 2**32 / golden ratio, buckets for prefix sums and for finding a point's source.
PASSES, GOLDEN, HASH_DIGITS, CELLS = 3, 2654435769, 3, 4096
#: A target of d hexadecimal digits has blocks of 2 ** (4 * d - BLOCK_BITS) words, or of one; slots that one row makes.
BLOCK_BITS, RUN = 13, 1 << 16


def sized_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size (words) and a shuffling key, with the columns keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).alias("shuffle_key"),
        *keep,
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """By source: sid, source_size, weight and target. Weights are 1, 2, 3, repeating, in the order of the sources; a target is at most PASSES times its source's size, and what is over is shared again by weight."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cap = (PASSES * F.col("source_size")).cast("double")
    t = totals.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double")).withColumn("cap", cap)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    full = F.col("cap") <= F.col("weight") * F.col("level")
    level = F.max(F.when(~full, F.col("level"))).over(every)
    t = t.withColumn("target", F.when(full | level.isNull(), F.col("cap")).otherwise(F.col("weight") * level))
    return t.select("source", "sid", "source_size", "weight", "target")


def source_blocks(targets: DataFrame) -> DataFrame:
    """targets with digits (hexadecimal digits of the target, which group the sources), block_size (words in a block) and most (words that its passes hold)."""
    digits = F.length(F.hex(F.greatest(F.floor("target"), F.lit(1)).cast("long")))
    t = targets.withColumn("digits", digits).withColumn("block_size", F.expr(f"shiftleft(1L, greatest(4 * digits - {BLOCK_BITS}, 0))"))
    return t.withColumn("most", PASSES * F.col("source_size"))


def slot_schedule(blocks: DataFrame) -> DataFrame:
    """slot, sid and block: which block of which source is taken where in the mix (slot: 0 to 2**52, over all groups). There are at most 8,192 slots for each source, and they are made in runs."""
    group = Window.partitionBy("digits")
    hi = F.sum("target").over(group.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    t = blocks.filter("target > 0").withColumn("whole", F.sum("target").over(group)).withColumn("hi", hi / F.col("whole")).withColumn("lo", (hi - F.col("target")) / F.col("whole"))
    t = t.withColumn("hi", F.when(F.col("sid") == F.max("sid").over(group), F.lit(2.0)).otherwise(F.col("hi")))
    cells = t.select("digits", "sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.floor(F.least(F.col("hi"), F.lit(1.0)) * CELLS).cast("int"))).alias("cell"))
    n = F.greatest(F.round(F.sum("target") / F.first("block_size")), F.lit(1)).cast("long")
    runs = blocks.filter("target > 0").groupBy("digits").agg(n.alias("n")).select("digits", "n", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)")).alias("run"))
    slots = runs.repartition("digits", "run").select("digits", "n", F.explode(F.expr(f"sequence(run, least(run + {RUN}, n) - 1)")).alias("i"))
    point = ((F.col("i") + 1) % (1 << 32) * GOLDEN % (1 << 32)).cast("double") / float(1 << 32)
    slots = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    placed = slots.join(cells, ["digits", "cell"]).filter("lo <= point AND point < hi")
    ranked = placed.withColumn("block", (F.row_number().over(Window.partitionBy("sid").orderBy("i")) - 1).cast("long"))
    # No source gives more than its passes hold.
    held = ranked.join(blocks.select("sid", "block_size", "most"), "sid").filter("block * block_size < most")
    place = ((2 * F.col("i") + 1).cast("double") / F.col("n") * float(1 << 51)).cast("long")
    return held.select(place.alias("slot"), "sid", "block")


def shuffled_positions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with sid, source_size, target and pos: the words before it in its source's shuffled order.

    Prefix sums go by buckets of the shuffling key, so that a source with most of the rows is spread over 16 ** HASH_DIGITS windows.
    """
    named = sized.withColumn("bucket", F.substring("shuffle_key", 1, HASH_DIGITS))
    joined = named.join(targets, named["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    sums = joined.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_pos"))
    inside = Window.partitionBy("sid", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = joined.withColumn("inner_pos", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(sums, ["sid", "bucket"]).withColumn("pos", F.col("bucket_pos") + F.col("inner_pos")).drop("bucket", "bucket_pos", "inner_pos", "shuffle_key")


def mix_pieces(positions: DataFrame, schedule: DataFrame) -> DataFrame:
    """The mix: slot, sid, pos, pass_no, start and words. Each row is a run of words of one document (named by sid and pos, in its pass) that one slot takes."""
    held = positions.filter("size > 0").select("sid", "pos", "size", "source_size", "block_size", "most")
    passes = held.select("*", F.explode(F.expr(f"sequence(0, {PASSES - 1})")).alias("pass_no")).withColumn("at", F.col("pass_no") * F.col("source_size") + F.col("pos")).filter("at < most")
    cut = passes.select(
        "sid", "pos", "size", "pass_no", "at", "block_size", "most",
        F.explode(F.expr("sequence(at div block_size, (at + size - 1) div block_size)")).alias("block"),
    )
    first = F.greatest(F.col("at"), F.col("block") * F.col("block_size"))
    last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("block_size"), F.col("most"))
    return cut.join(schedule, ["sid", "block"]).filter(first < last).select("slot", "sid", "pos", "pass_no", (first - F.col("at")).alias("start"), (last - first).alias("words"))


def mix_sources(docs: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix. documents: doc_id, source, size, sid, source_size, target, pos, taken and the columns keep."""
    sized = stage_table(sized_documents(docs, *keep), "mix-sizes")
    targets = stage_table(source_blocks(source_targets(sized)), "mix-targets")
    schedule = stage_table(slot_schedule(targets), "mix-slots")
    positions = shuffled_positions(sized, targets)
    pieces = mix_pieces(positions, schedule)
    taken = pieces.groupBy("sid", F.col("pos").alias("mix_key")).agg(F.sum("words").alias("mixed"))
    # Documents without words share a place with the next one that has some; as they take part in nothing, their key is another one.
    key = F.when(F.col("size") > 0, F.col("pos")).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)))
    both = positions.withColumn("mix_key", key).join(taken, ["sid", "mix_key"], "left")
    return both.withColumn("taken", F.coalesce(F.col("mixed"), F.lit(0)).cast("long")).drop("mix_key", "mixed", "digits", "block_size", "most"), pieces


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes them: whole copies, and where a source's last block ends within a document, its first words. Rows that are alike share equally what the mix takes of them."""
    like = ["doc_id", "source", "text_hash"]
    hashed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("mix_row"), "doc_id", "source", "text").withColumn("text_hash", F.xxhash64("text"))
    mixed, _ = mix_sources(hashed.select("doc_id", "source", "text", "text_hash"), "text_hash")
    share = mixed.groupBy(*like).agg(F.first("size").alias("size"), F.floor(F.sum("taken") / F.count("*")).alias("taken")).filter("taken > 0")
    a, b = hashed.select("mix_row", *like).alias("a"), share.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in like]
    copies = F.expr("IF(taken % size > 0, transform(sequence(0, taken div size), i -> IF(i < taken div size, size, taken % size)), array_repeat(size, int(taken div size)))")
    rows = a.join(b, on[0] & on[1] & on[2]).select("a.mix_row", "b.size", F.explode(copies).alias("words"))
    cut = F.array_join(F.slice(F.expr(r"filter(split(mix_row.text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("mix_row.text")).otherwise(cut)
    out = rows.select("mix_row", text.alias("mix_text"), (F.col("words") < F.col("size")).alias("mix_cut"))
    columns = []
    for c in docs.columns:
        own = F.col("mix_row." + quoted(c))
        if c == "text":
            own = F.col("mix_text")
        elif c == "n_chars":
            own = F.when(F.col("mix_cut"), F.length("mix_text")).otherwise(own).cast(docs.schema[c].dataType)
        columns.append(own.alias(c))
    return out.select(*columns)


def op3_source_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed, _ = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS k FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, ({PASSES} * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM totals),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM weighed WINDOW p AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT max(level) FILTER (cap > weight * level) AS final_level FROM levels),
targets AS (
  SELECT source, sid, source_size, total,
         CASE WHEN cap <= weight * level OR final_level IS NULL THEN cap ELSE weight * final_level END AS target FROM levels, final),
groups AS (
  SELECT *, greatest(1, 1::BIGINT << greatest(4 * digits - {BLOCK_BITS}, 0)) AS block_size
  FROM (SELECT *, length(to_base(greatest(floor(target)::BIGINT, 1), 16)) AS digits FROM targets)),
spans AS (
  SELECT sid, digits, (sum(target) OVER w - target) / sum(target) OVER g AS lo,
         CASE WHEN sid = max(sid) OVER g THEN 2.0::DOUBLE ELSE sum(target) OVER w / sum(target) OVER g END AS hi
  FROM groups WHERE target > 0 WINDOW w AS (PARTITION BY digits ORDER BY sid ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY digits)),
counts AS (SELECT digits, greatest(round(sum(target) / any_value(block_size)), 1)::BIGINT AS n FROM groups WHERE target > 0 GROUP BY digits),
slots AS (SELECT digits, ((((i + 1) % 4294967296) * {GOLDEN}) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE AS point FROM counts, LATERAL (SELECT unnest(range(n)) AS i)),
taken AS (SELECT sid, count(*) AS blocks FROM slots JOIN spans ON slots.digits = spans.digits AND lo <= point AND point < hi GROUP BY sid),
placed AS (
  SELECT doc_id, size, t.sid, source_size, target, block_size,
         coalesce(sum(size) OVER (PARTITION BY t.sid ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sized s JOIN groups t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (SELECT coalesce(sum(greatest(0, least(coalesce(blocks, 0) * block_size, {PASSES} * source_size, e * source_size + pos + size) - (e * source_size + pos))), 0)
        FROM range({PASSES}) r(e))::BIGINT AS taken
FROM placed LEFT JOIN taken USING (sid)
"""
