"""Minimum-cost repair of conversations' roles.

The legal conversations are those of a small automaton: at most one system turn,
first; then user and assistant in turn, user first; the last turn the
assistant's. For each turn the repair may keep or change its role, merge it into
the turn before, or put empty turns before it, at fixed costs; dynamic
programming finds the cheapest way.

A turn is a min-plus matrix over the automaton's states. All turns are range-sorted
by conversation and order and numbered by rank within their conversation's part of
a task (a fragment), and a fragment is cut into segments of SEGMENT_TURNS turns,
whatever their turn numbers. Each segment's matrix is made on its own; the matrices
of a fragment's segments are multiplied, and those of a conversation's fragments, of
which there are no more than tasks, are folded to find the states in which each is
entered and left. From there the way is traced down to segments and turns. So no
task holds more than a segment's texts of one conversation. What is returned is one
row for each turn, with its rendered piece; render_conversations joins them.

Markers in a text would forge turns, so "<|" is written as "<\\|" in rendered text,
and "<\\" as "<\\\\", which can be undone.

Order is by turn (nulls first), then role, then a hash of the text. A null or unknown role takes
whichever role is cheapest; a null text is empty. Rows with a null conv_id are
one conversation. Repeated rows are separate turns. Ties between repairs go to
the first in the order of ROLES. Very long texts are kept whole. Columns other than
the four named are not looked at, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from passagemill.llm.common import bound_batches, stage_table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
#: Costs of changing a known role, of giving an unknown one, of merging two turns, of an empty turn.
RELABEL, NAME, MERGE, INSERT = 2, 1, 1, 3
SEGMENT_TURNS, INFINITE = 1024, 1 << 28
#: The roles to insert, to get legally from one state to a turn of one role.
_BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (ASSISTANT, USER): (),
}
#: What to append for a legal end.
_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _steps(role: int) -> list[list[int]]:
    """Cost from each state to each state, by a turn with this role (0: unknown)."""
    out = [[INFINITE] * 4 for _ in range(4)]
    for old, new in product(range(4), (SYSTEM, USER, ASSISTANT)):
        name = NAME if role == 0 else 0 if role == new else RELABEL
        if old == new:
            out[old][new] = name + MERGE
        elif (old, new) in _BETWEEN:
            out[old][new] = name + INSERT * len(_BETWEEN[old, new])
    return out


#: The matrix of a turn, by role (0: unknown).
FLAT = [[x for row in _steps(r) for x in row] for r in range(4)]


_UNIT = [0 if i == j else INFINITE for i in range(4) for j in range(4)]


def product_of(matrices: Iterable[list[int]]) -> list[int]:
    """The min-plus product of matrices, as 16 costs from each state on entry to each on leaving."""
    out = _UNIT
    for m in matrices:
        out = [min(INFINITE, *(out[4 * i + k] + m[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]
    return out


def segment_matrix(roles: list[int]) -> list[int]:
    """The product of the matrices of turns with these roles."""
    return product_of(FLAT[role] for role in roles)


def route(matrices: list[list[int]], entry: int = START, leave: int | None = None) -> list[tuple[int, int]]:
    """The states in which each of matrices is entered and left on the cheapest way from entry to leave, or to a legal end."""
    costs = [[0 if s == entry else INFINITE for s in range(4)]]
    for m in matrices:
        costs.append([min(costs[-1][i] + m[4 * i + j] for i in range(4)) for j in range(4)])
    state = min(range(4), key=lambda s: costs[-1][s] + INSERT * len(_END[s])) if leave is None else leave
    out = []
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        came = min(range(4), key=lambda i: before[i] + m[4 * i + state])
        out.append((came, state))
        state = came
    return out[::-1]


def _role_code() -> Column:
    code = F.lit(0)
    for i, role in enumerate(ROLES):
        code = F.when(F.lower(F.trim("role")) == role, F.lit(i + 1)).otherwise(code)
    return code


def _numbered(t: DataFrame, parts: int | None, first_part: int = 0) -> DataFrame:
    """t in order, with frag (a number for each conversation's part of a task, rising in order) and pos (the rank in it)."""
    order = ["conv_id", "turn", "key", "tie"]
    ranged = t.repartitionByRange(parts, *order) if parts else t.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frag, pos, last = (first_part + TaskContext.get().partitionId()) << 32, 0, None
        for b in batches:
            frags, places = [], []
            for conv in b.column(0).to_pylist():
                if last is not None and last[0] != conv:
                    frag, pos = frag + 1, 0
                last = (conv,)
                frags.append(frag)
                places.append(pos)
                pos += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(frags, pa.int64()), pa.array(places, pa.int64())], names=[*b.schema.names, "frag", "pos"])

    schema = StructType([*t.schema.fields]).add("frag", LongType()).add("pos", LongType())
    return ranged.sortWithinPartitions(*order).mapInArrow(run, schema)


_MATRIX = "array<int>"
_WAY = "array<struct<entry:int,leave:int>>"


def _each(way: Callable[..., list[tuple[int, int]]]):
    """A batch function: way of each row's arguments, as structs."""
    return lambda *columns: pd.Series([[{"entry": int(e), "leave": int(x)} for e, x in way(*row)] for row in zip(*columns, strict=True)])


def _ints(matrices) -> list[list[int]]:
    return [[int(x) for x in m] for m in matrices]


def repair_chats(turns: DataFrame, segment_turns: int = SEGMENT_TURNS, parts: int | None = None, first_part: int = 0) -> DataFrame:
    """One row for each of turns (conv_id, turn, role, text): conv_id, segment, place (in the segment), turn, role, new_role, action, inserted, appended, cost, fragment. segment_turns: turns of a segment at most; parts: tasks of the sort, numbered from first_part. segment is a pair of numbers, in whose order a conversation's segments come."""
    bound_batches(turns.sparkSession)
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("key"), F.xxhash64("text").alias("tie"), "role", F.coalesce("text", F.lit("")).alias("text"), _role_code().alias("code"))
    t = stage_table(_numbered(t, parts, first_part), "chat-turns").withColumn("seg", F.floor(F.col("pos") / segment_turns))
    in_order = lambda *fields: F.array_sort(F.collect_list(F.struct(*fields)))
    matrix = F.pandas_udf(lambda s: s.map(lambda c: segment_matrix([int(x) for x in c])), _MATRIX)
    times = F.pandas_udf(lambda s: s.map(lambda c: product_of(_ints(c))), _MATRIX)
    segments = t.groupBy("conv_id", "frag", "seg").agg(in_order("pos", "code").alias("c")).select("conv_id", "frag", "seg", matrix(F.col("c.code")).alias("m"))
    frags = segments.groupBy("conv_id", "frag").agg(in_order("seg", "m").alias("kids")).select("conv_id", "frag", "kids", times(F.col("kids.m")).alias("m"))
    frags = stage_table(frags, "chat-fragments")
    whole = frags.groupBy("conv_id").agg(in_order("frag", "m").alias("kids"))
    top = F.pandas_udf(_each(lambda m: route(_ints(m))), _WAY)
    ways = whole.select(F.size("kids").alias("n"), F.posexplode(F.arrays_zip(F.col("kids.frag").alias("frag"), top(F.col("kids.m")).alias("way"))).alias("i", "x"))
    ways = ways.select("x.frag", "x.way.entry", "x.way.leave", (F.col("i") == F.col("n") - 1).alias("last"))
    down = F.pandas_udf(_each(lambda m, entry, leave: route(_ints(m), int(entry), int(leave))), _WAY)
    inner = frags.join(ways, "frag").select("frag", "last", F.size("kids").alias("n"), F.posexplode(F.arrays_zip(F.col("kids.seg").alias("seg"), down(F.col("kids.m"), F.col("entry"), F.col("leave")).alias("way"))).alias("i", "x"))
    inner = inner.select("frag", "x.seg", "x.way.entry", "x.way.leave", (F.col("last") & (F.col("i") == F.col("n") - 1)).alias("last"))
    held = t.groupBy("conv_id", "frag", "seg").agg(in_order("pos", "turn", "code", "text", "role").alias("rows"))
    traced = F.pandas_udf(_each(lambda codes, entry, leave: route([FLAT[int(c)] for c in codes], int(entry), int(leave))), _WAY)
    both = held.join(inner, ["frag", "seg"]).withColumn("path", traced(F.col("rows.code"), F.col("entry"), F.col("leave")))
    number = F.struct("frag", "seg").alias("segment")
    each = both.select("conv_id", number, "last", F.size("rows").alias("n"), F.posexplode(F.arrays_zip("rows", "path")).alias("place", "x"))
    role_of = F.array(F.lit(None).cast("string"), *[F.lit(r) for r in ROLES])
    old, new, code = F.col("x.path.entry"), F.col("x.path.leave"), F.col("x.rows.code")
    ended = F.col("last") & (F.col("place") == F.col("n") - 1)
    inserted = F.when((new == ASSISTANT) & old.isin(START, SYSTEM), F.array(F.lit("user"))).otherwise(F.array().cast("array<string>"))
    appended = F.when(ended & (new == SYSTEM), F.array(F.lit("user"), F.lit("assistant"))).when(ended & (new == USER), F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    merged = old == new
    changed = F.when(code == 0, NAME).when(code == new, 0).otherwise(RELABEL)
    empty = lambda r: F.concat(F.lit(OPEN), r, F.lit("\n" + CLOSE))
    safe = F.replace(F.replace(F.col("x.rows.text"), F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))
    out = each.select(
        "conv_id", "segment", "place", F.col("x.rows.turn").alias("turn"), F.col("x.rows.role").alias("role"),
        F.element_at(role_of, new + 1).alias("new_role"),
        F.concat_ws("+", F.when(F.size(inserted) > 0, "insert"), F.when(changed > 0, "relabel"), F.when(merged, "merge"), F.when((F.size(inserted) == 0) & (changed == 0) & ~merged, "keep")).alias("action"),
        inserted.alias("inserted"), appended.alias("appended"),
        (changed + F.when(merged, MERGE).otherwise(0) + INSERT * (F.size(inserted) + F.size(appended))).cast("long").alias("cost"),
        old.alias("old"), merged.alias("merged"), ended.alias("ended"), safe.alias("text"),
    )
    fragment = F.concat(
        F.when(F.col("merged"), F.lit("\n")).otherwise(
            F.concat(F.when(F.col("old") == START, F.lit("")).otherwise(F.lit(CLOSE)), F.array_join(F.transform("inserted", empty), ""), F.lit(OPEN), F.col("new_role"), F.lit("\n"))
        ),
        F.col("text"),
        F.when(F.col("ended"), F.concat(F.lit(CLOSE), F.array_join(F.transform("appended", empty), ""))).otherwise(F.lit("")),
    )
    return out.withColumn("fragment", fragment).select("conv_id", "segment", "place", "turn", "role", "new_role", "action", F.array_join("inserted", ",").alias("inserted"), F.array_join("appended", ",").alias("appended"), "cost", "fragment")


def render_conversations(repaired: DataFrame) -> DataFrame:
    """conv_id, segment, turns and rendered: the text of each conversation. It is in one row, or for one of more than a segment's turns in several, to be read in the order of segment."""
    rows = F.array_sort(F.collect_list(F.struct("place", "fragment")))
    return repaired.groupBy("conv_id", "segment").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda x: x["fragment"]), "").alias("rendered"))


def op9_chat_formatting(spark, sf_dir):
    return repair_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
