"""Splitting notes into heading-aware passages.

All of it is native: sections by nested splits at headings (those in fences are hidden
first), the order-dependent rules (merging short sections, packing paragraphs) by folds
over running lengths. Only frontmatter that is not plain 'key: value' goes to Python,
for YAML.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as tx

#: Fixed values of the splitter: size aimed at, largest passage, size under which a section is short.
TARGET_CHARS, MAX_CHARS, MIN_SECTION_CHARS = 1500, 4000, 300
JOIN = "\n\n"
HEADING = r"^(#{2,3})\s+(.+)$"


def section_lines(notes: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """key, pos, line, section, level and title of every line of notes. A fence line flips whether headings count."""
    lines = notes.select(key, F.posexplode(F.split(F.col(body), "\n", -1)).alias("pos", "line"))
    upto = Window.partitionBy(key).orderBy("pos")
    fence = F.regexp_replace("line", r"(?U)^\s+", "").rlike("^(?:```|~~~)")
    lines = lines.withColumn("fence", fence.cast("int")).withColumn("open", F.sum("fence").over(upto) % 2)
    heading = (F.col("fence") == 0) & (F.col("open") == 0) & F.col("line").rlike("(?U)(?d)" + HEADING)
    lines = lines.withColumn("level", F.when(heading, F.length(F.regexp_extract("line", HEADING, 1))))
    lines = lines.withColumn("title", F.when(heading, F.regexp_replace(F.regexp_extract("line", "(?U)(?d)" + HEADING, 2), r"(?U)^\s+|\s+$", "")))
    return lines.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(upto)).drop("fence", "open")


def sections(notes: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """key, section, heading_path and text, in order of section. A preamble without text is left out; a note always has a section."""
    lines = section_lines(notes, key, body)
    each = lines.groupBy(key, "section").agg(
        F.max("level").alias("level"), F.max("title").alias("title"),
        tx.rstrip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("text"),
    )
    w = Window.partitionBy(key).orderBy("section")
    h2 = F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(w)
    path = F.when(F.col("level") == 2, F.col("title")).when(F.col("level") == 3, tx.heading_path(h2, F.col("title")))
    many = F.max("section").over(Window.partitionBy(key)) > 0
    out = each.select(key, "section", path.alias("heading_path"), "text", many.alias("many"))
    return out.filter(~((F.col("section") == 0) & (F.col("text") == "") & F.col("many"))).drop("many")


def split_by_sections(body: Column, headings: Column) -> Column:
    """Whether a note is cut at its headings."""
    return (headings > 0) & (F.length(body) > TARGET_CHARS)


def hard_split(paragraph: Column) -> Column:
    """An array of slices of at most MAX_CHARS."""
    n = F.length(paragraph)
    return F.when(n <= MAX_CHARS, F.array(paragraph)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(MAX_CHARS)), lambda i: F.substring(paragraph, i, F.lit(MAX_CHARS))))


# Splitting a body by array expressions. ---------------------------------------

#: Blanks of one line, as the headings' and fences' rules know them; hides headings inside fences; stands for a mark that was in the text.
BLANK, HIDDEN, ESCAPED = r"[[^\S\n]\x1c-\x1f]", "\x01h", "\x01e"
FENCE = rf"{BLANK}*(?:```|~~~)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _hide_fenced(body: Column) -> Column:
    """body with marks before the headings inside fences. Bodies without a fence pass as they are."""
    parts = F.regexp_extract_all(body, F.lit(rf"(?Us)(?:\A|\n){FENCE}.*?(?:\n{FENCE}|\z)|.+?(?=\n{FENCE}|\z)"), F.lit(0))
    fenced = lambda x: x.rlike(rf"(?U)\A\n?{FENCE}")
    hide = lambda x: F.when(fenced(x), F.replace(x, F.lit("\n##"), F.lit("\n" + HIDDEN + "##"))).otherwise(x)
    return F.when(body.contains("```") | body.contains("~~~"), F.array_join(F.transform(parts, hide), "")).otherwise(body)


def body_sections(body: Column) -> Column:
    """An array of (path, text) of each section of a body: at the headings of two signs, then within each at those of three, so that a path is known from its own block."""
    hidden = _hide_fenced(F.replace(body, F.lit("\x01"), F.lit(ESCAPED)))
    shown = lambda c: F.replace(F.replace(c, F.lit(HIDDEN), F.lit("")), F.lit(ESCAPED), F.lit("\x01"))
    title = lambda part, signs: _strip(F.substring(shown(F.substring_index(part, "\n", 1)), signs + 1, 1 << 30))
    two, three = [rf"{'#' * k}{BLANK}[^\n]" for k in (2, 3)]

    def block(whole: Column) -> Column:
        above = F.when(whole.rlike(rf"(?U)\A{two}"), title(whole, 2))
        path = lambda part: F.when(part.rlike(rf"(?U)\A{three}"), tx.heading_path(above, title(part, 3)))
        text = lambda part: F.regexp_replace(shown(part), r"(?U)[\s\x1c-\x1f]+\z", "")
        return F.transform(F.split(whole, rf"(?U)\n(?={three})", -1), lambda part, i: F.struct(F.when((i == 0) & above.isNotNull(), above).otherwise(path(part)).alias("path"), text(part).alias("text")))

    every = F.flatten(F.transform(F.split(hidden, rf"(?U)\n(?={two})", -1), block))
    preamble = lambda x: (F.size(x) > 1) & x[0]["path"].isNull() & (x[0]["text"] == "")
    return tx.let(every, lambda x: F.when(preamble(x), F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))).otherwise(x))


def run_starts(items: Column) -> Column:
    """Where runs begin in an array of (size, joins, room): an item joins the run before it if it must (joins), or if it may (room) and both are within the target. A fold over running lengths; what it gathers grows with the runs only."""
    first = F.struct(F.lit(0).alias("length"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(run: Column, x: Column) -> Column:
        longer = run["length"] + len(JOIN) + x["size"]
        on = (run["i"] > 0) & (x["joins"] | (x["room"] & (longer <= TARGET_CHARS)))
        return F.struct(F.when(on, longer).otherwise(x["size"]).alias("length"), (run["i"] + 1).alias("i"), F.when(on, run["starts"]).otherwise(F.array_append(run["starts"], run["i"])).alias("starts"))

    return F.aggregate(items, first, step, lambda run: run["starts"])


def _runs(texts: Column, starts: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(start, joined texts) of each run."""
    return F.transform(starts, lambda a, k: use(a, F.array_join(F.slice(texts, a + 1, F.coalesce(F.get(starts, k + 1), F.size(texts)) - a), JOIN)))


def merge_short(found: Column) -> Column:
    """Units of sections. A short section joins the unit before it within the target, and the first long section the short ones before it if they are one unit, which then has its heading."""

    def merge(x: Column, short: Column) -> Column:
        head = F.array_position(short, F.lit(False)).cast("int") - 1
        fits = F.aggregate(F.slice(x, 1, F.greatest(head, F.lit(0))), F.lit(-len(JOIN)), lambda n, y: n + len(JOIN) + F.length(y["text"])) <= TARGET_CHARS
        return tx.let(F.struct(head.alias("at"), ((head > 0) & fits).alias("leads")), lambda h: units(x, short, h))

    def units(x: Column, short: Column, h: Column) -> Column:
        items = F.transform(x, lambda y, i: F.struct(F.length(y["text"]).alias("size"), (h["leads"] & (i == h["at"])).alias("joins"), F.get(short, i).alias("room")))
        path = lambda a: F.get(x, F.when(h["leads"] & (a == 0), h["at"]).otherwise(a))["path"]
        return tx.let(F.struct(F.transform(x, lambda y: y["text"]).alias("texts"), run_starts(items).alias("starts")), lambda r: _runs(r["texts"], r["starts"], lambda a, t: F.struct(path(a).alias("path"), t.alias("text"))))

    return tx.let(found, lambda x: tx.let(F.transform(x, lambda y: F.length(_strip(y["text"])) < MIN_SECTION_CHARS), lambda short: merge(x, short)))


def pack(unit: Column) -> Column:
    """A unit over MAX_CHARS in pieces of whole paragraphs near the target; paragraphs over MAX_CHARS are sliced, and empty ones left out."""
    slices = F.flatten(F.transform(F.filter(F.split(unit, r"\n[ \t]*\n+", -1), lambda p: p != ""), hard_split))
    items = lambda x: F.transform(x, lambda y: F.struct(F.length(y).alias("size"), F.lit(False).alias("joins"), F.lit(True).alias("room")))
    pieces = tx.let(slices, lambda x: tx.let(run_starts(items(x)), lambda starts: _runs(x, starts, lambda _, t: t)))
    return F.when(F.length(unit) <= MAX_CHARS, F.array(unit)).otherwise(pieces)


def split_bodies(body: Column) -> Column:
    """An array of passages (ordinal, heading_path, content) of each body; native. A null body is an empty one."""
    whole = lambda b: F.array(F.struct(F.lit(None).cast("string").alias("path"), b.alias("text")))
    headed = lambda x: F.exists(x, lambda y: F.coalesce(y["path"], F.lit("")) != "")
    cut = lambda b: tx.let(body_sections(b), lambda x: F.when(headed(x), merge_short(x)).otherwise(whole(b)))
    units = lambda b: F.when(F.length(b) > TARGET_CHARS, cut(b)).otherwise(whole(b))
    pieces = lambda u: F.transform(pack(u["text"]), lambda p: F.struct(u["path"].alias("path"), p.alias("text")))
    every = tx.let(F.coalesce(body, F.lit("")), lambda b: F.flatten(F.transform(units(b), pieces)))
    some = tx.let(every, lambda x: F.when(F.size(x) > 0, x).otherwise(whole(F.lit(""))))
    return F.transform(some, lambda x, i: F.struct(i.cast("int").alias("ordinal"), x["path"].alias("heading_path"), x["text"].alias("content")))


def read_note(content: Column) -> Column:
    """struct(name, description, type, body) of raw content, for plain 'key: value' frontmatter; native."""
    cut = tx.cut_frontmatter(content)
    block = cut["block"]
    return F.struct(*[tx.flat_field(block, k).alias(k) for k in ("name", "description", "type")], tx.normalise_body(cut["rest"]).alias("body"))


def _yaml_fields(block: str | None) -> dict:
    import yaml

    out = {"ok": False, "name": None, "description": None, "type": None}
    if block is None:
        return out
    try:
        read = yaml.safe_load(block)
    except Exception:  # noqa: BLE001  whatever the parser dislikes makes the block no frontmatter
        return out
    if isinstance(read, dict):
        out |= {"ok": True} | {k: read[k] for k in ("name", "description", "type") if isinstance(read.get(k), str)}
    return out


def yaml_fields(block: Column) -> Column:
    """struct(ok, name, description, type) of a YAML block; only genuine strings count."""
    return F.pandas_udf(lambda s: pd.DataFrame([_yaml_fields(b) for b in s]), "struct<ok:boolean,name:string,description:string,type:string>")(block)


#: Frontmatter lines that are plain strings in YAML too: a key, and a value that begins with a letter and is no word for true, false or null.
PLAIN_LINE = r"^[A-Za-z_][A-Za-z0-9_]{0,99}:[ ]+(?!(?i:true|false|yes|no|on|off|null)[ ]*$)\p{L}[\p{L}\p{N} _./-]*$"


def plain_block(block: Column) -> Column:
    """Whether a frontmatter block has plain lines only, with none of the three fields twice."""
    lines = F.split(block, "\n", -1)
    once = lambda key: F.size(F.filter(lines, lambda x: x.startswith(key + ":"))) <= 1
    return F.forall(lines, lambda x: x.rlike(PLAIN_LINE)) & once("name") & once("description") & once("type")


def split_notes(notes: DataFrame, content: str = "content") -> DataFrame:
    """notes with name, description, type, provenance_kind, provenance_date, body and passages. YAML is read in Python for blocks alone that are not plain; other rows give it null.

    One pass without a filter: a filter would repeat what the content is derived from, for itself and in each branch.
    """
    block = F.col("fm.block")
    cut = notes.withColumn("fm", tx.cut_frontmatter(F.col(content))).withColumn("odd", block.isNotNull() & ~plain_block(block))
    flat = F.struct(F.lit(True).alias("ok"), *[tx.flat_field(block, k).alias(k) for k in ("name", "description", "type")])
    both = cut.withColumn("read", yaml_fields(F.when(F.col("odd"), block)))
    both = both.withColumn("y", F.when(F.col("odd"), F.col("read")).when(block.isNotNull(), flat)).drop("odd", "read")
    rest = F.when(F.coalesce(F.col("y.ok"), F.lit(False)), F.col("fm.rest")).otherwise(F.col(content))
    out = both.withColumn("body", tx.normalise_body(rest)).withColumn("p", tx.provenance(F.col("body")))
    out = out.withColumn("name", F.col("y.name")).withColumn("description", F.col("y.description")).withColumn("type", F.col("y.type"))
    out = out.withColumn("provenance_kind", F.col("p.kind")).withColumn("provenance_date", F.col("p.date"))
    return out.withColumn("passages", split_bodies(F.col("body"))).drop("fm", "y", "p")
