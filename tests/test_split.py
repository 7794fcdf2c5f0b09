import plain_split
import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import split


def joined(found):
    return "".join("".join(t.split()) for _, t in found)


def body(*sections):
    return "\n\n".join(sections)


LONG = "A sentence of some words stands here. " * 12
CASES = {
    "empty": "",
    "blank": "  \n \n",
    "short with headings": "## A\n\ntext\n\n## B\n\ntext",
    "fenced": "## Real\n\n" + LONG * 4 + "\n```\n## not\n```\n~~~\n### nor\n~~~\n",
    "unclosed fence": LONG * 5 + "\n```\n## hidden\n" + LONG,
    "h3 alone": "### Only\n\n" + LONG * 5,
    "h3 below h2": "## Two\n\n" + LONG * 2 + "\n\n### Three\n\n" + LONG * 3,
    "one paragraph": "## P\n\n" + "x" * 10_000,
    "headingless": "\n\n".join([LONG] * 30),
    "log": "\n".join(f"## Entry {i}\n\nline {i}" for i in range(400)),
}


@pytest.mark.parametrize("name", CASES)
def test_invariants(name):
    text = CASES[name].rstrip()
    found = plain_split.passages_of(text)
    assert found and all(len(t) <= split.MAX_CHARS for _, t in found)
    assert joined(found) == "".join(text.split())


def test_small_body_stays_whole():
    assert plain_split.passages_of(CASES["short with headings"]) == [(None, CASES["short with headings"])]
    assert plain_split.passages_of("") == [(None, "")]


def test_heading_paths():
    paths = [p for p, _ in plain_split.passages_of(CASES["h3 below h2"])]
    assert paths == ["Two", "Two › Three"]
    assert plain_split.passages_of(CASES["h3 alone"])[0][0] == "Only"
    assert not any(p and "not" in p for p, _ in plain_split.passages_of(CASES["fenced"]))


def test_long_paragraph_is_sliced():
    assert max(len(t) for _, t in plain_split.passages_of(CASES["one paragraph"])) == split.MAX_CHARS


@pytest.mark.parametrize("run", [2, 5, 20, 120, 400])
def test_short_sections_merge_under_the_first_heading(run):
    text = "\n".join(f"## Entry {i}\n\nline {i} of the log" for i in range(run)) + "\n\n## Tail\n\n" + LONG * 4
    found = plain_split.passages_of(text)
    assert found[0][0] == ("Tail" if run <= 20 else "Entry 0")
    assert all(len(t) <= split.TARGET_CHARS or "Tail" in t for _, t in found)
    for i in range(run):
        assert sum(f"## Entry {i}\n" in t for _, t in found) == 1


def test_native_sections_equal_the_helper(spark):
    rows = [(i, t) for i, t in enumerate(CASES.values())]
    notes = spark.createDataFrame(rows, "id long, body string").withColumn("body", tx.normalise_body(F.col("body")))
    got = {}
    for r in split.sections(notes).orderBy("id", "section").collect():
        got.setdefault(r.id, []).append((r.heading_path, r.text))
    for r in notes.collect():
        assert got[r.id] == plain_split.scan(r.body), r.id


def test_frontmatter_cases(spark):
    cases = {
        "flat": ("---\nname: A\ndescription: b c\ntype: note\n---\n\nBody", ("A", "b c", "note", "Body")),
        "not strings": ("---\nname: 5\ntype: [a]\n---\nBody", (None, None, None, "Body")),
        "unclosed": ("---\nname: A\nBody", (None, None, None, "---\nname: A\nBody")),
        "empty block": ("---\n---\nBody", (None, None, None, "---\n---\nBody")),
        "broken": ("---\nname: [a\n---\nBody", (None, None, None, "---\nname: [a\n---\nBody")),
        "trailing blanks": ("---  \nname: A\n--- \t\nBody\n\n", ("A", None, None, "Body")),
        "indented first line": ("\n \n    code\nmore  \n", (None, None, None, "    code\nmore")),
        "blank": (" \n\t\n", (None, None, None, "")),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "id string, content string")
    for r in split.split_notes(df).collect():
        assert (r.name, r.description, r.type, r.body) == cases[r.id][1], r.id
        assert [p.ordinal for p in r.passages] == list(range(len(r.passages)))


def test_provenance(spark):
    cases = [
        ("[Source: user override — 2026-01-02]", "user override", "2026-01-02"), ("x [Source: empirical - 2026-09-30] y", "empirical", "2026-09-30"),
        ("[Source: empirical - 2026-13-45] [Source: empirical - 2026-01-01]", None, None), ("[Source: hearsay - 2026-01-01]", None, None), ("[Source:empirical-2026-01-01\t]", "empirical", "2026-01-01"), ("", None, None),
    ]
    df = spark.createDataFrame([(c[0], i) for i, c in enumerate(cases)], "body string, i int").withColumn("p", tx.provenance(F.col("body")))
    for r in df.collect():
        assert (r.p.kind, str(r.p.date) if r.p.date else None) == cases[r.i][1:]


def test_short_sections_hold_whole_turns(spark, sf_dir):
    from passagemill.plans import text_queries

    chars = {r.conv_id: r.n for r in text_queries.d3_short_sections(spark, sf_dir).groupBy("conv_id").agg(F.sum("chars").alias("n")).collect()}
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("longest")).collect()
    assert any(r.longest > 400 for r in turns)
    assert [r for r in turns if chars[r.conv_id] < 0.98 * r.n] == []


def by_rules(found):
    """The units of sections, told section by section as the rules are stated."""
    units, waiting = [], []
    for path, text in found:
        if len(text.strip()) < 300:
            if units and len(units[-1][1]) + 2 + len(text) <= 1500:
                units[-1] = (units[-1][0], units[-1][1] + "\n\n" + text)
            elif units:
                units.append((path, text))
            elif not waiting or len("\n\n".join([*(t for _, t in waiting), text])) <= 1500:
                waiting.append((path, text))
            else:
                units += [(waiting[0][0], "\n\n".join(t for _, t in waiting)), (path, text)]
                waiting = []
        else:
            units.append((path, "\n\n".join([*(t for _, t in waiting), text])))
            waiting = []
    return units + [(p, "\n\n".join(t for _, t in waiting)) for p, _ in waiting[:1]]


def test_units_follow_the_rules():
    import random

    rnd = random.Random(2)
    for _ in range(400):
        found = [(f"H{i}", "x" * rnd.choice([5, 120, 299, 299, 300, 700, 1490, 2000])) for i in range(rnd.randint(1, 14))]
        assert plain_split.merge_short(found) == by_rules(found)


def test_pack_keeps_blank_pieces():
    unit = "\n\n".join(["a" * 1400, "\f", "b" * 1499, "", "c" * 4100, "d"])
    assert plain_split.pack(unit) == ["a" * 1400 + "\n\n\f", "b" * 1499, "c" * 4000, "c" * 100 + "\n\nd"]


def test_native_split_equals_the_plain_one(spark):
    """Bodies put together at random from headings, fences, blanks of all kinds, short and long paragraphs."""
    import random

    rnd = random.Random(5)
    line = lambda: rnd.choice([
        f"## H{rnd.randint(0, 99)}", f"### h{rnd.randint(0, 99)} ", "##", "##  ", "## \x1f", "#### four", "##tight", "##\u00a0wide", " ## in", "```", "  ~~~ py", "\u2003```x", "", "", " ", "\f", "\r",
        "a\x01b", "\x01h## x", "\x01e", "w " * rnd.randint(1, 200), "é" * rnd.randint(1, 400), "long " * rnd.randint(100, 1000), "🙂" * rnd.choice([3, 290, 4001]), "## T\r",
    ])
    bodies = ["\n".join(line() for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    bodies += [None, "", "\n" * 5000, "## A\n" * 3000, "##  \n" + "x" * 1600, *CASES.values()]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").repartition(4)
    got = {r.id: [(p.ordinal, p.heading_path, p.content) for p in r.passages] for r in df.select("id", split.split_bodies(F.col("body")).alias("passages")).collect()}
    for i, b in enumerate(bodies):
        assert got[i] == [(k, p, c) for k, (p, c) in enumerate(plain_split.passages_of(b or ""))], i


def test_plain_frontmatter_is_what_yaml_reads(spark):
    blocks = [
        "name: A b\ntype: note", "name: 5", "name: yes", "name: Yes \ntype: x", "name: yesterday", "a: b", "name: a: b", "name: a #b", "name: x\nname: y", "name:  two  blanks  in", "name: é-ü/ö.1", "name: ", "name:x",
        "- a", "name: [x]", "name: 'q'", "Name: X\nname: y", "type: null", "description: None", "description: on\nname: On time", "name: a\n\ntype: b", "name: a\r", "name: y", "x-y: b\nname: c",
    ]
    df = spark.createDataFrame([(i, f"---\n{b}\n---\nBody") for i, b in enumerate(blocks)], "id int, content string")
    got = {r.id: (r.name, r.description, r.type) for r in split.split_notes(df).collect()}
    for i, b in enumerate(blocks):
        y = split._yaml_fields(b)
        assert got[i] == (y["name"], y["description"], y["type"]), b
    plain = df.select("id", split.plain_block(F.regexp_extract("content", r"(?s)---\n(.*)\n---", 1)).alias("p")).filter("p").count()
    assert plain >= 6


def test_bodies_are_split_once(spark, sf_dir):
    """No filter and no second branch, each of which would repeat what notes are derived from, or the split."""
    from passagemill.plans import text_queries

    plan = text_queries.d6_passages(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "Union" not in plan
