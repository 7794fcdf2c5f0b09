"""Web-search syntax: words are ANDed, or binds looser, - excludes, quotes make phrases. An or that nothing stands before, or that follows an or, is a word. Nothing is a syntax error."""

from __future__ import annotations

import re
from collections.abc import Callable

TERMS = "array<struct<clause:int,item:int,offset:int,length:int,negated:boolean,term:string>>"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W]+", text.lower())


def parse(q: str | None, normal: Callable[[str], str | None] = lambda t: t, cut: Callable[[str], list[str]] = words) -> list[dict]:
    """The terms of a query: a clause is an alternative, an item a word or phrase in it, offset a term's place in its phrase. cut gives the tokens of a word or phrase (several of one word make a phrase), normal a token's lexeme, or None to drop it (its place still counts)."""
    clauses: list[list[tuple[bool, list[tuple[int, str]]]]] = [[]]
    after_or, operand = False, False
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', q or ""):
        raw = m[3]
        if operand and raw and raw.lower() == "or":
            after_or, operand = True, False
            continue
        operand = True
        negated = bool(m[1]) if raw is None else raw.startswith("-")
        tokens = cut(m[2] if raw is None else raw.removeprefix("-"))
        found = [(i, x) for i, t in enumerate(tokens) if (x := normal(t)) is not None]
        if not found:
            continue
        if after_or and clauses[-1]:
            clauses.append([])
        after_or = False
        first = found[0][0]
        clauses[-1].append((negated, [(i - first, x) for i, x in found]))
    out = []
    for c, items in enumerate(x for x in clauses if x):
        for i, (negated, terms) in enumerate(items):
            out += [{"clause": c, "item": i, "offset": o, "length": len(terms), "negated": negated, "term": t} for o, t in terms]
    return out
