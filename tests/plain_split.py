"""The splitter told plainly in Python, one body at a time: what the native expressions are held against."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

from passagemill.functions import text as tx
from passagemill.operators.split import HEADING, JOIN, MAX_CHARS, MIN_SECTION_CHARS, TARGET_CHARS


def scan(body: str) -> list[tuple[str | None, str]]:
    """(heading path, text) of each section of one body."""
    out, path, above, held, fenced = [], None, None, [], False
    for line in body.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(HEADING, line)):
            out.append((path, "\n".join(held).rstrip()))
            title, held = m[2].strip(), []
            if len(m[1]) == 2:
                above = path = title
            else:
                path = f"{above}{tx.HEADING_JOINT}{title}" if above else title
        held.append(line)
    out.append((path, "\n".join(held).rstrip()))
    return out[1:] if len(out) > 1 and not out[0][1] else out


def run_starts(sizes: list[int], joins: Callable[[int, int], bool]) -> list[int]:
    """Where runs begin, when item i joins the run before it if joins(i, length of that run with it)."""
    longer = lambda run, item: (item[0], run[1] + len(JOIN) + item[1])
    runs = accumulate(enumerate(sizes), lambda run, item: grown if joins(*(grown := longer(run, item))) else item)
    return [i for i, length in runs if length == sizes[i]]


def joined_runs(texts: list[str], starts: list[int]) -> list[str]:
    return [JOIN.join(texts[a:b]) for a, b in zip(starts, [*starts[1:], None], strict=True)]


def merge_short(found: list[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
    """Units of sections. A short section joins the unit before it within the target, and the first long section the short ones before it if they are one unit, which then has its heading."""
    paths, texts = [p for p, _ in found], [t for _, t in found]
    short = [len(t.strip()) < MIN_SECTION_CHARS for t in texts]
    head = short.index(False) if False in short else 0
    leads = head > 0 and len(JOIN.join(texts[:head])) <= TARGET_CHARS
    starts = run_starts(list(map(len, texts)), lambda i, length: (leads and i == head) or (short[i] and length <= TARGET_CHARS))
    headings = [paths[head if leads and i == 0 else i] for i in starts]
    return list(zip(headings, joined_runs(texts, starts), strict=True))


def pack(unit: str) -> list[str]:
    """A unit over MAX_CHARS in pieces of whole paragraphs near the target; paragraphs over MAX_CHARS are sliced, and empty ones left out."""
    if len(unit) <= MAX_CHARS:
        return [unit]
    slices = [p[i : i + MAX_CHARS] for p in re.split(r"\n[ \t]*\n+", unit) for i in range(0, len(p), MAX_CHARS)]
    return joined_runs(slices, run_starts(list(map(len, slices)), lambda _, length: length <= TARGET_CHARS)) if slices else []


def passages_of(body: str) -> list[tuple[str | None, str]]:
    """(heading path, content) of the passages of one body."""
    found = scan(body)
    units = merge_short(found) if len(body) > TARGET_CHARS and any(p for p, _ in found) else [(None, body)]
    return [(path, piece) for path, unit in units for piece in pack(unit)] or [(None, "")]
