"""Tokens by class, for the English configuration: words, compounds, hosts, urls, addresses, paths and numbers.

A compound of hyphens is a token as a whole and then by its parts; a url as a whole, then
by host and path. Each token takes a place of its own. Tags, character entities and a
url's protocol are passed over without a place. A hyphen before a digit is a sign, not
part of a compound, and underscores part words. Documents (native expressions) and
queries (the same patterns, in a helper) are cut alike.

Runs are bounded where a pattern could look far ahead in vain, so that the time is linear
in the text: local parts, labels and names by their usual limits, compounds and paths
by 32 parts, after which a new token begins.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_LABEL = r"[a-z0-9][a-z0-9-]{0,62}+"
_HOST = rf"(?:{_LABEL}\.){{1,16}}[a-z]{{2,24}}(?![a-z0-9_-])(?::[0-9]{{1,5}})?"
_WORD = r"[\p{L}\p{N}]"
_NAME = r"[a-z0-9_.+-]{0,254}[a-z0-9_+-]"
TAG, ENTITY, PROTOCOL = r"</?[a-z!?][^<>]*>", r"&(?:#[0-9]{1,8}|#x[0-9a-f]{1,8}|[a-z]{1,31});", r"[a-z]{2,16}://"
EMAIL = rf"[a-z0-9][a-z0-9._%+-]{{0,63}}+@{_HOST}"
HOST_OR_URL = rf"{_HOST}(?:/[^\x00-\x20<>\"]*[^\x00-\x20<>\".,;:!?()'\[\]])?"
PATH = rf"(?:[~.]{{0,2}}+|[a-z0-9_.+-]{{1,255}}+)(?:/{_NAME}){{1,32}}"
NUMBER = rf"[+-]?[0-9]+(?:(?:\.[0-9]+){{1,8}}|(?:\.[0-9]+)?e[+-]?[0-9]+)?(?!{_WORD})"
COMPOUND = rf"\p{{L}}{_WORD}*(?:-\p{{L}}{_WORD}*){{1,32}}"
#: Classes in the order in which they are tried at a place.
TOKEN = "|".join((TAG, ENTITY, PROTOCOL, EMAIL, HOST_OR_URL, PATH, NUMBER, COMPOUND, rf"{_WORD}+"))

_SKIPPED = r"^[<&]|^[a-z]+://$"
_IS_URL = rf"^{_HOST}/"
_IS_COMPOUND = rf"^{_WORD}+(?:-{_WORD}+)+$"


def tokens(c: Column) -> Column:
    """All tokens of a text, in order of place. Null has none."""

    def parts(t: Column) -> Column:
        whole = F.array(t)
        return (
            F.when(t.rlike(_SKIPPED), F.array().cast("array<string>"))
            .when(t.rlike(_IS_URL), F.array(t, F.regexp_extract(t, "^[^/]*", 0), F.regexp_extract(t, "/.*$", 0)))
            .when(t.rlike(_IS_COMPOUND), F.concat(whole, F.split(t, "-")))
            .otherwise(whole)
        )

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0)), parts))


_find, _skipped, _is_url, _is_compound = (regex.compile(p) for p in (TOKEN, _SKIPPED, _IS_URL, _IS_COMPOUND))


def query_tokens(text: str) -> list[str]:
    """The tokens of a part of a query, as tokens gives them."""
    out: list[str] = []
    for t in _find.findall(text.lower()):
        if _skipped.search(t):
            continue
        out.append(t)
        if _is_url.search(t):
            host, _, rest = t.partition("/")
            out += [host, "/" + rest]
        elif _is_compound.search(t):
            out += t.split("-")
    return out
