"""Scalar functions over note texts, all native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.config import IngestConfig

#: Fixed values of the data model: limits of request fields, and the kinds a provenance marker may name.
MAX_SCOPE, MAX_PATH, MAX_STATUS, MAX_TOP_K = 512, 2048, 256, 50
PROVENANCE = r"\[Source:\s*(user override|empirical|agent inference)\s*[—-]\s*(\d{4}-\d{2}-\d{2})\s*\]"
HEADING_JOINT = " › "


def content_hash(content: Column) -> Column:
    """SHA-256 of the raw content."""
    return F.sha2(content, 256)


def pipeline_version(cfg: IngestConfig) -> Column:
    return F.lit(cfg.pipeline_version)


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def embedding_input(name: Column, heading_path: Column, content: Column) -> Column:
    """What is embedded for a passage: the parts that are not empty, by lines."""
    return F.concat_ws("\n", _given(name), _given(heading_path), _given(content))


def fts_lead_a(name: Column, heading_path: Column) -> Column:
    return F.concat_ws(" ", _given(name), _given(heading_path))


def fts_lead_c(description: Column) -> Column:
    return F.coalesce(description, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value reckoned once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


#: A line of ---, the lines of the block, and the next such line.
FRONTMATTER = r"(?U)\A---[^\S\n]*\n(?:((?s:.*?))\n)??---[^\S\n]*(?:\n|\z)"


def cut_frontmatter(content: Column) -> Column:
    """struct(block, rest): the lines between a leading --- and the next ---, and what follows; block is null and rest the whole content without such a pair."""
    head = F.when(content.startswith("---"), F.regexp_extract(content, FRONTMATTER, 0)).otherwise(F.lit(""))
    return let(head, lambda h: F.struct(F.when(h != "", F.regexp_extract(h, FRONTMATTER, 1)).alias("block"), F.when(h != "", F.substring(content, F.length(h) + 1, F.length(content))).otherwise(content).alias("rest")))


def flat_field(block: Column, key: str) -> Column:
    """The value of a plain 'key: value' line of a frontmatter block, or null."""
    return _given(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\r\n]*?)[ \t]*$", 1))


def normalise_body(rest: Column) -> Column:
    """Without leading blank lines and trailing blanks; the first line keeps its indentation."""
    return F.regexp_replace(F.regexp_replace(rest, r"(?U)^(?:[^\S\n]*\n)+", ""), r"(?U)\s+$", "")


def provenance(body: Column) -> Column:
    """struct(kind, date) of the first marker; both null without one, or when its date is impossible."""
    date = F.try_to_date(F.regexp_extract(body, "(?U)" + PROVENANCE, 2), "yyyy-MM-dd")
    return F.struct(F.when(date.isNotNull(), F.regexp_extract(body, "(?U)" + PROVENANCE, 1)).alias("kind"), date.alias("date"))


def query_text(q: Column, cfg: IngestConfig) -> Column:
    """The query as it is embedded."""
    return F.concat(F.lit(f"Instruct: {cfg.query_instruction}\nQuery:"), q) if cfg.query_instruction else q


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 15)


def heading_path(h2: Column, h3: Column) -> Column:
    return F.concat_ws(HEADING_JOINT, _given(h2), _given(h3))


def path_fault(path: Column) -> Column:
    """Null for a URI or a relative path without '..'; else what is wrong."""
    uri = path.rlike(r"^[a-z][a-z0-9+.\-]*://")
    return (
        F.when(path.isNull() | (F.length(path) < 1), F.lit("path is empty"))
        .when(F.length(path) > MAX_PATH, F.lit("path too long"))
        .when(uri, F.lit(None).cast("string"))
        .when(path.startswith("/"), F.lit("absolute path"))
        .when(F.array_contains(F.split(path, "/"), ".."), F.lit("parent component"))
    )


def request_fault(scope: Column, path: Column, content: Column, status: Column, cfg: IngestConfig) -> Column:
    """The first fault of an ingest request, or null."""
    return F.coalesce(
        F.when(F.length(scope) > MAX_SCOPE, F.lit("scope too long")),
        path_fault(path),
        F.when(F.length(status) > MAX_STATUS, F.lit("status too long")),
        F.when(content.isNull(), F.lit("no content")),
        F.when(F.length(content) > cfg.max_content_chars, F.lit("content too long")),
    )


def query_fault(q: Column, top_k: Column) -> Column:
    return F.coalesce(F.when(q.isNull() | (F.length(q) < 1), F.lit("query is empty")), F.when(~F.coalesce(top_k, F.lit(5)).between(1, MAX_TOP_K), F.lit("top_k out of range")))


def exclusion_patterns(globs: list[str]) -> list[str]:
    """Regular expressions for globs that match a path from its right end: * stays within a component, a leading **/ also matches no component."""
    import re

    out = []
    for glob in globs:
        anchored = glob[3:] if glob.startswith("**/") else glob
        parts = ["[^/]*".join(re.escape(x) for x in p.split("*")) for p in anchored.split("/")]
        out.append("(?:^|/)" + "/".join(parts) + "$")
    return out
