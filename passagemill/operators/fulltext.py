"""The full-text arm: weighted postings, matching, cover-density rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.functions import wordclass
from passagemill.session import stage_table

#: Token class of the simple configuration and label weights.
TOKEN = r"[\p{L}\p{N}_]+"
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Query terms are broadcast up to this many rows, and shuffled beyond.
BROADCAST_TERMS = 100_000


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(passages: DataFrame, *keep: str, stemmed: bool = False) -> DataFrame:
    """client_name, scope, passage_id, token, pos and weight label of every token of passages (passage_id, name, heading_path, content, description): A name and heading, B content, C description, each placed after the one before. stemmed: tokens by class, as english takes them."""
    cut = wordclass.tokens if stemmed else tokens
    a, b, c = cut(tx.fts_lead_a(F.col("name"), F.col("heading_path"))), cut(F.col("content")), cut(tx.fts_lead_c(F.col("description")))
    label = lambda arr, x: F.transform(arr, lambda t: F.struct(t.alias("token"), F.lit(x).alias("weight")))
    both = F.concat(label(a, "A"), label(b, "B"), label(c, "C"))
    return passages.select("client_name", "scope", "passage_id", *keep, F.posexplode(both).alias("at", "t")).select(
        "client_name", "scope", "passage_id", *keep, F.col("t.token").alias("token"), (F.col("at") + 1).alias("pos"), F.col("t.weight").alias("weight")
    )


def lexemes(token: Column) -> Column:
    """The lexeme of each token; null for a stop word. A task stems each token once, or again if it has met very many."""
    from passagemill.functions.english import known_lexeme

    return F.pandas_udf(lambda s: s.map(known_lexeme), "string")(token)


def vocabulary(posts: DataFrame) -> DataFrame:
    """token and lexeme of each distinct token that is no stop word."""
    return posts.select("token").distinct().withColumn("lexeme", lexemes(F.col("token"))).filter("lexeme IS NOT NULL")


def english(posts: DataFrame) -> DataFrame:
    """postings (stemmed) with lexeme in place of token: each distinct token is stemmed once; stop words go, but have kept their place."""
    return posts.join(vocabulary(posts), "token").drop("token")


def simple(posts: DataFrame) -> DataFrame:
    return posts.withColumnRenamed("token", "lexeme")


def query_terms(queries: DataFrame, stemmed: bool) -> DataFrame:
    """One row for each term of each of queries (query_id, client_name, q, repo_filter)."""
    from passagemill.functions import webquery
    from passagemill.functions.english import lexeme

    normal = lexeme if stemmed else (lambda t: t)
    cut = wordclass.query_tokens if stemmed else webquery.words
    parsed = F.pandas_udf(lambda s: s.map(lambda q: webquery.parse(q, normal, cut)), webquery.TERMS)
    return queries.select("query_id", "client_name", "repo_filter", F.explode(parsed("q")).alias("t")).select("query_id", "client_name", "repo_filter", "t.*")


def in_scope(repo_filter: str, scope: str) -> Column:
    """Null and '' are no filter."""
    return (F.coalesce(F.col(repo_filter), F.lit("")) == "") | (F.col(scope) == F.col(repo_filter))


def hits(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the terms' lexemes in their tenant and scope."""
    t = terms.withColumnRenamed("term", "lexeme").alias("t")
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        t = F.broadcast(t)
    p = posts.alias("p")
    on = (F.col("p.client_name") == F.col("t.client_name")) & (F.col("p.lexeme") == F.col("t.lexeme")) & in_scope("t.repo_filter", "p.scope")
    return p.join(t, on).select("query_id", "clause", "item", "offset", "length", "negated", "passage_id", "pos", "weight", F.col("t.lexeme").alias("lexeme"))


def matches(every: DataFrame, terms: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, passage_id of passages that satisfy some clause: all its items, none of its negated ones. A clause of negated items alone matches the rest of every (client_name, scope, passage_id): all passages of the tenant, also those without a token."""
    item = ["query_id", "clause", "item", "negated", "passage_id"]
    # Places matter in phrases only.
    phrases = found.filter("length > 1").groupBy(*item, "length", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("n")).filter("n = length")
    items = found.filter("length = 1").select(*item).distinct().unionByName(phrases.select(*item).distinct())
    got = items.groupBy("query_id", "clause", "passage_id").agg(F.count_if(~F.col("negated")).alias("yes"), F.count_if("negated").alias("no"))
    need = terms.select("query_id", "client_name", "repo_filter", "clause", "item", "negated").distinct().groupBy("query_id", "client_name", "repo_filter", "clause").agg(F.count_if(~F.col("negated")).alias("need"))
    positive = got.join(need.filter("need > 0").select("query_id", "clause", "need"), ["query_id", "clause"]).filter("yes = need AND no = 0").select("query_id", "passage_id")
    if need.filter("need = 0").isEmpty():
        return positive.distinct()  # every need not be read
    only_not = need.filter("need = 0").alias("n")
    every = every.select("client_name", "scope", "passage_id").alias("e")
    rest = every.join(only_not, (F.col("e.client_name") == F.col("n.client_name")) & in_scope("n.repo_filter", "e.scope")).select("query_id", "clause", "passage_id")
    negative = rest.join(got.select("query_id", "clause", "passage_id"), ["query_id", "clause", "passage_id"], "left_anti").select("query_id", "passage_id")
    return positive.unionByName(negative).distinct()


def cover_density(at: list[tuple[int, float, list[tuple[int, int, int, int]]]], clauses: dict[int, set[int]]) -> float:
    """Rank of one passage: over each minimal span of the hits (pos, weight, [(clause, item, offset, length)]) that holds all items of a clause, hits / sum of 1/weight, over 1 + the span's other words."""

    runs: dict[tuple[int, int, int], int] = {}  # offsets in the window of each place of each item
    whole: dict[tuple[int, int], int] = {}  # whole places of each item
    met = dict.fromkeys(clauses, 0)  # items of each clause that are there

    def count(i: int, step: int) -> None:
        pos, _, roles = at[i]
        for clause, item, offset, length in set(roles):
            run, own = (clause, item, pos - offset), (clause, item)
            was = runs.get(run, 0)
            runs[run] = was + step
            if max(was, was + step) == length:
                before = whole.get(own, 0)
                whole[own] = before + step
                if clause in met and item in clauses[clause] and 0 in (before, before + step):
                    met[clause] += step

    satisfied = lambda: any(met[c] == len(need) for c, need in clauses.items() if need)
    total, lo = 0.0, 0
    for end in range(len(at)):
        count(end, 1)
        first = lo
        while satisfied():
            count(lo, -1)
            lo += 1
        if lo > first:
            first, matched = lo - 1, end - lo + 2
            noise = (at[end][0] - at[first][0]) - (matched - 1)
            weight = sum(1 / at[i][1] for i in range(first, end + 1))
            total += (matched / weight) / (1 + max(0, noise))
    return float(np.float32(total))


def ranked(found: DataFrame, terms: DataFrame, every: DataFrame) -> DataFrame:
    """query_id, passage_id, rank (float) of all matching passages of every (client_name, scope, passage_id), from the hits found of terms. Queries whose clauses have one term each are a native sum of weights; the helper sees the hits of one matched passage at a time for the others."""
    matched = stage_table(matches(every, terms, found), "matched")  # read for both ranks and the result
    value = F.lit(None).cast("double")
    for label, w in WEIGHTS.items():
        value = F.when(F.col("weight") == label, F.lit(w)).otherwise(value)
    shape = terms.filter("NOT negated").groupBy("query_id", "clause").agg(F.count("*").alias("n")).groupBy("query_id").agg((F.max("n") == 1).alias("plain"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    use = found.filter("NOT negated").withColumn("w", value).join(F.broadcast(shape) if few else shape, "query_id")
    of = lambda rows: rows.join(matched, ["query_id", "passage_id"], "left_semi")
    # Equal places of a passage meet before anything is shuffled.
    plain = of(use.filter("plain").select("query_id", "passage_id", "pos", "w").distinct()).groupBy("query_id", "passage_id").agg(F.sum("w").cast("float").alias("rank"))
    need = terms.filter("NOT negated").select("query_id", "clause", "item").distinct().groupBy("query_id").agg(F.collect_list(F.struct("clause", "item")).alias("need"))
    grouped = of(use.filter("NOT plain")).groupBy("query_id", "passage_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "clause", "item", "offset", "length"))).alias("hits"))

    def rank(hit: pd.Series, need: pd.Series) -> pd.Series:
        out = []
        for h, n in zip(hit, need, strict=True):
            clauses: dict[int, set[int]] = {}
            for x in n:
                clauses.setdefault(x["clause"], set()).add(x["item"])
            by_pos: dict[int, tuple[float, list]] = {}
            for x in h:
                by_pos.setdefault(x["pos"], (x["w"], []))[1].append((x["clause"], x["item"], x["offset"], x["length"]))
            out.append(cover_density([(p, w, roles) for p, (w, roles) in sorted(by_pos.items())], clauses))
        return pd.Series(out, dtype="float32")

    covers = grouped.join(need, "query_id").select("query_id", "passage_id", F.pandas_udf(rank, "float")("hits", "need").alias("rank"))
    scored = plain.unionByName(covers)
    return matched.join(scored, ["query_id", "passage_id"], "left").select("query_id", "passage_id", F.coalesce("rank", F.lit(0.0).cast("float")).alias("rank"))


def top_candidates(scored: DataFrame, queries: DataFrame, candidates: int, default_top_k: int = 5) -> DataFrame:
    """query_id, passage_id, r: the first max(candidates, top_k) by rank, then id."""
    n = F.greatest(F.lit(candidates), F.coalesce(F.col("top_k"), F.lit(default_top_k)))
    w = Window.partitionBy("query_id").orderBy(F.col("rank").desc(), "passage_id")
    return scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 1000).join(queries.select("query_id", n.alias("n")), "query_id").filter("r <= n").select("query_id", "passage_id", "r")
