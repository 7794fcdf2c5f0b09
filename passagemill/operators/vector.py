"""The vector arm: exact nearest passages, an approximate variant, and its recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.vectors import cosine_distance_of, dot
from passagemill.operators import ann
from passagemill.operators.fulltext import in_scope

#: Bytes of query vectors that are broadcast to the matrix product at a time, and queries that are multiplied at a time.
BROADCAST_BYTES, QUERIES_AT_ONCE = 64 << 20, 256


def eligible(passages: DataFrame) -> DataFrame:
    return passages.filter(~F.col("embedding_degenerate"))


def _cut(distances: DataFrame, queries: DataFrame, candidates: int, default_top_k: int) -> DataFrame:
    n = F.greatest(F.lit(candidates), F.coalesce(F.col("top_k"), F.lit(default_top_k)))
    w = Window.partitionBy("query_id").orderBy("distance", "passage_id")
    return distances.withColumn("r", F.row_number().over(w)).filter("r <= 1000").join(queries.select("query_id", n.alias("n")), "query_id").filter("r <= n").select("query_id", "passage_id", "distance", "r")


def query_blocks(rows: DataFrame, block_bytes: int = BROADCAST_BYTES) -> list[DataFrame]:
    """rows (with query_id and query_vector) in parts of about block_bytes of vectors."""
    width, many = rows.select(F.coalesce(F.max(F.size("query_vector")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-width * many * 8 // block_bytes))
    return [rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]


def tenant_distances(passages: DataFrame, queries: DataFrame, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, passage_id, scope, repo_filter and distance of all passages of each query's tenant, native. A tenant's passages are dealt out by id and the queries are broadcast in blocks, so that no tenant is in one task; norms are reckoned once for each vector."""
    vector = lambda c: F.col(c).cast("array<double>")
    n = max(int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")), passages.sparkSession.sparkContext.defaultParallelism)
    # By number: what is few bytes is much work here, and would be put into few tasks.
    p = passages.select("passage_id", "client_name", "scope", vector("embedding").alias("e")).repartition(n, F.xxhash64("passage_id")).withColumn("e_norm", F.sqrt(dot(F.col("e"), F.col("e"))))
    q = queries.filter("query_vector IS NOT NULL").select("query_id", "client_name", "repo_filter", vector("query_vector").alias("query_vector"))
    found = None
    for block in query_blocks(q, block_bytes):
        v = block.withColumn("v_norm", F.sqrt(dot(F.col("query_vector"), F.col("query_vector"))))
        part = p.join(F.broadcast(v), "client_name").select("query_id", "passage_id", "scope", "repo_filter", cosine_distance_of(F.col("e"), F.col("query_vector"), F.col("e_norm"), F.col("v_norm")).alias("distance"))
        found = part if found is None else found.unionByName(part)
    return found


def nearest_native(passages: DataFrame, queries: DataFrame, candidates: int, default_top_k: int = 5, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, passage_id, distance, r by a join on the tenant and native distances."""
    d = tenant_distances(eligible(passages), queries, block_bytes).filter(in_scope("repo_filter", "scope")).filter(~F.isnan("distance"))
    return _cut(d.select("query_id", "passage_id", "distance"), queries, candidates, default_top_k)


def nearest(passages: DataFrame, queries: DataFrame, candidates: int, default_top_k: int = 5, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, passage_id, distance, r by a matrix product for each batch of passages: the queries go to the passages, in blocks of block_bytes, and embeddings are never shuffled. A batch gives its best of each query."""
    rows = queries.filter("query_vector IS NOT NULL").select("query_id", "client_name", "repo_filter", "top_k", "query_vector")
    narrow = eligible(passages).select("passage_id", "client_name", "scope", "embedding")
    found = None
    for block in query_blocks(rows, block_bytes):
        held = block.collect()  # about block_bytes
        part = narrow.mapInPandas(_best(passages.sparkSession.sparkContext.broadcast(_by_tenant(held, candidates, default_top_k))), "query_id long, passage_id long, distance double")
        found = part if found is None else found.unionByName(part)
    return _cut(found, queries, candidates, default_top_k)


def _by_tenant(rows: list, candidates: int, default_top_k: int) -> dict[str, tuple]:
    """By tenant, its queries' ids, unit vectors, scopes and wanted numbers; zero vectors have no nearest."""
    out: dict[str, list] = {}
    for r in rows:
        v = np.array(r["query_vector"], np.float64)
        if (norm := np.sqrt((v * v).sum())) > 0:
            out.setdefault(r["client_name"], []).append((r["query_id"], v / norm, r["repo_filter"] or "", max(candidates, r["top_k"] or default_top_k)))
    return {client: ([x[0] for x in g], np.array([x[1] for x in g]), [x[2] for x in g], [x[3] for x in g]) for client, g in out.items()}


def _best(table):
    """A function over batches of passages: the nearest in each batch for each query of the broadcast table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for client, part in b.groupby("client_name"):
                if client not in table.value:
                    continue
                m = np.array(part["embedding"].tolist(), np.float64)
                norms = np.sqrt((m * m).sum(axis=1))
                some = norms > 0
                m, ids, scopes = m[some] / norms[some, None], part["passage_id"].to_numpy()[some], part["scope"].to_numpy()[some]
                names, q, wanted, ns = table.value[client]
                for at in range(0, len(names), QUERIES_AT_ONCE):
                    d = 1 - np.clip(q[at : at + QUERIES_AT_ONCE] @ m.T, -1, 1)
                    for k, row in enumerate(d, at):
                        here = np.flatnonzero(scopes == wanted[k]) if wanted[k] else np.arange(len(ids))
                        best = here[np.lexsort((ids[here], row[here]))[: ns[k]]]
                        out.append(pd.DataFrame({"query_id": names[k], "passage_id": ids[best], "distance": row[best]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "passage_id": [], "distance": []})

    return run


def nearest_approximate(passages: DataFrame, queries: DataFrame, candidates: int, width: int, default_top_k: int = 5, reach: float = 1.0, index: ann.Index | None = None) -> DataFrame:
    """query_id, passage_id, distance, r by inverted lists of codes (index, else made here) and full vectors of what they leave over; see operators.ann."""
    kept, _ = ann.candidates_of(index or ann.build_index(passages, width), queries, candidates, default_top_k, reach)
    return _cut(ann.compare(kept, passages, queries), queries, candidates, default_top_k)


def recall_report(passages: DataFrame, queries: DataFrame, candidates: int, width: int, reach: float = 1.0) -> DataFrame:
    """client_name, queries, recall, starved, and the shares of the tenant's passages whose codes were looked at (scanned) and whose vectors were compared, of the approximate search against the exact one."""
    kept, work = ann.candidates_of(ann.build_index(passages, width), queries, candidates, reach=reach)
    found = recall(_cut(ann.compare(kept, passages, queries), queries, candidates, 5), nearest(passages, queries, candidates), queries)
    sizes = eligible(passages).groupBy("client_name").agg(F.count("*").alias("passages"))
    shares = work.join(queries.select("query_id", "client_name"), "query_id").join(sizes, "client_name").groupBy("client_name").agg(F.avg(F.col("seen") / F.col("passages")).alias("scanned"), F.avg(F.col("compared") / F.col("passages")).alias("compared"))
    return found.join(shares, "client_name")


def recall(approximate: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """client_name, queries, recall and starved (queries without a result) of approximate against exact."""
    hit = exact.join(approximate.select("query_id", "passage_id", F.lit(1).alias("hit")), ["query_id", "passage_id"], "left")
    each = hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"), F.sum(F.coalesce("hit", F.lit(0))).alias("got"))
    return each.join(queries.select("query_id", "client_name"), "query_id").groupBy("client_name").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.count_if(F.col("got") == 0).alias("starved"))
