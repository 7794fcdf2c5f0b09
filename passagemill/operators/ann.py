"""The approximate vector arm: inverted lists of compact codes, and exact re-ranking.

A tenant's unit vectors are dealt to cells by spherical k-means; their number grows with
the square root of the tenant. The k-means is fitted on a bounded sample of each tenant
(SAMPLE_BYTES of vectors); every passage is indexed. A passage is kept as one byte for
each dimension of what its cell's centroid leaves over, with a step and the norm of what
the bytes leave over in turn. The lists are range-sorted by (tenant, cell), so that
readers skip other tenants' and cells' row groups.

For a query, a passage's similarity is known from its code up to the error kept with it.
So a task keeps, for each query, the n-th best of the similarities that are certain, and
passes over cells whose centroid and radius cannot reach it and passages whose code
cannot. What is left of all tasks is cut in the same way and compared with the full
vectors. With reach 1 nothing is lost: results are those of the exact search. A smaller
reach takes cells for smaller than they are and passes over more of them.

Tenant and scope are looked at before anything is cut, so no query is starved. Queries
are sent in blocks of bounded size, as are the centroids; embeddings are read for
the passages that are left, and never shuffled unless these are too many to send.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.vectors import cosine_distance
from passagemill.session import stage_table

#: Bytes of vectors of a tenant's sample; cells of a tenant at most; rounds of k-means; bytes of centroids or queries that are sent at a time; rows that are sent.
SAMPLE_BYTES, MOST_CELLS, ROUNDS, SENT_BYTES, SENT_ROWS = 16 << 20, 4096, 8, 32 << 20, 200_000
LISTS = "client_name string, cell int, passage_id long, scope string, code binary, step double, error double, far double"


@dataclass(frozen=True)
class Index:
    """cells: client_name, cell, centroid, radius, passages. lists: the columns of LISTS."""

    cells: DataFrame
    lists: DataFrame
    width: int


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1)


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _sendable(rows: DataFrame) -> DataFrame:
    """rows, with the hint to send them if they are few."""
    return F.broadcast(rows) if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else rows


def fit_cells(passages: DataFrame, width: int, seed: int = 7) -> DataFrame:
    """client_name, cell and centroid, from a sample of each tenant's passages by a hash of their id."""
    most = max(1024, SAMPLE_BYTES // (4 * width))
    sizes = passages.groupBy("client_name").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("passage_id"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")) * (1 << 20)
    sample = passages.join(_sendable(sizes), "client_name").filter(share).select("client_name", "embedding", "n")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = _units(np.array(rows["embedding"].tolist(), np.float64))
        k = min(MOST_CELLS, int(np.ceil(np.sqrt(rows["n"].iloc[0]))), len(x))
        x = x[np.lexsort(x.T)]
        centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            own = np.concatenate([(x[a : a + 8192] @ centres.T).argmax(axis=1) for a in range(0, len(x), 8192)])
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres = np.where(np.bincount(own, minlength=k)[:, None] > 0, _units(sums), centres)
        return pd.DataFrame({"client_name": rows["client_name"].iloc[0], "cell": np.arange(k), "centroid": list(centres)})

    return sample.groupBy("client_name").applyInPandas(fit, "client_name string, cell int, centroid array<double>")


def _held_cells(cells: DataFrame, *more: str) -> dict[str, tuple[np.ndarray, ...]]:
    """By tenant, its centroids and more columns, in order of cell. cells: a block of bounded size."""
    t = cells.select("client_name", "cell", "centroid", *more).toArrow().to_pandas().sort_values(["client_name", "cell"])
    return {name: (np.array(g["centroid"].tolist(), np.float64), *(g[c].to_numpy() for c in more)) for name, g in t.groupby("client_name")}


def encode(passages: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """The lists' rows of passages (passage_id, client_name, scope, embedding) whose tenants have cells; new passages can be encoded by cells fitted before."""
    blocks = max(1, -(-cells.count() * width * 8 // SENT_BYTES))
    out = None
    for i in range(blocks):
        held = passages.sparkSession.sparkContext.broadcast(_held_cells(cells.filter(_block("client_name", blocks) == i)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                for client, rows in b.groupby("client_name"):
                    if client not in held.value:
                        continue
                    x = _units(np.array(rows["embedding"].tolist(), np.float64))
                    centres = held.value[client][0]
                    cell = (x @ centres.T).argmax(axis=1)
                    rest = x - centres[cell]
                    step = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                    code = np.rint(rest / step[:, None]).astype(np.int8)
                    error = np.sqrt(((rest - code * step[:, None]) ** 2).sum(axis=1)) + 1e-9
                    far = np.sqrt((rest * rest).sum(axis=1)) + 1e-9
                    yield pd.DataFrame({"client_name": client, "cell": cell, "passage_id": rows["passage_id"], "scope": rows["scope"], "code": [c.tobytes() for c in code], "step": step, "error": error, "far": far})

        part = passages.filter(_block("client_name", blocks) == i).select("passage_id", "client_name", "scope", "embedding").mapInPandas(run, LISTS)
        out = part if out is None else out.unionByName(part)
    return out


def build_index(passages: DataFrame, width: int) -> Index:
    """The index of passages (passage_id, client_name, scope, embedding, embedding_degenerate)."""
    own = passages.filter(~F.col("embedding_degenerate")).select("passage_id", "client_name", "scope", "embedding")
    fitted = stage_table(fit_cells(own, width), "cells")
    lists = stage_table(encode(own, fitted, width).repartitionByRange("client_name", "cell", "passage_id").sortWithinPartitions("client_name", "cell", "passage_id"), "lists")
    return _measured(fitted, lists, width)


def _measured(cells: DataFrame, lists: DataFrame, width: int) -> Index:
    sizes = lists.groupBy("client_name", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("passages"))
    every = cells.select("client_name", "cell", "centroid").join(sizes, ["client_name", "cell"], "left").fillna({"radius": 0.0, "passages": 0})  # a cell's number is its place among all
    return Index(stage_table(every, "cells"), lists, width)


def with_lists(index: Index, more: DataFrame) -> Index:
    """index with more rows of LISTS: passages that encode() has dealt to its cells."""
    return _measured(index.cells, stage_table(index.lists.unionByName(more).repartitionByRange("client_name", "cell", "passage_id").sortWithinPartitions("client_name", "cell", "passage_id"), "lists"), index.width)


@dataclass
class _Asked:
    """The queries of one tenant: unit vectors, scopes and how many passages are wanted, and the best certain similarities of each so far."""

    ids: np.ndarray
    q: np.ndarray
    scopes: np.ndarray
    n: np.ndarray

    def __post_init__(self) -> None:
        self.best = [np.empty(0) for _ in self.ids]
        self.least, self.seen = np.full(len(self.ids), -np.inf), np.zeros(len(self.ids), np.int64)

    def learn(self, i: int, low: np.ndarray) -> None:
        best = np.concatenate([self.best[i], low])
        n = self.n[i]
        if len(best) > n:
            best = np.partition(best, len(best) - n)[len(best) - n :]
        self.best[i] = best
        if len(best) == n:
            self.least[i] = best.min()


def _asked(rows: list, n_of) -> dict[str, _Asked]:
    out: dict[str, list] = {}
    for r in rows:
        v = np.array(r["query_vector"], np.float64)
        if (norm := np.sqrt((v * v).sum())) > 0:
            out.setdefault(r["client_name"], []).append((r["query_id"], v / norm, r["repo_filter"] or "", n_of(r)))
    return {c: _Asked(np.array([x[0] for x in g]), np.array([x[1] for x in g]), np.array([x[2] for x in g], object), np.array([x[3] for x in g])) for c, g in out.items()}


FOUND = "query_id long, passage_id long, low double, high double, seen long"


def _scan(lists: DataFrame, asked, held, width: int, reach: float) -> DataFrame:
    """Rows of FOUND: passages that can be among a query's best as far as a task knows; and, without a passage, how many codes it has looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {c: _Asked(a.ids, a.q, a.scopes, a.n) for c, a in asked.value.items()}
        for b in batches:
            clients, cells = b.column("client_name").to_numpy(zero_copy_only=False), b.column("cell").to_numpy()
            ids, step, error = (b.column(c).to_numpy() for c in ("passage_id", "step", "error"))
            scopes = b.column("scope").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(x.as_py() for x in b.column("code")), np.int8).reshape(-1, width)
            edges = np.flatnonzero(np.append(True, (clients[1:] != clients[:-1]) | (cells[1:] != cells[:-1])))
            out = []
            for a, z in zip(edges, [*edges[1:], len(ids)], strict=True):
                if (ask := mine.get(clients[a])) is None:
                    continue
                centres, radius = held.value[clients[a]]
                base = ask.q @ centres[cells[a]]
                live = np.flatnonzero(base + reach * radius[cells[a]] >= ask.least)
                if not len(live):
                    continue
                near = base[live, None] + (ask.q[live] @ codes[a:z].T.astype(np.float64)) * step[a:z]
                there = np.array([(scopes[a:z] == s) if s else np.ones(z - a, bool) for s in ask.scopes[live]])
                low, high = near - error[a:z], near + error[a:z]
                for k, i in enumerate(live):
                    ask.seen[i] += int(there[k].sum())
                    ask.learn(i, low[k][there[k]])
                which, row = np.nonzero(there & (high >= ask.least[live, None]))
                out.append((ask.ids[live[which]], ids[a:z][row], low[which, row], high[which, row]))
            if out:
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.int64())], names=["query_id", "passage_id", "low", "high", "seen"])
        for ask in mine.values():
            none = lambda t, n=len(ask.ids): pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(ask.ids), none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array(ask.seen)], names=["query_id", "passage_id", "low", "high", "seen"])

    return lists.mapInArrow(run, FOUND)


def candidates_of(index: Index, queries: DataFrame, candidates: int, default_top_k: int = 5, reach: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(kept, work): query_id, client_name, passage_id of the passages to compare; query_id, seen (codes looked at) and compared."""
    spark = queries.sparkSession
    wanted = F.greatest(F.lit(candidates), F.coalesce(F.col("top_k"), F.lit(default_top_k)))
    rows = queries.filter("query_vector IS NOT NULL").select("query_id", "client_name", "repo_filter", "query_vector", wanted.alias("n"))
    rows = stage_table(rows, "asked")
    tenants = _sendable(rows.select("client_name").distinct())
    cells = index.cells.join(tenants, "client_name", "left_semi")
    blocks = max(1, -(-max(rows.count(), cells.count()) * index.width * 8 // SENT_BYTES))
    found = None
    for i in range(blocks):
        # Both by tenant; a tenant of too many queries for one block comes again in several.
        own = rows.filter(_block("client_name", blocks) == i)
        parts = max(1, -(-own.count() * index.width * 8 // SENT_BYTES))
        held = spark.sparkContext.broadcast(_held_cells(cells.filter(_block("client_name", blocks) == i), "radius"))
        lists = index.lists.filter(F.col("client_name").isin(sorted(held.value))) if len(held.value) <= 100 else index.lists
        for j in range(parts):
            asked = spark.sparkContext.broadcast(_asked(own.filter(_block("query_id", parts) == j).collect(), lambda r: r["n"]))  # about SENT_BYTES
            part = _scan(lists, asked, held, index.width, reach)
            found = part if found is None else found.unionByName(part)
    found = stage_table(found, "found")
    w = Window.partitionBy("query_id")
    ranked = found.filter("passage_id IS NOT NULL").join(rows.select("query_id", "client_name", "n"), "query_id")
    ranked = ranked.withColumn("place", F.row_number().over(w.orderBy(F.col("low").desc(), "passage_id"))).withColumn("least", F.max(F.when(F.col("place") == F.col("n"), F.col("low"))).over(w))
    kept = stage_table(ranked.filter("least IS NULL OR high >= least").select("query_id", "client_name", "passage_id"), "kept")
    compared = kept.groupBy("query_id").agg(F.count("*").alias("compared"))
    work = found.filter("passage_id IS NULL").groupBy("query_id").agg(F.sum("seen").alias("seen")).join(compared, "query_id", "left").withColumn("compared", F.coalesce("compared", F.lit(0)))
    return kept, work


def compare(kept: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, passage_id and distance of kept, by full vectors."""
    few = kept.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    full = passages.select("client_name", "passage_id", "embedding").join(F.broadcast(kept) if few else kept, ["client_name", "passage_id"])
    both = full.join(queries.select("query_id", "query_vector"), "query_id")
    return both.select("query_id", "passage_id", cosine_distance(F.col("embedding"), F.col("query_vector")).alias("distance")).filter(~F.isnan("distance"))
