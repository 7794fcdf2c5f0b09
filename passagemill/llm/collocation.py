r"""Phrases whose words stand together more often than chance: counting by tiles of frequency-ranked ids.

Per language, texts are cut into pieces at [.,;:!?\x0A-\x0D] and pieces into words
[^\x20\x09]+, A-Z in lower case. A phrase is 2 to `longest` words in a row in a piece.

The words that occur LEAST times or more get ids by falling frequency, and texts become
sequences of ids, with 0 for other words and between pieces. Pairs of neighbouring ids
are counted by tiles of TILE x TILE ids: as frequent words have low ids, the occurrences
crowd into few tiles. In a task, a tile with many of them is a dense array that
numpy's bincount adds to by address; the others are counted as sorted coordinates. The
tasks' counts are summed by Spark. Pairs that occur LEAST times or more are the frequent
phrases of two words; they get ids by their own frequency ranks, each place's pair of
ids becomes one id, and pairs of these (which overlap in a word) are the phrases of
three words; and so on. A phrase can't be frequent if its parts are not, so nothing is
lost.

Ids are ranks for the DICTIONARY most frequent words or phrases of a length, which are
sent to the tasks (two 64-bit numbers each). Any beyond these have their hash as id, are
found by a Bloom filter of bounded size (what it lets through by mistake is too rare to
pass the count) and are counted as sorted coordinates. So nothing sent grows with the
data, and no word is lost. Words and phrases are told apart by 64-bit hashes of language and words.

A null lang is `und`, a null text empty. Very long texts and words are kept whole, and repeated
rows count again. Ties of a phrase's cuts go to the shortest first part, ties of rank by
frequency, then phrase in byte order. Columns other than text and lang are not looked at,
whatever their names. An empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.llm.bytewords import Words, bloom, may_hold, parts, word_bytes, words_of
from passagemill.llm.common import bound_batches, mix64, stage_table

LEAST, LONGEST, FIRST = 100, 5, 2000
BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_BYTES = word_bytes(b" \t" + BREAKS)
_BREAK = ~word_bytes(BREAKS)
#: Ids of a length that are ranks; ids along a side of a tile; dense tiles that a task holds; coordinates that it holds; ids that are looked at at a time.
DICTIONARY, TILE, HELD_TILES, HELD_PAIRS, SLICE = 1 << 18, 256, 32, 1 << 19, 1 << 19
#: Ids from which a row of a sequence table ends at the next gap, and bytes of a row group. Parquet's writer looks at a page's size each 100 rows, and pages are (de)compressed whole outside the heap, so rows must be small.
ROW_IDS, GROUP_BYTES = 1 << 11, 4 << 20
#: Occurrences in a slice from which a tile is dense.
DENSE = TILE * TILE // 8
#: Bytes of a batch to tasks, and rows of a batch from them.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1 << 16
_SIGN = np.uint64(1 << 63)


def _keys(w: Words, lang: pa.Array) -> np.ndarray:
    """A hash of the language and the word, for each word."""
    coded = pc.fill_null(lang, "und").dictionary_encode()
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return mix64(w.hashes() ^ seeds[coded.indices.to_numpy()[w.row]])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n, its occurrences; word is null for the sum over all words of lang. Words are summed as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in parts(b, 0)):
            w = words_of(b.column(0), WORD_BYTES)
            if not len(w):
                continue
            lang = pc.fill_null(b.column(1), "und")
            _, first, n = np.unique(_keys(w, lang), return_index=True, return_counts=True)
            words = pa.array([w.data[a:z].tobytes() for a, z in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(w.row[first])), words, pa.array(n)], names=["lang", "word", "n"])
            all_of = w.counts()
            yield pa.RecordBatch.from_arrays([lang, pa.nulls(len(lang), pa.string()), pa.array(all_of)], names=["lang", "word", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Ids:
    """Ids of keys: ranks from 1 of those held, a negative number made of the key for others that the filter lets through, else 0."""

    keys: np.ndarray
    ranks: np.ndarray
    rest: np.ndarray | None

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = np.where(self.keys[at] == keys, self.ranks[at], 0)
        if self.rest is not None:
            more = np.flatnonzero((out == 0) & may_hold(self.rest, keys))
            out[more] = (keys[more] | _SIGN).view(np.int64)
        return out


def ids_of(phrases: DataFrame, n: int, most: int) -> Ids:
    """Ids of the n phrases (key, f), of which the `most` most frequent at most get ranks."""
    rest = None
    if n > most:
        upto, least = 0, None
        for f, c in phrases.groupBy("f").agg(F.count("*").alias("c")).orderBy(F.col("f").desc()).limit(most).toLocalIterator():
            upto += c
            if upto > most:
                break
            least = f
        cut = F.col("f") >= F.lit(least) if least is not None else F.lit(False)
        rest = bloom(phrases.filter(~cut), "key", n)
        phrases = phrases.filter(cut)
    held = phrases.select("key", "f").toArrow()  # at most `most` rows
    if not held.num_rows:
        return Ids(np.zeros(1, np.uint64), np.zeros(1, np.int64), rest)
    keys, f = held["key"].to_numpy().view(np.uint64), held["f"].to_numpy()
    ranks = np.empty(len(keys), np.int64)
    ranks[np.lexsort((keys, -f))] = np.arange(1, len(keys) + 1)
    order = np.argsort(keys)
    return Ids(keys[order], ranks[order], rest)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a.view(np.uint64)) ^ b.view(np.uint64))


def runs_only(seq: np.ndarray) -> np.ndarray:
    """seq without ids that have no neighbour, and with one 0 between runs."""
    some = seq != 0
    pair = np.zeros(len(seq) + 1, bool)
    pair[1:-1] = some[:-1] & some[1:]
    at = np.flatnonzero(pair[:-1] | pair[1:])
    return np.insert(seq[at], np.flatnonzero(np.diff(at) > 1) + 1, 0) if len(at) else seq[:0]


def _as_rows(seqs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """seqs as rows of about ROW_IDS ids, or of one longer run: they are cut between runs, where no neighbours are lost."""
    for s in seqs:
        s = runs_only(s)
        if len(s):
            gaps = np.flatnonzero(s == 0)
            cuts = np.unique(np.searchsorted(gaps, np.arange(ROW_IDS, len(s), ROW_IDS)))
            ends = [*gaps[cuts[cuts < len(gaps)]].tolist(), len(s)]
            rows = [s[a:z].tobytes() for a, z in zip([0, *(z + 1 for z in ends[:-1])], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["seq"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of each batch as one sequence, with a 0 between rows."""
    for b in batches:
        if b.num_rows:
            seq = b.column(0).cast(pa.large_binary())
            ends = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
            ids = np.frombuffer(seq.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64)
            yield np.insert(ids, (ends[1:-1] - ends[0]) // 8, 0)


def _stage_sequences(seqs: DataFrame, name: str) -> DataFrame:
    return stage_table(seqs, name, {"parquet.block.size": str(GROUP_BYTES)})


def _slices(seqs: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same neighbours in slices, each with the first id of the next."""
    for s in seqs:
        for at in range(0, len(s), SLICE):
            yield s[at : at + SLICE + 1]


def word_sequences(docs: DataFrame, ids) -> DataFrame:
    """seq: sequences of word ids, as bytes; ids: a broadcast of Ids."""

    def seqs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in (p for b in batches for p in parts(b, 0)):
            w = words_of(b.column(0), WORD_BYTES)
            if not len(w):
                continue
            piece = np.searchsorted(np.flatnonzero(_BREAK[w.data]), w.start)
            new = np.cumsum((np.diff(piece) != 0) | (np.diff(w.row) != 0))
            out = np.zeros(len(w) + (int(new[-1]) if len(new) else 0), np.int64)
            out[np.arange(len(w)) + np.concatenate(([0], new)).astype(np.int64)] = ids.value.of(_keys(w, b.column(1)))
            yield out

    return docs.select("text", "lang").mapInArrow(lambda b: _as_rows(seqs(b)), "seq binary")


def phrase_sequences(seqs: DataFrame, ids) -> DataFrame:
    """seqs with each place's pair of neighbours as one id."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for s in _sequences(batches):
            a, b = s[:-1], s[1:]
            yield np.where((a != 0) & (b != 0), ids.value.of(pair_keys(a, b)), 0)

    return seqs.mapInArrow(lambda b: _as_rows(paired(b)), "seq binary")


def pair_counts(seqs: DataFrame) -> DataFrame:
    """a, b, f: how often neighbours a, b occur in seqs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        codes, counts, held = [], [], 0

        def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH_ROWS]) for x in (a, b, n)], names=["a", "b", "f"])

        def dense() -> Iterator[pa.RecordBatch]:
            for (ta, tb), cells in tiles.items():
                at = np.flatnonzero(cells)
                yield from out(at // TILE + ta * TILE + 1, at % TILE + tb * TILE + 1, cells[at])
            tiles.clear()

        def sparse() -> Iterator[pa.RecordBatch]:
            code, n = np.concatenate(codes), np.concatenate(counts)
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            code, n = code[first], np.add.reduceat(n[order], first)
            return out(code >> 31, code & 0x7FFFFFFF, n)

        for s in _slices(_sequences(batches)):
            a, b = s[:-1], s[1:]
            both = np.flatnonzero((a > 0) & (b > 0))
            far = np.flatnonzero((a != 0) & (b != 0) & ((a < 0) | (b < 0)))
            if len(far):
                pairs, n = np.unique(np.stack([a[far], b[far]], 1), axis=0, return_counts=True)
                yield from out(pairs[:, 0].copy(), pairs[:, 1].copy(), n)
            if not len(both):
                continue
            a, b = a[both] - 1, b[both] - 1
            side = int(b.max()) // TILE + 1
            tile = (a // TILE) * side + b // TILE
            for t in np.flatnonzero(np.bincount(tile) >= DENSE):
                at = tile == t
                key = (int(t) // side, int(t) % side)
                if key not in tiles and len(tiles) >= HELD_TILES:
                    yield from dense()
                cells = np.bincount((a[at] % TILE) * TILE + b[at] % TILE, minlength=TILE * TILE)
                tiles[key] = tiles[key] + cells if key in tiles else cells
                a, b, tile = a[~at], b[~at], tile[~at]
            code, n = np.unique(((a + 1) << 31) | (b + 1), return_counts=True)
            codes.append(code)
            counts.append(n)
            held += len(code)
            if held > HELD_PAIRS:
                yield from sparse()
                codes, counts, held = [], [], 0
        if held:
            yield from sparse()
        yield from dense()

    return seqs.mapInArrow(run, "a long, b long, f long").groupBy("a", "b").agg(F.sum("f").alias("f"))


def _with_ids(phrases: DataFrame, ids) -> DataFrame:
    """phrases (key, ...) with their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("id", pa.array(ids.value.of(b.column("key").to_numpy().view(np.uint64))))

    return phrases.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in phrases.dtypes) + ", id long")


def _word_keyed(words: DataFrame) -> DataFrame:
    """words (lang, word, f) with key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("key", pa.array(_keys(words_of(b.column("word"), WORD_BYTES), b.column("lang")).view(np.int64)))

    return words.mapInArrow(run, "lang string, word string, f long, key long")


def _pair_keyed(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("key", pa.array(pair_keys(b.column("a").to_numpy(), b.column("b").to_numpy()).view(np.int64)))

    return pairs.select("a", "b", "f").mapInArrow(run, "a long, b long, f long, key long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, dictionary: int = DICTIONARY) -> tuple[DataFrame, list[DataFrame]]:
    """(totals, levels): lang and n, the words of each lang; for 2, 3, ... words the phrases that occur least times or more: id, lang, phrase, f, a and b (ids of the phrases without the last and first word), pre and suf (frequencies of its first and last 1, 2, ... words)."""
    spark = docs.sparkSession
    bound_batches(spark, BATCH_BYTES)
    share = spark.sparkContext.broadcast
    counts = stage_table(word_counts(docs).filter((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    totals = counts.filter("word IS NULL").select("lang", "n")
    words = stage_table(_word_keyed(counts.filter("word IS NOT NULL").filter(F.col("n") >= least).select("lang", "word", F.col("n").alias("f"))), "phrase-keys")
    n = words.count()
    if not n:
        return totals, []
    ids = share(ids_of(words, n, dictionary))
    none = F.array().cast("array<long>")
    level = stage_table(_with_ids(words, ids).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("pre"), none.alias("suf")), "phrases-1")
    seqs = _stage_sequences(word_sequences(docs, ids), "phrase-sequences")
    levels: list[DataFrame] = []
    for width in range(2, longest + 1):
        pairs = stage_table(_pair_keyed(pair_counts(seqs).filter(F.col("f") >= least)), f"phrase-pairs-{width}")
        n = pairs.count()
        if not n:
            break
        ids = share(ids_of(pairs, n, dictionary))
        left = level.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), F.concat("pre", F.array("f")).alias("pre"))
        right = level.select(F.col("id").alias("b"), "last", F.concat("suf", F.array("f")).alias("suf"))
        both = _with_ids(pairs, ids).join(left, "a").join(right, "b")
        level = stage_table(both.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "a", "b", "pre", "suf"), f"phrases-{width}")
        levels.append(level)
        if width < longest:
            seqs = _stage_sequences(phrase_sequences(seqs, ids), f"phrase-sequences-{width}")
    return totals, levels


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, dictionary: int = DICTIONARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first phrases. A phrase that is always part of a longer one is left out."""
    totals, levels = frequent_phrases(docs, least, longest, dictionary)
    if not levels:
        return docs.sparkSession.createDataFrame([], RESULT)
    kept = []
    for i, level in enumerate(levels):
        if i + 1 < len(levels):
            # A phrase in a longer one of its frequency is in one of one word more of it.
            over = levels[i + 1].select(F.explode(F.array("a", "b")).alias("id"), "f").distinct()
            level = level.join(over, ["id", "f"], "left_anti")
        kept.append(level.select("lang", "phrase", F.col("f").alias("a"), "pre", "suf"))
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    every = every.join(totals, "lang")
    # Products are exact decimals: factors below 10^18.
    score = "CAST(1000 * a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0)) DIV (CAST(pre[k - 1] AS DECIMAL(18,0)) * CAST(suf[size(suf) - k] AS DECIMAL(18,0)))"
    cuts = F.expr(f"transform(sequence(1, size(pre)), k -> struct({score} AS score, k AS k, pre[k - 1] AS l, suf[size(suf) - k] AS r))")
    scored = every.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= first)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS b FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[b:b + k - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
o AS (SELECT DISTINCT c.lang, array_to_string(w[x:x + j - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k - j + 2)) AS x FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) c),
m AS (SELECT c.* FROM c WHERE NOT EXISTS (FROM o WHERE o.lang = c.lang AND o.phrase = c.phrase AND o.a >= c.a)),
u AS (SELECT *, unnest(range(1, k)) AS h FROM m),
x AS (
  SELECT u.lang, u.phrase, u.a, u.h, l.a AS l, r.a AS r, t.n, ((1000::HUGEINT * u.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM u JOIN t ON t.lang = u.lang JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:h], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[h + 1:], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y QUALIFY rank <= 2000
"""
