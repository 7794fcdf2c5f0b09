"""Languages of a text as a mixture.

Each language has a smoothed distribution over hashed byte trigrams of lower-cased
letters. A document is a mixture of languages: expectation maximisation estimates
the proportions, sets of the likeliest languages are compared by log-likelihood
less a penalty for each further language, and the answer is the largest
proportion within the best set. A language joins a set only if it accounts for a
trigram of the text or more, so that a set's growth is bounded by the text.

The model holds every label. It is sparse: 8 bytes for each pair of a label and a
trigram bucket that was seen, as all unseen buckets of a label share one
probability. So what is broadcast grows with the labels (at most 512 KB for each,
if it fills all buckets), and not with the documents.

Null texts and texts without a letter are "und" with score 0. Rows without a lang
take no part in training; with none to train on all texts are "und". Texts are
judged one by one, so repeated rows and ties change nothing (equal proportions:
the language that sorts first); an empty table gives an empty result. Texts are
read whole; texts are worked on together up to CELLS numbers, and a long one
alone takes its distinct trigrams times the labels that know them. Columns of any
names stay; see predict for those that clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from passagemill.llm.common import bound_batches, free_name, stage_table

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Additive smoothing, EM rounds over all languages and over a set, weight of the penalty.
SMOOTHING, ROUNDS, SET_ROUNDS, PENALTY = 0.1, 6, 4, 1.0
#: Numbers that are worked on together, and counts that a training task holds before it sends them on.
CELLS, HELD = 1 << 21, 1 << 20
FOLDS, UNKNOWN = 5, "und"

#: ASCII other than letters becomes a blank; bytes of other scripts stay.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Model(NamedTuple):
    """Probabilities of buckets by language: unseen[l] for each bucket, and seen[e] more in the buckets of its entries. Bucket b has the entries from starts[b] to starts[b + 1], of the languages lang[e]."""

    starts: np.ndarray
    lang: np.ndarray
    seen: np.ndarray
    unseen: np.ndarray


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a whole text, or None without a letter."""
    low = (text or "").lower()
    if not any(map(str.isalpha, low)):
        return None
    raw = b" " + low.encode("utf-8", "surrogatepass").translate(_LETTERS) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[code != 0x202020]
    bucket = (code * np.uint32(2654435769)) >> np.uint32(32 - BUCKET_BITS)
    return np.unique(bucket, return_counts=True)


def make_model(lang: np.ndarray, bucket: np.ndarray, n: np.ndarray, languages: int) -> Model:
    """The model of counts n by language (a number) and bucket, each pair once."""
    order = np.argsort(bucket, kind="stable")
    lang, bucket, n = lang[order].astype(np.int32), bucket[order], n[order]
    whole = np.bincount(lang, weights=n, minlength=languages) + SMOOTHING * BUCKETS
    starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])
    return Model(starts, lang, (n / whole[lang]).astype(np.float32), SMOOTHING / whole)


def train(docs: DataFrame) -> tuple[list[str], Model]:
    """(languages, model) from docs (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        codes, counts, held = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            lang = pa.DictionaryArray.from_arrays(pa.array(code >> BUCKET_BITS, pa.int32()), pa.array(list(names), pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([lang, pa.array(code & (BUCKETS - 1), pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (found := trigram_counts(text)) is None:
                    continue
                codes.append((names.setdefault(lang, len(names)) << BUCKET_BITS) | found[0].astype(np.int64))
                counts.append(found[1])
                held += len(found[0])
                if held > HELD:
                    code, n = summed()
                    if len(code) > HELD // 2:
                        yield rows(code, n)
                        names, codes, counts, held = {}, [], [], 0
                    else:
                        codes, counts, held = [code], [n], len(code)
        if codes:
            yield rows(*summed())

    bound_batches(docs.sparkSession)
    known = docs.filter("lang IS NOT NULL").select("text", "lang")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stage_table(counts, "trigram-counts")
    table = counts.toArrow()  # labels x BUCKETS rows at most
    names = table["lang"].combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    own = names.dictionary.to_pylist()
    langs = sorted(own)
    place = {lang: i for i, lang in enumerate(langs)}
    number = np.array([place[lang] for lang in own], np.int64)[names.indices.to_numpy()] if own else np.empty(0, np.int64)
    return langs, make_model(number, table["bucket"].to_numpy(), table["n"].to_numpy(), len(langs))


class _Texts:
    """Some texts' trigrams (terms), and the model's entries for them."""

    def __init__(self, some: list[tuple[np.ndarray, np.ndarray]], model: Model):
        sizes = np.array([len(f[0]) for f in some])
        self.n, self.langs, self.unseen = len(some), len(model.unseen), model.unseen
        self.starts = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(self.n), sizes)
        self.c = np.concatenate([f[1] for f in some]).astype(np.float64)
        self.total = np.add.reduceat(self.c, self.starts)
        bucket = np.concatenate([f[0] for f in some])
        first, many = model.starts[bucket], model.starts[bucket + 1] - model.starts[bucket]
        self.term = np.repeat(np.arange(len(bucket), dtype=np.int32), many)
        entry = np.arange(len(self.term)) + np.repeat(first - (np.cumsum(many) - many), many)
        self.cell = self.doc[self.term] * self.langs + model.lang[entry]
        self.seen = model.seen[entry].astype(np.float64)

    def by_cell(self, values: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.bincount(cell, weights=values, minlength=self.n * self.langs).reshape(self.n, self.langs)

    def single(self) -> np.ndarray:
        """The log-likelihood of each language alone."""
        gain = np.log1p(self.seen / self.unseen[self.cell % self.langs])
        return self.total[:, None] * np.log(self.unseen) + self.by_cell(self.c[self.term] * gain, self.cell)

    def mixed(self, theta: np.ndarray, term: np.ndarray, cell: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The probability of each term under its text's mixture."""
        return (theta @ self.unseen)[self.doc] + np.bincount(term, weights=theta.ravel()[cell] * seen, minlength=len(self.c))

    def estimate(self, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """theta after some rounds of EM, and its log-likelihood. Languages with proportion 0 stay out; texts without any stay at 0."""
        use = theta.ravel()[self.cell] > 0
        own = (self.term, self.cell, self.seen) if use.all() else (self.term[use], self.cell[use], self.seen[use])
        live = (theta > 0).any(axis=1)[self.doc]
        for _ in range(rounds):
            w = np.divide(self.c, self.mixed(theta, *own), out=np.zeros(len(self.c)), where=live)
            part = np.add.reduceat(w, self.starts)[:, None] * self.unseen + self.by_cell(w[own[0]] * own[2], own[1])
            theta = theta * part / self.total[:, None]
        logs = np.log(self.mixed(theta, *own), out=np.zeros(len(self.c)), where=live)
        return theta, np.add.reduceat(self.c * logs, self.starts)


def infer(texts: list[str | None], model: Model) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(languages, proportions) of the chosen set of each text, in order of language; None for a text without a letter."""
    found = [trigram_counts(t) for t in texts]
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
    if not len(model.unseen):
        return out
    at = [i for i, f in enumerate(found) if f is not None and len(f[0])]
    many = np.diff(model.starts)
    sizes = np.array([len(model.unseen) + int(many[found[i][0]].sum()) for i in at], np.int64)
    run = (np.cumsum(sizes) - sizes) // CELLS
    for r in np.unique(run):
        rows = [at[i] for i in np.flatnonzero(run == r)]
        for i, share in zip(rows, _infer_some([found[i] for i in rows], model), strict=True):
            langs = np.flatnonzero(share)
            out[i] = langs, share[langs]
    return out


def _infer_some(some: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    """The proportions of texts that are given as trigram counts. A set of languages grows while the penalised likelihood does."""
    t = _Texts(some, model)
    single = t.single()
    best, each = single.argmax(axis=1), np.arange(t.n)
    theta, _ = t.estimate(np.full((t.n, t.langs), 1 / t.langs), ROUNDS)
    order = np.where(theta * t.total[:, None] >= 1, theta, 0)
    order[each, best] += 1  # the likeliest single language leads every set
    rank = np.argsort(np.argsort(-order, axis=1, kind="stable"), axis=1, kind="stable")
    may = (order > 0).sum(axis=1)
    chosen = np.zeros_like(theta)
    chosen[each, best] = 1
    score, grows = single.max(axis=1), may > 1
    k = 2
    while grows.any():
        start = np.where(grows[:, None] & (rank < k), np.maximum(theta, 1e-3), 0)
        start /= np.maximum(start.sum(axis=1, keepdims=True), 1e-30)
        got, like = t.estimate(start, SET_ROUNDS)
        like -= PENALTY * (k - 1) * np.log(np.maximum(t.total, 2))
        better = grows & (like > score)
        chosen[better], score[better] = got[better], like[better]
        # The second language may help only together with the third, so that no set ends at one.
        grows &= (better | (k == 2)) & (may > k)
        k += 1
    return chosen / chosen.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, langs: list[str], model: Model) -> DataFrame:
    """docs (which have a text) with lang_pred, score and lang_set (the chosen languages with their proportions). Where docs has such columns, underscores are put before the new ones' names."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = [free_name(docs.columns, c) for c in ("lang_pred", "score", "lang_set")]
    held = spark.sparkContext.broadcast(tuple(model))  # 8 bytes for each seen pair of label and bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            pred, score, sets = [], [], []
            for found in infer(b.column(b.schema.get_field_index("text")).to_pylist(), own):
                if found is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    sets.append("")
                    continue
                top = int(found[1].argmax())
                pred.append(langs[found[0][top]])
                score.append(min(1.0, float(found[1][top])))
                sets.append(",".join(f"{langs[i]}:{x:.3f}" for i, x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=[*b.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType()).add(names[2], StringType())
    return docs.mapInArrow(run, schema)


def op6_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    d = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    langs, model = train(d.filter(~F.col("held_out")).select("text", "lang"))
    return predict(d.select("doc_id", "held_out", "text"), langs, model).select("doc_id", "held_out", "lang_pred", "score", "lang_set")
