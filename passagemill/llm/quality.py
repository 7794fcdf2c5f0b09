"""Quality rules as weak supervision.

Each rule looks at one document and votes good, bad, or abstains. Expectation
maximisation over the counts of vote patterns estimates how each rule votes on
good and on bad documents; a document is kept when its posterior probability of
being good reaches a threshold, in place of having to pass every rule.

Words are runs of other than blanks (space, \\t, \\n, \\v, \\f, \\r). A null or
empty text has no words and fails the base test; an empty table gives an empty
result. Very long texts are counted whole. Rows are judged one by one, so repeated
rows and null or repeated doc_ids change nothing. Other columns are kept as a struct
of their own meanwhile, so their names clash with nothing.

The stop-word rule knows four languages. It abstains on a text without any of their
words, as that may be of another language.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import SMALL_BYTES, bound_batches, quoted, stage_table, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
#: Frequent words of the languages that the stop-word rule knows.
STOP_WORDS = frozenset(
    b"the of and to in is that it as with la le les des et que de el los las en un una der die das und ist nicht ein mit zu von".split()
)
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "stop_words", "capitals", "shouting")
GOOD, BAD, ABSTAIN = 1, 2, 0

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 10, 20, 5

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long, n_stop_words long, n_capital_words long, n_shouted long"
)


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts named in FEATURES for one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), 0, 0, 0, 0, 0, 0)
    joined = b"".join(words)
    chars = np.frombuffer(joined, np.uint8)
    word_chars = int(((chars & 0xC0) != 0x80).sum())
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    windows = window_hashes(word_hashes(words), REPEAT_WIDTH)
    repeated = 0
    if len(windows):
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[back] > 1)
        if len(twice):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + REPEAT_WIDTH, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    stop = sum(map(STOP_WORDS.__contains__, raw.lower().split()))
    capital = sum(map(bytes.isupper, words))
    shouted = raw.count(b"!!") + raw.count(b"??")
    return n, word_chars, symbols, lines, dup, repeated, stop, capital, shouted


def _feature_frame(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_features(t) for t in text], columns=[f.split()[0] for f in FEATURES.split(", ")])


def features(text: Column) -> Column:
    """A struct of FEATURES. Not marked deterministic, so that no filter on it is pushed below it and runs it twice."""
    return F.pandas_udf(_feature_frame, FEATURES).asNondeterministic()(text)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rule_votes() -> dict[str, Column]:
    """The vote of each rule over the feature columns."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(c("n_lines"), F.lit(1)).cast("double")
    mean = c("word_chars") / n
    return {
        "length": _vote(c("n_words").between(30, 100_000), c("n_words") < 5),
        "word_length": _vote(mean.between(3, 10), (mean < 2) | (mean > 15)),
        "symbols": _vote(c("n_symbols") / n < 0.02, c("n_symbols") / n > 0.15),
        "dup_lines": _vote((c("n_dup_lines") / lines < 0.1) & (c("n_lines") > 1), c("n_dup_lines") / lines > 0.3),
        "repeats": _vote(c("n_repeat_words") / n < 0.05, c("n_repeat_words") / n > 0.15),
        "stop_words": _vote(c("n_stop_words") / n > 0.1, (c("n_stop_words") > 0) & (c("n_stop_words") / n < 0.02) & (c("n_words") >= 20)),
        "capitals": _vote(c("n_capital_words") / n < 0.1, c("n_capital_words") / n > 0.4),
        "shouting": _vote(c("n_shouted") / n < 0.02, c("n_shouted") / n > 0.2),
    }


def estimate_accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, belief: float = 20.0) -> tuple[float, list[list[list[float]]]]:
    """EM over (votes, count) patterns: P(good) and, by rule, P(vote | bad) and P(vote | good).

    belief: pseudo-counts for the belief that a rule which votes is right 4 times in 5; it also fixes which class is which.
    """
    rules = len(RULES)
    hope = [[1 / 3, 2 / 15, 8 / 15], [1 / 3, 8 / 15, 2 / 15]]  # by class bad, good; by vote abstain, good, bad
    table = [[[x for x in row] for row in hope] for _ in range(rules)]
    prior = 0.8
    for _ in range(rounds):
        counts = [[[belief * x for x in row] for row in hope] for _ in range(rules)]
        good = [belief * 0.2, belief * 0.8]
        for votes, count in patterns:
            log = [math.log(1 - prior), math.log(prior)]
            for r, v in enumerate(votes):
                log[0] += math.log(table[r][0][v])
                log[1] += math.log(table[r][1][v])
            p = 1 / (1 + math.exp(min(700.0, log[0] - log[1])))
            good[0] += count * (1 - p)
            good[1] += count * p
            for r, v in enumerate(votes):
                counts[r][0][v] += count * (1 - p)
                counts[r][1][v] += count * p
        prior = min(0.999, max(0.001, good[1] / (good[0] + good[1])))
        table = [[[x / sum(row) for x in row] for row in rule] for rule in counts]
    return prior, table


def posterior(model: tuple[float, list[list[list[float]]]], votes: dict[str, Column]) -> Column:
    """Posterior probability of good, as a native expression over the votes."""
    prior, table = model
    log_odds = F.lit(math.log(prior / (1 - prior)))
    for r, name in enumerate(RULES):
        weights = [math.log(table[r][1][v] / table[r][0][v]) for v in (ABSTAIN, GOOD, BAD)]
        log_odds = log_odds + F.when(votes[name] == GOOD, weights[GOOD]).when(votes[name] == BAD, weights[BAD]).otherwise(weights[ABSTAIN])
    return 1 / (1 + F.exp(-log_odds))


FIELDS = [x.split()[0] for x in FEATURES.split(", ")]


def judge_quality(docs: DataFrame, threshold: float = 0.5, stage: tuple[str, ...] | None = None) -> DataFrame:
    """row (a struct of docs' columns, or of those in stage) and report: a struct of FEATURES, base_failed, quality (posterior) and kept.

    Features are counted once and staged; vote patterns (at most 3 ** 8 of them, whatever the input) are counted from there, and the model is applied to them. stage: the columns that are staged and returned, where not all are needed.
    """
    bound_batches(docs.sparkSession, SMALL_BYTES)
    votes = rule_votes()
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in (docs.columns if stage is None else stage)])
    counts = stage_table(docs.select(row.alias("row"), features(F.col("text")).alias("f")), "quality-features").select("row", "f.*")
    patterns = counts.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*RULES).count().collect()
    model = estimate_accuracies([(tuple(r[k] for k in RULES), r["count"]) for r in sorted(patterns)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counts.withColumn("quality", posterior(model, votes)).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return judged.select("row", F.struct(*FIELDS, "quality", "base_failed", "kept").alias("report"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return judge_quality(docs, threshold).filter("report.kept").select(*[F.col("row." + quoted(c)).alias(c) for c in docs.columns])


def op8_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = judge_quality(docs, stage=("doc_id",))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
    return q.select("row.doc_id", *[F.col(f"report.{c}").alias(c) for c in columns])
