import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from passagemill.llm import bytewords, collocation, decontaminate, prefix_trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Words of batches and the filter. ---------------------------------------------

ODD = ["", None, "a", " a  B\tc ", "été Ünd x", "x" * 5000 + " y", "a", "one.two,three", "\x00\x01", "🙂 🙂"]


@pytest.mark.parametrize("part", [slice(0, None), slice(3, 7)])
def test_words_of_a_batch(part):
    w = bytewords.words_of(pa.array(ODD)[part], bytewords.word_bytes(b" \t"))
    want = [(i, x) for i, t in enumerate(ODD[part]) for x in re.findall(r"[^ \t]+", (t or "").translate(LOWER))]
    assert [(int(r), w.data[a:z].tobytes().decode()) for r, a, z in zip(w.row, w.start, w.end, strict=True)] == want
    h = w.hashes()
    assert len(set(h.tolist())) == len({x for _, x in want})
    assert all((h[i] == h[j]) == (want[i][1] == want[j][1]) for i in range(len(h)) for j in range(len(h)))


def test_the_filter_loses_no_key(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS k")
    table = bytewords.bloom(keys, "k", 5000)
    held = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert bytewords.may_hold(table, held).all()
    assert bytewords.may_hold(table, np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64)).mean() < 0.1
    assert not bytewords.may_hold(bytewords.bloom(keys.limit(0), "k", 0), held).any()


# op11 ------------------------------------------------------------------------


def found_plainly(docs, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[a : a + width])].add("" if i is None else str(i))
    out = []
    for doc, t in docs:
        w, hit, got = words(t), set(), set()
        for g, ids in windows.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    got |= ids
        out.append((doc, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


PASSAGE = " ".join(f"w{i}" for i in range(14))
ITEMS = [(1, PASSAGE), (2, "short item here"), (10, "one"), (3, None), (4, " ,. "), (None, "nobody's own words"), (2, "a second text of item two"), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 and on"), (6, "e e e e e e e e e e e e")]
DOCS = [
    (1, PASSAGE), (2, "x " + PASSAGE.upper().replace(" ", "-") + " y"), (3, " ".join(f"w{i}" for i in range(9))), (4, None), (5, ""), (6, "Short, item; HERE"), (6, "Short, item; HERE"), (None, "one"),
    (7, "a short item is here, nobody s own words"), (8, "e " * 30), (9, ("filler words " * 4000) + PASSAGE + " tail"), (11, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w3 w4"), (12, "été one été"),
]


def test_decontamination_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bytewords, "PART", 40)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' AS h", "'x' AS RID").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    for width in (10, 3):
        got = [tuple(r) for r in decontaminate.decontaminate(docs, items, width).collect()]
        assert sorted(got, key=repr) == found_plainly(DOCS, ITEMS, width)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    clean = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r.contaminated for r in clean)


def test_decontamination_equals_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(decontaminate.op11_decontamination(spark, sf_dir), duck.execute(decontaminate.OP11_SQL)) == 200


# op12 ------------------------------------------------------------------------


def phrases_plainly(docs, least, longest, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[a : a + k]) for a in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p.count(" "): [] for p in counts}
        for p, a in counts.items():
            if " " in p and a >= least:
                kept[p.count(" ")].append((p, a))
        rows = []
        for k, found in kept.items():
            for p, a in found:
                if any(f" {p} " in f" {q} " and b >= a for j in kept if j > k for q, b in kept[j]):
                    continue
                w = p.split(" ")
                cuts = [(1000 * a * n[lang] // (counts[" ".join(w[:c])] * counts[" ".join(w[c:])]), c) for c in range(1, len(w))]
                score, c = min(cuts)
                rows.append((-score, -a, p.encode(), p, counts[" ".join(w[:c])], counts[" ".join(w[c:])]))
        out += [(lang, i + 1, p, -a, left, right, n[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def some_texts():
    rng = np.random.default_rng(3)
    common = ["new york city", "a b a b a b", "été à la"]
    words = [f"v{i}" for i in range(30)]
    texts = [(" ".join([*rng.choice(words, 40, p=np.arange(30, 0, -1) / 465), *rng.permutation(common)]).replace("v7", "v7,").replace("v9", "V9\tx"), ["en", None, "", "de"][i % 4]) for i in range(120)]
    return [*texts, (None, "en"), ("", "en"), ("a b " * 3000, "en"), *texts[:5], ("." * 50, "fr")]


@pytest.mark.parametrize("dictionary", [1 << 18, 40, 1])
def test_collocations_equal_brute_force(spark, dictionary, monkeypatch):
    monkeypatch.setattr(collocation, "DENSE", 20)
    monkeypatch.setattr(bytewords, "PART", 1000)
    texts = some_texts()
    docs = spark.createDataFrame(texts, "text string, lang string").selectExpr("*", "1 AS n", "'x' AS word").repartition(4)
    got = sorted(tuple(r) for r in collocation.collocations(docs, 8, 5, 25, dictionary).collect())
    assert got == phrases_plainly(texts, 8, 5, 25)
    assert len(got) > 40


def test_tiles_dense_and_sparse_count_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seq = np.concatenate([rng.integers(0, 1300, 20_000), rng.integers(0, 3, 20_000), -rng.integers(1, 5, 500)]).astype(np.int64)
    frame = spark.createDataFrame([(bytearray(s.tobytes()),) for s in np.array_split(seq, 7)], "seq binary")
    want = Counter()
    for s in np.array_split(seq, 7):
        want.update((int(a), int(b)) for a, b in zip(s[:-1], s[1:], strict=True) if a and b)
    for dense, tiles, held in ((1, 2, 100), (1 << 40, 2, 100), (1000, 48, 1 << 21)):
        monkeypatch.setattr(collocation, "DENSE", dense)
        monkeypatch.setattr(collocation, "HELD_TILES", tiles)
        monkeypatch.setattr(collocation, "HELD_PAIRS", held)
        monkeypatch.setattr(collocation, "SLICE", 1000)
        assert {(r.a, r.b): r.f for r in collocation.pair_counts(frame).collect()} == want


def test_runs_only():
    runs = lambda *x: collocation.runs_only(np.array(x, np.int64)).tolist()
    assert runs(0, 1, 0, 2, 3, 0, 0, 4, 0, 5, 6, 7, 0) == [2, 3, 0, 5, 6, 7]
    assert runs() == runs(1) == runs(0, 1, 0) == []


def test_rows_of_sequences_are_small_and_lose_no_neighbours(spark):
    rng = np.random.default_rng(7)
    short = np.where(rng.random(50_000) < 0.05, 0, rng.integers(1, 40, 50_000))
    short[::200] = 0
    long = rng.integers(1, 40, 9_000)
    pairs = lambda s: Counter((int(a), int(b)) for a, b in zip(s[:-1], s[1:], strict=True) if a and b)
    rows = [r for b in collocation._as_rows(iter([short])) for r in b.column(0).to_pylist()]
    assert max(map(len, rows)) <= 8 * (2048 + 200)
    frame = spark.createDataFrame([(bytearray(r),) for r in [*rows, *(r for b in collocation._as_rows(iter([long])) for r in b.column(0).to_pylist())]], "seq binary").coalesce(1)
    assert {(r.a, r.b): r.f for r in collocation.pair_counts(frame).collect()} == pairs(short) + pairs(long)


def test_collocations_over_many_rows_of_sequences(spark):
    rng = np.random.default_rng(11)
    texts = [(" ".join(x + "." * (i % 9 == 0 and j < 3) for i, x in enumerate(rng.choice([f"v{i}" for i in range(4)], 4000).tolist())), "en") for j in range(4)]
    got = sorted(tuple(r) for r in collocation.collocations(spark.createDataFrame(texts, "text string, lang string").coalesce(1), 8, 5, 5000).collect())
    assert got == phrases_plainly(texts, 8, 5, 5000)
    assert any(len(r[2].split()) > 3 for r in got)


def test_sequences_are_staged_in_small_row_groups(spark):
    seq = np.random.default_rng(13).integers(-(1 << 62), 1 << 62, 3 << 20)
    seq[::50] = 0
    frame = spark.createDataFrame([(bytearray(s.tobytes()),) for s in np.array_split(seq, 1024)], "seq binary").coalesce(1)
    staged = collocation._stage_sequences(frame, "test-sequences")
    (path,) = staged.inputFiles()
    found = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert found.num_row_groups > 1 and max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) < 8 << 20


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocation.collocations(empty).count() == 0
    assert collocation.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0
    assert collocation.collocations(spark.createDataFrame([("a. " * 200, "en")], "text string, lang string")).count() == 0


def test_collocations_equal_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(collocation.op12_collocations(spark, sf_dir), duck.execute(collocation.OP12_SQL)) > 0


# op13 ------------------------------------------------------------------------


def trie_plainly(turns):
    convs = defaultdict(list)
    for c, t, role, text in turns:
        convs[c].append((-1 if t is None else 0, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(rows)] for c, rows in convs.items()}
    built = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - c % 20, []) if c is not None else []
        built[c] = base[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built, key=lambda c: (c is None, c or 0)):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def below(k):
        leaves, saved = (0 if kids[k] else 1), (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        for x in kids[k]:
            more = below(x)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for k, m in members.items():
        ends = ",".join("null" if c is None else str(c) for c in m if len(built[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns():
    turns = []
    for c in [*range(0, 60), 80, 81, 85, 205, 10**12]:
        for t in range(c % 5 + 1):
            turns.append((c, t, ["user", "assistant"][t % 2], f"turn {t} of {c // 20 if c % 3 else c % 7}"))
    turns += [(20, t, "user", "again " * (t % 3)) for t in range(6, 30)] + [(40, t, "user", "again " * (t % 3)) for t in range(6, 27)]
    turns += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(20)]
    turns += [(c, 20, "user", f"other {c % 2}") for c in range(1020, 1040)]
    return [*turns, (1, None, None, None), (1, None, "user", ""), (7, 3, "user", "x"), (7, 3, "user", "x"), (None, 0, "user", "mine"), (None, 2, None, "too"), (500, 0, None, "w " * 9000)]


@pytest.mark.parametrize("block", [8, 1, 3])
def test_trie_equals_brute_force(spark, block):
    turns = some_turns()
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS d", "'x' AS K1").repartition(6)
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame, block).collect()]
    assert sorted(got, key=repr) == trie_plainly(turns)


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    turns = [(lone, 0, "user", "gone")]
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(turns, schema)).collect()] == trie_plainly(turns)


def test_running_totals_over_tasks(spark):
    rows = [(k, i, (k * 7919 + i * 104729) % 1000 - 300) for k, n in ((1, 5), (2, 900), (3, 1), (4, 300)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        for xor in (False, True):
            got = {(r.k, r.i): (r.run_v, r.run_rows) for r in prefix_trie.running(frame, "k", ["i"], ["v"], xor, "test-running").collect()}
            for k in (1, 2, 3, 4):
                total = 0
                for n, (_, i, v) in enumerate(x for x in rows if x[0] == k):
                    total = total ^ v if xor else total + v
                    assert got[k, i] == (total, n + 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_trie_equals_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(prefix_trie.op13_prefix_trie(spark, sf_dir), duck.execute(prefix_trie.OP13_SQL)) > 50
