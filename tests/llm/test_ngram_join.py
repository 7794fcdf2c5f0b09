import random

from passagemill.llm import ngram_join as nj
from passagemill.llm.components import components, joined


def brute(docs, width=4, percent=85):
    def shingles(t):
        w = [x.decode() for x in (t or "").encode().lower().split()]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {d: shingles(t) for d, t in docs}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def planted(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    passage = " ".join(rnd.choice(words) for _ in range(60))
    for family in range(25):
        size = rnd.choice([3, 5, 7, 9, 15, 40, 90, 200, 500])
        base = [rnd.choice(words) for _ in range(size)]
        for _ in range(rnd.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, size // 50, size // 30])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.2:
                w = w[: max(1, int(len(w) * rnd.uniform(0.8, 1)))]
            text = " ".join(w)
            docs.append((n, text.upper() if rnd.random() < 0.1 else text + (" " + passage if family % 6 == 0 else "")))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]
    rnd.shuffle(docs)
    return docs


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        docs = planted(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
        assert got == brute(docs)


def edits_of_edits(seed, families, size=10):
    """Families of short texts (size of them at most), each text an edit or a prolonged copy of one before it in its family, with ids in no order."""
    rnd, texts = random.Random(seed), []
    for f in range(families):
        family = [[f"f{f}w{i}" for i in range(rnd.randint(9, 18))]]
        for j in range(rnd.randint(size - 6, size)):
            w = list(rnd.choice(family))
            for _ in range(rnd.choice([1, 1, 2])):
                at, new = rnd.choice([0, len(w) - 1, len(w)]), f"f{f}e{j}x{rnd.randrange(4)}"
                w[at : at + rnd.choice([0, 1])] = [new]
            family.append(w)
        texts += [" ".join(w) for w in family]
    ids = rnd.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts, strict=True))


def test_cells_of_many_leaves_equal_brute_force(spark):
    """Small leaves, so that stand-ins and the descent through the tree's levels are needed."""
    for seed, leaf in ((11, 2), (12, 5)):
        docs = edits_of_edits(seed, 4, 120) + [(100_000 + d, t) for d, t in planted(seed)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_copies(df, leaf=leaf).collect()}
        want = brute(docs)
        assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_common_blocks_equal_brute_force(spark):
    """A group of near copies that is most of the table, so that its blocks are found common by the sample."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(300):
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(120)] = f"x{d}y{rnd.randrange(99)}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    keys, cells = nj.common_keys(df, 300)
    assert len(keys) > 20 and (keys[1:] > keys[:-1]).all() and set(cells) <= set(range(300))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_copies(df, leaf=16).collect()}
    assert got == brute(docs)


def test_edits_of_edits_equal_brute_force(spark):
    docs = edits_of_edits(3, 250)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = brute(docs)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_other_threshold(spark):
    docs = planted(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute(docs, 5, 80)


def test_linking_sets_share_a_block():
    import numpy as np

    rnd = np.random.default_rng(0)
    for _ in range(300):
        n = int(rnd.integers(6, 900))
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        n = len(a)
        k = int(rnd.integers(0, nj.differing(n) + 1))
        gone = min(k // 2, n - 1)
        b = np.unique(np.concatenate([np.delete(a, rnd.choice(n, gone, replace=False)), rnd.integers(0, 1 << 63, k - gone).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (n + len(b) - both) and not np.array_equal(a, b):
            assert np.intersect1d(nj.block_keys(a), nj.block_keys(b)).size


def test_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(nj.op2_ngram_join(spark, sf_dir), duck.execute(nj.OP2_SQL)) == 200


def test_keep_one(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(5, t, "a"), (3, t, "b"), (3, t, "c"), (7, "other text here now", None), (None, "x y z", "n")], "doc_id long, text string, n_shingles string")
    assert sorted((r.doc_id or -1) for r in nj.keep_one(docs).collect()) == [-1, 3, 7]


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "z z z z z z"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in nj.near_copies(docs).collect())
    assert got == [(-1, 2, 4), (-1, 3, -1), (2, 0, 2), (4, 2, 4)] or got == [(-1, 1, -1), (-1, 2, 4), (2, 0, 2), (4, 2, 4)]
    assert nj.near_copies(docs.filter("1 = 0")).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_links_join_components(spark):
    """More links joined to components equal the components of all links; links within components and none change nothing."""
    rng = random.Random(5)
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    table = lambda rows: spark.createDataFrame(rows, "u long, v long")
    found = components(table(some))
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)]
    as_dict = lambda df: {r.node: r.component for r in df.collect()}
    assert as_dict(joined(found, table(more))) == as_dict(components(table(some + more)))
    assert as_dict(joined(found, table([]))) == as_dict(joined(found, table(some))) == as_dict(found)


def test_texts_and_sets_are_not_shuffled_to_their_cells(spark):
    docs, members = [(i, f"a b c d e{i}") for i in range(60)], [(1, i) for i in range(60)]
    made = nj.tree_members(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(members, "cell long, doc_id long"), spark.createDataFrame([], "doc_id long"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan


def test_one_row_of_a_repeated_id_counts(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k")]
    members = [(7, 1), (8, 1), (7, 2)]
    made = nj.tree_members(*[spark.createDataFrame(rows, kinds) for rows, kinds in ((docs, "doc_id long, text string"), (members, "cell long, doc_id long"), ([(1,)], "doc_id long"))])
    assert sorted((r.cell, r.doc_id, r.n) for r in made.collect()) == [(7, 1, 3), (7, 2, 2), (8, 1, 3)]
