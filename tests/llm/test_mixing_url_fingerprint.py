import hashlib

import numpy as np
from pyspark.sql import functions as F

from passagemill.llm import fingerprint as fp
from passagemill.llm import common, mixing, url_filter


def test_mixing_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(mixing.op3_source_mixing(spark, sf_dir), duck.execute(mixing.OP3_SQL)) == 200


def test_url_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(url_filter.op5_url_filters(spark, sf_dir), duck.execute(url_filter.OP5_SQL)) == 50


def test_mixing_targets_and_schedule(spark):
    words = lambda n: "w " * n
    rows = [(i, "a", words(50)) for i in range(40)] + [(100 + i, "b", words(20)) for i in range(5)] + [(200 + i, None, words(30)) for i in range(60)] + [(300, "b", None), (301, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed, pieces = mixing.mix_sources(docs)
    got = mixed.toPandas()
    total = got["size"].sum()
    by = got.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - total) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    assert (abs(by.taken - by.target) <= 0.02 * total).all()
    assert by.target["b"] == 300  # weight 2 would be more than three times its words
    assert (got.taken <= 3 * got["size"]).all() and len(got) == len(rows)
    # every part of the schedule is near the weights
    slots = pieces.toPandas()
    half = slots[slots.slot < slots.slot.max() / 2].groupby("sid").words.sum()
    whole = slots.groupby("sid").words.sum()
    assert (abs(half / half.sum() - whole / whole.sum()) < 0.02).all()


def test_small_sources_take_their_targets(spark):
    """Sources far below a block of the mix: none vanishes and none takes much more or less than its target, and they are spread over the mix."""
    big = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("z").alias("source"), F.repeat(F.lit("w "), 25_000).alias("text"))
    rows = [(10_000 + 10 * k + i, f"s{k}", "w " * n) for k, n in enumerate([1, 5, 60, 300, 1000, 2500]) for i in range(7)]
    docs = big.union(spark.createDataFrame(rows, "doc_id long, source string, text string")).toDF("doc_id", "source", "text")
    mixed, pieces = mixing.mix_sources(docs)
    by = mixed.groupBy("sid", "source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).toPandas()
    assert (abs(by.taken - by.target) <= 1 + 0.01 * by.target).all(), by
    slots = pieces.groupBy("sid", "slot").agg(F.sum("words").alias("words")).toPandas()
    half = slots[slots.slot < slots.slot.max() / 2].groupby("sid").words.sum()
    taken = by.set_index("sid").taken
    assert all(abs(half.get(k, 0) / n - 0.5) < 0.05 for k, n in taken.items() if n >= 100), (half, taken)


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(1, "a", "x y z", 5), (2, "a", "p  q\nr s", 8), (3, "b", "k " * 60, 120), (4, "b", None, 0)], "doc_id long, source string, text string, n_chars long")
    mixed, _ = mixing.mix_sources(docs)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert words == {k: v for k, v in taken.items() if v}


def test_mixed_documents_with_clashing_names(spark):
    names = ["mix_text", "mix_cut", "MIX_ROW", "a.b", "words"]
    docs = spark.createDataFrame([(1, "a", "x y z", *"pqrst")], "doc_id long, source string, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a", "x y z", *"pqrst")]


def test_url_levels(spark):
    hosts = ["www.example.co.uk", "co.uk", "a.b.example.com", "localhost", "example.com:8080", "10.0.0.1:80", "[::1]", "", "x.gouv.fr", "xco.uk"]
    got = {r.host: (r.domain, r.suffix) for r in url_filter.with_levels(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {
        "www.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"),
        "example.com:8080": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "address"), "[::1]": ("[::1]", "address"), "": ("", ""), "x.gouv.fr": ("x.gouv.fr", "gouv.fr"), "xco.uk": ("xco.uk", "uk"),
    }


def test_beta_score_equals_integration(spark):
    """The score's probability against the beta distribution's, by a fine sum over points that avoid its poles."""
    from math import erf, sqrt

    for a, b in ((0.67, 0.33), (1, 1), (2, 8), (8.67, 0.33), (5, 10), (30, 70), (3, 4)):
        u = (np.arange(400_000) + 0.5) / 400_000
        low, high = 0.3**a / a * np.mean((1 - 0.3 * u ** (1 / a)) ** (b - 1)), 0.7**b / b * np.mean((1 - 0.7 * u ** (1 / b)) ** (a - 1))
        z = spark.createDataFrame([(a / (a + b), float(a + b))], "mean double, weight double").select(url_filter.beta_score(0.3).alias("z")).first().z
        if a < 20:
            assert abs((1 + erf(z / sqrt(2))) / 2 - low / (low + high)) < 0.03, (a, b)


def test_bad_hosts_do_not_taint_a_public_suffix(spark):
    """Bad pages on a few .co.uk hosts say little of another one, among many good pages elsewhere."""
    pages = [(i, f"http://h{i % 50}.info/p/{i}") for i in range(1000)] + [(1000 + i, f"http://bad{i % 5}.co.uk/p/{1000 + i}") for i in range(40)]
    pages += [(5000 + i, f"http://good{i}.co.uk/p/{5000 + i}") for i in range(20)] + [(9000, "http://innocent.co.uk/x"), (9001, "http://new.info/x"), (9002, "http://new.info:8080/x")]
    labels = [(i, 1, 0) for i in range(1000)] + [(1000 + i, 0, 0) for i in range(40)] + [(5000 + i, 1, 0) for i in range(20)]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    verdict = {r.page_id: r.verdict for r in out}
    assert [verdict[i] for i in (9000, 9001, 9002)] == ["allow"] * 3 and {verdict[1000 + i] for i in range(40)} == {"block"}


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(docs)[0].count() == 0
    no_words = spark.createDataFrame([(1, None, None), (1, None, None)], docs.schema)
    assert [r.taken for r in mixing.mix_sources(no_words)[0].collect()] == [0, 0]


def test_url_cases(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://WWW.Example.COM/en/5"), (4, "https://a.example.com/en/5"), (5, "http://x.net/fr/1"), (6, "http://x.net?fr/"), (7, "http://org")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/5", "www.example.com/en/", "allow")
    assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("net/fr/", "block") and got[6][1:3] == ("", None)
    assert url_filter.filter_urls(pages.filter("1 = 0"), labels).count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.example.org/x/{i}") for i in range(60)] + [(100, "http://bad.example.org/other"), (101, "http://new.example.org/other")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labels, ()).collect()}
    assert got[100] == "block" and got[0] == "allow"


def test_hot_hosts_are_split(spark, sf_dir, monkeypatch):
    """With few rows to be hot, broadcast or salted: the same rows."""
    want = sorted(map(str, url_filter.op5_url_filters(spark, sf_dir).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(str, url_filter.op5_url_filters(spark, sf_dir).collect())) == want
    monkeypatch.setattr(common, "BROADCAST_KEYS", 1)
    assert sorted(map(str, url_filter.op5_url_filters(spark, sf_dir).collect())) == want


def jaccard(a, b):
    def s(t):
        w = t.encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_of_edits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fp.edited_likeness(docs, 7).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[doc].n_chars == len(text)
        errors += [abs(got[doc].near_edited - jaccard(text, edited)), abs(got[doc].near_next - jaccard(text, after))]
    assert np.mean(errors) < 0.03 and max(errors) < 0.25


def test_sketches_merge_and_count():
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1500, 4500))
    x, y = fp.sketch(a), fp.sketch(b)
    assert abs(fp.resemblance(x, y) - 1496 / 4496) < 0.12 and abs(fp.containment(x, y) - 0.5) < 0.15
    assert abs(fp.distinct_count(x) / 2996 - 1) < 0.25
    parts = fp.merge(fp.sketch(" ".join(a.split()[:2000])), fp.sketch(" ".join(a.split()[1996:])))
    assert list(parts) == list(x) and list(fp.from_string(fp.to_string(x))) == list(x)


def test_fingerprint_corner_cases(spark):
    d = spark.createDataFrame([(5, "a b c d e f g"), (None, "x y"), (5, None), (2, ""), (5, "a b c d e f g")], "doc_id long, text string")
    got = fp.edited_likeness(d, 3).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.n_chars == 13}) == 1
    assert fp.edited_likeness(d.filter("1 = 0")).count() == 0
    many = spark.createDataFrame([(None if i % 2 else 9, f"word{i} " * 20) for i in range(400)] + [(i, "x y z") for i in range(40)], "doc_id long, text string").repartition(3)
    cut, parts = fp._part(many.selectExpr("doc_id", "text", "xxhash64(text) AS tie", "octet_length(text) AS bytes"), 8)
    held = {(r.part, r.doc_id): r.n for r in cut.groupBy("part", "doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(n for (_, doc), n in held.items() if doc is None) < 100 and max(n for (_, doc), n in held.items() if doc == 9) < 100
    out = fp.edited_likeness(many, 8).collect()
    assert len(out) == 440 and sum(r.near_next == 1.0 for r in out) in (37, 38, 39)
    one = fp.edited_likeness(d.filter("doc_id = 2")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    wide = d.withColumn("fingerprint_of", F.lit(1))
    assert fp.fingerprints(wide).columns == ["doc_id", "text", "fingerprint_of", "fingerprint", "distinct_shingles"]
    assert fp.fingerprints(d.withColumn("fingerprint", F.lit("own"))).columns == ["doc_id", "text", "fingerprint", "_fingerprint", "distinct_shingles"]


def test_mixing_of_many_sources(spark, same_rows):
    """400 sources of about one size, and beside them some of a few words and one with most of all: points place every one, near its own target, and SQL agrees."""
    import duckdb

    rows = [(10 * k + i, f"s{k:03}", "w " * (37 + (7 * k + 11 * i) % 60)) for k in range(400) for i in range(8)]
    rows += [(10_000 + i, "z", "w " * 3000) for i in range(60)] + [(20_000 + k, f"t{k}", "w " * (k + 1)) for k in range(6)] + [(30_000, "t0", None), (30_001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed, pieces = mixing.mix_sources(docs)
    by = mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).toPandas()
    assert (abs(by.taken - by.target) <= 4 + 0.01 * by.target).all(), by[abs(by.taken - by.target) > 4 + 0.01 * by.target]
    assert abs(by.taken.sum() / by.target.sum() - 1) < 0.01
    slots = pieces.toPandas()
    half = slots[slots.slot < 1 << 51].groupby("sid").words.sum()
    whole = slots.groupby("sid").words.sum()
    assert all(abs(half.get(k, 0) - n / 2) <= 4 + 0.01 * n for k, n in whole.items())
    duck = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    duck.execute("CREATE TABLE documents AS SELECT * FROM documents")
    assert same_rows(mixed.select("doc_id", "size", "source_size", "target", "taken"), duck.execute(mixing.OP3_SQL)) == len(rows)
