import json

import pytest
from pyspark.sql import functions as F

from passagemill import schemas
from passagemill.config import IngestConfig
from passagemill.functions import vectors as vf
from passagemill.functions.embed import embedder
from passagemill.operators import audit, ingest
from passagemill.sources import corpus, store
from passagemill.streaming import feed

CFG = IngestConfig(dimension=8, backend="hash")
EMBED = lambda c: vf.hash_embedding(c, 8).cast("array<double>")
R = "request_id long, client_name string, scope string, path_or_uri string, content string, force boolean"


def empty(spark):
    return spark.createDataFrame([], schemas.NOTES), spark.createDataFrame([], schemas.PASSAGES)


def keep(spark, *frames):
    """Frames as tables of their own, as a store would hold them."""
    return tuple(spark.createDataFrame(f.collect(), f.schema) for f in frames)


def test_lifecycle(spark):
    first = spark.createDataFrame([(1, "acme", None, "a.md", "one\n\ntext", False), (2, "globex", None, "a.md", "other", False)], R)
    notes, passages, results = ingest.ingest(first, *empty(spark), CFG, EMBED, F.lit("2026-01-01").cast("timestamp"))
    assert {r.outcome for r in results.collect()} == {"new"}
    notes, passages = keep(spark, notes, passages)
    ids = {(r.client_name, r.path_or_uri): r.id for r in notes.collect()}
    assert len(set(ids.values())) == 2 and audit.duplicate_keys(notes, *ingest.IDENTITY).count() == 0 and audit.orphans(passages, notes).count() == 0

    again = ingest.ingest(first, notes, passages, CFG, EMBED)
    assert {r.outcome for r in again[2].collect()} == {"skipped"} and [r.passages for r in again[2].collect()] == [1, 1]
    assert sorted(again[0].collect()) == sorted(notes.collect()) and sorted(again[1].collect()) == sorted(passages.collect())

    for cfg in (IngestConfig(8, "hash", splitter_version="4"), IngestConfig(8, "hash", fts_version="2"), IngestConfig(8, "hash", input_version="2"), IngestConfig(8, "other")):
        assert {r.outcome for r in ingest.ingest(first, notes, passages, cfg, EMBED)[2].collect()} == {"changed"}

    forced = ingest.ingest(first.withColumn("force", F.lit(True)), notes, passages, CFG, EMBED)
    assert {r.outcome for r in forced[2].collect()} == {"forced"} and {r.content_hash for r in forced[0].collect()} == {r.content_hash for r in notes.collect()}

    change = spark.createDataFrame([(3, "acme", "", "a.md", "## H\n\nnew", False)], R)
    n2, p2, r2 = ingest.ingest(change, notes, passages, CFG, EMBED, F.lit("2026-02-02").cast("timestamp"))
    row = n2.filter("client_name = 'acme'").collect()
    assert len(row) == 1 and row[0].id == ids["acme", "a.md"] and row[0].created_at.month == 1 and row[0].updated_at.month == 2
    assert [p.content for p in p2.filter("client_name = 'acme'").collect()] == ["## H\n\nnew"]
    assert p2.filter("client_name = 'globex'").count() == 1


def test_failure_keeps_what_was_there(spark):
    notes, passages = keep(spark, *ingest.ingest(spark.createDataFrame([(1, "a", "", "x.md", "old", False)], R), *empty(spark), CFG, EMBED)[:2])
    bad = lambda c: F.when(F.contains(c, F.lit("poison")), F.array_repeat(F.lit(0.0), 8)).otherwise(EMBED(c))
    requests = spark.createDataFrame([(2, "a", "", "x.md", "poison " * 900 + "\n\n" + "fine " * 900, False), (3, "a", "", "y.md", "poison", False), (4, "a", "", "z.md", "ok", False)], R)
    n, p, r = ingest.ingest(requests, notes, passages, CFG, bad)
    assert {x.request_id: (x.outcome, x.fault) for x in r.collect()} == {2: ("failed", "zero norm"), 3: ("failed", "zero norm"), 4: ("new", None)}
    assert {x.path_or_uri: x.body for x in n.collect()} == {"x.md": "old", "z.md": "ok"} and {x.content for x in p.collect()} == {"old", "ok"}


def test_validation(spark):
    cases = [("/etc/passwd", "x"), ("docs/../../secrets.md", "x"), ("https://e.org/a/../b", "x"), ("a.md", "y" * 500_000), ("b.md", "y" * 500_001), ("c.md", "漢" * 200_000), ("", "x"), ("p" * 2049, "x")]
    requests = spark.createDataFrame([(i, "a", "", p, c, False) for i, (p, c) in enumerate(cases)], R)
    _, _, r = ingest.ingest(requests, *empty(spark), CFG, EMBED)
    fault = {x.request_id: x.fault for x in r.collect()}
    assert fault == {0: "absolute path", 1: "parent component", 2: None, 3: None, 4: "content too long", 5: None, 6: "path is empty", 7: "path too long"}
    summary = ingest.run_summary(r).collect()[0]
    assert (summary.considered, summary.ingested, summary.failed) == (8, 3, 5)


def test_delete_is_the_owners(spark):
    notes, passages = keep(spark, *ingest.ingest(spark.createDataFrame([(1, "a", "", "x.md", "t", False), (2, "b", "", "x.md", "t", False)], R), *empty(spark), CFG, EMBED)[:2])
    ids = {r.client_name: r.id for r in notes.collect()}
    foreign = spark.createDataFrame([("a", ids["b"])], "client_name string, note_id long")
    assert ingest.delete_notes(notes, passages, foreign)[0].count() == 2
    own = spark.createDataFrame([("a", ids["a"])], "client_name string, note_id long")
    n, p = ingest.delete_notes(notes, passages, own)
    assert n.count() == p.count() == 1 and ingest.lookup_notes(notes, passages, own.withColumnRenamed("note_id", "id")).collect()[0].passage_count == 1


def test_embedder_batches_in_order(spark):
    embed = embedder(lambda: lambda texts: [[float(len(texts)), float(t)] for t in texts], 16)
    got = spark.createDataFrame([(i, str(i)) for i in range(40)], "i int, t string").coalesce(1).select("i", embed(F.col("t")).alias("e")).collect()
    assert [r.e[1] for r in got] == [float(r.i) for r in got] and [r.e[0] for r in got] == [16.0] * 32 + [8.0] * 8
    short = embedder(lambda: lambda texts: [], 16)
    with pytest.raises(Exception, match="vectors for"):
        spark.createDataFrame([("x",)], "t string").select(short(F.col("t"))).collect()


def test_corpus(spark, tmp_path):
    for path, raw in {"a.md": b"one\r\ntwo", "sub/b.md": b"\xff\xfe", "MEMORY.md": b"m", "sub/deep/MEMORY.md": b"m", "sub/learning-log.md": b"l", "c.txt": b"t", "drafts/d.md": b"d"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    files, failed = corpus.read_corpus(spark, f"file://{tmp_path}")
    assert {r.path_or_uri: r.content for r in files.collect()} == {"a.md": "one\ntwo", "drafts/d.md": "d"} and [r.path_or_uri for r in failed.collect()] == ["sub/b.md"]
    more, _ = corpus.read_corpus(spark, f"file://{tmp_path}", corpus.resolve_excludes(["drafts/*"], use_defaults=False))
    assert {r.path_or_uri for r in more.collect()} == {"a.md", "MEMORY.md", "sub/deep/MEMORY.md", "sub/learning-log.md"}


def test_golden(spark, tmp_path):
    doc = {"version": 1, "gate": {"top_k": 5, "threshold": 2, "minimum_queries": 3}, "queries": [{"query": "q", "expect_path_or_uri": "a"}, {"query": "r", "expect_path_or_uri": ["b", "c"], "notes": "n"}]}
    (tmp_path / "g.yaml").write_text("version: 1\ngate:\n  top_k: 5\n  threshold: 2\n  minimum_queries: 3\nqueries:\n- query: q\n  expect_path_or_uri: a\n- {query: r, expect_path_or_uri: [b, c], notes: n}\n")
    gate, rows = corpus.load_golden(spark, f"file://{tmp_path}/g.yaml")
    assert gate["threshold"] == 2 and [list(r.expect_path_or_uri) for r in rows.collect()] == [["a"], ["b", "c"]]
    for bad, message in (({"version": 2}, "version"), ({"queries": [{"query": "  ", "expect_path_or_uri": "a"}]}, r"queries\[0\]"), ({"queries": [{"query": "q", "expect_path_or_uri": "a"}, {"query": "q", "expect_path_or_uri": []}]}, r"queries\[1\]"), ({"gate": {"top_k": True}}, "gate.top_k"), ({"gate": []}, "gate must be a mapping"), ({"queries": {}}, "queries must be a list"), ({"queries": ["q"]}, r"queries\[0\]: must be a mapping"), ({"queries": [{"query": "q", "expect_path_or_uri": ["a", ""]}]}, "expect_path"), ({"queries": [{"query": "q", "expect_path_or_uri": "a", "notes": 3}]}, "notes")):
        with pytest.raises(ValueError, match=message):
            corpus.check_golden(spark, json.dumps(doc | bad))
    for text, message in (("- a\n", "mapping"), ("", "mapping"), ("a: [", "not YAML")):
        with pytest.raises(ValueError, match=message):
            corpus.check_golden(spark, text)


def test_store_round_trip(spark, tmp_path):
    notes, passages, _ = ingest.ingest(spark.createDataFrame([(1, "a", "", "x.md", "t", False), (2, "b", "", "x.md", "t", False)], R), *empty(spark), CFG, EMBED)
    notes, passages = keep(spark, notes, passages)
    corpus.write_store(notes, passages, f"file://{tmp_path}/store")
    corpus.write_store(notes.filter("client_name = 'a'"), passages.filter("client_name = 'a'"), f"file://{tmp_path}/store")
    n, p = corpus.read_store(spark, f"file://{tmp_path}/store")
    assert n.count() == p.count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
    go = lambda: feed.ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/store", f"file://{tmp_path}/cp", CFG, EMBED).awaitTermination()
    put("1.json", [{"request_id": 1, "op": "upsert", "client_name": "a", "repo_name": "r", "path_or_uri": "x.md", "content": "old", "arrived_at": "2026-01-01T00:00:00Z"}, {"request_id": 2, "op": "upsert", "client_name": "a", "scope": "r", "path_or_uri": "x.md", "content": "new", "arrived_at": "2026-01-02T00:00:00Z"}, {"request_id": 3, "op": "upsert", "client_name": "a", "path_or_uri": "y.md", "content": "y"}])
    go()
    n, p = store.LogStore(spark, f"file://{tmp_path}/store").read()
    assert {r.path_or_uri: r.body for r in n.collect()} == {"x.md": "new", "y.md": "y"}
    put("2.json", [{"request_id": 4, "op": "delete", "client_name": "a", "path_or_uri": "y.md"}, {"request_id": 5, "op": "upsert", "client_name": "a", "scope": "r", "path_or_uri": "x.md", "content": "new"}])
    go()
    held = store.LogStore(spark, f"file://{tmp_path}/store")
    n, p = held.read()
    assert held.version() == 1 and {r.path_or_uri for r in n.collect()} == {"x.md"} and {r.content for r in p.collect()} == {"new"}


def contents(held):
    n, p = held.read()
    return {(r.client_name, r.path_or_uri): r.body for r in n.collect()}, sorted((r.client_name, r.content) for r in p.collect())


def test_log_of_batches(spark, tmp_path):
    """Upserts, changes, deletes and new beginnings over many batches, merged and not, against applying each batch to whole tables."""
    quiet, busy = (store.LogStore(spark, f"file://{tmp_path}/{n}", 4, *more) for n, more in (("quiet", (1000, 1e9)), ("busy", (2, 0.6, 0))))
    state = keep(spark, *empty(spark))
    schema = "request_id long, op string, client_name string, path_or_uri string, content string"
    base = [(i, "upsert", "acme", f"{i}.md", f"text {i} " * 40) for i in range(30)]
    batches = [base, [(1, "upsert", "acme", "1.md", "changed"), (2, "delete", "acme", "2.md", None)], [(2, "upsert", "acme", "2.md", "anew"), (3, "delete", "acme", "3.md", None), (4, "upsert", "globex", "4.md", "theirs")],
               [(2, "delete", "acme", "2.md", None), (1, "upsert", "acme", "1.md", "changed"), (9, "delete", "acme", "none.md", None), (5, "upsert", "acme", "5.md", "five"), (3, "upsert", "acme", "3.md", "back")]]
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, schema)
        state = keep(spark, *feed.apply_batch(batch, *state, CFG, EMBED)[:2])
        want = {(r.client_name, r.path_or_uri): r.body for r in state[0].collect()}, sorted((r.client_name, r.content) for r in state[1].collect())
        changed = feed.batch_changes(batch, *busy.read(), CFG, EMBED)
        for held in (quiet, busy):
            held.append(i, *changed)
        merged, gone = busy.merge(), busy.collect()
        assert contents(busy) == want and busy.version() == i and not set(gone) & set(store.cover(busy.runs()))
        assert merged is None or merged in busy.runs()
    assert contents(quiet) == want
    assert len(quiet.runs()) == len(batches) and len(busy.runs()) < len(batches)
    # What a small batch wrote follows the batch.
    sizes = [sum(f.stat().st_size for f in (tmp_path / "quiet" / r.name).rglob("part-*") if "done" not in str(f)) for r in quiet.runs()]
    assert max(sizes[1:]) < sizes[0]
    # A batch reads the buckets that it names.
    n, _ = quiet.read([0])
    assert {r.bucket for r in n.select(quiet.bucket().alias("bucket")).collect()} <= {0}


def test_half_written_batches_do_not_count(spark, tmp_path):
    held = store.LogStore(spark, f"file://{tmp_path}/s", 2)
    batch = spark.createDataFrame([(1, "upsert", "acme", "1.md", "one")], "request_id long, op string, client_name string, path_or_uri string, content string")
    changed = feed.batch_changes(batch, *held.read(), CFG, EMBED)
    held.append(0, *changed)
    (tmp_path / "s" / "r00000000-00000000" / "done" / "_SUCCESS").unlink()
    assert held.version() == -1 and contents(held) == ({}, [])
    held.append(0, *changed)
    assert held.version() == 0 and contents(held)[1] == [("acme", "one")]


def test_cover_of_runs():
    r = store.Run
    assert store.cover([r(0, 0), r(1, 1), r(2, 2), r(1, 2), r(3, 3)]) == [r(0, 0), r(1, 2), r(3, 3)]
    assert store.cover([r(0, 0), r(0, 4), r(1, 3), r(5, 5)]) == [r(0, 4), r(5, 5)]
    assert store.cover([]) == []


def test_each_passage_is_embedded_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            counted.add(len(texts))
            return [[float(len(x))] * 8 for x in texts]

        return model

    rows = [(i, "acme", "", f"{i}.md", "## A\n\n" + "word " * 200 + "\n\n## B\n\n" + "more " * 200, False) for i in range(5)]
    out = ingest.ingest(spark.createDataFrame(rows, R), *empty(spark), CFG, embedder(load))
    assert [f.count() for f in out] == [5, 10, 5] and counted.value == 10


def test_ids_are_a_tenants_own(spark):
    """Two tenants' notes of one id: a fault and a count of one do not reach the other."""
    first = spark.createDataFrame([(1, "acme", "", "a.md", "one", False), (2, "globex", "", "a.md", "two", False)], R)
    notes, passages, _ = ingest.ingest(first, *empty(spark), CFG, EMBED)
    same = {"id": F.lit(7).cast("long")}
    notes, passages = keep(spark, notes.withColumns(same), passages.withColumn("note_id", F.lit(7).cast("long")))
    change = spark.createDataFrame([(3, "acme", "", "a.md", "fails now", False), (4, "globex", "", "a.md", "fine now", False)], R)
    embed = lambda c: F.when(c.contains("fails"), F.array().cast("array<double>")).otherwise(EMBED(c))
    n, p, r = ingest.ingest(change, notes, passages, CFG, embed)
    assert {x.client_name: (x.outcome, x.passages) for x in r.collect()} == {"acme": ("failed", 0), "globex": ("changed", 1)}
    assert {x.client_name: x.content for x in p.collect()} == {"acme": "one", "globex": "fine now"}


def test_corpus_is_listed_in_tasks(spark, tmp_path):
    """Files of nested folders, with the names that Spark's readers pass over, and no list of files in Spark's index."""
    for name in ("a.md", "x/b.md", "x/y/c d.md", "x/.hidden.md", "_gone/d.md", "x/e.txt", ".f/g.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    files, failed = corpus.read_corpus(spark, f"file://{tmp_path}")
    want = {"a.md": "a.md", "x/b.md": "x/b.md", "x/y/c d.md": "x/y/c d.md"}
    assert {r.path_or_uri: r.content for r in files.collect()} == want and failed.isEmpty()
    assert "binaryFile" not in files._jdf.queryExecution().executedPlan().toString()
    by_spark, _ = corpus.read_corpus(spark, f"file://{tmp_path.parent}/{tmp_path.name[:-1]}*")
    assert {r.content for r in by_spark.collect()} == set(want)


def test_requests_are_derived_once(spark):
    from pyspark.sql import functions as F

    from passagemill import schemas
    from passagemill.config import IngestConfig
    from passagemill.functions import vectors as vf
    from passagemill.operators import ingest

    calls = spark.sparkContext.accumulator(0)

    def derive(k):
        calls.add(1)
        return f"text {k}"

    r = spark.range(20).select(F.lit("c").alias("client_name"), F.lit("s").alias("scope"), F.concat(F.col("id"), F.lit(".md")).alias("path_or_uri"), F.udf(derive, "string")("id").alias("content"))
    notes, passages = spark.createDataFrame([], schemas.NOTES), spark.createDataFrame([], schemas.PASSAGES)
    new, pieces, results = ingest.changes(r, notes, passages, IngestConfig(dimension=4, backend="hash"), lambda c: vf.hash_embedding(c, 4).cast("array<double>"))
    assert (new.count(), pieces.count(), results.count()) == (20, 20, 20)
    assert calls.value == 20
