from passagemill.llm.common import stage_table


def test_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage_table(stage(spark, docs, sf_dir), name)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns, name
        assert 0 < out.count() < 4 * n, name
        docs = out
    assert cp.run(spark, sf_dir).count() == docs.count()


def test_near_copies_from_080(spark, sf_dir):
    """Scattered edits that leave a five-word similarity of 0.808 (a four-word one of 0.844) make a copy; with 0.786 both stay."""
    import corpus_pipeline as cp

    docs = []
    for family in range(10):
        w = [f"f{family}w{i}" for i in range(380)]
        for k, edits in enumerate((0, 8) if family % 2 else (0, 9)):
            docs.append((10 * family + k, " ".join(f"new{x}" if x % 40 == 20 and x // 40 < edits else word for x, word in enumerate(w))))
    kept = cp.ngram_join(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d // 10 % 2 == 0 or d % 10 == 0)


def test_stages_bound_their_batches_of_texts(spark, sf_dir):
    """What a stage leaves to Python comes in batches of 1 MB, whatever was set before: workers outlive a stage and keep what its largest batch took."""
    import corpus_pipeline as cp

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    for name, stage in cp.STAGES:
        spark.conf.set(key, str(16 << 20))
        stage(spark, docs, sf_dir).count()
        assert name in ("pii", "source_mixing") or int(spark.conf.get(key)) <= 1 << 20, name


def test_stages_on_nothing(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("1 = 0")
    for name, stage in cp.STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "passagemill"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "passagemill.llm" not in f.read_text(), f


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept: the base rules of quality, links of near copies, spans, words of the mix and pieces of the packing, all reckoned plainly."""
    import re
    from collections import Counter

    import corpus_pipeline as cp
    from tests.llm.test_ngram_join import brute as groups
    from tests.llm.test_pii import brute as spans
    from tests.llm.test_quality_language_chat import brute_quality

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(cp.STAGES)
    good = stage_table(stages["quality_rules"](spark, docs, sf_dir), "t")
    all_rows, kept = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in good.collect()}
    failed = {d for d, r in all_rows.items() if (q := brute_quality(r.text))[0] < 10 or 100 * q[4] > 20 * q[0]}
    assert not failed & set(kept) and len(kept) > 0.9 * (len(all_rows) - len(failed)) and all(all_rows[d] == r for d, r in kept.items())
    one = stage_table(stages["ngram_join"](spark, good, sf_dir), "t")
    assert {r.doc_id for r in one.collect()} == {c for _, c in groups([(d, r.text) for d, r in kept.items()], 5, 80).values()}
    safe = stage_table(stages["pii"](spark, one, sf_dir), "t")
    for r in safe.collect():
        found, text, out, at = spans(kept[r.doc_id].text), kept[r.doc_id].text, [], 0
        for kind, lo, hi in (x.split(":") for x in found.split(",") if x):
            if int(lo) >= at:
                out += [text[at : int(lo)], f"<{kind.upper()}>"]
                at = int(hi)
        plain = "".join(out) + text[at:]
        # Added spans may replace more; what is there is then a shorter list of the same pieces.
        assert r.text == plain or (spans(r.text) == "" and len(re.findall("<[A-Z]+>", r.text)) > len(re.findall("<[A-Z]+>", plain))), r.doc_id
        assert r.n_chars == len(r.text)
    mixed = stage_table(stages["source_mixing"](spark, safe, sf_dir), "t")
    sizes, taken = {r.doc_id: len(words(r.text)) for r in safe.collect()}, Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(words(r.text))
    assert all(0 < n <= 3 * sizes[d] for d, n in taken.items()) and abs(sum(taken.values()) / sum(sizes.values()) - 1) < 0.02
    copies, whole, length = Counter(r.doc_id for r in mixed.collect()), Counter(), Counter()
    for r in stages["packing"](spark, mixed, sf_dir).collect():
        length[r.doc_id] += r.length
        whole[r.doc_id] += r.doc_tokens * (r.start == 0)
    assert whole == length and set(whole) == set(copies)
