import hashlib
import re

from passagemill.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


CASES = [
    None, "", "a@b.c+d@e.f x@y", "999.1.1.1 0001.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1", "é😀 +49 (30) 1234 5678! 4111 1111 1111 1111 +1",
    "4111-1111-1111-1111 4111111111111112 +1.2.3.4.5.6.7.8.9.0", "1 " * 3000 + "a@" * 2000 + "x" * 5000, "a@b.co a@b.co 0.0.0.0",
]


def test_base_spans_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(CASES)], docs.schema)
    all_docs = docs.unionByName(extra)
    found = pii.with_candidates(all_docs)
    got = {r.doc_id: r for r in found.select("row.doc_id", "row.text", pii.span_text(pii.F.transform(pii.F.array_sort(pii.F.transform(pii.F.filter("found", lambda c: c["base"]), lambda c: pii.F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e")))), lambda x: x)).alias("base")).collect()}
    for doc_id, row in got.items():
        assert row.base == brute(row.text), doc_id


def test_query_columns(spark, sf_dir):
    rows = pii.op1_pii(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_email == base.count("email:") and r.n_card == base.count("card:") and r.n_ip == base.count("ip:") and r.n_phone == base.count("phone:")
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "call +1 (415) 555-0123 or a@b.com.", 3, "x"), (2, None, None, "y"), (3, "plain", 5, None)], "doc_id long, text string, n_chars long, pii_found string")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].pii_found == "x" and pii.redact(docs).columns == docs.columns
    assert out[1].text == "call <PHONE> or <EMAIL>." and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "plain" and out[3].n_chars == 5


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.redact(none).count() == 0
    model = pii.fit(pii.with_candidates(none))
    assert set(model) == {0, 1, 2, 3}


def test_loose_candidates_are_added_when_labelers_agree(spark):
    rows = [(i, f"phone: (415) 555-{1000 + i} and mail jo{i} (at) example.com") for i in range(60)] + [(100 + i, f"version 123 456 {1000 + i}x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.with_candidates(docs)
    spans = {r.doc_id: r.s for r in found.select("row.doc_id", pii.span_text(pii.accepted(pii.fit(found))).alias("s")).collect()}
    assert sum("phone:" in spans[i] and "email:" in spans[i] for i in range(60)) == 60
    assert not any(spans[100 + i] for i in range(60))


def test_clashing_names(spark):
    names = ["doc_id", "text", "row", "found", "spans", "PII_TEXT", "events", "a.b", "redacted", "m_card"]
    docs = spark.createDataFrame([(1, "a@b.com x", *[str(i) for i in range(8)])], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "<EMAIL> x", *[str(i) for i in range(8)])]


def test_long_redaction_equals_brute_force(spark):
    """Spans over many blocks and chunks, some of which overlap."""
    text = "".join(f"é{i} +49 30 {1000000 + i} 1.2.3.{i % 300} x{i}@b.com " + "z" * (i % 700) for i in range(900))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.with_candidates(docs)
    spans = found.select(pii.accepted(pii.fit(found)).alias("s")).first().s
    out, at = [], 0
    for x in spans:
        if x.s >= at:
            out += [text[at : x.s], f"<{pii.KINDS[x.kind].upper()}>"]
            at = x.e
    assert len(spans) > 1500 and pii.redact(docs).first().text == "".join(out) + text[at:]


def test_two_megabytes_of_numbers(spark):
    """Time grows about linearly: each text has as many matches of one kind as it can hold."""
    import time

    texts = ["4111111111111111, " * 60_000 + "(415) 555-0123, " * 60_000, "1.2.3.4, +49 30 1234567, " * 80_000, "12345 " * 170_000 + "7," * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    began = time.time()
    got = {r.doc_id: r.n for r in pii.with_candidates(docs).select("row.doc_id", pii.F.size("found").alias("n")).collect()}
    assert time.time() - began < 60
    assert got == {0: 120_000, 1: 160_000, 2: 0}
