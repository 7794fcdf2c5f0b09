"""Personal data in texts, by native expressions alone.

Base spans are the leftmost, non-overlapping matches of one pattern for each kind
that pass a check (octets, Luhn, number of digits). Further candidates come from
looser patterns. Labelers vote on every candidate or abstain: the strict pattern,
a gazetteer of prefixes and name endings, keywords before it, what it touches,
and its checksum. Expectation maximisation over the counts of vote patterns
estimates the labelers' reliabilities; its posteriors then train a naive Bayes
classifier over votes and shapes, which decides on the candidates that are not
base spans. Base spans always stay.

Only counts by kind, votes and shape reach the driver; their number is bounded by
the labelers, not by the input. Offsets are code points, ends exclusive. A null
text counts as empty. Very long texts are searched whole, in a time that grows
little faster than they do: arrays are built in blocks (scan), and texts are cut
from chunks. Rows are judged one by one, so null or repeated doc_ids and repeated
rows change nothing; an empty table gives an empty result. Other columns are kept
as a struct of their own meanwhile, so their names clash with nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import quoted, stage_table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. They find what the plain patterns find, in linear time: a run that failed from its start is not tried again from within, and repeats are possessive. Runs of under 13 digits, which can be no card, are passed over.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser patterns, and a text that must occur for them to be tried.
LOOSE = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63} ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,24}", ("(at)", "[at]")),
    "ip": (r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])", ("[.]",)),
    "phone": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-]*[0-9])", ("-", ".", " ")),
}
#: Gazetteers: endings of names, first digits of cards, and of phone numbers; words that stand before a kind.
ENDINGS = "com|net|org|edu|gov|info|io|de|fr|es|uk|eu"
CARD_START = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
PHONE_START = r"^(?:1|33|34|39|44|49|7|81|86|91)"
NEAR = {
    "email": r"(?i)(?:e-?mail|contact|write to|reach|courriel|correo|kontakt)\W*\w{0,8}\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|addr|node|from|adresse)\W*\w{0,8}\W*$",
    "card": r"(?i)(?:card|visa|credit|debit|carte|tarjeta|karte|iban|account)\W*\w{0,8}\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|appel|llame)\W*\w{0,8}\W*$",
}
#: Elements of a block of a scan, and characters of a chunk of text.
BLOCK, CHUNK = 100, 4096
CONTEXT_CHARS, THRESHOLD = 32, 0.9
VOTERS, SHAPES = ("strict", "gazetteer", "context", "edges", "checksum"), ("length", "digits", "style", "after")
FOR, AGAINST, ABSTAIN = 1, 2, 0

_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + IF(i % 2 = 1, int(substring(d, length(d) - i + 1, 1)), "
    "2 * int(substring(d, length(d) - i + 1, 1)) - IF(int(substring(d, length(d) - i + 1, 1)) > 4, 9, 0))) % 10 = 0"
)


def _digits(m: str = "x.m") -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str = "x.m") -> str:
    return "aggregate(array(" + _digits(m) + "), false, (ok, d) -> " + _LUHN + ")"


#: Whether a match of the base pattern is a base span.
VALID = {
    "email": "true",
    "ip": "NOT exists(split(x.m, '[.]'), o -> length(ltrim('0', o)) > 3 OR int(right(concat('000', ltrim('0', o)), 3)) > 255)",
    "card": f"length({_digits()}) BETWEEN 14 AND 19 AND IF(length({_digits()}) BETWEEN 14 AND 19, {_luhn()}, false)",
    "phone": f"length({_digits()}) BETWEEN 10 AND 15",
}


def scan(array: str, start: str, step: str, out: str, kind: str) -> str:
    """SQL array of out(a.st, x) for each element x of array, where a.st is start and then step(a.st, x). kind is out's type.

    An array that grows by one element is copied each time, so results are gathered in blocks: n elements cost n * BLOCK + (n / BLOCK)^2 copies rather than n^2.
    """
    return (
        f"flatten(aggregate(transform(sequence(0, (size({array}) - 1) div {BLOCK}), b -> transform(sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size({array})) - 1), i -> {array}[i])), "
        f"named_struct('st', {start}, 'out', cast(array() AS array<array<{kind}>>)), "
        f"(acc, block) -> transform(array(aggregate(block, named_struct('st', acc.st, 'out', cast(array() AS array<{kind}>)), "
        f"(a, x) -> named_struct('st', {step}, 'out', array_append(a.out, {out})))), r -> named_struct('st', r.st, 'out', array_append(acc.out, r.out)))[0], acc -> acc.out))"
    )


def _located(t: DataFrame, name: str) -> DataFrame:
    """t with l_name: structs (s, e, m, pre, post) of the matches m_name, from the pieces p_name between them."""
    m, p = f"m_{name}", f"p_{name}"
    t = t.withColumn(f"z_{name}", F.expr(f"IF(size({m}) > 0, arrays_zip({m}, {p}), NULL)"))
    starts = scan(f"z_{name}", "0", f"a.st + length(x.{p}) + coalesce(length(x.{m}), 0)", f"a.st + length(x.{p})", "int")
    t = t.withColumn(f"s_{name}", F.expr(f"IF(size({m}) > 0, {starts}, NULL)"))
    one = f"transform({m}, (m, i) -> named_struct('s', s_{name}[i], 'e', s_{name}[i] + length(m), 'm', m, 'pre', right({p}[i], {CONTEXT_CHARS}), 'post', left({p}[i + 1], 1)))"
    return t.withColumn(f"l_{name}", F.expr(f"IF(size({m}) > 0, {one}, cast(array() AS array<struct<s:int,e:int,m:string,pre:string,post:string>>))"))


def _votes(kind: str, base: str) -> str:
    """SQL struct of kind, place, base, votes and shapes for the span struct x."""
    n = f"length({_digits()})"
    vote = lambda yes, no="false": f"CASE WHEN {yes} THEN {FOR} WHEN {no} THEN {AGAINST} ELSE {ABSTAIN} END"
    gazetteer = {
        "email": vote(rf"x.m rlike '(?i)[.)\\]] ?(?:{ENDINGS})$'"),
        "ip": vote(r"x.m rlike '^(?:10|127|172|192)\\D'", r"x.m rlike '^0'"),
        "card": vote(f"{_digits()} rlike '{CARD_START}'", f"{_digits()} rlike '^[01789]'"),
        "phone": vote(f"x.m rlike '^[+]' AND {_digits()} rlike '{PHONE_START}'", f"{_digits()} rlike '^0{{3}}'"),
    }[kind]
    checksum = {
        "email": vote("length(x.m) BETWEEN 6 AND 254", "length(x.m) > 254"),
        "ip": vote(VALID["ip"] if base == "true" else "true", "x.m rlike '^0[.]0[.]'"),
        "card": vote(f"{n} BETWEEN 13 AND 19 AND IF({n} BETWEEN 13 AND 19, {_luhn()}, false)", "true"),
        "phone": vote(f"{n} BETWEEN 10 AND 15", "true"),
    }[kind]
    edges = vote("(x.pre = '' OR x.pre rlike '[\\\\s(:;,\\\"<>|=]$') AND (x.post = '' OR x.post rlike '^[\\\\s).:;,\\\"<>|!?]')", "x.pre rlike '[A-Za-z0-9_]$' OR x.post rlike '^[A-Za-z0-9_]'")
    near = NEAR[kind].replace("\\", "\\\\")
    return (
        f"named_struct('kind', {KINDS.index(kind)}, 's', x.s, 'e', x.e, 'base', {base}, "
        f"'strict', IF({base}, {FOR}, {ABSTAIN}), 'gazetteer', {gazetteer}, 'context', {vote(f'x.pre rlike {chr(39)}{near}{chr(39)}')}, 'edges', {edges}, 'checksum', {checksum}, "
        f"'length', least(length(x.m) div 4, 8), 'digits', least({n} div 2, 10), "
        f"'style', CASE WHEN x.m rlike '[ (]' THEN 1 WHEN x.m rlike '-' THEN 2 WHEN x.m rlike '@' THEN 3 ELSE 0 END, "
        f"'after', CASE WHEN x.post = '' THEN 0 WHEN x.post rlike '^\\\\s' THEN 1 WHEN x.post rlike '^[A-Za-z0-9]' THEN 2 ELSE 3 END)"
    )


def with_candidates(docs: DataFrame) -> DataFrame:
    """row (a struct of docs' columns) and found: an array of candidate structs (kind, s, e, base, the VOTERS, the SHAPES)."""
    t = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("pii_text"))
    gates = {"email": F.contains("pii_text", F.lit("@")), "phone": F.contains("pii_text", F.lit("+"))}
    none = F.array().cast("array<string>")
    for kind, pattern in BASE.items():
        found = F.regexp_extract_all("pii_text", F.lit(pattern), F.lit(0))
        if kind in ("ip", "card"):
            # Most texts have no digits at all beside words; the short test spares them the pattern.
            found = F.when(F.col("pii_text").rlike("[0-9]" if kind == "card" else "[0-9][.][0-9]"), found).otherwise(none)
        t = t.withColumn(f"m_{kind}", F.when(gates[kind], found).otherwise(none) if kind in gates else found)
    for kind, (pattern, needs) in LOOSE.items():
        gate = F.lit(False)
        for need in needs:
            gate = gate | F.contains("pii_text", F.lit(need))
        if kind == "phone":
            gate = F.col("pii_text").rlike("[0-9]{3}[ .-][0-9]{4}")
        t = t.withColumn(f"m_loose_{kind}", F.when(gate, F.regexp_extract_all("pii_text", F.lit(pattern), F.lit(0))).otherwise(none))
    for name, pattern in [*((k, p) for k, p in BASE.items()), *((f"loose_{k}", p) for k, (p, _) in LOOSE.items())]:
        t = t.withColumn(f"p_{name}", F.when(F.size(f"m_{name}") > 0, F.split("pii_text", pattern, -1)))
    for name in [*BASE, *(f"loose_{k}" for k in LOOSE)]:
        t = _located(t, name)
    parts = []
    for kind in KINDS:
        parts.append(f"transform(filter(l_{kind}, x -> {VALID[kind]}), x -> {_votes(kind, 'true')})")
    t = t.withColumn("pii_base", F.expr(f"concat({', '.join(parts)})"))
    more = [f"transform(filter(l_card, x -> length({_digits()}) BETWEEN 13 AND 19 AND NOT ({VALID['card']})), x -> {_votes('card', 'false')})"]
    more += [f"transform(l_loose_{kind}, x -> {_votes(kind, 'false')})" for kind in LOOSE]
    t = t.withColumn("pii_more", F.expr(f"concat({', '.join(more)})"))
    # A candidate stands apart from all base spans if those that begin before its end have ended by its start: one sweep over ends and starts in order.
    events = (
        "sort_array(concat(transform(pii_base, b -> named_struct('at', b.s, 'base', 1, 'i', -1, 'other', b.e)), "
        "transform(pii_more, (c, i) -> named_struct('at', c.e, 'base', 0, 'i', i, 'other', c.s))))"
    )
    both = "size(pii_base) > 0 AND size(pii_more) > 0"
    t = t.withColumn("events", F.expr(f"IF({both}, {events}, NULL)"))
    apart = scan("events", "-1", "IF(x.base = 1, greatest(a.st, x.other), a.st)", "IF(x.base = 0 AND a.st <= x.other, x.i, -1)", "int")
    kept = f"transform(filter({apart}, i -> i >= 0), i -> pii_more[i])"
    return t.select("row", F.expr(f"IF({both}, concat(pii_base, {kept}), concat(pii_base, pii_more))").alias("found"))


Model = dict[int, tuple[float, dict[str, dict[int, float]]]]


def fit(found: DataFrame, rounds: int = 30, belief: float = 10.0) -> Model:
    """By kind: the classifier's prior log-odds and its weight for each value of each vote and shape. found has found."""
    keys = ["kind", *VOTERS, *SHAPES]
    # One string for each candidate: were the fields taken one by one, the candidates would be looked for once for each.
    packed = F.transform("found", lambda c: F.concat_ws(",", *[c[k].cast("string") for k in keys]))
    counted = found.select(F.explode(packed).alias("c")).groupBy("c").count().collect()
    rows = [dict(zip(keys, map(int, r["c"].split(",")), strict=True)) | {"count": r["count"]} for r in sorted(counted)]
    hope = {True: (0.4, 0.5, 0.1), False: (0.4, 0.1, 0.5)}  # P(abstain, for, against) before any data
    model: Model = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        patterns: dict[tuple, int] = defaultdict(int)
        for r in own:
            patterns[tuple(r[v] for v in VOTERS)] += r["count"]
        table = {y: [hope[y]] * len(VOTERS) for y in hope}
        prior = 0.5

        def real(votes: tuple, prior: float, table: dict) -> float:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[True][i][v] / table[False][i][v]) for i, v in enumerate(votes))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

        for _ in range(rounds):
            counts = {y: [[belief * x for x in hope[y]] for _ in VOTERS] for y in hope}
            mass = {True: belief, False: belief}
            for votes, n in patterns.items():
                p = real(votes, prior, table)
                for y, q in ((True, p), (False, 1 - p)):
                    mass[y] += n * q
                    for i, v in enumerate(votes):
                        counts[y][i][v] += n * q
            prior = mass[True] / (mass[True] + mass[False])
            table = {y: [tuple(x / sum(c) for x in c) for c in counts[y]] for y in hope}
        weights: dict[str, dict[int, float]] = {v: {x: math.log(table[True][i][x] / table[False][i][x]) for x in (0, 1, 2)} for i, v in enumerate(VOTERS)}
        for shape in SHAPES:
            seen: dict[int, list[float]] = defaultdict(lambda: [belief, belief])
            for r in own:
                p = real(tuple(r[v] for v in VOTERS), prior, table)
                seen[r[shape]][0] += r["count"] * p
                seen[r[shape]][1] += r["count"] * (1 - p)
            good, bad = sum(x[0] for x in seen.values()) or 1.0, sum(x[1] for x in seen.values()) or 1.0
            weights[shape] = {x: max(-2.0, min(2.0, math.log(a / good) - math.log(b / bad))) for x, (a, b) in seen.items()}
        model[kind] = (math.log(prior / (1 - prior)), weights)
    return model


def accepted(model: Model, threshold: float = THRESHOLD) -> Column:
    """found less the candidates that the classifier turns down, by start, then kind."""

    def probability(c: Column) -> Column:
        odds = F.lit(0.0)
        for kind, (prior, weights) in model.items():
            score = F.lit(prior)
            for name, by_value in weights.items():
                term = F.lit(0.0)
                for value, w in by_value.items():
                    term = F.when(c[name] == value, F.lit(w)).otherwise(term)
                score = score + term
            odds = F.when(c["kind"] == kind, score).otherwise(odds)
        return 1 / (1 + F.exp(-odds))

    kept = F.filter("found", lambda c: c["base"] | (probability(c) >= threshold))
    return F.sort_array(F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"), c["base"].alias("base"))))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["s"], c["e"])))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets (of spans that overlap, the first), and n_chars, if it has that column, brought up to date."""
    found = with_candidates(docs)
    spans = found.select("row", accepted(fit(found)).alias("spans"))
    some = "size(spans) > 0"
    chunks = F.expr(rf"IF({some}, regexp_extract_all(row.text, '(?s).{{1,{CHUNK}}}', 0), NULL)")
    # Before each span that counts: its plain text, from the end of the last one; a span that begins earlier gives null.
    parts = scan("spans", "0", "IF(x.s < a.st, a.st, x.e)", "IF(x.s < a.st, NULL, named_struct('at', a.st, 's', x.s, 'e', x.e, 'kind', x.kind))", "struct<at:int,s:int,e:int,kind:int>")
    t = spans.withColumn("chunks", chunks).withColumn("parts", F.expr(f"IF({some}, filter({parts}, x -> x IS NOT NULL), NULL)"))
    joined = lambda lo, last: f"array_join(transform(sequence({lo} div {CHUNK}, {last}), i -> chunks[i]), '')"
    before = f"substring({joined('x.at', f'x.s div {CHUNK}')}, x.at % {CHUNK} + 1, x.s - x.at)"
    cut = f"transform(parts, x -> concat({before}, '<', element_at(array('EMAIL', 'IP', 'CARD', 'PHONE'), x.kind + 1), '>'))"
    end = "element_at(parts, -1).e"
    rest = f"IF({end} div {CHUNK} < size(chunks), substring({joined(end, 'size(chunks) - 1')}, {end} % {CHUNK} + 1), '')"
    text = F.expr(f"IF({some}, concat(array_join({cut}, ''), {rest}), row.text)")
    out = t.select("row", "spans", text.alias("redacted"))
    columns = []
    for f in docs.schema:
        own = F.col("row." + quoted(f.name))
        if f.name == "text":
            own = F.col("redacted")
        elif f.name == "n_chars":
            own = F.when(F.size("spans") > 0, F.length("redacted")).otherwise(own).cast(f.dataType)
        columns.append(own.alias(f.name))
    return out.select(*columns)


def op1_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = stage_table(with_candidates(docs).select(F.col("row.doc_id").alias("doc_id"), "found"), "pii-candidates")
    spans = found.withColumn("spans", accepted(fit(found)))
    base = F.filter("spans", lambda c: c["base"])
    count = lambda k: F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
