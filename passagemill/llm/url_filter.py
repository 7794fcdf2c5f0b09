"""URL filter: allow and block rules first, host reputation for the rest.

A page whose url ends its path in a document number that labels covers is a
labelled outcome of its host: bad if that document is toxic or of low quality. A
host's share of bad pages is a beta-binomial posterior whose prior comes from
its registered domain, the domain's from its public suffix and the suffix's from all
pages. Prior strengths are fitted by moments over the children at each level. A
page is blocked when the lower posterior bound of its host, a quantile of its beta
distribution, passes a limit.

Null urls and urls without :// have empty host and path, match no rule and have
the reputation of the empty host. Unlabelled hosts, and an empty labels table,
fall back to their parents' prior. Repeated rows count as often as they occur.
Urls of any length are read whole; other columns of pages and labels are not read,
so their names clash with nothing. Hosts are counted and staged once; a host of
many pages is joined without meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import hot_join, stage_table

#: (verdict, host and path), as the query's contract gives them.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels are general second levels below a country's (as in co.uk); what an address looks like.
SUFFIX = r"(?:ac|co|com|edu|go|gov|gob|gouv|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}|[^.]*"
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$"
#: Limit on a host's share of bad pages, normal quantile of the posterior bound (a tenth lies below it), bounds of a prior's strength (in pages), the most where there are too few children to fit it.
MAX_BAD, BOUND_Z, MIN_STRENGTH, MAX_STRENGTH, NO_STRENGTH = 0.3, 1.2816, 1.0, 200.0, 10.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def with_levels(df: DataFrame) -> DataFrame:
    """df with suffix (the public suffix of host: a general second level before a country's, or the last label) and domain (the suffix with the label before it). A port counts for neither; an address is a domain of its own, below the suffix of addresses."""
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    address = bare.rlike(ADDRESS)
    suffix = F.regexp_extract(bare, rf"(?:^|\.)({SUFFIX})$", 1)
    domain = F.regexp_extract(bare, rf"((?:[^.]*\.)?(?:{SUFFIX}))$", 1)
    return df.withColumn("domain", F.when(address, bare).otherwise(domain)).withColumn("suffix", F.when(address, F.lit("address")).otherwise(suffix))


def _shrink(parent_mean: str, strength: str) -> Column:
    return (F.col("bad") + F.col(strength) * F.col(parent_mean)) / (F.col("n") + F.col(strength))


def _strength(children: DataFrame, by: list[str]) -> DataFrame:
    """Strength of the prior that the children of each parent share, by moments: the between-child variance of their shares beyond what binomial noise gives; null with under three children, or with one page each."""
    share = F.col("bad") / F.col("n")
    c = children.filter("n > 0")
    g = c.groupBy(*by) if by else c.groupBy()
    m = g.agg(F.avg(share).alias("p"), F.count("*").alias("k"), F.var_pop(share).alias("var"), F.avg(1 / F.col("n")).alias("inv"))
    p = F.col("p")
    between = (F.col("var") - p * (1 - p) * F.col("inv")) / F.when(F.col("inv") < 1, 1 - F.col("inv"))
    s = F.when((F.col("k") < 3) | (F.col("inv") >= 1), F.lit(None).cast("double")).when(between <= 0, F.lit(MAX_STRENGTH)).otherwise(F.least(F.greatest(p * (1 - p) / between - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)))
    return m.select(*by, s.alias("strength"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """By host of hosts: rows (how many of hosts), n, bad, mean and weight (pages seen and those of the prior) of the posterior share of bad pages. outcomes: host, bad (0 or 1)."""
    counts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    h = with_levels(hosts.groupBy("host").agg(F.count("*").alias("rows")).join(counts, "host", "left").fillna(0, ["n", "bad"]))
    h = stage_table(h, "hosts")
    domains = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 10)).alias("all_mean"))
    # Without a strength of its own a child leans on its parent's posterior, and knows no more than that does.
    given = lambda weight: F.coalesce("strength", F.least(F.lit(NO_STRENGTH), weight)).alias("strength")
    s = suffixes.crossJoin(overall).crossJoin(_strength(suffixes, [])).withColumn("strength", given(F.lit(NO_STRENGTH)))
    s = s.select("suffix", _shrink("all_mean", "strength").alias("suffix_mean"), (F.col("n") + F.col("strength")).alias("suffix_weight"))
    d_strength = _strength(domains, ["suffix"])
    d = domains.join(s, "suffix").join(d_strength, "suffix", "left").withColumn("strength", given(F.col("suffix_weight")))
    d = d.select("suffix", "domain", _shrink("suffix_mean", "strength").alias("domain_mean"), (F.col("n") + F.col("strength")).alias("domain_weight"))
    h_strength = _strength(h, ["suffix", "domain"])
    x = h.join(d, ["suffix", "domain"]).join(h_strength, ["suffix", "domain"], "left").withColumn("strength", given(F.col("domain_weight")))
    mean, weight = _shrink("domain_mean", "strength"), F.col("n") + F.col("strength")
    return x.select("host", "rows", "n", "bad", mean.alias("mean"), weight.alias("weight"))


def beta_score(x: float) -> Column:
    """The normal score of x in the beta distribution with the columns mean and weight, by the cube-root approximation (Abramowitz and Stegun 26.5.22)."""
    a, b = F.greatest(F.col("mean") * F.col("weight"), F.lit(1e-3)), F.greatest((1 - F.col("mean")) * F.col("weight"), F.lit(1e-3))
    u, v = F.cbrt(b * x), F.cbrt(a * (1 - x))
    return 3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / F.sqrt(u * u / b + v * v / a)


def filter_urls(pages: DataFrame, outcomes_of: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, bad_mean and bad_score (the normal score of the limit in the host's posterior). outcomes_of: labelled documents (doc_id, quality, toxic)."""
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    marks = outcomes_of.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad.cast("long")).alias("bad"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    outcomes = p.withColumn("doc_id", number.try_cast("long")).filter("doc_id IS NOT NULL").join(marks, "doc_id").select("host", "bad")
    reputation = stage_table(host_reputation(outcomes, p), "host-reputation")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    score = beta_score(MAX_BAD)
    own = F.when(score < -BOUND_Z, F.lit("block")).otherwise(F.lit("allow"))
    return hot_join(p.drop("url"), reputation, ["host"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("mean", 9).alias("bad_mean"), F.round(score, 9).alias("bad_score"))


def op5_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
marks AS (
  SELECT doc_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::BIGINT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
outcomes AS (
  SELECT host, bad FROM p JOIN marks ON try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1), '') AS BIGINT) = marks.doc_id),
counts AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM outcomes GROUP BY host),
h AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, 
    CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare ELSE regexp_extract(bare, '((?:[^.]*\.)?(?:{SUFFIX}))$', 1) END AS domain,
    CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN 'address' ELSE regexp_extract(bare, '(?:^|\.)({SUFFIX})$', 1) END AS suffix
  FROM (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS bare FROM p) LEFT JOIN counts USING (host)),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
whole AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 10) AS mean FROM s),
ms AS (SELECT 1 AS one, avg(bad / n) AS p, count(*) AS k, var_pop(bad / n) AS var, avg(1 / n) AS inv FROM s WHERE n > 0),
md AS (SELECT suffix, avg(bad / n) AS p, count(*) AS k, var_pop(bad / n) AS var, avg(1 / n) AS inv FROM d WHERE n > 0 GROUP BY ALL),
mh AS (SELECT suffix, domain, avg(bad / n) AS p, count(*) AS k, var_pop(bad / n) AS var, avg(1 / n) AS inv FROM h WHERE n > 0 GROUP BY ALL),
ss AS (SELECT CASE WHEN k < 3 OR inv >= 1 THEN 10.0 WHEN var - p * (1 - p) * inv <= 0 THEN 200.0 ELSE least(greatest(p * (1 - p) * (1 - inv) / (var - p * (1 - p) * inv) - 1, 1.0), 200.0) END::DOUBLE AS w FROM ms),
sd AS (SELECT suffix, CASE WHEN k < 3 OR inv >= 1 THEN NULL WHEN var - p * (1 - p) * inv <= 0 THEN 200.0 ELSE least(greatest(p * (1 - p) * (1 - inv) / (var - p * (1 - p) * inv) - 1, 1.0), 200.0) END::DOUBLE AS w FROM md),
sh AS (SELECT suffix, domain, CASE WHEN k < 3 OR inv >= 1 THEN NULL WHEN var - p * (1 - p) * inv <= 0 THEN 200.0 ELSE least(greatest(p * (1 - p) * (1 - inv) / (var - p * (1 - p) * inv) - 1, 1.0), 200.0) END::DOUBLE AS w FROM mh),
sm AS (SELECT suffix, (bad + w * mean) / (n + w) AS mean, n + w AS weight FROM s, whole, ss),
dw AS (SELECT d.suffix, d.domain, bad, n, mean, coalesce(w, least(10, weight)) AS w FROM d JOIN sm USING (suffix) LEFT JOIN sd USING (suffix)),
dm AS (SELECT suffix, domain, (bad + w * mean) / (n + w) AS mean, n + w AS weight FROM dw),
hw AS (SELECT h.host, bad, n, mean, coalesce(w, least(10, weight)) AS w FROM h JOIN dm USING (suffix, domain) LEFT JOIN sh USING (suffix, domain)),
hm0 AS (SELECT host, (bad + w * mean) / (n + w) AS mean, n + w AS weight FROM hw),
hm1 AS (SELECT host, greatest(mean * weight, 1e-3)::DOUBLE AS a, greatest((1 - mean) * weight, 1e-3)::DOUBLE AS b FROM hm0),
hm2 AS (SELECT *, cbrt(b * 0.3::DOUBLE) AS u, cbrt(a * 0.7::DOUBLE) AS v FROM hm1),
hm AS (SELECT host, 3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / sqrt(u * u / b + v * v / a) AS score FROM hm2),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN score < -1.2816 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r JOIN hm ON r.host = hm.host
"""
