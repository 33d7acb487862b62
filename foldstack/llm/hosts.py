"""URL filters: listed rules first, empirical-Bayes host reputation for the rest.

Labelled pages are counted per host once; registered domains and suffixes are sums of these counts. Every level has a
beta-binomial prior: its mean is the posterior mean of the level above, its strength comes from how far the shares of
that level spread around their parents (moments). So a host of few labels leans on its registered domain, that on
its suffix, that on all pages. A host is blocked when a lower bound of its posterior share of bad pages reaches a limit.

The bound is Cantelli's: whatever the posterior's shape, the share lies above ``mean - sd * sqrt((1 - risk) / risk)``
with probability ``1 - risk`` at least.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, store


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Suffixes of two labels; every other suffix is a host's last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Share of bad pages from which a host is blocked, and the risk that the bound is wrong.
LIMIT, RISK = 0.5, 0.05
#: Bounds of the correlation of outcomes inside a group, from which a prior's strength is ``1 / rho - 1``.
RHO_LEAST, RHO_MOST = 0.001, 0.5
#: A host of more than one in so many pages is hot; there are at most so many of them, and these are broadcast.
HOT = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/ ? #``, A-Z lower-cased; empty for null and without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The label before the suffix with the suffix; a user part and a port do not count, an address stands for itself."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last = F.substring_index(bare, ".", -2)
    two = F.substring_index(bare, ".", -3)
    address = bare.rlike(r"^[0-9]+([.][0-9]+){3}$") | bare.startswith("[")
    return F.when(address, bare).when(last.isin(list(suffixes)), two).otherwise(last)


def suffix_of(domain: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """What follows a registered domain's first label; an address has the empty suffix."""
    address = domain.rlike(r"^[0-9]+([.][0-9]+){3}$") | domain.startswith("[")
    two = F.substring_index(domain, ".", -2)
    return F.when(address, "").when(two.isin(list(suffixes)), two).otherwise(F.substring_index(domain, ".", -1))


def _strength(groups: DataFrame) -> Column:
    """Prior strength of a level of ``(n, bad, prior)``: moments of a beta-binomial around each group's own prior."""
    spread = F.col("prior") * (1 - F.col("prior"))
    residual = F.sum(F.when(spread > 0, (F.col("bad") - F.col("n") * F.col("prior")) ** 2 / spread).otherwise(0.0))
    rho = F.try_divide(residual - F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1)))
    bounded = F.greatest(F.lit(RHO_LEAST), F.least(F.lit(RHO_MOST), F.coalesce(rho, F.lit(RHO_MOST))))
    return F.lit(groups.agg((1 / bounded - 1).alias("strength")).first()["strength"])


def _posterior(groups: DataFrame) -> DataFrame:
    """``groups (.., n, bad, prior)`` with the level's strength and the posterior mean of each."""
    strength = _strength(groups)
    mean = (strength * F.col("prior") + F.col("bad")) / (strength + F.col("n"))
    return groups.withColumn("strength", strength).withColumn("mean", mean)


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, domain, suffix, n_pages, n, bad, mean, low)`` of every host of ``pages (page_id, host, path)``.

    ``outcomes (page_id, bad)`` labels some pages, ``bad`` being true or false. Each level's counts are sums over the
    level below, so a hot host is one combined row per task. Without any outcome the mean is one half everywhere.
    """
    marks = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = pages.join(marks, "page_id", "left")
    counts = known.groupBy("host").agg(
        F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.count_if("bad").alias("bad")
    )
    domain = registered_domain(F.col("host"))
    hosts = store(counts.withColumn("domain", domain).withColumn("suffix", suffix_of(F.col("domain"))), "hosts-counts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = store(hosts.groupBy("domain", "suffix").agg(*sums), "hosts-domains")
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    everywhere = (total["bad"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    suffixes = store(_posterior(suffixes.withColumn("prior", F.lit(everywhere))), "hosts-suffixes")
    above = suffixes.select("suffix", F.col("mean").alias("prior"))
    domains = store(_posterior(domains.join(above, "suffix")), "hosts-shrunk")
    above = domains.select("domain", F.col("mean").alias("prior"))
    rated = _posterior(hosts.join(above, "domain"))
    alpha, size = F.col("mean"), F.col("strength") + F.col("n")
    deviation = F.sqrt(alpha * (1 - alpha) / (size + 1))
    low = F.greatest(F.lit(0.0), F.col("mean") - F.lit(sqrt((1 - RISK) / RISK)) * deviation)
    return rated.select("host", "domain", "suffix", "n_pages", "n", "bad", "mean", low.alias("low"))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct ``(rule, verdict)``, else null.

    A rule fits its host and all subdomains where the path starts with the rule's. The rules are a list the caller
    holds, tried from the longest down, so the first that fits decides.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, chosen).otherwise(found)
    return found


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``(page_id, host, path, rule, verdict, mean, low)`` per row of ``pages``.

    The longest fitting rule decides; other pages are blocked where the lower bound of their host's share of bad pages
    reaches ``LIMIT``. A null url has an empty host and path, and so a reputation shared with others like it; a null
    id is a page without outcome; repeated rows are judged one by one and count in ``n_pages``; several outcomes of
    one page count once, bad if any is. An empty table gives none, and other columns do not matter. Rows of one hot
    host are never brought together: hot hosts, at most ``HOT``, are broadcast, the others are joined by host.
    """
    link = F.col(f"`{url}`")
    rows = store(narrow(pages, page_id=page_id, host=host_of(link), path=path_of(link)), "hosts-pages")
    rated = store(reputation(rows, outcomes), "hosts-rated")
    total = rated.agg(F.sum("n_pages")).first()[0] or 0
    scores = rated.select("host", "n_pages", "mean", "low")
    is_hot = F.col("n_pages") * HOT > total
    hot = F.broadcast(scores.filter(is_hot).drop("n_pages"))  # fewer than HOT rows
    cold = scores.filter(~is_hot).drop("n_pages")
    joined = rows.join(hot, "host").unionByName(rows.join(hot, "host", "left_anti").join(cold, "host"))
    found = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") >= LIMIT, "block").otherwise("allow")
    return joined.withColumn("found", found).select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", own).alias("verdict"),
        "mean",
        "low",
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """``(page_id, bad)``: a page is the page of the document of the same id; bad is of low quality or toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = F.coalesce(F.col("quality"), F.col("toxic")).isNotNull()
    return narrow(labels.filter(known), page_id="doc_id", bad=bad)


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(pages, page_outcomes(labels)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages
), placed AS (
  SELECT page_id,
         CASE WHEN mark = 0 THEN '' ELSE translate(regexp_extract(substr(url, mark + 3), '^[^/?#]*', 0),
              '{_UPPER}', '{_LOWER}') END AS host,
         CASE WHEN mark = 0 THEN '' ELSE regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM cut
), marks AS (
  SELECT doc_id AS page_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad
  FROM labels WHERE coalesce(quality, toxic) IS NOT NULL GROUP BY doc_id
), counts AS (
  SELECT host, count(bad) AS n, count(*) FILTER (bad) AS bad FROM placed LEFT JOIN marks USING (page_id) GROUP BY host
), labelled AS (
  SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM counts
), hosts AS (
  SELECT host, n, bad, array_to_string(parts[-2:], '.') AS domain, parts[-1] AS suffix FROM labelled
), domains AS (
  SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, CASE WHEN sum(sum(n)) OVER () = 0 THEN 0.5
         ELSE (sum(sum(bad)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) END AS prior FROM domains GROUP BY suffix
), s1 AS (
  SELECT 1 / greatest({RHO_LEAST}, least({RHO_MOST}, coalesce((sum((bad - n * prior) ** 2 / (prior * (1 - prior))) - sum(n))
         / nullif(sum(n * (n - 1)), 0), {RHO_MOST}))) - 1 AS strength FROM suffixes
), p1 AS (
  SELECT suffix, (strength * prior + bad) / (strength + n) AS prior FROM suffixes, s1
), d AS (
  SELECT domains.*, prior FROM domains JOIN p1 USING (suffix)
), s2 AS (
  SELECT 1 / greatest({RHO_LEAST}, least({RHO_MOST}, coalesce((sum((bad - n * prior) ** 2 / (prior * (1 - prior))) - sum(n))
         / nullif(sum(n * (n - 1)), 0), {RHO_MOST}))) - 1 AS strength FROM d
), p2 AS (
  SELECT domain, (strength * prior + bad) / (strength + n) AS prior FROM d, s2
), h AS (
  SELECT hosts.*, prior FROM hosts JOIN p2 USING (domain)
), s3 AS (
  SELECT 1 / greatest({RHO_LEAST}, least({RHO_MOST}, coalesce((sum((bad - n * prior) ** 2 / (prior * (1 - prior))) - sum(n))
         / nullif(sum(n * (n - 1)), 0), {RHO_MOST}))) - 1 AS strength FROM h
), p3 AS (
  SELECT host, n, strength, (strength * prior + bad) / (strength + n) AS mean FROM h, s3
), low AS (
  SELECT host, mean - sqrt({1 - RISK} / {RISK}) * sqrt(mean * (1 - mean) / (strength + n + 1)) AS low FROM p3
), fit AS (
  SELECT placed.*, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM placed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN low >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM fit JOIN low USING (host)
"""
