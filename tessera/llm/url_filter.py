"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled outcomes of pages (1 good, 0 bad) are counted per host, registered
domain and suffix. A suffix is the last label of a host, or one of the longer
``SUFFIXES``; the registered domain is the suffix with one more label; what
stands before an ``@`` or is a port counts for neither. A bare address is its
own domain, and all of them are under one suffix. Each
level's rate of bad pages is shrunk to the level above by a beta-binomial prior
whose strength comes from how much the rates of that level differ (method of
moments). A host is blocked if the lower posterior bound of its rate of bad
pages lies above ``limit``, by default the rate of all labelled pages: that is
a host which is worse than the others beyond chance. Hosts without labels
inherit their domain's, suffix's or overall rate and its prior.

Counts are partial aggregates, so a host with a third of all pages is one row
per task, the pages of frequent hosts are never shuffled, and the hosts of a
domain, or domains of a suffix, that has many are dealt out.

Cases: a null url, or one without ``://``, has empty host and path and is
judged by the overall rate; labels that are null are no outcome; repeated
pages and labels count each time; without labels every page is allowed; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, dealt, materialise

#: The rules of the contract (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which domains are registered.
SUFFIXES = (
    "ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.hk com.mx com.my com.pe com.ph com.pl "
    "com.sg com.tr com.tw com.ua com.ve com.vn edu.au edu.br edu.cn edu.tw go.jp gov.au gov.br gov.cn gov.in gov.uk ne.jp net.au net.br net.cn net.nz net.uk "
    "nhs.uk or.jp or.kr org.au org.br org.cn org.nz org.tw org.uk org.za"
).split()
#: The suffix that bare addresses are under.
ADDRESSES = "[address]"
BARE = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"
#: How many deviations the bound of a rate is off.
DEVIATIONS = 1.645
#: Bounds of the strength of a prior, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of rules equally long a block wins."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """A host without a user before it or a port behind."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column, suffixes: Sequence[str]) -> Column:
    name = name_of(host)
    last = F.substring_index(name, ".", -2)
    return F.when(name.rlike(BARE), F.lit(ADDRESSES)).when(last.isin(*suffixes), last).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str]) -> Column:
    name = name_of(host)
    long = F.substring_index(name, ".", -2).isin(*suffixes)
    return F.when(name.rlike(BARE), name).when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def strength(counts: DataFrame) -> DataFrame:
    """One row: the overall rate and the strength of the prior for rates in ``counts`` (n, bad)."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("xx"))
    rate = F.col("bad") / F.col("n")
    within = rate * (1 - rate)
    between = F.col("xx") / F.col("n") - rate * rate  # weighted variance of the rates
    extra = between - within * F.col("k") / F.col("n")
    raw = F.when(extra > 0, within / extra).otherwise(F.lit(STRONGEST))
    return total.select(F.coalesce(rate, F.lit(0.0)).alias("rate"), F.least(F.greatest(F.coalesce(raw, F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST)).alias("kappa"))


def reputation(labelled: DataFrame, hosts: DataFrame, limit: float | None = None, deviations: float = DEVIATIONS, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Verdicts by host: ``hosts`` (host, ...) with bad_rate, bound and by_host, from labelled outcomes (host, good)."""
    levels = {"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}
    own = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("good")).alias("bad"))
    own = materialise(own.withColumns(levels), "host-outcomes")
    domains = own.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix_counts = own.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    priors = [materialise(strength(x), "prior").first() for x in (suffix_counts, domains, own)]  # a row each
    top = priors[0].rate
    shrunk = lambda up, k: (F.coalesce(F.col("bad"), F.lit(0)) + k * up) / (F.coalesce(F.col("n"), F.lit(0)) + k)
    by_suffix = suffix_counts.select("suffix", shrunk(F.lit(top), priors[0].kappa).alias("suffix_rate"))
    rows = hosts.withColumns(levels)
    places = materialise(rows.groupBy("domain", "suffix").agg(F.count(F.lit(1)).alias("_hosts")), "domains")
    above = places.groupBy("suffix").agg(F.count(F.lit(1)).alias("_domains")).join(by_suffix, "suffix", "left")
    above = materialise(above.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(top))), "suffixes")
    found = dealt(places.join(domains.select("domain", "n", "bad"), "domain", "left"), above, ["suffix"], "_domains")
    prior = F.when(F.col("n").isNull(), F.col("suffix_rate")).otherwise(shrunk(F.col("suffix_rate"), priors[1].kappa))
    found = materialise(found.select("domain", "_hosts", prior.alias("prior")), "domain-priors")
    rows = dealt(rows.join(own.select("host", "n", "bad"), "host", "left"), found, ["domain"], "_hosts")
    prior = F.col("prior")
    kappa = priors[2].kappa
    size = F.coalesce(F.col("n"), F.lit(0)) + kappa
    rows = rows.withColumn("bad_rate", shrunk(prior, kappa))
    bound = F.col("bad_rate") - deviations * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (size + 1))
    verdict = F.when(F.col("bound") > (top if limit is None else limit), "block").otherwise("allow")
    return rows.withColumn("bound", bound).select(*hosts.columns, "bad_rate", "bound", verdict.alias("by_host"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float | None = None) -> DataFrame:
    """The verdict on each page: page_id, host, path, rule, verdict. ``labels`` holds (doc_id, quality) of pages by their id."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcomes = labels.filter("quality is not null").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    labelled = rows.select("page_id", "host").join(outcomes, "page_id")
    counts = materialise(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    hosts = materialise(reputation(labelled, counts, limit).select("host", "pages", "by_host"), "reputation")
    found = by_key(rows, hosts, "host", "pages")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host").alias("verdict"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, suffixes: Sequence[str] = SUFFIXES) -> str:
    """The same as DuckDB SQL."""
    cases = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')", h + p, v) for v, h, p in cases]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    level = lambda of, by: f"SELECT {by}, sum(n) AS n, sum(bad) AS bad FROM {of} GROUP BY ALL"
    moments = lambda t: (
        f"SELECT rate, least(greatest(CASE WHEN extra > 0 THEN rate * (1 - rate) / extra ELSE {STRONGEST} END, {WEAKEST}), {STRONGEST}) AS kappa FROM ("
        f"SELECT sum(bad) / sum(n) AS rate, sum(bad * bad / n) / sum(n) - rate * rate - rate * (1 - rate) * count(*) / sum(n) AS extra FROM {t})"
    )
    listed = ", ".join(f"'{x}'" for x in suffixes)
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
named AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u),
labels_of AS (SELECT host, name, regexp_matches(name, '{BARE}') AS bare, labels, CASE WHEN array_to_string(labels[-2:], '.') IN ({listed}) THEN 2 ELSE 1 END AS k FROM (SELECT *, string_split(name, '.') AS labels FROM named)),
parts AS (SELECT host, CASE WHEN bare THEN '{ADDRESSES}' ELSE array_to_string(labels[-k:], '.') END AS suffix, CASE WHEN bare THEN name ELSE array_to_string(labels[-(k + 1):], '.') END AS domain FROM labels_of),
own AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(1 - quality)::DOUBLE AS bad FROM u JOIN labels ON doc_id = page_id JOIN parts USING (host)
        WHERE quality IS NOT NULL GROUP BY ALL),
dom AS ({level("own", "domain, suffix")}), suf AS ({level("own", "suffix")}),
ps AS ({moments("suf")}), pd AS ({moments("dom")}), ph AS ({moments("own")}),
sr AS (SELECT suffix, (bad + ps.kappa * ps.rate) / (n + ps.kappa) AS suffix_rate FROM suf, ps),
dr AS (SELECT domain, (bad + pd.kappa * suffix_rate) / (n + pd.kappa) AS domain_rate FROM dom JOIN sr USING (suffix), pd),
hr AS (SELECT host, (coalesce(bad, 0) + ph.kappa * coalesce(domain_rate, suffix_rate, ps.rate)) / (coalesce(n, 0) + ph.kappa) AS r, coalesce(n, 0) + ph.kappa AS size, coalesce(ps.rate, 0) AS top
       FROM parts LEFT JOIN (SELECT host, n, bad FROM own) USING (host) LEFT JOIN dr USING (domain) LEFT JOIN sr USING (suffix), ph, ps)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({verdict}, CASE WHEN r - {DEVIATIONS} * sqrt(r * (1 - r) / (size + 1)) > top THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN hr USING (host)"""
