"""Links, urls and commands: vetting, discovery, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X

# Words and hosts that speak for a demonstration page, what each adds, and the least sum that counts.
KEYWORDS = ("demo", "live", "preview", "playground", "在线演示", "在线预览", "演示地址", "体验地址", "线上演示", "访问演示", "预览地址", "try it", "homepage")
HOSTS = ("github.io", "gitee.io", "vercel.app", "netlify.app", "pages.dev", "surge.sh", "herokuapp.com", "web.app", "firebaseapp.com")
LABEL_WORDS = "demo|演示|预览|live|体验"
REPOSITORY = r"^https?://(www\.)?github\.com/[^/]+/[^/]+/?$"
KEYWORD, HOST, LABEL, SAME, REPO, RAW, MIRROR, LOCAL = 3, 6, 8, -20, -12, -8, -4, -15
LEAST = 5


def vetted(urls: DataFrame, allowed: tuple[str, ...] = L.ALLOWED_HOSTS, url: str = "url") -> DataFrame:
    """Urls with accepted and the reason of a rejection; name look-ups are left to the network."""
    raw = F.trim(F.col(url))
    authority = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    sensitive = reduce(lambda a, b: a | b, (host.endswith(s) for s in L.SENSITIVE_SUFFIXES), host.isin(*L.SENSITIVE_HOSTS))
    listed = reduce(lambda a, b: a | b, (host.endswith("." + h) for h in allowed), host.isin(*allowed))
    reason = (
        F.when(F.coalesce(raw, F.lit("")) == "", "blank")
        .when(~F.lower(raw).rlike("^https?://"), "scheme")
        .when(F.contains(authority, F.lit("@")), "user")
        .when(~port.isin("", "80", "443"), "port")
        .when(host == "", "host")
        .when(sensitive, "sensitive")
        .when(~listed, "not allowed")
    )
    return urls.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def screened(commands: DataFrame, command: str = "command") -> DataFrame:
    """Commands with allowed and the reason of a refusal."""
    c = F.col(command)
    denied = reduce(lambda a, b: a | b, (F.lower(c).rlike(p) for p in L.DENIED_COMMANDS))
    urls = F.regexp_extract_all(c, F.lit(r"(?i)https?://[^\s\"']+"), F.lit(0))
    remote = F.exists(urls, lambda u: ~u.rlike(r"(?i)https?://(localhost|127\.0\.0\.1)([:/]|$)"))
    reason = F.when(F.coalesce(F.trim(c), F.lit("")) == "", "blank").when(F.length(c) > L.MAX_COMMAND, "long").when(denied, "dangerous").when(remote, "network")
    return commands.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def in_pages(pages: DataFrame) -> DataFrame:
    """Links of pages (page_id, html): (page_id, nth, url, label), urls absolute."""
    pairs = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(pairs).alias("nth", "link"))
    return rows.select("page_id", "nth", F.regexp_extract("link", r'href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_extract("link", r">([^<]*)</a>", 1)).alias("label"))


def in_markdown(lines: DataFrame) -> DataFrame:
    """Markdown links of every line, and plain urls of lines that speak of a demo: lines (doc_id, line, text)."""
    md = F.transform(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(https?://[^)\s]+\)"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"\((.*)\)$", 1).alias("url"), F.trim(F.regexp_extract(x, r"^\[([^\]]*)\]", 1)).alias("label")))
    plain = F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s<>\"'\])]+"), F.lit(0)), lambda x: F.struct(x.alias("url"), F.lit("").alias("label")))
    about = F.lower("text").rlike("demo|live")
    found = F.concat(md, F.when(about, plain).otherwise(F.filter(plain, lambda x: F.lit(False))))
    rows = lines.select("doc_id", "line", "text", F.explode(found).alias("x"))
    return rows.select("doc_id", "line", "text", F.regexp_replace("x.url", "[),.;]+$", "").alias("url"), "x.label")


def score(links: DataFrame, line: str = "text", source: str | None = None) -> DataFrame:
    """Links with a score that adds words, hosts and penalties; ``source`` names a column with the address of the link's own repository."""
    every = F.lower(F.concat_ws(" ", "label", line, "url"))
    low = F.lower("url")
    point = lambda c, n: F.when(c, n).otherwise(0)
    terms = [point(every.contains(k), KEYWORD) for k in KEYWORDS] + [point(low.contains(h), HOST) for h in HOSTS]
    terms += [point(F.lower("label").rlike(LABEL_WORDS), LABEL), point(low.rlike(REPOSITORY), REPO)]
    terms += [point(low.contains("raw.githubusercontent.com") | low.contains("/raw/"), RAW), point(low.contains("gitee.com") & ~low.contains("gitee.io"), MIRROR), point(low.rlike("localhost|127\\.0\\.0\\.1"), LOCAL)]
    if source is not None:
        own = X.repo_key(F.col("url"))
        terms.append(point(F.coalesce((own != "") & (own == X.repo_key(F.col(source))), F.lit(False)), SAME))
    return links.withColumn("score", reduce(lambda a, b: a + b, terms))


def best(links: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """Per key the link with the highest score, then the longest label, then the first url; scores under ``least`` are out."""
    rows = links.filter(F.col("score") >= least)
    order = F.struct("score", F.length("label").alias("n"))
    top = rows.groupBy(key).agg(F.max(order).alias("m"))
    rows = rows.join(top, key).filter((F.col("score") == F.col("m.score")) & (F.length("label") == F.col("m.n")))
    return rows.groupBy(key).agg(F.min(F.struct("url", "label", "score")).alias("b")).select(key, "b.*")


def repository_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.withColumn("repo_key", X.repo_key(F.col(url)))
