"""URL filters with redirect equivalence, in DataFrame operations only.

Rules decide a url by its host and path. Urls that redirect to each other or name each other as canonical are aliases:
distributed connected components over those links carry block decisions to aliases that no rule decides. An explicit
allow has precedence: a url that a rule allows stays allowed, and aliases of an allowed url are not blocked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import checkpoint, components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Where html names a redirect or canonical link, as regular expressions.
LINK_TAG = r"""<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
META_TAG = r"""<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
LINK_URL = r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
META_URL = r"""\burl\s*=\s*["']?([^"'\s>]+)"""


#: A url's host, path and query: what follows its first ://.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, n), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def node(url: Column) -> Column:
    """What aliases are: host, path and query; null without host."""
    whole = F.concat(host(url), path(url), _part(url, 3))
    return F.when(F.regexp_like(whole, F.lit("^[^/?]")), whole)


def decided(rules: list[tuple[str, str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. rules: (allow or block, host, path), a host with its subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    fits = [((host_ == h) | host_.endswith("." + h)) & path_.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda c, x: c.when(x[0], F.lit(x[1])), zip(fits, values, strict=True), F).otherwise(F.lit(None).cast("string")) if fits else F.lit(None).cast("string")
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def resolved(base: Column, href: Column) -> Column:
    """href as seen from the page at base."""
    begin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), href))
        .when(href.startswith("/"), F.concat(begin, href))
        .when(F.regexp_like(href, F.lit("^[#?]")), F.concat(begin, path(base), href))
        .otherwise(F.concat(begin, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls: pages and the redirect and canonical links in their html."""
    page = pages.where(F.col(html).contains("canonical") | F.lower(F.col(html)).contains("refresh") | F.lower(F.col(html)).contains("canonical"))
    said = lambda tag, inner: F.transform(F.regexp_extract_all(F.col(html), F.lit(f"(?is)({tag})")), lambda x: F.regexp_extract(x, f"(?is){inner}", 1))
    both = F.concat(said(LINK_TAG, LINK_URL), said(META_TAG, META_URL))
    found = page.select(F.col(url).alias("source"), F.explode(both).alias("href")).where("href != ''")
    return found.select("source", resolved(F.col("source"), F.col("href")).alias("target"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict): a row for each row of pages.

    rule: the longest that fits, as host and path, else null. verdict: the rule's; without one `block` if an alias is
    blocked by its rule and none is allowed by one, else `allow`. links: more redirects, as (source, target) urls, such
    as a crawler's log; a link's url counts by its own rule even if it is not among pages. A null url, or one without
    ://, has an empty host and path, no rule and no alias: it is allowed. Null html has no links. Repeated rows and null
    keys stay; an empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(key).alias(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), node(F.col(url)).alias("node"))
    rule, verdict = decided(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("own", verdict)
    edges = [page_links(pages, url, html)] if html else []
    edges += [links.select("source", "target")] if links is not None else []
    if not edges:
        return rows.select(key, "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    both = checkpoint(reduce(DataFrame.unionByName, edges))
    aliases = both.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")).where("a is not null and b is not null")
    found = checkpoint(components(aliases))
    _, verdict = decided(rules, F.regexp_extract("node", "^([^/?]*)", 1), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1))
    told = found.withColumn("v", verdict).groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    blocked = checkpoint(told.where("blocked and not coalesce(allowed, false)").select("component"))
    alias = checkpoint(found.join(blocked, "component").select("node", F.lit(True).alias("alias_blocked")))
    return rows.join(alias, "node", "left").select(key, "host", "path", "rule", F.coalesce("own", F.when(F.col("alias_blocked"), "block"), F.lit("allow")).alias("verdict"))
