"""URL rules, carried to aliases over redirect and canonical-link edges.

A rule (host, path) fits urls of its host and its subdomains whose path starts with the rule's; the
longest fitting rule decides. Urls that a page redirects to, or names as its canonical url, are its
aliases: connected components over these edges. A url without a rule of its own is blocked if some
alias is blocked by a rule, unless some alias is explicitly allowed: allow has precedence. A url with
a rule keeps that rule's verdict. Without a rule and without aliases a url is allowed.

Nodes are urls without their fragment, scheme and host in lower case. Edges may lead to urls that are
no page; rules judge these too.

Defined results: a NULL url, or one without '://', has an empty host and path, fits no rule and has no
aliases. Repeated rows are judged alike. NULL html has no links. Of two rules of equal length the one
with the longer host decides, then allow. No rows: an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import components, salted_lookup, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(like: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rows = [(v, h, p) for v, h, p in rules]
    return like.sparkSession.createDataFrame(rows, "verdict string, host string, path string")


def match(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and rule_verdict (NULL where none fits) to ``urls``.

    Rules meet the distinct hosts first, by equal host suffixes; a host then carries its few rules to
    its urls.
    """
    placed = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    hosts = placed.select("host").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = rules.select(
        F.col("host").alias("suffix"),
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("verdict") == "allow").alias("allows"),
            F.concat("host", "path").alias("rule"),
            F.col("path").alias("starts"),
        ).alias("fit"),
    ).distinct()
    each = hosts.select("host", F.explode(suffixes).alias("suffix")).join(named, "suffix")
    fits = stage(each.groupBy("host").agg(F.collect_list("fit").alias("fits")), "host-rules")
    found = salted_lookup(placed, fits, "host", [url, "path"])
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["starts"])))
    found = found.withColumn("best_", best)
    verdict = F.when(F.col("best_.allows"), "allow").when(~F.col("best_.allows"), "block")
    return found.withColumn("rule", F.col("best_.rule")).withColumn("rule_verdict", verdict).drop("fits", "best_")


def node_of(url: Column) -> Column:
    """The url as a node: without fragment, scheme and host in lower case; NULL if it is no url."""
    parts = lambda k: F.regexp_extract(F.trim(url), r"(?s)^([^:/?#]+://[^/?#]*)([^#]*)", k)
    return F.concat(F.nullif(lower(parts(1)), F.lit("")), parts(2))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.replace(F.trim(F.regexp_replace(found, r"^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&"))


def _resolved(link: Column, base: Column) -> Column:
    """A link as an absolute url; NULL if it leads to no page of its own."""
    plain = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.regexp_extract(plain, r"(?s)^([^:/?#]+://[^/]*/(?:.*/)?)", 1)
    before = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), "")
        .when(link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|#)"), None)
        .when(link.startswith("//"), F.regexp_extract(base, r"^([^:/?#]+:)//", 1))
        .when(link.startswith("/"), F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0))
        .when(link.startswith("?"), plain)
        .otherwise(F.coalesce(F.nullif(folder, F.lit("")), F.concat(plain, F.lit("/"))))
    )
    return F.concat(before, link)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): page and the url of its canonical link or meta refresh."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    tags = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    likely = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv") & F.col(url).isNotNull())
    # Few pages have such tags; written, they make short plans instead of one very long expression.
    each = stage(likely.select(F.col(url).alias("page"), F.explode(tags).alias("tag")), "link-tags")
    canonical = F.when(
        F.col("tag").rlike(r"(?i)^<link\b") & lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"),
        _attribute(F.col("tag"), "href"),
    )
    refresh = F.when(
        F.col("tag").rlike(r"(?i)^<meta\b") & (lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"),
        F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*[\"']?([^\"']+)", 1),
    )
    links = stage(each.select("page", F.trim(F.coalesce(canonical, refresh)).alias("link")), "links")
    links = links.where("link is not null and link <> ''")
    edges = links.select(node_of(F.col("page")).alias("a"), node_of(_resolved(F.col("link"), F.col("page"))).alias("b"))
    return stage(edges, "link-edges").where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and component (smallest alias, NULL without aliases) to ``pages``.

    ``edges``: (a, b) of urls, redirects and canonical links alike.
    """
    nodes = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a is not null and b is not null")
    groups = components(nodes, "a", "b")
    judged = match(groups.withColumnRenamed("node", "node_"), rules, "node_")
    flags = judged.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("rule_verdict") == "block"), F.lit(False)).alias("blocks_"),
        F.coalesce(F.bool_or(F.col("rule_verdict") == "allow"), F.lit(False)).alias("allows_"),
    )
    known = groups.join(flags, "component").withColumnRenamed("node", "node_")
    known = stage(known.select("node_", "component", "blocks_", "allows_"), "aliases")
    rows = salted_lookup(match(pages, rules, url).withColumn("node_", node_of(F.col(url))), known, "node_", [url, "path"])
    spread = F.when(F.col("blocks_") & ~F.col("allows_"), "block").otherwise("allow")
    verdict = F.coalesce("rule_verdict", spread)
    return rows.withColumn("verdict", verdict).drop("node_", "blocks_", "allows_", "rule_verdict")
