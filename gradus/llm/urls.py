"""URL filter with redirect equivalence, in DataFrame operations only.

A rule (action, host, path) fits its host and all subdomains where the URL's path starts with the
rule's; the longest fitting rule wins, allow before block at equal length. URLs are nodes of an
alias graph: spellings that servers redirect to one another (scheme, ``www.``/``m.``, trailing
slash, index page or ``.html``, fragment, tracking parameters) share a node, and canonical links,
meta refreshes and given redirects are edges. Distributed connected components make the alias
classes. A URL without a fitting rule takes its class's verdict: allow if any member is explicitly
allowed, else block if any member is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import save
from gradus.operators.cluster import cluster_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The common name of a URL's redirect spellings; null or not a URL: null."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index\.html?|\.html?|/+)$", "")
    query = F.regexp_extract(F.regexp_extract(url, r"(?s)^[^#]*", 0), r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|ref)(?:=|$)")), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def resolve(url: Column, ref: Column) -> Column:
    """An absolute URL for a reference found on a page."""
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?://)", 1), F.regexp_extract(url, SPLIT, 1)
    return (F.when(ref.contains("://"), ref).when(ref.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), ref))
            .when(ref.startswith("/"), F.concat(scheme, host, ref))
            .otherwise(F.concat(scheme, host, F.regexp_replace(path_of(url), r"[^/]*$", ""), F.lit(""), ref)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url) for every canonical link and meta refresh."""
    u, h = F.col(url), F.col(html)
    refs = F.concat(F.transform(F.regexp_extract_all(h, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
                    F.transform(F.regexp_extract_all(h, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, TARGET, 1)))
    found = pages.where(u.contains("://")).select(u.alias("from_url"), F.explode(refs).alias("ref")).where("ref <> ''")
    return found.select("from_url", resolve(F.col("from_url"), F.col("ref")).alias("to_url")).distinct()


def fitting_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, action, rule) of the URLs that a rule fits. ``urls``: distinct (url, host, path).
    Each host meets the rules by its own suffixes, in one equi-join, so the rule list may be long;
    the rules are a written table, broadcast only below the measured size threshold."""
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "action")
    hits = (urls.select("url", "path", F.explode(suffix).alias("suffix")).join(rules, "suffix")
            .where(F.col("path").startswith(F.col("rule_path"))))
    best = F.max(F.struct((F.length("suffix") + F.length("rule_path")).alias("n"), (F.col("action") == "allow").alias("allow"),
                          F.concat("suffix", "rule_path").alias("rule"), "action"))
    return hits.groupBy("url").agg(best.alias("b")).select("url", "b.action", "b.rule")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None,
                page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (see the module's text).

    A null URL or one without ``://`` has empty host and path, fits no rule, has no aliases and is
    allowed. Null or empty html has no links. Repeated rows get the same verdict each; other
    columns of the input don't matter. Empty pages give an empty result."""
    spark = pages.sparkSession
    r = save(spark.createDataFrame(rules, "action string, host string, path string"), "url-rules")
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url").where("from_url is not null and to_url is not null"))
    links = save(links, "url-links")
    edges = links.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")).where("u is not null and v is not null")
    nodes = edges.where("u <> v").select(F.explode(F.array("u", "v")).alias("id"))
    comp = cluster_components(nodes, edges.toDF("id", "rep")).toDF("component", "node")
    seen = pages.select(F.col(url).alias("url")).where(F.col("url").contains("://")).union(links.select("to_url")).distinct()
    seen = seen.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = save(fitting_rule(seen, r), "url-ruled")
    decided = (ruled.select(node_of(F.col("url")).alias("node"), (F.col("action") == "allow").alias("allow"))
               .groupBy("node").agg(F.max("allow").alias("allow")))
    decided = (decided.join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("class"))
               .agg(F.max("allow").alias("class_allow")))
    members = comp.select("node", F.col("component").alias("class")).join(decided, "class").select("node", "class_allow")
    alone = decided.join(comp, decided["class"] == comp["node"], "left_anti").select(F.col("class").alias("node"), "class_allow")
    by_node = members.union(alone)
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    p = p.join(ruled, "url", "left").withColumn("node", node_of(F.col("url"))).join(by_node, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("class_allow"), F.lit("allow")).when(~F.col("class_allow"), F.lit("block")), F.lit("allow"))
    return p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", verdict.alias("verdict"))
