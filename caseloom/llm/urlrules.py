"""URL rules that follow redirects and canonical links.

A rule has a host and a path; it fits its host and all subdomains, if the path of the URL
starts with the rule's.  The longest fitting rule wins.  URLs that redirect to each other or
name each other as canonical are one class (connected components over the link table), and
a class passes its block decision on to members without a rule of their own, unless a member
is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import stage
from caseloom.llm.components import connected_components

# (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LINK_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://.*$"
OTHER_SCHEME = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:.*$"  # mailto: and the like


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest fitting rule (host and path together); null
    fields if none fits."""
    choice = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        own = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, own).otherwise(choice)
    return choice


def unescaped(text: Column) -> Column:
    """Ampersands of an attribute as they are meant."""
    return F.regexp_replace(F.trim(text), "&amp;|&#38;", "&")


def resolved(base: Column, target: Column) -> Column:
    """The absolute URL that a link of the page ``base`` means; null if it names no page.

    ``//host/x`` takes the scheme of the page, ``/x`` its host, ``?x`` its path, and ``x`` its
    folder, with ``.`` and ``..`` taken out; ``#x``, the empty link and other schemes name none.
    A page without ``://`` has no relative links.
    """
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    host = F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    site = F.concat(scheme, F.lit("://"), host)
    asked = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(
        F.concat(F.regexp_replace(path, r"(?s)[^/]*$", ""), F.when(F.contains(path, F.lit("/")), "").otherwise("/"), own)
    )
    parts = F.split(F.substring(whole, 2, 2**31 - 1), "/")
    plain = F.aggregate(
        F.slice(parts, 1, F.size(parts)), F.lit(""),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.regexp_replace(done, r"(?s)/[^/]*$", ""))
        .otherwise(F.concat(done, F.lit("/"), part)),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    relative = F.when(own == "", F.concat(site, path, asked)).otherwise(F.concat(site, plain, folder, asked))
    return (
        F.when(F.rlike(target, F.lit(ABSOLUTE)), target)
        .when((target == "") | F.startswith(target, F.lit("#")) | (F.locate("://", base) == 0), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.rlike(target, F.lit(OTHER_SCHEME)), None)
        .otherwise(relative)
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: each page and the URL that it names as canonical or refreshes to, made absolute."""

    def targets(tag: str, target: str) -> Column:
        tags = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(tag), F.lit(0))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))

    found = F.concat(targets(LINK_TAG, HREF), targets(REFRESH_TAG, TARGET))
    links = pages.where(F.col(url_col).isNotNull()).select(
        F.col(url_col).alias("a"), F.explode(F.transform(found, unescaped)).alias("target")
    )
    return links.select("a", resolved(F.col("a"), F.col("target")).alias("b")).where("b is not null")


def node(url: Column) -> Column:
    """What is asked of a server: the URL without its fragment, scheme and host in lower case."""
    host, _ = host_and_path(url)
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(plain, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host, rest)).otherwise(plain)


def judge(
    pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id",
    url_col: str = "url", html_col: str = "html", default: str = "allow",
) -> DataFrame:
    """``id_col, host, path, rule, verdict, component`` for every page.

    ``redirects`` may add links ``a, b`` (a redirect log).  A page with a rule has the rule's
    verdict.  A page without one is blocked if a member of its class has a block rule and none
    an allow rule; else ``default``.  Null URLs and URLs without ``://`` have empty host and
    path, and no aliases if null.  Repeated rows are judged alike; ``component`` is the
    smallest URL of the class, null for a page without aliases.  Very long pages are searched
    whole; no pages give no rows; other columns are ignored.
    """
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("a").cast("string"), F.col("b").cast("string")))
    links = stage(links.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")), "links")
    classes = connected_components(links)
    host, path = host_and_path(F.col("node"))
    decided = classes.select("component", best_rule(host, path, rules)["verdict"].alias("verdict"))
    verdicts = decided.groupBy("component").agg(
        F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed")
    )
    spread = classes.join(verdicts, "component").select(
        "node", "component", (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("blocked")
    )
    host, path = host_and_path(F.col(url_col))
    own = pages.select(
        F.col(id_col).alias("judged_id"), host.alias("host"), path.alias("path"), node(F.col(url_col)).alias("node")
    ).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    return own.join(spread, "node", "left").select(
        F.col("judged_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("blocked"), F.lit("block")), F.lit(default)).alias("verdict"),
        "component",
    )
