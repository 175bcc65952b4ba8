"""URL filters that follow redirects and canonical links, in DataFrame functions alone.

Rules judge urls by host and path. A page's aliases are the pages joined to it by redirects and
canonical links, over any number of steps: the connected components of the graph of both, whose nodes are
urls without what names no other page (scheme, fragment, tracking parameters). A block reaches all
aliases that no rule judges, unless one of them is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.components import components
from faultgrain.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# The rules of the query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; allow wins between two of one length."""
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in order
    ]
    return F.coalesce(*fits)


# Query parameters that only say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)"


def key_of(url: Column) -> Column:
    """What all spellings of one page's url share: host, path (the root's if empty) and query; null without a host.

    Scheme, fragment and the parameters of TRACKING name no other page; everything else may.
    """
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    named = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(named != "", F.concat(F.lit("?"), named)).otherwise("")))


def _without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` steps taken, from the root at most."""
    empty = F.array().cast("array<string>")
    steps = F.split(F.when(path.rlike(r"(?s)/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path), "/")
    taken = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
        empty,
        lambda done, step: F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(step == ".", done)
        .otherwise(F.concat(done, F.array(step))),
    )
    return F.concat(F.lit("/"), F.array_join(taken, "/"))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as seen from ``url``: with scheme, from the host's root, from the page's folder or the page itself; other schemes are no page."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    stem, tail = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)", 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, _without_dots(stem), tail))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(stem == "", F.concat(root, path_of(url), tail))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, stem)), tail))
    )


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1)


CANONICAL = r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*["']?([^"'>\s]+)"""


def alias_links(pages: DataFrame) -> DataFrame:
    """``a, b, target``: keys of pages and of the pages they redirect to or name as canonical, and the latter's full url.

    All such tags of a page count.
    """
    html, url = F.col("html"), F.col("url")
    canonical = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(1)), lambda tag: _attribute(tag, "href"))
    targets = F.concat(canonical, F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1)))
    linked = pages.select(url, F.explode(targets).alias("link")).filter("link != ''")
    linked = linked.select(url, _absolute(F.col("link"), url).alias("target"))
    return linked.select(key_of(url).alias("a"), key_of(F.col("target")).alias("b"), "target").dropna()


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every page's ``page_id, host, path, rule, verdict, alias_of``.

    A rule's verdict stands; rules judge the pages and the targets of their links, be they pages of the table or not. A page that no rule fits is blocked if an alias is blocked and none
    is explicitly allowed, else allowed. ``alias_of`` is the smallest url key of its aliases. Null urls and urls
    without ``://`` have no host, no path, no rule and no alias, and are allowed. Rows of one page_id
    stay apart; rows without page_id keep it null. An empty table gives no rows.
    """
    url = F.col("url")
    read = pages.select("page_id", "url", "html")
    judged = read.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("node")
    ).withColumn("fit", matched(F.col("host"), F.col("path"), rules))
    judged = materialize(judged, "judged-urls")
    links = materialize(alias_links(read), "alias-links")
    found = components(links.select("a", "b"))
    verdict = F.col("fit.verdict")
    # A target need not be a page of the table to carry a verdict.
    target = matched(host_of(F.col("target")), path_of(F.col("target")), rules)
    known = judged.select("node", "fit").union(links.select("b", target)).filter("node IS NOT NULL")
    by_node = known.groupBy("node").agg(
        F.max(verdict == "allow").alias("allowed"), F.max(verdict == "block").alias("blocked")
    )
    named = by_node.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    decided = named.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    spread = named.select("node", "component").join(decided, "component")
    block = F.coalesce(F.col("blocked"), F.lit(False)) & ~F.coalesce(F.col("allowed"), F.lit(False))
    spread = spread.select("node", "component", F.when(block, "block").otherwise("allow").alias("spread"))
    return judged.join(spread, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(verdict, "spread", F.lit("allow")).alias("verdict"),
        F.col("component").alias("alias_of"),
    )
