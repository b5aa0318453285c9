"""URL filtering with redirect equivalence.

Redirects (``<meta http-equiv="refresh">``) and canonical links of a page say that two URLs name one
document. Connected components over these edges are the sets of aliases. A URL that a rule
fits keeps that rule's decision. Any other URL takes its component's: blocked if a member is
blocked by rule and none is allowed by rule, since an explicit allow goes before a propagated block.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Workspace


class Rule(NamedTuple):
    """Decides a host and its subdomains, for paths that start with ``path``."""

    action: str
    host: str
    path: str


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty if null or without ``://``."""
    rest = F.expr(f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^#]*)", 1)


def as_node(url: Column) -> Column:
    """A URL as a node of the graph of aliases: without its fragment, scheme and host in lower case, as they do not tell URLs apart."""
    url = without_fragment(url)
    scheme, user, host = (F.regexp_extract(url, r"^([^:/?#]*://)([^/?#]*@)?([^/?#]*)", k) for k in (1, 2, 3))
    rest = F.substring(url, F.length(scheme) + F.length(user) + F.length(host) + 1, F.length(url))
    return F.concat(lower_ascii(scheme), user, lower_ascii(host), rest)


def alias_targets(html: Column) -> Column:
    """Targets of the canonical links and redirects in a page, as written but for ``&amp;``."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))

    def target(tag: Column) -> Column:
        href = F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
        moved = F.regexp_extract(tag, r"""(?i)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)""", 1)
        canonical = tag.rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?canonical\b""")
        refresh = tag.rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b""")
        return F.replace(F.when(canonical, href).when(refresh, moved).otherwise(""), F.lit("&amp;"), F.lit("&"))

    return F.filter(F.transform(tags, target), lambda t: t != "")


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    up = lambda kept: F.when(F.size(kept) > 0, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", up(kept)).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), step)
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def absolute(target: str, base: str) -> Column:
    """A target URL resolved against the page's as RFC 3986 says, without its fragment. One with a scheme is kept as it is."""
    part = lambda url, pattern: F.regexp_extract(url, pattern, 1)
    given, page = without_fragment(F.col(target)), without_fragment(F.col(base))
    scheme, root, path = part(page, "^([^:/?#]*:)"), part(page, "^([^:/?#]*://[^/?#]*)"), part(page, "^[^:/?#]*://[^/?#]*([^?]*)")
    asked, query = part(given, "^([^?]*)"), part(given, r"^[^?]*(\?.*)$")
    folder = F.when(path == "", F.lit("/")).otherwise(part(path, "^(.*/)"))
    merged = F.when(F.startswith(asked, F.lit("/")), asked).otherwise(F.concat(folder, asked))
    return (
        F.when(given.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), given)
        .when(F.startswith(given, F.lit("//")), F.concat(scheme, given))
        .when(given == "", page)
        .when(asked == "", F.concat(root, path, query))
        .otherwise(F.concat(root, without_dots(merged), query))
    )


def decide(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The longest rule that fits each distinct ``node`` of ``urls``: node, rule, action.

    A URL meets rules by the suffixes of its host, so the work is a join however many rules there are.
    """
    table = urls.sparkSession.createDataFrame([(r.host, r.path, f"{r.host}{r.path}", r.action) for r in rules], "suffix string, start string, rule string, action string")
    host, path = split_url("node")
    split = urls.select("node", host.alias("host"), path.alias("path"))
    suffix = F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))"))
    suffixes = split.select("node", "path", suffix.alias("suffix"))
    fitting = suffixes.join(table, "suffix").where(F.startswith("path", "start"))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "action"))
    return fitting.groupBy("node").agg(best.alias("best")).select("node", "best.rule", "best.action")


def filter_urls(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Judges every row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, alias_group.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and are allowed; a null html
    has no aliases. URLs that differ in the case of scheme or host, or in their fragment, are one. alias_group is the smallest
    URL of the component, so written, null for a URL without aliases. Repeated rows are judged alike.
    """
    ws = Workspace(pages.sparkSession, "urls")
    host, path = split_url("url")
    rows = pages.select("page_id", "url", "html", as_node(F.coalesce("url", F.lit(""))).alias("node"), host.alias("host"), path.alias("path"))
    aliases = rows.where("host <> ''").select("node", F.explode(alias_targets(F.col("html"))).alias("target"))
    edges = ws.save(aliases.select(F.col("node").alias("src"), as_node(absolute("target", "node")).alias("dst")).where("src <> dst").distinct())
    groups = ws.save(connected_components(edges, ws))

    judged = rows.select("node").union(groups.select("node")).distinct()
    decisions = ws.save(decide(judged, rules))
    member = groups.join(decisions, "node", "left").groupBy("component")
    spread = member.agg(F.bool_or(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked"), F.bool_or(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("allowed"))
    inherited = ws.save(groups.join(spread, "component").select("node", "component", (F.col("blocked") & ~F.col("allowed")).alias("inherits")))
    full = rows.select("page_id", "node", "host", "path").join(decisions, "node", "left").join(inherited, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("inherits"), "block").otherwise("allow"))
    return full.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("component").alias("alias_group"))
