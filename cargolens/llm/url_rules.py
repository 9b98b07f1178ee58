"""Url rules, and their block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cargolens.llm.components import connected_components
from cargolens.llm.storage import written

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Java's regular expressions go one call deeper for each repeat, so repeats are bounded.
_LINK_TAG = r"""(?i)<link\b(?:[^>"']++|"[^"]*+"|'[^']*+'){0,500}+>"""
_META_TAG = r"""(?i)<meta\b(?:[^>"']++|"[^"]*+"|'[^']*+'){0,500}+>"""
_IS_REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_NUMBER = r"^(?:(\d{1,7})|[xX]([0-9A-Fa-f]{1,6}));?"
#: Named references for characters that urls hold, but ``&amp;``.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def url_address(url: Column) -> Column:
    """What a url names whatever the scheme and fragment: host, path and query; null if none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), rest))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; empty if the tag lacks it."""
    def value(quoted):
        return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*{quoted}""", 1)

    return F.concat(value('"([^"]*)"'), value("'([^']*)'"), value(r"""([^"'\s>][^\s>]*)"""))


def _without_references(text: Column) -> Column:
    """Named and printable ASCII numeric character references replaced, each once."""
    def number(part, k):
        found = F.coalesce(
            F.regexp_extract(part, _NUMBER, 1).try_cast("int"),
            F.conv(F.regexp_extract(part, _NUMBER, 2), 16, 10).try_cast("int"),
        )
        rest = F.regexp_replace(part, _NUMBER, "")
        return F.when(k == 0, part).when(
            found.between(33, 126), F.concat(F.chr(found), rest)
        ).otherwise(F.concat(F.lit("&#"), part))

    def segment(part):
        for name, character in NAMED.items():
            part = F.replace(part, F.lit(name), F.lit(character))
        return F.array_join(F.transform(F.split(part, "&#"), number), "")

    decoded = F.array_join(F.transform(F.split(text, "&amp;"), segment), "&")
    return F.when(text.contains("&"), decoded).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/``, with ``.`` and ``..`` segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    ends_open = path.rlike(r"/\.{1,2}$")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    found = F.concat(F.lit("/"), F.array_join(kept, "/"))
    found = F.when(ends_open & ~found.endswith("/"), F.concat(found, F.lit("/"))).otherwise(found)
    return F.when(path.contains("/."), found).otherwise(path)


def _resolved(target: Column, page: Column) -> Column:
    """The address a target leads to from a page, null if it leads nowhere (RFC 3986, 5.2)."""
    scheme = F.regexp_extract(page, "^([^:/?#]*:)//", 1)
    site = F.regexp_extract(page, "^([^:/?#]*://[^/?#]*)", 1)
    path = url_path(page)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    rest = F.regexp_extract(target, r"^[^?#]*([?#].*)?$", 1)
    own = F.regexp_extract(target, r"^([^?#]*)", 1)
    return (
        F.when(target == "", None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.contains("://"), target))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(site == "", None)
        .when(target.startswith("/"), F.concat(site, _without_dots(own), rest))
        .when(target.startswith("#"), None)
        .when(target.startswith("?"), F.concat(site, path, target))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), rest))
    )


def page_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``src, dst``: urls of pages and of the canonical and refresh targets in their html.

    All ``link`` tags that have ``canonical`` among the words of ``rel`` count, and all refresh
    ``meta`` tags. Character references in targets are decoded (named ones of ``NAMED`` and
    ``&amp;``, numeric ones of printable ASCII), and relative targets resolved against the page.
    Targets without a host (``mailto:``, a fragment alone) and pages without url or html are left
    out, as are tags of more than 500 quoted and unquoted stretches (250 attributes).
    """
    rows = pages.select(F.col(url_column).alias("src"), F.col(html_column).alias("html"))
    found = rows.filter("src IS NOT NULL").filter(F.col("html").rlike("(?i)canonical|refresh"))
    tags = {
        kind: F.regexp_extract_all("html", F.lit(tag), F.lit(0))
        for kind, tag in (("link", _LINK_TAG), ("meta", _META_TAG))
    }
    canonical = F.filter(
        tags["link"],
        lambda tag: F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical"),
    )
    refresh = F.filter(tags["meta"], lambda tag: tag.rlike(_IS_REFRESH))
    targets = F.concat(
        F.transform(canonical, lambda tag: _attribute(tag, "href")),
        F.transform(refresh, lambda tag: F.regexp_extract(tag, _URL, 1)),
    )
    found = found.select("src", F.explode(targets).alias("dst"))
    target = F.trim(_without_references(F.col("dst")))
    return found.select("src", target.alias("dst")).select(
        "src", _resolved(F.col("dst"), F.col("src")).alias("dst")
    ).filter("dst IS NOT NULL")


def _decide(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, decision`` of those distinct ``host, path`` that a rule fits."""
    table = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("suffix"),
        F.col("path").alias("rule_path"), F.col("verdict").alias("decision"),
    ).filter("suffix IS NOT NULL AND rule_path IS NOT NULL")
    # Only as many labels of a host are looked up as any rule has.
    labels = table.agg(F.max(F.size(F.split("suffix", r"\.")))).first()[0] or 0
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))),
        lambda k: F.array_join(F.slice(parts, -k, k), "."),
    )
    fits = (
        places.select("host", "path").filter("host <> ''").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(table, "suffix")
        .filter(F.startswith("path", "rule_path"))
    )
    rule = F.concat("suffix", "rule_path")
    best = F.struct(
        F.length(rule).alias("size"), (F.col("decision") == ALLOW).alias("allows"),
        rule.alias("rule"), "decision",
    )
    return (
        fits.groupBy("host", "path").agg(F.max(best).alias("best"))
        .select("host", "path", "best.rule", "best.decision")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame, id_column: str = "page_id",
               url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, via``: one row per row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains where the
    path starts with the rule's; the longest fitting one wins, of equal ones one that allows.
    ``links`` has ``src, dst``, urls of redirects and canonical links; urls they connect are
    aliases, which connected components find. A rule that fits a url decides it, so an explicit
    allow holds against blocked aliases. A url without a rule is blocked if one of its aliases,
    page or not, is blocked by a rule (``via`` is then the smallest address of the group), and
    else allowed.

    Urls that are null or have no ``://`` have empty host and path, fit no rule and are allowed.
    Repeated rows are judged each. Empty tables of rules or links decide nothing. Other columns
    are ignored.
    """
    url = F.col("url")
    named = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).select(
        "page_id", url_host(url).alias("host"), url_path(url).alias("path"),
        url_address(url).alias("address"),
    )
    known = written(links.select("src", "dst"), "links")
    ends = known.select(F.col("src").alias("url")).union(known.select(F.col("dst").alias("url")))
    nodes = ends.select(
        url_address(url).alias("node"), url_host(url).alias("host"), url_path(url).alias("path")
    ).filter("node IS NOT NULL").distinct()
    groups = connected_components(
        known.select(url_address(F.col("src")).alias("a"), url_address(F.col("dst")).alias("b"))
    )
    decided = written(
        _decide(named.select("host", "path").union(nodes.select("host", "path")), rules), "rules"
    )
    blocked = (
        nodes.join(decided.filter(F.col("decision") == BLOCK), ["host", "path"])
        .join(groups, "node").select("component").distinct()
    )
    aliases = written(
        groups.join(blocked, "component").select(
            F.col("node").alias("address"), F.col("component").alias("group")
        ),
        "aliases",
    )
    by_alias = F.col("rule").isNull() & F.col("group").isNotNull()
    verdict = F.coalesce("decision", F.when(by_alias, BLOCK).otherwise(ALLOW))
    return (
        named.join(decided, ["host", "path"], "left").join(aliases, "address", "left")
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                F.when(by_alias, F.col("group")).alias("via"))
    )
