"""Targets of canonical and refresh tags, and blocks that spread over them."""

from __future__ import annotations

import pytest

from cargolens.llm import url_rules

PAGE = "http://a.example.net/dir/page.html?q=1#top"


@pytest.mark.parametrize("html, targets", [
    ('<link rel="canonical" href="https://h.com/x?a=1&amp;b=2">', ["https://h.com/x?a=1&b=2"]),
    ('<link rel="canonical" href="https:&#47;&#x2F;h.com/x">', ["https://h.com/x"]),
    ('<link rel="canonical" href="https://h.com/&amp;#47;">', ["https://h.com/&#47;"]),
    ('<link rel="nofollow canonical" href="https://h.com/x">', ["https://h.com/x"]),
    ("<link href='//h.com/x' rel=canonical>", ["http://h.com/x"]),
    ('<link rel="canonical" href="/x"><link href="y" rel="CANONICAL">',
     ["http://a.example.net/x", "http://a.example.net/dir/y"]),
    ('<link rel="canonical" href="?p=2">', ["http://a.example.net/dir/page.html?p=2"]),
    ('<link rel="canonical" href="../x/./y">', ["http://a.example.net/x/y"]),
    ('<link rel="canonical" href="../../..">', ["http://a.example.net/"]),
    ('<link rel="canonical" href="/a/b/..?x=/../y">', ["http://a.example.net/a/?x=/../y"]),
    ('<link title="a > b" rel="canonical" href="https://h.com/x">', ["https://h.com/x"]),
    ('<meta http-equiv="refresh" content="0; url=next">', ["http://a.example.net/dir/next"]),
    ('<link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="#x">', []),
    ('<link rel="canonicals" href="/x"><link rel="canonical">', []),
    ('<link rel="canonical" href="/x">' + "<link " + 'a="b" ' * 50_000 + "<link " + '"' * 50_001,
     ["http://a.example.net/x"]),
    ("<link " + "a" * 500_000 + ' rel="canonical" href="/x">', ["http://a.example.net/x"]),
    ("", []),
    (None, []),
])
def test_targets(spark, html, targets):
    pages = spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string")
    assert [r["dst"] for r in url_rules.page_links(pages).collect()] == targets


def test_blocks_spread_over_every_kind_of_link(spark):
    rows = [
        (1, "http://a.net/dir/p", '<link rel="canonical" href="https://b.com/de/?a=1&amp;b=2">'),
        (2, "http://b.com/other", '<link rel="canonical" href="de/page">'),
        (3, "http://c.net/p", '<link rel="nofollow canonical" href="https://b.com/de/x">'),
        (4, "http://d.net/p", '<link rel="canonical" href="/own"><link rel="canonical" href="https://b.com/de/y">'),
        (5, "http://e.net/p", '<link rel="stylesheet" href="https://b.com/de/x">'),
        (6, None, '<link rel="canonical" href="https://b.com/de/x">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("com", "/de/", "block")], "host string, path string, verdict string")
    found = url_rules.judge_urls(pages, rules, url_rules.page_links(pages)).collect()
    assert {r["page_id"] for r in found if r["verdict"] == "block"} == {1, 2, 3, 4}
