"""The forms in which pages name each other: relative targets, other spellings of a url, lists in rel."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from chronoframe.llm import urls

SCHEMA = "page_id bigint, url string, html string"
BLOCKED = "http://b.example.com/de/1"  # by the rule example.com/de/


def link(target, rel="canonical"):
    return f'<link rel="{rel}" href="{target}">'


def refresh(target):
    return f'<meta http-equiv="refresh" content="0; url={target}">'


def verdicts(spark, pages, redirects=None):
    return {r.page_id: r.verdict for r in urls.url_verdicts(spark.createDataFrame(pages, SCHEMA), redirects=redirects).collect()}


def test_targets_pass_the_block(spark):
    """Each page on a host of its own; the rule example.com/de/ fits its target."""
    targets = ["/de/1", "de/1", "../de/1", "./x/.././../de/1", "//{}/de/1", "//{}/de/1#top", "HTTP://{}/de/1", "http://{}/de/1#a"]
    pages = []
    for form in (link, refresh):
        for t in targets:
            n = len(pages)
            host = f"h{n}.example.com"
            pages.append((n, f"http://{host}/{'q/' if t.startswith('.') else ''}page.html?x#y", form(t.format(host.upper()))))
    got = verdicts(spark, [*pages, (-1, "http://h0.example.com/other", None)])
    assert got.pop(-1) == "allow"
    assert set(got.values()) == {"block"} and len(got) == len(pages)


def test_pages_of_one_node(spark):
    html = link(BLOCKED)
    pages = [(1, "http://EXAMPLE.com/x", html), (2, "http://example.com/x", None), (3, "HTTP://example.com/x#top", None), (4, "http://example.com/X", None), (5, "http://example.com/x?q", None)]
    assert verdicts(spark, pages) == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_lists_in_rel(spark):
    tags = [link(BLOCKED, "alternate canonical"), f"<link href='{BLOCKED}' rel='Canonical\nnofollow'>", f"<link rel=canonical href={BLOCKED}>"]
    assert set(verdicts(spark, [(i, f"http://a.com/{i}", t) for i, t in enumerate(tags)]).values()) == {"block"}


def test_other_targets(spark):
    pages = [(1, "http://a.com/x", link("mailto:a@b")), (2, "no scheme", link("/de/1")), (3, "http://a.com/y", link("#z")), (4, "http://a.com/z", link(BLOCKED, "noncanonical")), (5, "http://a.com/w", link(""))]
    assert set(verdicts(spark, pages).values()) == {"allow"}


def test_base_and_given_redirects(spark):
    page = (1, "http://a.com/x", '<base target="_top" href="http://b.example.com/de/"> ' + link("1"))
    assert verdicts(spark, [page]) == {1: "block"}
    given = spark.createDataFrame([("http://B.example.com/old#f", "/de/1")], "url string, target string")
    assert verdicts(spark, [(1, "http://b.example.com/old", None)], given) == {1: "block"}


def test_resolved_as_the_library_does(spark):
    bases = ["http://a.com/b/c/d;p?q", "http://a.com", "https://A.com/", "http://a.com/x/?y#z"]
    targets = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "g#s", ";x", ".", "./", "..", "../g", "../..", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/../h", "g;x=1/../y", "g?y/../x", "https://o.net/p", "/go?u=http://x/"]
    pairs = [(b, t) for b in bases for t in targets]
    rows = spark.createDataFrame(pairs, "b string, t string").select("b", "t", urls.resolved(F.col("b"), F.col("t")).alias("u")).collect()
    for r in rows:
        assert urldefrag(r.u).url == urldefrag(urljoin(r.b, r.t)).url, (r.b, r.t)
