"""URL rules, and decisions that pass between pages that redirect to or name each other.

A rule is a host and the start of a path; it fits the host and all its subdomains.  Pages that no
rule fits take the decision of their alias component: pages are linked to the targets of
`<link rel="canonical">`, of `<meta http-equiv="refresh">` and of given redirects.  A component with
an allowed page is allowed; otherwise one with a blocked page is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import connected_components, stored

#: Rules of the registered query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for text without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, rule).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, without white space at its ends; empty where it is not there."""
    form = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
    return F.regexp_replace(F.concat(*[F.regexp_extract(tag, form, i) for i in (1, 2, 3)]), r"\A\s+|\s+\z", "")


def node_of(url: Column) -> Column:
    """The url by which a page or target is known: scheme and host in lower case, no fragment; text that has no scheme as it is."""
    whole = F.regexp_extract(url, rf"(?s)\A({_SCHEME}://[^/?#]*)([^#]*)", 0)
    front = F.regexp_extract(url, rf"(?s)\A{_SCHEME}://[^/?#]*", 0)
    return F.when(front != "", F.concat(F.translate(front, _UPPER, _LOWER), F.substr(whole, F.length(front) + 1))).otherwise(url)


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its `.` and `..` segments worked off."""
    steps = F.split(F.substr(path, F.lit(2)), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    end = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def resolved(base: Column, target: Column) -> Column:
    """The target as a whole url, read from the url `base` (RFC 3986, 5.2); null where it has a scheme but no host, or is relative and `base` has no scheme."""
    scheme = F.regexp_extract(base, rf"(?s)\A({_SCHEME}:)//", 1)
    site = F.regexp_extract(base, rf"(?s)\A{_SCHEME}://[^/?#]*", 0)
    rest = F.substr(base, F.length(site) + 1)
    path = F.regexp_extract(rest, r"(?s)\A[^?#]*", 0)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)\A.*/", 0))
    own = F.regexp_extract(target, r"(?s)\A[^?#]*", 0)
    after = F.substr(target, F.length(own) + 1)
    whole = F.rlike(target, F.lit(rf"\A{_SCHEME}:"))
    from_base = (
        F.when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, _without_dots(own), after))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path, after))
        .when(own == "", F.concat(F.regexp_extract(base, r"(?s)\A[^#]*", 0), after))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), after))
    )
    return F.when(whole, F.when(F.rlike(target, F.lit(rf"\A{_SCHEME}://")), target)).when(site != "", from_base)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) for canonical links and refresh redirects in the pages.

    Relative and scheme-relative targets are read from the page's `<base href>`, or its url where it has
    none.  Targets of other kinds (`mailto:`, `data:`) make no row, nor do relative ones of a url without scheme.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    tags = pages.where(F.col("url").isNotNull() & (F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))))
    base = _attribute(F.regexp_extract(html, r"(?is)<base\s[^>]*\shref\s*=[^>]*>|<base\shref\s*=[^>]*>", 0), "href")
    tags = tags.select("url", base.alias("base"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.when(F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract("tag", r"""(?is)url\s*=\s*["']?([^"'>\s;]+)""", 1))
    named = tags.select("url", "base", F.regexp_replace(F.coalesce(canonical, refresh), "&amp;", "&").alias("named")).where("named <> ''")
    named = named.withColumn("base", F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.regexp_replace("base", "&amp;", "&")), "url")))
    return named.select("url", resolved(F.col("base"), F.col("named")).alias("target")).where("target IS NOT NULL")


def url_verdicts(pages: DataFrame, rules: dict[str, str] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, the rule that fits or null, and the verdict.

    `redirects` may give further (url, target) pairs, whose targets may be relative as well.  Urls that
    differ only in the case of scheme and host or in the fragment are one in the components.  A page whose url is null, or whose component
    has no rule, is allowed.  Repeated rows stay; extra columns are left out; an empty table gives
    no rows.  A rule of the page itself stands above its component.
    """
    host, path = split_url(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    own = own.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    own = own.withColumn("said", F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", F.coalesce(resolved(F.col("url"), F.col("target")), "target").alias("target")))
    edges = edges.select(node_of(F.col("url")).alias("url"), node_of(F.col("target")).alias("target"))
    edges = stored(edges.where("url <> target").distinct(), "aliases")
    columns = ["page_id", "host", "path", "rule"]
    if edges.isEmpty():  # no page names another
        return own.select(*columns, F.coalesce("said", F.lit("allow")).alias("verdict"))
    components = stored(connected_components(edges.select(F.col("url").alias("a"), F.col("target").alias("b"))), "components")
    # rules also speak for targets that are no pages of the table
    h, p = split_url(F.col("node"))
    ruled = components.withColumn("rule", fitting_rule(h, p, rules))
    rank = F.max(F.when(F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")) == "allow", 2).when(F.col("rule").isNotNull(), 1).otherwise(0))
    decided = ruled.groupBy("component").agg(rank.alias("rank"))
    passed = components.join(decided, "component").select(F.col("node"), F.when(F.col("rank") == 1, "block").otherwise("allow").alias("passed"))
    return own.withColumn("node", node_of(F.col("url"))).join(passed, "node", "left").select(*columns, F.coalesce("said", "passed", F.lit("allow")).alias("verdict"))
