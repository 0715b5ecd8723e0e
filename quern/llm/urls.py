"""URL rules with block decisions carried over redirect and canonical aliases.

DataFrame functions only.  Nodes are URLs without scheme, fragment and
tracking parameters; edges come from ``<link rel=canonical>``, meta refresh
and, if given, a table of redirects.  The connected component of a node shares
decisions: an alias without a rule of its own is allowed if any URL of its
component is explicitly allowed, else blocked if any is blocked, else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components

#: Query parameters that don't change which page is meant.
TRACKING = ("utm_", "ref=")
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; empty for null or no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return host, path, query


def alias_key(host: Column, path: Column, query: Column) -> Column:
    """One name for spellings of a URL that mean the same page; null without a host."""
    kept = F.filter(F.split(query, "&"), lambda q: (q != "") & ~F.startswith(q, F.lit(TRACKING[0])) & ~F.startswith(q, F.lit(TRACKING[1])))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (``host/path`` as given) that fits, else null."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, under = rule.partition("/")
        on_host = (host == at) | F.endswith(host, F.lit(f".{at}"))
        fits.append(F.when(on_host & F.startswith(path, F.lit(slash + under)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in sorted(rules, reverse=True):  # of a rule given both ways, allow holds
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def with_rules(df: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """``df`` (host, path) with the rule that fits and its verdict, ``own``.

    A sequence of rules becomes one expression.  A table of rules (verdict,
    rule) is joined on the suffixes of the distinct hosts, so it may be as
    large as a blocklist is.
    """
    if not isinstance(rules, DataFrame):
        ruled = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        return ruled.withColumn("own", verdict_of(F.col("rule"), rules))
    at = F.substring_index("rule", "/", 1)
    table = rules.select(at.alias("at"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("under"), "rule", F.col("verdict").alias("own"))
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spots = df.select("host", "path").distinct().withColumn("at", F.explode(suffixes)).join(table, "at").where(F.startswith("path", "under"))
    best = spots.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "own")).alias("best"))
    return df.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "own": F.col("best.own")}).drop("best")


def _resolved(path: Column) -> Column:
    """A path without its ``.`` and ``..`` parts."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), kept).otherwise(path)


def absolute(target: Column, host: Column, path: Column) -> Column:
    """A link target of a page as an absolute URL; null for other schemes and for places inside the page."""
    x = F.replace(target, F.lit("&amp;"), F.lit("&"))
    tail = F.regexp_extract(x, r"([?#].*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?[^/]*$", 1))
    near = F.concat(F.lit("http://"), host, _resolved(F.concat(folder, F.regexp_extract(x, r"^[^?#]*", 0))), tail)
    return (
        F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x)
        .when(x.startswith("//"), F.concat(F.lit("http:"), x))
        .when(x.startswith("/"), F.concat(F.lit("http://"), host, _resolved(F.regexp_extract(x, r"^[^?#]*", 0)), tail))
        .when(x.startswith("?"), F.concat(F.lit("http://"), host, path, x))
        .when((x == "") | x.startswith("#") | x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(near)
    )


def html_links(html: Column, host: Column, path: Column) -> Column:
    """Absolute targets of the first canonical link and the first meta refresh of a page."""
    found = F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL_TAG, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH_TAG, 0), REFRESH_URL, 1),
    )
    return F.filter(F.transform(found, lambda x: absolute(x, host, path)), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """One row per page row: id, url, host, path, rule, alias, verdict.

    ``rules``: ('allow' or 'block', 'host/path prefix'), or a table of such
    with columns ``verdict`` and ``rule``.  ``redirects`` has columns ``source`` and ``target``.  A page with a rule keeps that rule's
    verdict.  Null urls have an empty host, no alias and are allowed; repeated
    pages each keep their row; a null html has no links, an empty table no rows.
    Link targets are resolved against the page, ``&amp;`` is ``&`` in them.
    """
    host, path, query = split_url(F.col("url"))
    base = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    base = with_rules(base.withColumns({"host": host, "path": path, "alias": alias_key(host, path, query)}), rules)
    links = base.where(F.col("alias").isNotNull()).select(F.col("alias").alias("a"), F.explode(html_links(F.col("html"), F.col("host"), F.col("path"))).alias("url"))
    if redirects is not None:
        h, p, q = split_url(F.col("source"))
        links = links.unionByName(redirects.select(alias_key(h, p, q).alias("a"), F.col("target").alias("url")))
    ends = with_rules(links.withColumns({"host": host, "path": path, "b": alias_key(host, path, query)}), rules)
    roots = components(ends.select("a", "b"))
    nodes = base.select("alias", "own").unionByName(ends.select(F.col("b").alias("alias"), "own")).where("alias is not null and own is not null")
    said = nodes.groupBy("alias").agg(F.bool_or(F.col("own") == "allow").alias("allowed"))
    named = said.join(roots, F.col("alias") == F.col("node"), "left").select(F.coalesce("root", "alias").alias("root"), "allowed")
    blocked = named.groupBy("root").agg(F.bool_or("allowed").alias("allowed")).where("not allowed").select("root")
    members = roots.join(blocked, "root", "left_semi").select(F.col("node").alias("alias")).unionByName(blocked.select(F.col("root").alias("alias"))).withColumn("spread", F.lit(True))
    return (
        base.drop("html")
        .join(members, "alias", "left")
        .withColumn("verdict", F.coalesce("own", F.when(F.col("spread"), F.lit("block")), F.lit("allow")))
        .select(id_col, "url", "host", "path", "rule", "alias", "verdict")
    )
