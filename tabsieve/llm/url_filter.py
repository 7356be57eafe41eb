"""URL filters with redirect equivalence, in DataFrame operations only.

Rules judge host and path. Redirect and canonical-link edges join URLs into components; a block decision
reaches every alias of the component unless some alias is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.components import connected_components
from tabsieve.llm.license_scan import CAPITALS, SMALL
from tabsieve.llm.stages import written

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

MOST_RULES = 100_000

_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """The URL without scheme and fragment: what redirects and canonical links compare."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), rest))


def resolved(target: Column, url: Column) -> Column:
    """A link target as an absolute URL: absolute, scheme-relative, rooted and relative forms."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    site = F.concat(F.lit("http://"), url_host(url))
    return (F.when(target == "", F.lit(None)).when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.startswith("/"), F.concat(site, target))
            .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .otherwise(F.concat(site, F.regexp_extract(F.concat(url_path(url), F.lit("")), r"(?s)\A(.*/)", 1),
                                F.when(url_path(url).contains("/"), F.lit("")).otherwise(F.lit("/")), target)))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src and dst URLs of canonical links and refresh redirects in the pages' markup."""
    def found(tag: str, part: str) -> Column:
        return F.regexp_extract(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), tag, 0), part, 1)

    targets = F.array(found(_LINK, _HREF), found(_REFRESH, _TARGET))
    return (pages.select(F.col(url).alias("src"), F.explode(targets).alias("_t")).filter(F.col("_t") != "")
            .select("src", resolved(F.col("_t"), F.col("src")).alias("dst")).filter(F.col("dst").isNotNull()))


def rule_verdicts(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and verdict of the longest fitting rule, for distinct (host, path) with one.

    A host is expanded to itself and its parent domains, which are joined to the rules' hosts by equality.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = places.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("_suffix"))
    fits = parents.join(rules, F.col("_suffix") == F.col("rule_host")).filter(F.col("path").startswith(F.col("rule_path")))
    longest = F.max(F.struct(F.length("rule"), "rule", "rule_verdict"))
    return fits.groupBy("host", "path").agg(longest.alias("_r")).select("host", "path", "_r.rule", "_r.rule_verdict")


def rule_table(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rules as a table; up to MOST_RULES of them are marked for broadcast."""
    rows = [(v, h, p, h + p) for v, h, p in rules]
    table = df.sparkSession.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string, rule string")
    return F.broadcast(table) if len(rows) <= MOST_RULES else table


def judge_pages(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None,
                key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    The longest rule that fits decides. A URL without a rule takes the decision of its component over
    redirect and canonical edges (from the markup, and from `redirects` with src and dst if given): allow
    if any alias is allowed by a rule, else block if any is blocked, else allow. Aliases need not be pages.

    `rules` is a table (rule_verdict, rule_host, rule_path, rule), RULES by default; a given table is
    broadcast only if Spark knows it to be small. Null URLs and URLs without `://` have an empty host and path, no rule and no
    alias, and are allowed. Null and empty markup has no edges. Repeated rows get the same answer each;
    other columns are ignored; an empty table stays empty.
    """
    rules = rule_table(pages) if rules is None else rules
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    ends = written(
        edges.select(url_node(F.col("src")).alias("a"), url_node(F.col("dst")).alias("b"), "src", "dst")
        .filter("a is not null and b is not null"), "redirects")
    nodes = connected_components(ends, "a", "b")
    known = ends.select(F.col("a").alias("node"), F.col("src").alias("u")).union(ends.select("b", "dst")).select(
        "node", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path")).distinct()
    decided = (
        known.join(rule_verdicts(known, rules), ["host", "path"]).join(nodes, "node").groupBy("component")
        .agg(F.max(F.col("rule_verdict") == "allow").alias("_allowed")))
    aliases = written(nodes.join(decided, "component").select(
        "node", F.when(F.col("_allowed"), "allow").otherwise("block").alias("_alias")), "aliases")
    placed = pages.select(
        F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), url_node(F.col(url)).alias("_node"))
    judged = placed.join(rule_verdicts(placed, rules), ["host", "path"], "left")
    return judged.join(aliases, F.col("_node") == F.col("node"), "left").select(
        key, "host", "path", "rule", F.coalesce("rule_verdict", "_alias", F.lit("allow")).alias("verdict"))
