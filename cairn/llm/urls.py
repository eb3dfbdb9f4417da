"""URL filters: rules, and redirect equivalence over redirect and canonical-link edges. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
#: <link rel=canonical>, <meta http-equiv=refresh> and <base>, whatever the order of the attributes, and what they name.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b)[^>]*>"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)(?:[^>"']|"[^"]*"|'[^']*')*>"""
BASE = r"(?is)<base\b[^>]*>"
HREF, CONTENT = r"(?is)\bhref" + _VALUE, r"(?is)\bcontent" + _VALUE
DELAYED = r"""(?is)^\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?["']?\s*([^"'\s]+)"""
#: Entities that stand in addresses; the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def value_of(tag: Column, attribute: str) -> Column:
    """The value of an attribute of a tag, quoted or not; empty if there is none."""
    return F.trim(F.concat(*[F.regexp_extract(tag, attribute, i) for i in (1, 2, 3)]))


def _numbered(text: Column, pattern: str, code) -> Column:
    number = lambda e: code(F.regexp_extract(e, pattern, 1))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    return F.aggregate(found, text, lambda t, e: F.when(number(e) < 128, F.replace(t, e, F.char(number(e)))).otherwise(t))


def unescaped(text: Column) -> Column:
    """Without the entities above and numbered ones of ASCII characters."""
    text = _numbered(text, r"&#(\d{2,3});", lambda x: x.cast("int"))
    text = _numbered(text, r"(?i)&#x([0-9a-f]{2});", lambda x: F.conv(x, 16, 10).cast("int"))
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def without_dots(path: Column) -> Column:
    """A path without its segments . and .."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1))))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    ends = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.array_join(kept, "/"), ends)).otherwise(path)


def resolved(target: Column, page: Column) -> Column:
    """``target`` as a link on the page at ``page`` means it; null if it is no http address or names the page itself."""
    scheme = F.regexp_extract(page, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(page, r"(?s)^.*?://([^/?#]*)", 1))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(page), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (target == "") | target.startswith("#"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, without_dots(path), rest))
        .when(target.startswith("?"), F.concat(site, path_of(page), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), rest))
    )


def links_of(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(f, t): each canonical link and meta refresh of each page, resolved against its <base> or its address."""
    # the cheap test first: few pages have either
    marked = F.lower(F.col(html_col)).rlike("canonical|http-equiv")
    tags = pages.where(marked & F.col(url_col).isNotNull()).select(
        F.col(url_col).alias("f"),
        F.regexp_extract(F.col(html_col), BASE, 0).alias("base"),
        F.regexp_extract_all(F.col(html_col), F.lit(CANONICAL), 0).alias("canonical"),
        F.regexp_extract_all(F.col(html_col), F.lit(REFRESH), 0).alias("refresh"),
    )
    told = tags.select(
        "f",
        F.coalesce(resolved(unescaped(value_of(F.col("base"), HREF)), F.col("f")), "f").alias("at"),
        F.explode(F.concat(F.transform("canonical", lambda x: value_of(x, HREF)), F.transform("refresh", lambda x: F.regexp_extract(value_of(x, CONTENT), DELAYED, 1)))).alias("t"),
    )
    return told.select("f", resolved(unescaped(F.col("t")), F.col("at")).alias("t")).where("t is not null")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What two addresses share when they name one resource: host, path and query, not scheme or fragment."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), query_of(url)))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Longest: host and path together; then the allow rule.

    One CASE in order of length, so it stays in generated code.
    """
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule, verdict and ``alias_of`` (the component's smallest address, null where a url has no alias).

    A url that a rule fits has the rule's verdict. Any other takes it from its aliases: edges are canonical links
    and meta refreshes in the html plus ``redirects`` (from_url, to_url), their connected components are
    equivalent addresses, and a component is blocked if a member is blocked by a rule and none is allowed by one:
    an explicit allow takes precedence, also where equal urls have conflicting edges. Targets that are no crawled
    page carry rule verdicts too. Every link of a page counts; relative targets resolve against the page's <base> or
    address, entities are decoded.

    Urls that are null or hold no ``://`` have empty host and path and no aliases; null and empty html has no links;
    html of any length is searched whole, once. Equal urls share a node, so repeated rows agree; rows stay one to one
    with the input, of any id and with an empty result for an empty table. Other columns are ignored.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col), url.alias("__url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "__v": verdict, "__node": node_of(F.col("__url"))})
    edges = None
    if html_col:
        edges = links_of(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(F.col("from_url").alias("f"), F.col("to_url").alias("t"))
        edges = more if edges is None else edges.unionByName(more)
    if edges is None:
        done = base.withColumns({"alias_of": F.lit(None).cast("string"), "__c": F.lit(None).cast("string")})
    else:
        edges = written(edges.select("f", "t").distinct(), "links")
        comps = written(connected(edges.select(node_of(F.col("f")).alias("a"), node_of(F.col("t")).alias("b"))), "components")
        ends = edges.select(F.explode(F.array("f", "t")).alias("u"))
        _, v = best_rule(host_of(F.col("u")), path_of(F.col("u")), rules)
        ruled = ends.select(node_of(F.col("u")).alias("node"), v.alias("v")).where("v is not null").distinct()
        known = base.where("__v is not null").select(F.col("__node").alias("node"), F.col("__v").alias("v"))
        votes = comps.join(ruled.unionByName(known).distinct(), "node").groupBy("component").agg(F.max(F.col("v") == "allow").alias("ok"))
        # per address, so that a component's size never meets in one task
        passed = comps.join(votes, "component", "left").select(F.col("node").alias("__node"), F.col("component").alias("alias_of"), F.when(F.col("ok"), "allow").when(~F.col("ok"), "block").alias("__c"))
        done = base.join(passed, "__node", "left")
    return done.select(id_col, "host", "path", "rule", F.coalesce("__v", "__c", F.lit(default)).alias("verdict"), "alias_of")


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with the links of their html; see ``judge`` for nulls, repeated and conflicting rows and empty tables."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def redirects_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with a redirect table: two pages of three redirect to the page of a seventh of their id, so chains and
    components arise, and verdicts pass along them. Rules block the start of some and allow that of others."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    to = pages.select(F.col("page_id").alias("__to"), F.col("url").alias("to_url"))
    moved = pages.where("page_id % 3 <> 0 and page_id >= 40").join(to, F.expr("page_id div 7") == F.col("__to")).select(F.col("url").alias("from_url"), "to_url")
    rules = (("block", "org", "/de/"), ("allow", "com", "/fr/"), ("block", "net", "/"))
    return judge(pages, rules, moved, html_col=None)


ORACLE = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(kind, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (SELECT page_id, host, path, (SELECT {'rule': h || q, 'v': kind} FROM r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, q)
       ORDER BY length(h || q) DESC, kind LIMIT 1) AS b FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict, NULL::VARCHAR AS alias_of FROM ruled
"""

REDIRECTS_ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query FROM pages),
n AS (SELECT *, CASE WHEN contains(url, '://') THEN host || path || query END AS node FROM p),
r(kind, h, q) AS (VALUES ('block', 'org', '/de/'), ('allow', 'com', '/fr/'), ('block', 'net', '/')),
ruled AS (SELECT page_id, node, host, path, (SELECT {'rule': h || q, 'v': kind} FROM r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, q)
       ORDER BY length(h || q) DESC, kind LIMIT 1) AS b FROM n),
e AS (SELECT DISTINCT a.node AS x, b.node AS y FROM n a JOIN n b ON a.page_id // 7 = b.page_id WHERE a.page_id % 3 <> 0 AND a.page_id >= 40 AND a.node <> b.node),
s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(node, c) AS (SELECT x, x FROM s UNION SELECT s.y, reach.c FROM reach JOIN s ON s.x = reach.node),
comp AS (SELECT node, min(c) AS c FROM reach GROUP BY node),
votes AS (SELECT c, bool_or(b.v = 'allow') AS ok FROM comp JOIN ruled USING (node) WHERE b.v IS NOT NULL GROUP BY c)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, CASE WHEN ok THEN 'allow' WHEN NOT ok THEN 'block' END, 'allow') AS verdict, comp.c AS alias_of
FROM ruled LEFT JOIN comp USING (node) LEFT JOIN votes ON votes.c = comp.c
"""
