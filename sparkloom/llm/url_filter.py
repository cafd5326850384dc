"""URL filters with redirect equivalence (DataFrame functions only).

Redirects (meta refresh, or a table of them) and canonical links join urls into components; a url without a rule
of its own is blocked if a rule blocks any url of its component.  A url's own rule, allow or block, comes first:
an explicit allow is never overridden by what an alias does.

The nodes of the graph are host, path and query, so the targets of a redirector (``r?u=1``, ``r?u=2``) don't become
one component.  A url that no link or redirect names with its query takes what is known of it without the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, stored

#: (action, host, path) of the production list.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: So many rules are compiled into the plan; longer lists are joined by host suffix.
FEW_RULES = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags of any length; one that is never closed runs to the end, so that a page is read once.
_TAGS = r"(?is)<(?:link|meta)\b[^>]*+(?:>|\z)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)


def _place(path: Column) -> Column:
    """The path as a node has it: an empty one is ``/``."""
    return F.when(path == "", "/").otherwise(path)


def _chain(rules: Sequence[tuple[str, str, str]]) -> Column:
    """(action, rule) of the longest rule that fits the columns host and path, else null."""
    out, host, path = None, F.col("host"), F.col("path")
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        value = F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<action: string, rule: string>") if out is None else out


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``urls(host, path, ...)`` with ``own``, the (action, rule) of the longest rule that fits (host and path
    together), else null.  A short list is compiled into the plan; a DataFrame (action, host, path), or a list of over
    FEW_RULES, is joined by the suffixes of distinct hosts, so that neither list nor urls need fit one machine.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= FEW_RULES:
            return urls.withColumn("own", _chain(rules))
        rules = urls.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    rules = rules.select("action", F.col("host").alias("r_host"), F.col("path").alias("r_path")).where("action IS NOT NULL AND r_host IS NOT NULL AND r_path IS NOT NULL").distinct()
    longest = F.broadcast(rules.agg(F.coalesce(F.max(F.length("r_host")), F.lit(0)).alias("most")))  # one row
    each = urls.where("host <> ''").select("host", "path").distinct().join(longest)
    tail = F.expr("right(concat('.', host), most + 1)")  # no suffix longer than the longest host of a rule
    dots = F.filter(F.sequence(F.lit(1), F.length(tail)), lambda i: F.substr(tail, i, F.lit(1)) == ".")
    each = each.where("most > 0").select("host", "path", F.explode(F.transform(dots, lambda i: F.substr(tail, i + 1))).alias("r_host"))
    fits = each.join(rules, "r_host").where(F.col("path").startswith(F.col("r_path")))
    order = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.concat("r_host", "r_path").alias("rule"), "action")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("o")).select("host", "path", F.struct(F.col("o.action").alias("action"), F.col("o.rule").alias("rule")).alias("own"))
    return urls.join(best, ["host", "path"], "left")


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) for canonical links and meta refreshes in ``html``; targets without a host are resolved."""
    tags = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag")).where(F.col("tag").endswith(">"))
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    refresh = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*['"]?\s*([^"'\s>]+)""", 1)
    is_link = F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?\s*canonical\b""")
    is_meta = F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b""")
    target = F.when(is_link, href).when(is_meta, refresh)
    base = F.concat(F.lit("x://"), host_of(F.col("url")))
    full = (
        F.when(target.rlike(_SCHEME), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.regexp_replace(_place(path_of(F.col("url"))), r"[^/]*$", ""), target))
    )
    return tags.where(target != "").select(F.col("url").cast("string").alias("url"), full.alias("target"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``redirects(url, target)`` adds edges to those found in the html.  Scheme and fragment make no other node; an
    empty path is the node of ``/``.  A null url, or one without ``://``, has empty host and path, is in no component,
    and is allowed; null html has no links.  Repeated rows and extra columns do no harm.
    """
    pages = pages.select("page_id", "url", "html")
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("url", "target"))
    url = lambda c: (host_of(c), _place(path_of(c)), query_of(c))
    node = lambda c: F.struct(*(x.alias(n) for n, x in zip(("host", "path", "query"), url(F.col(c)), strict=True)))
    # through explode: a filter pushed below would take the expressions of both ends along, several times
    ends = links.select(F.explode(F.array(F.struct(node("url").alias("a"), node("target").alias("b")))).alias("e")).select("e.a", "e.b")
    edges = stored(ends.where("a.host <> '' AND b.host <> '' AND a <> b").distinct())
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"))
    parts = ruled(parts, rules)
    if edges.isEmpty():
        dropped(edges)
        return parts.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", F.lit("allow")).alias("verdict"))
    members = stored(components(edges))
    dropped(edges)
    bad = ruled(members.select("node.host", "node.path", "component"), rules).where("own.action = 'block'").select("component").distinct()
    known = members.join(bad.withColumn("bad", F.lit(True)), "component", "left").select(F.col("node.host").alias("b_host"), F.col("node.path").alias("b_path"), F.col("node.query").alias("b_query"), F.coalesce("bad", F.lit(False)).alias("blocked"))
    plain = known.where("b_query = ''").select(F.col("b_host").alias("p_host"), F.col("b_path").alias("p_path"), F.col("blocked").alias("p_blocked"))
    place = _place(F.col("path"))
    found = parts.join(known, (F.col("host") == F.col("b_host")) & (place == F.col("b_path")) & (F.col("query") == F.col("b_query")), "left")
    found = found.join(plain, (F.col("host") == F.col("p_host")) & (place == F.col("p_path")), "left")
    verdict = F.coalesce("own.action", F.when(F.coalesce("blocked", "p_blocked"), "block"), F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


ORACLE = r"""
WITH RECURSIVE rules(action, h, p) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
part AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^?#]*(\?[^#]*)?', 1) AS query FROM part),
tag AS (SELECT host, path, query, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM page WHERE host <> ''),
raw AS (SELECT host, path, query, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
                        WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*[''"]?\s*([^"''\s>]+)', 1) END AS t FROM tag),
full_ AS (SELECT host, path, query, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN substr(t, instr(t, '://') + 3) WHEN starts_with(t, '//') THEN substr(t, 3) WHEN starts_with(t, '/') THEN host || t
                ELSE host || regexp_replace(CASE path WHEN '' THEN '/' ELSE path END, '[^/]*$', '') || t END AS v FROM raw WHERE t <> ''),
ends AS (SELECT [host, CASE path WHEN '' THEN '/' ELSE path END, query] AS a, [translate(regexp_extract(v, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), CASE regexp_extract(v, '^[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(v, '^[^/?#]*([^?#]*)', 1) END, regexp_extract(v, '^[^?#]*(\?[^#]*)?', 1)] AS b FROM full_),
edge AS (SELECT a, b FROM ends WHERE b[1] <> '' UNION SELECT b, a FROM ends WHERE b[1] <> ''),
reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
fit AS (SELECT host, path, arg_max((h || p, action), (length(h || p), h || p)) AS r FROM (SELECT DISTINCT host, path FROM page UNION SELECT a[1], a[2] FROM edge), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
known AS (SELECT a, bool_or(coalesce(fit.r[2] = 'block', false)) AS blocked FROM reach LEFT JOIN fit ON fit.host = b[1] AND fit.path = b[2] GROUP BY 1)
SELECT page_id, page.host, page.path, fit.r[1] AS rule, coalesce(fit.r[2], CASE WHEN coalesce(k.blocked, q.blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN fit ON fit.host = page.host AND fit.path = page.path
LEFT JOIN known k ON k.a = [page.host, CASE page.path WHEN '' THEN '/' ELSE page.path END, page.query]
LEFT JOIN known q ON q.a = [page.host, CASE page.path WHEN '' THEN '/' ELSE page.path END, '']
"""
