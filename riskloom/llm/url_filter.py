"""URL filters with redirect equivalence [native]: block and allow rules on host suffix and path prefix, and
decisions that spread over components of redirect and canonical-link edges.

A url's own longest fitting rule decides. A url that no rule fits takes its component's decision: allow if a
member is expressly allowed, else block if a member is blocked, else allow. Urls are told apart by lower-cased
host, path and query; scheme and fragment are left out. Null and odd urls have host and path "" and are
allowed; pages without links form no component; repeated rows give repeated results; an empty table gives an empty one;
other columns are not read. Html of any length is searched by two expressions; links with thousands of dot segments
cost the square of their number. Keys of urls are 64-bit hashes: among n urls two share one with chance n^2 / 2^65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import connected_components

#: Fixed values of the contract: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules are literals of the plan, so their number is bounded; larger lists belong in a table join.
MOST_RULES = 1000

_CANONICAL = r"""(?is)<link\b(?=[^>]*[\s"'/]rel\s*=\s*["']?canonical\b)[^>]*[\s"'/]href\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*[\s"'/]http-equiv\s*=\s*["']?refresh\b)[^>]*[\s"'/]content\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null: the rule's host or a subdomain of it, and a path that starts with the rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} literal rules")
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """Identity of a url: host, path and query, as a 64-bit hash; null for no url."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.xxhash64(host_of(url), path_of(url), query))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its segments . and .. resolved (RFC 3986, 5.2.4)."""
    parts = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))
    step = lambda so_far, x: F.when(x == ".", so_far).when(x == "..", F.regexp_replace(so_far, "/[^/]*$", "")).otherwise(F.concat(so_far, F.lit("/"), x))
    folded = F.concat(F.aggregate(parts, F.lit(""), step), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def absolute(link: Column, base: Column) -> Column:
    """link as seen from the page base, by RFC 3986, 5.2; links of schemes without :// (mail addresses, scripts) have no host."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, r"(?s)^(.*/)", 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(path == "", F.concat(site, own, F.when(link.startswith("?"), link).otherwise(F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1))))
        .when(link.startswith("/"), F.concat(site, without_dots(path), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): canonical links and meta refreshes of the pages, as absolute urls."""
    links = F.array(F.regexp_extract(html, _CANONICAL, 1), F.regexp_extract(html, _REFRESH, 1))
    has = F.col(html).rlike(r"(?i)canonical|http-equiv")
    found = pages.where(has & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.explode(links).alias("link")).where("link <> ''")
    return found.select("url", absolute(F.regexp_replace("link", "&amp;", "&"), F.col("url")).alias("target"))


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, component) per page. edges: (url, target), by default those in the pages' html.

    Only the urls in edges are joined; the join on the url's key is an equi-join of a narrow table, which
    adaptive execution splits where one url holds many pages. Pages without a url key, which join nothing, are dealt
    by their page's key instead.
    """
    edges = alias_edges(pages, url, html) if edges is None else edges
    u, t = F.col("url"), F.col("target")
    linked = edges.select(url_key(u).alias("a"), url_key(t).alias("b")).where("a is not null and b is not null")
    ends = edges.select(F.explode(F.array(u, t)).alias("url")).where("url is not null")
    decided = ends.select(url_key(u).alias("node"), verdict_of(rule_of(host_of(u), path_of(u), rules), rules).alias("own")).where("node is not null").distinct()
    parts = connected_components(linked)
    spread = (
        decided.join(parts, "node").groupBy("component")
        .agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
        .select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow").alias("spread"))
    )
    labels = parts.join(spread, "component").select(F.col("node").alias("_node"), F.lit(0).alias("_salt"), "component", "spread")
    at = F.col(url)
    judged = pages.select(F.col(key), host_of(at).alias("host"), path_of(at).alias("path"), F.coalesce(url_key(at), F.lit(0)).alias("_node"), F.when(url_key(at).isNull(), F.pmod(F.xxhash64(key), F.lit(1024)) + 1).otherwise(0).cast("int").alias("_salt"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.col("spread"), F.lit("allow"))
    return judged.join(labels, ["_node", "_salt"], "left").select(key, "host", "path", "rule", verdict.alias("verdict"), "component")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; aliases are the redirects and canonical links in the pages."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("component")


OP3_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
l AS (
  SELECT url, unnest([
    regexp_extract(html, '<link\b[^>]*[\s"''/]rel\s*=\s*["'']?canonical\b[^>]*[\s"''/]href\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
    regexp_extract(html, '<link\b[^>]*[\s"''/]href\s*=\s*["'']?([^"''\s>]+)[^>]*[\s"''/]rel\s*=\s*["'']?canonical\b', 1, 'is'),
    regexp_extract(html, '<meta\b[^>]*[\s"''/]http-equiv\s*=\s*["'']?refresh\b[^>]*[\s"''/]content\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1, 'is')]) AS link
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
lp AS (SELECT url, link, regexp_extract(link, '^([^?#]*)', 1, 's') AS lpath, regexp_extract(link, '^[^?#]*(.*)$', 1, 's') AS rest,
    regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS site, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS own FROM (SELECT url, replace(link, '&amp;', '&') AS link FROM l WHERE link <> '')),
lm AS (SELECT *, CASE WHEN starts_with(lpath, '/') THEN lpath WHEN own = '' THEN '/' || lpath ELSE regexp_extract(own, '^(.*/)', 1, 's') || lpath END AS merged FROM lp),
ld AS (SELECT *, CASE WHEN regexp_matches(merged, '/\.\.?(/|$)') THEN
    list_reduce(string_split(merged, '/')[2:], lambda acc, x: CASE x WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END, '') || CASE WHEN regexp_matches(merged, '/\.\.?$') THEN '/' ELSE '' END
    ELSE merged END AS clean FROM lm),
e AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || link
    WHEN lpath = '' THEN site || own || CASE WHEN starts_with(link, '?') THEN link ELSE regexp_extract(url, '^[^?#]*(\?[^#]*)', 1, 's') END
    ELSE site || clean || rest END AS target FROM ld),
u AS (SELECT DISTINCT url FROM (SELECT url FROM p UNION ALL SELECT target FROM e)),
n AS (SELECT url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_extract(url, '^[^?#]*(\?[^#]*)', 1, 's') AS query FROM u WHERE contains(url, '://')),
r(rule, rhost, rpath, rverdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
hp AS (SELECT DISTINCT host, path FROM p UNION SELECT DISTINCT host, path FROM n),
f AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS own FROM hp
  LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
k AS (SELECT url, host || chr(10) || path || chr(10) || query AS id, own FROM n JOIN f USING (host, path)),
g AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e JOIN k a ON a.url = e.url JOIN k b ON b.url = e.target),
both_ways AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, x.b FROM reach JOIN both_ways x ON x.a = reach.b),
s AS (SELECT reach.a AS id, CASE WHEN bool_or(k.own = 'allow') THEN 'allow' WHEN bool_or(k.own = 'block') THEN 'block' ELSE 'allow' END AS spread
  FROM reach JOIN k ON k.id = reach.b GROUP BY reach.a)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.own, s.spread, 'allow') AS verdict
FROM p JOIN f ON f.host = p.host AND f.path = p.path LEFT JOIN k ON k.url = p.url LEFT JOIN s ON s.id = k.id
"""
