"""URL block and allow rules that follow redirects and canonical links.

Pages whose addresses lead to each other (redirect table, ``<link rel=canonical>``, ``<meta http-equiv=refresh>``) are
aliases: connected components over those edges. An address with a rule of its own keeps that rule's verdict. Any other
address takes the decision of its aliases: allow if one of them is explicitly allowed, else block if one is blocked,
else allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, connected_components

#: Fixed values: (verdict, host, path) of the rules in use.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MAX_RULES = 2000

TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of equally long ones an allow rule wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into the plan")
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1:])):
        on_host = (host == h) | host.endswith(f".{h}")
        fits.append(F.when(on_host & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """An address without its fragment, the vertex of the alias graph."""
    return F.regexp_extract(url, r"^[^#]*", 0)


def _absolute(target: Column, url: Column) -> Column:
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme, host = F.substring_index(url, "://", 1), F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) that pages state in their html; pages without address or html have none."""
    tags = (
        pages.select("url", "html")
        .where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|http-equiv"))
        .select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    )
    target = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(
        F.col("tag").rlike(REFRESH), F.regexp_extract("tag", REFRESH_URL, 1)
    )
    found = tags.select("url", target.alias("t")).where("t is not null and t != ''")
    return found.select(node_of(F.col("url")).alias("a"), node_of(_absolute(F.col("t"), F.col("url"))).alias("b"))


def judge(
    pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, host, path, rule, verdict.

    ``redirects`` (source, target) adds edges. Null or malformed addresses have empty host and path, no rule and no
    aliases: they are allowed. Repeated rows are judged alike, each on its own row; an empty table gives no rows. Other
    columns are not read.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source")), node_of(F.col("target"))))
    members = connected_components(edges)
    fit = rule_of(host_of(F.col("vertex")), path_of(F.col("vertex")), rules)
    ruled = members.withColumn("verdict", fit["verdict"])
    decided = ruled.groupBy("root").agg(F.min("verdict").alias("alias_verdict")).where("alias_verdict is not null")
    aliases = members.join(decided, "root").select(F.col("vertex").alias("node"), "alias_verdict")  # allow < block
    url = F.col("url")
    own = pages.select("page_id", "url", node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return own.join(aliases, "node", "left").select(
        "page_id", "url", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
    )


def kept_pages(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The (page_id, url) rows that are allowed."""
    return judge(pages, redirects, rules).where("verdict = 'allow'").select("page_id", "url")


ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), tags AS (
  SELECT url, rest, unnest(regexp_extract_all(html, '{TAG.replace("'", "''")}')) AS tag FROM p WHERE rest IS NOT NULL
), targets AS (
  SELECT url, rest, replace(CASE WHEN regexp_matches(tag, '{CANONICAL.replace("'", "''")}') THEN regexp_extract(tag, '{HREF.replace("'", "''")}', 1)
    WHEN regexp_matches(tag, '{REFRESH.replace("'", "''")}') THEN regexp_extract(tag, '{REFRESH_URL.replace("'", "''")}', 1) END, '&amp;', '&') AS t FROM tags
), edges AS (
  SELECT regexp_extract(url, '^[^#]*') AS a, regexp_extract(CASE WHEN strpos(t, '://') > 0 THEN t
    WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN split_part(url, '://', 1) || '://' || regexp_extract(rest, '^[^/?#]*') || t
    ELSE split_part(url, '://', 1) || '://' || regexp_extract(rest, '^[^/?#]*')
      || CASE WHEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '[^/]*$', '') END || t END, '^[^#]*') AS b
  FROM targets WHERE t <> ''
), sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS u, a AS v FROM sym UNION SELECT r.u, s.b FROM reach r JOIN sym s ON r.v = s.a),
nodes AS (SELECT regexp_extract(url, '^[^#]*') AS node FROM p UNION SELECT a FROM sym),
split AS (
  SELECT node, CASE WHEN strpos(node, '://') > 0 THEN substr(node, strpos(node, '://') + 3) END AS rest FROM nodes
), hosted AS (
  SELECT node, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split
), rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
ruled AS (
  SELECT node, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
  FROM hosted LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
), alias AS (SELECT u AS node, min(verdict) AS verdict FROM reach JOIN ruled ON ruled.node = reach.v GROUP BY u)
SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(ruled.verdict, alias.verdict, 'allow') AS verdict
FROM p LEFT JOIN ruled ON ruled.node = regexp_extract(url, '^[^#]*') LEFT JOIN alias ON alias.node = ruled.node
"""
