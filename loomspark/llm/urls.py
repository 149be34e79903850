"""URL filters with redirect equivalence, in DataFrame functions only.

A rule names a host and the beginning of a path; it fits that host and all below it, and the longest rule that fits
decides a url. What no rule decides is decided by its aliases: redirects, canonical links and refreshes of pages are edges
between urls, urls that differ only in what no server tells apart are one node, and connected components of all edges, by
alternating large-star and small-star, are classes of equivalent urls. A block of any member goes to those members that no
rule decides; an explicit allow of any member takes precedence over it. All else is allowed.

One node: the scheme http or https, the case of scheme and host, a default port, an empty path, the fragment,
empty and tracking parameters make no difference.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; a null or empty one has no alias;
pages without html have no links; a link to nowhere or to itself is no edge; rows that repeat an id are judged each for
itself, those that repeat a url alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut, hot_limit, met
from loomspark.llm.neardup import components

ALLOW, BLOCK = "allow", "block"
#: Rules of the query: verdict, host and path (fixed values).
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"
#: Parameters that tell a server nothing (fixed values).
TRACKING = r"(?i)^(?:utm_[a-z]+|gclid|fbclid|msclkid)(?:=.*)?$"
#: Rules up to which they are one expression, and rows up to which decisions are broadcast (about 10 MB).
MOST_RULES, FEW = 1000, 200_000


def lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def host(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 3), F.lit(""))


def ordered(rules) -> list[tuple[str, str, str, str]]:
    """(verdict, host, path, rule), the longest first; of equal rules an allow goes first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    parts = [(v, r.partition("/")[0].lower(), "/" + r.partition("/")[2], r) for v, r in rules]
    for v, h, _, r in parts:
        if v not in (ALLOW, BLOCK) or not h or "/" not in r:
            raise ValueError(f"no rule: {v} {r}")
    return sorted(parts, key=lambda x: (-len(x[3]), x[3], x[0]))


def fits(h: Column, p: Column, rule_host: str, rule_path: str) -> Column:
    return ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)


def decided(h: Column, p: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host and path; null where none does."""
    some = ordered(rules)
    if not some:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    pick = lambda i: F.coalesce(*[F.when(fits(h, p, x[1], x[2]), x[i]) for x in some])
    return pick(3), pick(0)


def normal(url: Column) -> Column:
    """The form that urls of one node share; a text without an authority is its own form, nothing has none."""
    whole = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme, h, p = lower(F.regexp_extract(whole, AUTHORITY, 1)), host(whole), path(whole)
    web = scheme.isin("http", "https")
    h = F.when(web, F.regexp_replace(h, r":(?:80|443)?$", "")).otherwise(h)
    asked = F.split(F.regexp_extract(whole, r"(?s)\?(.*)$", 1), "&", -1)
    asked = F.array_join(F.filter(asked, lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    form = F.concat(F.when(web, "").otherwise(F.concat(scheme, F.lit(":"))), F.lit("//"), h, F.when(p == "", "/").otherwise(p), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))
    return F.when(url.rlike(AUTHORITY), form).otherwise(F.when(url != "", url))


def resolved(link: Column, url: Column) -> Column:
    """A link of a page as an absolute url; null where it leads nowhere."""
    base = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.concat(base, F.coalesce(F.nullif(F.regexp_extract(path(url), r"(?s)^.*/", 0), F.lit("")), F.lit("/")))
    found = (
        F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(base == "", None)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, "(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.rlike(r"^(?:[#]|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .otherwise(F.concat(folder, link))
    )
    return F.when(link != "", found)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in quotes of either kind or without; null if it has none."""
    at = rf"(?is)\s{name}\s*=\s*"
    values = [F.nullif(F.regexp_extract(tag, at + v, 1), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]
    return F.replace(F.trim(F.coalesce(*values)), F.lit("&amp;"), F.lit("&"))


def links(html: Column) -> Column:
    """array<string>: where a page says that it really is, by its first canonical link and its first refresh."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = lambda name: F.regexp_extract_all(plain, F.lit(rf"(?is)<{name}\s[^>]*>"), F.lit(0))
    first = lambda found: F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
    canonical = first(F.transform(tags("link"), lambda t: F.when(F.lower(_attribute(t, "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)"), _attribute(t, "href"))))
    content = lambda t: F.when(F.lower(_attribute(t, "http-equiv")) == "refresh", _attribute(t, "content"))
    refresh = first(F.transform(tags("meta"), lambda t: F.nullif(F.trim(F.regexp_extract(content(t), r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*)", 1)), F.lit(""))))
    # a plain search first: few pages have either
    return F.array_compact(F.array(F.when(html.rlike("(?i)canonical"), canonical), F.when(html.rlike("(?i)refresh"), refresh)))


def equivalents(pages: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(from_url, to_url): what pages and redirects (from_url, to_url) say is the same."""
    out = None
    if html_col is not None:
        u = F.col(url_col)
        out = pages.where(u.isNotNull()).select(u.alias("from_url"), F.explode(links(F.col(html_col))).alias("_to")).select("from_url", resolved(F.col("_to"), F.col("from_url")).alias("to_url"))
    if redirects is not None:
        more = redirects.select("from_url", resolved(F.col("to_url"), F.col("from_url")).alias("to_url"))
        out = more if out is None else out.unionByName(more)
    return out.where((F.col("from_url") != "") & (F.col("to_url") != ""))


def node(url: Column) -> Column:
    return F.md5(F.encode(normal(url), "UTF-8"))


def blocked_nodes(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(node) of all urls that have a blocked alias and no allowed one."""
    urls = pages.select(F.col(url_col).alias("url"))
    said = None
    if html_col is not None or redirects is not None:
        said = cut(equivalents(pages, redirects, url_col, html_col).distinct())
        urls = urls.unionByName(said.select(F.explode(F.array("from_url", "to_url")).alias("url")))
    urls = urls.where(F.col("url") != "")
    _, verdict = decided(host(F.col("url")), path(F.col("url")), rules)
    ruled = urls.withColumn("v", verdict).where(F.col("v").isNotNull()).select(node(F.col("url")).alias("node"), "v")
    marks = ruled.groupBy("node").agg(F.max(F.col("v") == BLOCK).alias("blocks"), F.max(F.col("v") == ALLOW).alias("allows"))
    only = (F.col("blocks")) & ~F.col("allows")
    edges = cut(said.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")).where("a <> b").distinct()) if said is not None else None
    if edges is None or edges.isEmpty():
        return cut(marks.where(only).select("node"))
    member = cut(components(edges, local=False))
    marks = marks.join(member.withColumnRenamed("id", "node"), "node", "left")
    alone = marks.where(F.col("component").isNull() & only).select("node")
    classes = marks.where("component is not null").groupBy("component").agg(F.max("blocks").alias("blocks"), F.max("allows").alias("allows")).where(only).select("component")
    # a large component goes to its members, not they to it
    sized = member.join(classes, "component", "left_semi").groupBy("component").agg(F.count("*").alias("n"))
    sized = cut(sized)
    n, most = sized.agg(F.sum("n"), F.max("n")).first()
    return cut(alone.unionByName(met(member, sized, ["component"], "n", hot_limit(n or 0), most=most or 0).select(F.col("id").alias("node"))))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html", id_col: str = "page_id") -> DataFrame:
    """A row for each row of pages: id, host, path, rule and verdict."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("own"), F.when(rule.isNull(), node(F.col("url"))).alias("node"))
    blocked = blocked_nodes(pages, rules, redirects, url_col, html_col).withColumn("by_alias", F.lit(True))
    if blocked.count() <= FEW:
        rows = rows.join(F.broadcast(blocked), "node", "left")
    else:
        free = rows.where(F.col("node").isNotNull())
        times = cut(free.groupBy("node").agg(F.count("*").alias("n")).join(blocked, "node"))
        n, most = times.agg(F.sum("n"), F.max("n")).first()
        # pages of a frequent url stay where they are; the rest meets by url
        hot = F.broadcast(times.where(F.col("n") >= hot_limit(n or 0)).select("node", F.col("by_alias").alias("hot")))
        cold = times.where(F.col("n") < hot_limit(n or 0)).select("node", "by_alias")
        marked = rows.join(hot, "node", "left")
        rest = marked.where("hot is null and node is not null").drop("hot").join(cold, "node", "left")
        rows = marked.where("hot is not null or node is null").withColumnRenamed("hot", "by_alias").unionByName(rest)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", F.when(F.col("by_alias"), BLOCK), F.lit(ALLOW)).alias("verdict"))


def _rules_sql(h: str, p: str, what: int) -> str:
    whens = " ".join(f"when ({h} = '{x[1]}' or ends_with({h}, '.{x[1]}')) and starts_with({p}, '{x[2]}') then '{x[what]}'" for x in ordered(RULES))
    return f"case {whens} end"


def _host_sql(u: str) -> str:
    return rf"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _path_sql(u: str) -> str:
    return rf"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _node_sql(u: str) -> str:
    """normal() in SQL, for web addresses; RE2 has no look-behind, so parameters are taken one by one."""
    whole = f"regexp_replace({u}, '(?s)#.*$', '')"
    asked = rf"array_to_string(list_filter(string_split(regexp_extract({whole}, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[a-z]+|gclid|fbclid|msclkid)(=.*)?$')), '&')"
    p = _path_sql(whole)
    return rf"'//' || regexp_replace({_host_sql(whole)}, ':(80|443)?$', '') || (case {p} when '' then '/' else {p} end) || (case {asked} when '' then '' else '?' || {asked} end)"


#: The same in SQL, where pages have absolute links with quoted attributes.
ORACLE = rf"""
with recursive p as (select page_id, coalesce(url, '') as url, html from pages),
l as (
  select url as f, replace(trim(unnest(list_transform(list_filter(regexp_extract_all(html, '(?is)<link\s[^>]*>'),
    lambda t: regexp_matches(t, '(?is)\srel\s*=\s*"canonical"'))[1:1], lambda t: regexp_extract(t, '(?is)\shref\s*=\s*"([^"]*)"', 1)))), '&amp;', '&') as t
  from p),
u as (select url from p union select f from l union select t from l),
v as (select {_node_sql("url")} as node, {_rules_sql(_host_sql("url"), _path_sql("url"), 0)} as v from u where url <> ''),
e as (select {_node_sql("f")} as a, {_node_sql("t")} as b from l where t <> ''),
two as (select a, b from e union select b, a from e),
r(node, v) as (select node, v from v where v is not null union select two.b, r.v from r join two on two.a = r.node),
m as (select node from r group by node having bool_or(v = 'block') and not bool_or(v = 'allow')),
q as (select page_id, url, {_host_sql("url")} as host, {_path_sql("url")} as path from p)
select page_id, host, path, {_rules_sql("host", "path", 3)} as rule,
  coalesce({_rules_sql("host", "path", 0)}, case when url <> '' and {_node_sql("url")} in (select node from m) then 'block' else 'allow' end) as verdict
from q
"""
