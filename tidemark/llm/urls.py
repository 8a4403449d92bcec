"""URL rules with redirect equivalence: a block reaches the aliases of a blocked page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import materialise

#: Rules of the registered query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"<[Ll][Ii][Nn][Kk]\s[^>]*>"
_CANONICAL = r"\s[Rr][Ee][Ll]\s*=\s*[\"']?[Cc][Aa][Nn][Oo][Nn][Ii][Cc][Aa][Ll][\"'\s/>]"
_HREF = r"\s[Hh][Rr][Ee][Ff]\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"<[Mm][Ee][Tt][Aa]\s[^>]*>"
_REFRESH = r"\s[Hh][Tt][Tt][Pp]-[Ee][Qq][Uu][Ii][Vv]\s*=\s*[\"']?[Rr][Ee][Ff][Rr][Ee][Ss][Hh][\"'\s/>]"
_TARGET = r"[;,\"'\s][Uu][Rr][Ll]\s*=\s*[\"']?([^\"'\s>]+)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """The graph's name of a url: without fragment, host in lower case. Null or without `://`: null."""
    host = host_of(url)
    scheme = F.regexp_extract(url, r"^((?s:.*?)://)", 1)
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    path = F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.contains("://"), F.concat(lower_ascii(scheme), host, path))


def resolve(url: Column, target: Column) -> Column:
    """A link target read on the page `url`: absolute, `//host/..`, `/path`, `?query` or relative to the page's folder."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme, origin = F.regexp_extract(url, r"^((?s:.*?):)//", 1), F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, target))
            .when(target.startswith("/"), F.concat(origin, target))
            .when(target.startswith("?"), F.concat(origin, path_of(url), target))
            .when(target.startswith("#"), url)
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's key and the key of a canonical link or refresh redirect in its html."""
    found = F.concat(
        F.transform(F.filter(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda t: t.rlike(_CANONICAL)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.filter(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda t: t.rlike(_REFRESH)), lambda t: F.regexp_extract(t, _TARGET, 1)))
    rows = pages.where("html is not null and url is not null").select("url", F.explode(found).alias("target")).where("target <> ''")
    return rows.select(page_key(F.col("url")).alias("a"), page_key(resolve(F.col("url"), F.col("target"))).alias("b")).where("a <> b")


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, host and path counted together; null when none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    whens = lambda values: reduce(lambda acc, x: acc.when(*x), zip(fits[1:], map(F.lit, values[1:])), F.when(fits[0], F.lit(values[0])))
    return whens([h + p for _, h, p in ordered]), whens([v for v, _, _ in ordered])


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component for each row of `pages` (page_id, url, html).

    A url with a fitting rule gets the rule's verdict. Any other is judged by its component of redirects and canonical
    links (those in the html and, when given, the rows `source_url, target_url` of `redirects`): allow if a member is
    explicitly allowed, else block if a member is explicitly blocked, else allow. Rules also count for link targets
    that are no pages themselves. A url alone in its component has no component and is allowed.

    Null url or one without `://`: host and path empty, no rule, allow. Null html: no links. Repeated rows are judged
    alike and all returned; an empty table gives no rows; columns other than the three are not read."""
    if not rules:
        raise ValueError("at least one rule is needed")
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(page_key(F.col("source_url")).alias("a"), page_key(F.col("target_url")).alias("b")))
    members = materialise(components(edges), "aliases")
    rule, verdict = matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    groups = members.groupBy("component").agg(F.max(F.coalesce(verdict == "allow", F.lit(False))).alias("allowed"), F.max(F.coalesce(verdict == "block", F.lit(False))).alias("blocked"))
    fate = members.join(groups, "component").select(F.col("node").alias("key"), "component", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("inherited"))
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(page_key(F.col("url")), F.concat(F.lit("none:"), F.xxhash64("page_id").cast("string"))).alias("key"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return base.join(fate, "key", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "inherited", F.lit("allow")).alias("verdict"), "component")
