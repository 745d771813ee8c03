"""URL filters with redirect equivalence.

A rule (action, host, path) fits its host and all subdomains when the url's path starts with the
rule's; the longest host+path wins and, at equal length, allow. Pages that no rule fits take the
decision of their aliases: urls with the same normal form, and urls that redirects or canonical
links join, directly or over others (distributed connected components). Targets of links are judged by
the rules too, whether or not the table has a page for them. In such a class an explicit allow goes
before a block; a class without any rule is allowed.

All canonical links and refreshes of a page count, with character references decoded, and are resolved
against the page or its base; those in comments or scripts do not. Null urls and urls without '://'
have empty host and path, fit no rule and have no alias: allowed. Null or empty html has no links. Of
rules of equal length allow goes first, then the order of host and path. Extra columns are ignored,
whatever their names. Repeated rows give repeated results, an empty table an empty table.
"""

from __future__ import annotations

import html as _html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from civicframe.llm.common import table, written
from civicframe.llm.html_extract import ATTR, TOKEN
from civicframe.llm.components import connected_components

#: The rules of the production query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Up to this many rules are an expression; more are joined on the host's suffixes.
INLINE_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """Without scheme, leading www., fragment, tracking parameters, .html and the last slash; the query's parts in order."""
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)=")))
    path = F.regexp_replace(path_of(url), r"(\.html?|/)$", "")
    form = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), path, F.lit("?"), F.array_join(parts, "&"))
    return F.when(F.instr(url, "://") > 0, form)


def links_of(url: str, page: str) -> list[str]:
    """Canonical links and refreshes of a page, as absolute urls."""
    base, out = url, []
    for m in TOKEN.finditer(page):
        if m[2] or (m[3] or "").lower() not in ("link", "meta", "base"):
            continue
        attrs: dict = {}
        for a in ATTR.finditer(m[4]):
            attrs.setdefault(a[1].lower(), _html.unescape(a[2] or a[3] or a[4] or "").strip())
        tag = m[3].lower()
        if tag == "base" and base is url and attrs.get("href"):
            base = _joined(url, attrs["href"]) or url
        elif tag == "link" and "canonical" in attrs.get("rel", "").lower().split():
            out.append(attrs.get("href"))
        elif tag == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
            to = re.search(r"(?i)\burl\s*=\s*(?:\"([^\"]*)|'([^']*)|(\S+))", attrs.get("content", ""))
            out.append(to and (to[1] or to[2] or to[3]))
    found = (_joined(base, x) for x in out if x)
    return [x for x in found if x]


def _joined(base: str, ref: str) -> str | None:
    try:
        return urljoin(base, ref)
    except ValueError:  # no valid host
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def link_targets(url: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([links_of(u, h) for u, h in zip(url, html)], dtype=object)


def _rank(rules) -> list:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and action of the longest rule that fits columns host and path, else null."""
    if len(rules) <= INLINE_RULES:
        rule = action = None
        for act, host, path in _rank(rules):
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule = (F if rule is None else rule).when(fits, F.lit(host + path))
            action = (F if action is None else action).when(fits, F.lit(act))
        null = F.lit(None).cast("string")
        return df.withColumn("rule", null if rule is None else rule).withColumn("action", null if action is None else action)
    ranked = [(a, h, p, i) for i, (a, h, p) in enumerate(_rank(rules))]
    listed = df.sparkSession.createDataFrame(ranked, "r_action string, r_host string, r_path string, r_rank int")
    keys = df.select("host", "path").distinct()
    suffixes = F.expr(r"transform(sequence(1, size(split(host, '\\.'))), i -> substring_index(host, '.', -i))")
    best = (
        keys.withColumn("r_host", F.explode(suffixes)).join(listed, "r_host").filter("startswith(path, r_path)")
        .groupBy("host", "path").agg(F.min_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")), "r_rank").alias("best"))
    )
    return df.join(best, ["host", "path"], "left").select(*[df[c] for c in df.columns], "best.rule", "best.action")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, alias_class, own_action."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), normal_form(url).alias("form"))
    judged = with_rule(base, rules)
    targets = (
        pages.filter((F.instr(url, "://") > 0) & F.col(html_col).rlike("(?i)canonical|refresh"))
        .select(normal_form(url).alias("u"), F.explode(link_targets(url, F.col(html_col))).alias("target"))
    )
    # links are parsed once: for the edges, and for the rules that fit their targets
    links = written(targets.select("u", normal_form(F.col("target")).alias("v"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path")).filter("u <> v").distinct(), "links")
    alias = connected_components(links.select("u", "v"))
    linked = with_rule(links.select("host", "path", F.col("v").alias("form")), rules)
    forms = (
        judged.select("form", "action").unionByName(linked.select("form", "action")).filter("form IS NOT NULL").groupBy("form")
        .agg(F.max(F.expr("action = 'allow'")).alias("a"), F.max(F.expr("action = 'block'")).alias("b"))
        .join(alias, F.col("form") == F.col("node"), "left")
        .select("form", F.coalesce("component", "form").alias("alias_class"), "a", "b")
    )
    classes = forms.groupBy("alias_class").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    said = (
        forms.select("form", "alias_class").join(classes, "alias_class")
        .select("form", "alias_class", F.expr("CASE WHEN a THEN 'allow' WHEN b THEN 'block' ELSE 'allow' END").alias("by_alias"))
    )
    return judged.join(said, "form", "left").select(
        F.col("page_id").alias(id_col), "host", "path", "rule",
        F.coalesce("action", "by_alias", F.lit("allow")).alias("verdict"), "alias_class",
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: The given pages carry no redirect or canonical link, so classes are normal forms here; test_url_filters covers links.
ORACLE = {
    "op10_url_filters": r"""
        WITH p AS (SELECT page_id, url,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        f AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html?|/)$', '') || '?' ||
            array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
                lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') END AS alias_class,
            CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
        a AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM f),
        c AS (SELECT alias_class, max(action = 'allow') AS a, max(action = 'block') AS b FROM a GROUP BY alias_class)
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN c.a THEN 'allow' WHEN c.b THEN 'block' END, 'allow') AS verdict, alias_class
        FROM a LEFT JOIN c USING (alias_class)"""
}
