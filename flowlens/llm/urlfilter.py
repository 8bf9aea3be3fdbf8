"""Operator 1, URL filters by redirect equivalence (DataFrame functions only).

Rules (host, path, verdict) judge a url: a rule fits its host and all subdomains when the
url's path starts with the rule's path; the longest fitting rule string wins (ties: the
longer host, then allow). Urls without a rule take the verdict of their aliases: pages
that redirect (meta refresh) or name a canonical link are joined by an edge to the target,
distributed connected components gather the aliases, and

1. a rule that fits the url itself decides,
2. else an explicit allow of any alias gives allow,
3. else a block of any alias gives block,
4. else the url is allowed.

Targets that are not pages take part as aliases too. A url is compared as an alias without
its fragment, with scheme and host in lower case, ``.`` and ``..`` segments of the path
resolved, and an empty path as ``/`` (rules judge a page's own path as it stands).

Defined results: a null url, or one without ``://``, has empty host and path, fits no
rule, has no alias and is allowed; null html has no links; repeated rows and ids are
judged row by row; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import common as C
from flowlens.llm.components import connected_components

#: Rules up to this many are compiled into one column; more are joined by host and path.
COMPILED_RULES = 64
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# fixed values: the A-Z letters that are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER),
                      F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resolved(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; an empty one as ``/``."""
    closed = F.regexp_replace(path, r"(/\.{1,2})$", "$1/")
    parts = F.split(F.substring(closed, 2, 1 << 30), "/")
    folded = F.aggregate(parts, F.lit(""), lambda done, part: F.when(part == ".", done).when(
        part == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part)))
    return (F.when(path == "", F.lit("/")).when(path.rlike(r"/\.{1,2}(/|$)"), folded).otherwise(path))


def node_of(url: Column) -> Column:
    """The url as an alias node: without fragment, scheme and host in lower case, path resolved."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    asked = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(
        scheme, F.lit("://"), host_of(url), resolved(path_of(url)), asked))


def fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    """Whether the rule's host is the host or a parent of it and its path a prefix."""
    return (((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host)))
            & F.startswith(path, rule_path))


def match_rules(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null when none fits) to rows with host and path;
    ``key`` names a column that is unique over the rows.

    Short lists compile to one expression. Longer ones are joined on (host suffix, path
    prefix), the prefixes cut at the path lengths that occur in the rules.
    """
    rules = (rules.select(F.translate("host", UPPER, LOWER).alias("rh"), F.col("path").alias("rp"),
                          F.col("verdict").alias("rv"))
             .where("rh is not null and rp is not null and rv in ('allow', 'block')")
             .groupBy("rh", "rp").agg(F.min("rv").alias("rv")))
    few = rules.limit(COMPILED_RULES + 1).collect()
    if len(few) <= COMPILED_RULES:
        few.sort(key=lambda r: (-len(r.rh + r.rp), -len(r.rh), r.rv))
        found = [(fits(F.col("host"), F.col("path"), F.lit(r.rh), F.lit(r.rp)), r) for r in few]
        pick = lambda value: reduce(
            lambda rest, x: F.when(x[0], F.lit(value(x[1]))).otherwise(rest), reversed(found),
            F.lit(None).cast("string"))
        return df.withColumn("rule", pick(lambda r: r.rh + r.rp)).withColumn(
            "rule_verdict", pick(lambda r: r.rv))
    lengths = [r[0] for r in rules.select(F.length("rp")).distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    wide = (df.select(key, "path", F.explode(suffixes).alias("rh"), F.array_compact(F.array(*cut)).alias("cut"))
            .select(key, "rh", F.explode("cut").alias("rp")).join(rules, ["rh", "rp"]))
    best = wide.groupBy(key).agg(F.max(F.struct(
        (F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("h"),
        (F.col("rv") == "allow").alias("a"), F.concat("rh", "rp").alias("rule"),
        F.col("rv").alias("rule_verdict"))).alias("b"))
    return df.join(best.select(key, "b.rule", "b.rule_verdict"), key, "left")


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def link_edges(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` -> ``(u, v, kind)``: url to canonical link or redirect target.

    Comments, scripts and styles are taken out first; relative targets are resolved.
    """
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    url, to = F.col("url"), F.col("to")
    tags = (pages.where(url.contains("://"))
            .where(F.col("html").rlike(r"(?i)<(link|meta)\b[^>]*(canonical|refresh)"))
            .select("url", F.explode(F.regexp_extract_all(
                clean, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag")))
    tags = _pinned(tags, ["url"], rel=F.lower(_attribute(F.col("tag"), "rel")),
                   href=_attribute(F.col("tag"), "href"), content=_attribute(F.col("tag"), "content"),
                   equiv=F.lower(_attribute(F.col("tag"), "http-equiv")))
    canonical = F.col("rel").rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.regexp_extract("content", r"""(?i)url\s*=\s*['"]?([^'"]+)""", 1)
    found = _pinned(tags, ["url"], kind=F.when(canonical, "canonical").otherwise("redirect"),
                    to=F.trim(F.replace(F.when(canonical, F.col("href")).when(
                        F.col("equiv") == "refresh", refresh), F.lit("&amp;"), F.lit("&"))),
                    scheme=F.substring_index(url, "://", 1), host=host_of(url), path=path_of(url))
    found = found.where(F.coalesce(F.length("to"), F.lit(0)) > 0)
    site = F.concat("scheme", F.lit("://"), "host")
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    target = (F.when(to.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), to)
              .when(F.startswith("to", F.lit("//")), F.concat("scheme", F.lit(":"), "to"))
              .when(F.startswith("to", F.lit("/")), F.concat(site, to))
              .when(F.startswith("to", F.lit("?")), F.concat(site, "path", "to"))
              .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), to)))
    solved = _pinned(found, ["url", "kind"], target=target)
    return solved.select(node_of(url).alias("u"), node_of(F.col("target")).alias("v"), "kind")


def _pinned(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """The ``kept`` columns and new ones that are computed once: the generator keeps the
    planner from copying a long expression into each of its uses."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*kept, made)


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, host, path, rule, verdict and ``alias_root`` (smallest alias; null if none)
    of every row. ``edges(u, v)`` adds known redirects to those found in the html.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    links = link_edges(rows.select("url", "html")).select("u", "v")
    if edges is not None:
        links = links.unionAll(edges.select(node_of(F.col("u")), node_of(F.col("v"))))
    alias = connected_components(links)
    known = match_rules(_pinned(alias, ["node", "root"], host=host_of(F.col("node")),
                                path=path_of(F.col("node"))), rules, "node")
    groups = known.groupBy("root").agg(F.min("rule_verdict").alias("alias_verdict"))   # allow < block
    aliases = C.staged(alias.join(groups, "root").select("node", "root", "alias_verdict"), "alias")

    url = F.col("url")
    urls = _pinned(rows, ["id", "url"], host=host_of(url), path=path_of(url))
    judged = _with_rules(urls, rules)
    out = (judged.withColumn("node", node_of(url)).join(aliases, "node", "left"))
    return out.select(
        "id", "url", "host", "path", "rule",
        F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
        F.col("root").alias("alias_root"))


def _with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """match_rules over distinct (host, path), so that repeated urls and ids are no trouble."""
    if len(rules.limit(COMPILED_RULES + 1).collect()) <= COMPILED_RULES:
        return match_rules(urls, rules, "id")
    spot = F.concat_ws("/", F.length("host"), F.concat("host", "path"))
    seen = urls.select("host", "path").distinct().withColumn("spot", spot)
    return urls.withColumn("spot", spot).join(
        match_rules(seen, rules, "spot").select("spot", "rule", "rule_verdict"), "spot", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: rule and verdict of every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge_urls(C.table(spark, sf_dir, "pages"), rules)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql() -> str:
    """DuckDB SQL of the query: rules, links out of the html, aliases by a recursive walk."""
    after = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({after}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract({after}, '^[^/?#]*([^?#]*)', 1)"
    parts = f"string_split(substr(regexp_replace({path}, '(/\\.{{{{1,2}}}})$', '\\1/'), 2), '/')"
    step = ("lambda done, part: CASE part WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '')"
            " ELSE done || '/' || part END")
    clean_path = (f"CASE WHEN {path} = '' THEN '/' WHEN regexp_matches({path}, '/\\.{{{{1,2}}}}(/|$)')"
                  f" THEN list_reduce(list_prepend('', {parts}), {step}) ELSE {path} END")
    node = (f"CASE WHEN instr({{0}}, '://') > 0 THEN translate(split_part({{0}}, '://', 1), '{UPPER}', '{LOWER}')"
            f" || '://' || {host} || {clean_path} || regexp_extract({after}, '^[^?#]*(\\?[^#]*)', 1) END")
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    best = ("(SELECT {what} FROM rules r WHERE ({t}.host = r.h OR ends_with({t}.host, '.' || r.h))"
            " AND starts_with({t}.path, r.p) ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.v LIMIT 1)")
    attr = ("trim(regexp_replace(regexp_extract(tag, '(?is)[\\s\"''/]{0}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1),"
            " '^[\"'']|[\"'']$', '', 'g'))")
    to = (f"trim(replace(CASE WHEN canonical THEN {attr.format('href')} ELSE"
          f" regexp_extract({attr.format('content')}, '(?i)url\\s*=\\s*[''\"]?([^''\"]+)', 1) END, '&amp;', '&'))")
    clean = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"
    site = f"split_part(url, '://', 1) || '://' || {host.format('url')}"
    return f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {values}),
p AS (SELECT page_id, coalesce({host.format('url')}, '') AS host, coalesce({path.format('url')}, '') AS path,
             {node.format('url')} AS node FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all({clean}, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages
         WHERE url LIKE '%://%' AND regexp_matches(html, '(?i)<(link|meta)\\b[^>]*(canonical|refresh)')),
kinds AS (SELECT url, tag, regexp_matches(lower({attr.format('rel')}), '(^|\\s)canonical(\\s|$)') AS canonical,
                 lower({attr.format('http-equiv')}) = 'refresh' AS refresh FROM tags),
found AS (SELECT url, {to} AS dest FROM kinds WHERE canonical OR refresh),
solved AS (SELECT url, CASE WHEN regexp_matches(dest, '(?i)^[a-z][a-z0-9+.-]*://') THEN dest
                  WHEN starts_with(dest, '//') THEN split_part(url, '://', 1) || ':' || dest
                  WHEN starts_with(dest, '/') THEN {site} || dest
                  WHEN starts_with(dest, '?') THEN {site} || {path.format('url')} || dest
                  ELSE {site} || coalesce(nullif(regexp_extract({path.format('url')}, '^(.*/)', 1), ''), '/') || dest END AS dest
           FROM found WHERE dest <> ''),
half AS (SELECT {node.format('url')} AS u, {node.format('dest')} AS v FROM solved),
edge AS (SELECT u, v FROM half WHERE u <> v UNION SELECT v, u FROM half WHERE u <> v),
walk(node, other) AS (SELECT u, u FROM edge UNION SELECT w.node, e.v FROM walk w JOIN edge e ON e.u = w.other),
judged AS (SELECT w.node, {best.format(what='r.v', t='w')} AS v
           FROM (SELECT node, {host.format('other')} AS host, {path.format('other')} AS path FROM walk) w),
alias AS (SELECT node, min(v) AS v FROM judged GROUP BY node)
SELECT p.page_id, p.host, p.path, {best.format(what='r.h || r.p', t='p')} AS rule,
       coalesce({best.format(what='r.v', t='p')}, alias.v, 'allow') AS verdict
FROM p LEFT JOIN alias USING (node)
"""


ORACLE_SQL = _sql()
