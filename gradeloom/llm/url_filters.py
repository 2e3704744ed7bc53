"""URL filters: host and path rules, and block decisions that reach every alias of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import ascii_lower, saved
from gradeloom.llm.components import connected_components

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Query parameters that never name another page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url"))).otherwise("")


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add url_host and url_path: both empty for a null url or one without '://'."""
    df = df.withColumn("_url", F.coalesce(F.col(url), F.lit("")))
    rest = _after_scheme(F.col("_url"))
    return df.withColumns({
        "url_host": ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        "url_path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    }).drop("_url")


def canonical_key(url: Column) -> Column:
    """The address without scheme, fragment, tracking parameters and closing slash; null where it is none."""
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    rest = F.regexp_replace(rest, rf"(?<=[?&])(?:{TRACKING})=[^&]*(?:&|$)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]$", ""), r"/$", "")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    return F.when(F.length(rest) > 0, F.concat(host, F.regexp_replace(rest, r"^[^/?]*", "")))


def rule_columns(rules: Sequence[tuple[str, str, str]], host: str = "url_host", path: str = "url_path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits; of equally long ones allow wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def alias_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(u, v): from each page's key to the key that its canonical link or its redirect names.

    Relative targets are taken from the page's host. Null html has no links.
    """
    tag = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canonical = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    tag = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    redirect = F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    links = pages.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), "url_host", F.explode(F.filter(F.array(canonical, redirect), lambda x: F.length(x) > 0)).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).when(F.col("to").startswith("/"), F.concat(F.lit("http://"), "url_host", "to")).otherwise(F.col("to"))
    return links.select(F.col("key").alias("u"), canonical_key(to).alias("v"))


def _node(written: bool, name: Column) -> Column:
    """A node of the address graph: a url as written, or a canonical address. Canonical ones are the smaller."""
    return F.struct(F.lit(int(written)).alias("written"), name.alias("name"))


def address_links(page: DataFrame, html: str = "html") -> DataFrame:
    """(u, v) nodes: each url as written to its canonical address, and canonical addresses to those that their pages name."""
    written = page.where(F.col("_key").isNotNull()).select(_node(True, F.col("_written")).alias("u"), _node(False, F.col("_key")).alias("v")).distinct()
    named = alias_links(page, html).where(F.col("v").isNotNull())
    return written.unionByName(named.select(_node(False, F.col("u")).alias("u"), _node(False, F.col("v")).alias("v")))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """Judge every page: adds url_host, url_path, rule, verdict and component.

    A page whose url a rule fits gets the longest rule's verdict. Any other page takes the decision of
    its aliases: urls joined to its own by canonical addresses, canonical links and redirects
    (connected components, named by their least canonical address). There an explicit allow precedes a block; without either the page
    is allowed. rules is a list in the driver and small by contract; pages meet only summed decisions.
    Null or odd urls have empty host and path, no rule and no alias. Repeated rows keep their rows; columns
    of the added names are replaced, others but html stay; long urls are taken whole; an empty table gives no rows.
    """
    page = with_host_path(pages, url)
    page = page.withColumn("_key", canonical_key(F.col(url)))
    rule, verdict = rule_columns(rules)
    page = page.withColumns({"rule": rule, "_own": verdict, "_written": F.when(F.col("_key").isNotNull(), F.col(url))})
    label = connected_components(address_links(page, html))
    own = page.where(F.col("_key").isNotNull()).groupBy("_written", "_key").agg(F.max(F.col("_own") == "block").alias("blocked"), F.max(F.col("_own") == "allow").alias("allowed"))
    urls = saved(own.withColumn("node", _node(True, F.col("_written"))).join(label, "node").drop("node"), "url_nodes")
    decided = urls.groupBy("component").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    decided = decided.where("blocked and not coalesce(allowed, false)").select("component", F.lit("block").alias("_alias"))
    told = urls.join(decided, "component", "left").withColumn("_component", F.col("component.name"))
    told = told.where("_alias is not null or _component != _key").select("_written", "_component", "_alias")
    out = page.drop(html).join(told, "_written", "left")
    return out.withColumn("verdict", F.coalesce("_own", "_alias", F.lit("allow"))).withColumn("component", F.coalesce("_component", "_key")).drop("_own", "_alias", "_key", "_written", "_component")


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page judged by RULES and its aliases."""
    from gradeloom.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), "rule", "verdict", "component")


def _key_sql(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1)"
    rest = f"regexp_replace({rest}, '([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+', '\\1', 'g')"
    rest = f"regexp_replace(regexp_replace({rest}, '[?&]$', ''), '/$', '')"
    low = f"translate(regexp_extract({rest}, '^[^/?]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"CASE WHEN length({rest}) > 0 THEN {low} || regexp_replace({rest}, '^[^/?]*', '') END"


def op8_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for op8_url_filters."""
    order = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow"))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in order]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, order, strict=True))
    own = " ".join(f"WHEN {f} THEN '{what}'" for f, (what, _, _) in zip(fits, order, strict=True))
    return f"""WITH RECURSIVE a AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_key_sql("url")} AS key FROM a),
p AS (SELECT *, CASE {rule} END AS rule, CASE {own} END AS own FROM b),
t AS (SELECT key, host, unnest([regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS x FROM p WHERE key IS NOT NULL),
l AS (SELECT key AS u, {_key_sql("CASE WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN 'http://' || host || x ELSE x END")} AS v FROM t WHERE length(x) > 0),
e AS (SELECT u, v FROM l WHERE u <> v UNION SELECT v, u FROM l WHERE u <> v),
w AS (SELECT u AS n, u AS m FROM e UNION SELECT w.n, e.v FROM w JOIN e ON e.u = w.m),
c AS (SELECT n AS key, min(m) AS component FROM w GROUP BY n),
k AS (SELECT p.key, coalesce(component, p.key) AS component, bool_or(coalesce(own = 'block', false)) AS blocked, bool_or(coalesce(own = 'allow', false)) AS allowed FROM p LEFT JOIN c ON c.key = p.key WHERE p.key IS NOT NULL GROUP BY ALL),
d AS (SELECT component, bool_or(blocked) AND NOT bool_or(allowed) AS bad FROM k GROUP BY component)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN bad THEN 'block' END, 'allow') AS verdict, k.component FROM p LEFT JOIN k ON k.key = p.key LEFT JOIN d ON d.component = k.component"""
