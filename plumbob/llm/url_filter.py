"""Allow and block rules on URLs, carried over redirects and canonical links.

A URL is judged by the longest rule that fits it. URLs that redirect to each
other or name each other as canonical are aliases: they form the connected
components of those links, found by distributed rounds, and a URL without a rule
of its own takes the decision of its aliases. An explicit allow always wins: a
page with an allow rule stays allowed, and a component that holds an allowed URL
is not blocked. Everything is a DataFrame expression.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, stored
from plumbob.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tasks over which the pages of one URL are spread when they meet the decision of its aliases.
SALTS = 32

# A tag's target: of a link that is canonical, and of a refresh.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical["'\s/>])[^>]*\bhref\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh["'\s/>])[^>]*\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"'>\s]+)"""

# A character reference in an attribute. Without its semicolon a name counts only where no "=" follows.
REFERENCE = r"&(?:#[xX][0-9A-Fa-f]++;?|#[0-9]++;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))"
#: What names stand for, and the numbers of Windows-1252 that HTML reads as its characters.
CHARACTERS = json.dumps(
    {f"&{name}": text for name, text in html5.items()}
    | {f"#{n}": text for n in range(128, 160) if (text := bytes([n]).decode("cp1252", "ignore"))}
)


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], what: int) -> Column:
    """The longest rule of ``(host/path, action)`` that fits, or its action; null if none does.

    A rule fits its host and all subdomains if the path starts with its own.
    Rules of one length are taken in alphabetical order.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, rest = rule[0].partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule[what])).otherwise(found)
    return found


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``."""
    segments = F.split(path, "/", -1)
    none = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), none, step)
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(kept, ends), "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL without its scheme, fragment and dot segments, host in lower case: what aliases are compared by."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(without_dots(path)), query)


def decoded(text: Column) -> Column:
    """An attribute's value with its character references read; what is none stays as it is."""
    table = F.from_json(F.lit(CHARACTERS), "map<string,string>")

    def character(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^&#[xX]?([0-9A-Fa-f]+)", 1)
        # Longer numbers are no characters, and leading zeros do not count.
        short = F.right(F.concat(F.lit("0"), F.regexp_replace(digits, "^0+", "")), F.lit(9))
        n = F.when(reference.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("bigint")
        fine = (F.length(F.regexp_replace(digits, "^0+", "")) <= 8) & n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        by_number = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
        named = F.coalesce(F.try_element_at(table, reference), reference)
        return F.when(reference.startswith("&#"), F.coalesce(F.try_element_at(table, F.concat(F.lit("#"), n.cast("string"))), by_number)).otherwise(named)

    between = F.split(text, REFERENCE, -1)
    read = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), character)
    parts = F.zip_with(between, read, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def resolved(target: Column, base: Column) -> Column:
    """A link's target as a URL; relative ones are put on the base's host, folder or path."""
    target = F.trim(target)
    root = F.concat(F.lit("http://"), host_of(base))
    folder = F.regexp_extract(path_of(base), "^(.*/)", 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, F.when(path_of(base) == "", "/").otherwise(path_of(base)), target))
        .when(target.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), None)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame, url_column: str, html_column: str) -> DataFrame:
    """``(a, b)``: nodes of each page and of the targets of its canonical links and refreshes."""
    html, url = ref(html_column).cast("string"), ref(url_column).cast("string")

    def first(pattern: str, group: int) -> Column:
        return F.regexp_extract(html, pattern, group)

    canonical = F.concat(*(first(CANONICAL, g) for g in (1, 2, 3)))
    refresh = first(REFRESH, 1)
    targets = F.filter(
        F.array(
            F.when(F.lower(html).contains("canonical"), canonical),
            F.when(F.lower(html).contains("refresh"), refresh),
        ),
        lambda t: t.isNotNull() & (t != ""),
    )
    rows = pages.where(url.contains("://")).select(url.alias("url"), targets.alias("targets")).where(F.size("targets") > 0)
    rows = rows.select("url", F.explode("targets").alias("target")).select("url", decoded(F.col("target")).alias("target"))
    # Written between the steps: one expression of both would be too long to compile.
    rows = stored(rows.select("url", resolved(F.col("target"), F.col("url")).alias("target")), "links")
    return rows.where("target IS NOT NULL").select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))


def alias_decisions(links: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(node, decision)`` for each node of links whose component holds a rule; allow before block."""
    nodes = connected_components(links)
    url = F.concat(F.lit("http://"), F.col("node"))
    own = nodes.withColumn("action", matching_rule(host_of(url), path_of(url), rules, 1))
    groups = own.groupBy("component").agg(F.min("action").alias("decision")).where("decision IS NOT NULL")  # allow < block
    return nodes.join(groups, "component").select("node", "decision")


def judge_pages(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    redirects: DataFrame | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules`` are ``(host/path, 'allow' | 'block')``; ``redirects`` may add links
    ``(from_url, to_url)`` to those that pages hold. A page without a rule takes
    the decision of its aliases, else it is allowed. A null URL, or one without
    ``://``, has an empty host and path and no aliases. Repeated rows stay.
    """
    links = page_links(pages, url_column, html_column)
    if redirects is not None:
        known = redirects.where(F.col("from_url").contains("://") & F.col("to_url").contains("://"))
        links = links.union(known.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    aliases = alias_decisions(links, rules)
    salts = aliases.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    url = F.col("url")
    rows = pages.select(as_long(id_column).alias("page_id"), F.coalesce(ref(url_column).cast("string"), F.lit("")).alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumns({
        "rule": matching_rule(host, path, rules, 0),
        "action": matching_rule(host, path, rules, 1),
        "node": F.when(url.contains("://"), node_of(url)),
        "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"),
    })
    verdict = F.coalesce("action", "decision", F.lit("allow"))
    return rows.join(salts, ["node", "salt"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), q AS (
  SELECT page_id, lower(regexp_extract(r, '^([^/?#]*)', 1)) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) AS query,
    regexp_extract(html, '(?is)<link[^>]*rel="?canonical"?[^>]*href="(https?://[^">]*)"', 1) AS target
  FROM p
), rules(rule, h, f, action) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), urls AS (
  SELECT DISTINCT host, path FROM q
  UNION SELECT lower(regexp_extract(target, '://([^/?#]*)', 1)), regexp_extract(target, '://[^/?#]*([^?#]*)', 1) FROM q WHERE target <> ''
), fits AS (
  SELECT host, path, rule, action FROM urls JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) = 1
), links AS (
  SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || query AS a,
    lower(regexp_extract(target, '://([^/?#]*)', 1)) || regexp_extract(target, '://[^/?#]*([^#]*)', 1) AS b,
    lower(regexp_extract(target, '://([^/?#]*)', 1)) AS bh, regexp_extract(target, '://[^/?#]*([^?#]*)', 1) AS bp, host, path
  FROM q WHERE target <> ''
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (
  WITH RECURSIVE r AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a) SELECT * FROM r
), named AS (
  SELECT a AS node, action FROM links JOIN fits USING (host, path)
  UNION SELECT b, action FROM links JOIN fits ON fits.host = bh AND fits.path = bp
), decided AS (SELECT reach.a AS node, min(action) AS decision FROM reach JOIN named ON named.node = reach.b GROUP BY reach.a)
SELECT page_id, q.host, q.path, rule, coalesce(action, decision, 'allow') AS verdict
FROM q LEFT JOIN fits USING (host, path)
  LEFT JOIN decided ON decided.node = q.host || CASE WHEN q.path = '' THEN '/' ELSE q.path END || q.query
"""
