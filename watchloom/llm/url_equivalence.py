"""URL filter with redirect equivalence (DataFrame functions only).

Pages are nodes; a canonical link or a refresh redirect in a page's html is an edge to the url it names. Urls in
one connected component are aliases of each other: if a rule blocks one of them, the others are blocked too.
An explicit rule always decides its own url first, so an allowed alias of a blocked page stays allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.components import connected_components
from watchloom.llm.storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits the host and all its subdomains where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Else both empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null. Of equally long ones allow goes first, then the name decides."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def alias_key(url: Column) -> Column:
    """What makes two spellings the same node: host, path and query, without scheme and fragment; null without ://."""
    host, _ = split_url(url)
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(rest == "", "/").otherwise(rest)))


LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


#: Targets that name no other page: fragments, schemes without //, and paths with dot segments.
NO_PAGE = r"\A#|\A[A-Za-z][A-Za-z0-9+.\-]*:(?!//)|(?:\A|/)\.\.?(?:/|\z)"


def resolved(target: Column, url: Column) -> Column:
    """The absolute url of a target named by the page at url; null where it names no page."""
    target = F.regexp_replace(target, r"\A(?:\./)+", "")
    host, path = split_url(url)
    there = F.concat(F.lit("http://"), host)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"\A.*/", 0))
    return (
        F.when(target.rlike(NO_PAGE) | (target == ""), None)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(there, target))
        .when(F.startswith(target, F.lit("?")), F.concat(there, F.when(path == "", "/").otherwise(path), target))
        .otherwise(F.concat(there, folder, target))
    )


def page_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(u, v) from each page to the urls that its canonical links and its refresh redirects name, relative ones resolved against the page's url."""
    html = F.col(html_col)
    named = lambda tag, at: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, at, 1))
    tags = F.concat(named(LINK, HREF), named(REFRESH, TARGET))
    linked = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("_url"), F.explode(tags).alias("_to")).where("_to <> ''")
    edges = linked.select(alias_key(F.col("_url")).alias("u"), alias_key(resolved(F.col("_to"), F.col("_url"))).alias("v"))
    return edges.where("u is not null and v is not null")


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    edges: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, component (the least alias key of its component; null if no edge).

    edges: further (u, v) url pairs, such as a crawler's redirect log; null html or urls make no edge, and neither do targets that are
    fragments, other schemes than those with ://, or paths with dot segments. All canonical links and refreshes of a page count.
    A component is blocked if a rule blocks any url in it, be that url a page or only a link's target. Pages without
    a rule get their component's decision, others the default. A url that is null or has no :// has an
    empty host and path, fits no rule and gets the default. Of rules equally long allow goes first, then the name decides. Repeated
    rows and urls are judged alike; html is read whole; an empty table gives an empty table; other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), alias_key(F.col(url_col)).alias("_key"))
    judged = judged.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    links = page_edges(pages, url_col, html_col) if html_col else None
    if edges is not None:
        more = edges.select(alias_key(F.col("u")).alias("u"), alias_key(F.col("v")).alias("v"))
        links = links.union(more) if links is not None else more
    found = None
    if links is not None:
        links = cut(links)  # the pages are scanned once
        # node keys are 64-bit hashes while components are sought: fixed width whatever the urls' length
        known = links.select(F.explode(F.array("u", "v")).alias("key")).where("key is not null").distinct()
        tied = connected_components(links.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")))
        node_rule = fitting_rule(*split_url(F.concat(F.lit("http://"), F.col("key"))), rules)
        nodes = known.join(tied, F.xxhash64("key") == F.col("node")).select("key", F.col("component").alias("_component"), (F.coalesce(node_rule["verdict"], F.lit("")) == "block").alias("_blocked"))
        groups = nodes.groupBy("_component").agg(F.max("_blocked").alias("_blocked"), F.min("key").alias("component"))
        found = nodes.select("key", "_component").join(groups, "_component").select(F.col("key").alias("_key"), "component", "_blocked")
    if found is None:
        judged = judged.withColumn("component", F.lit(None).cast("string")).withColumn("_blocked", F.lit(False))
    else:
        # pages without a key or a link don't meet in one task: they have no row to join
        judged = judged.withColumn("_key", F.coalesce("_key", F.concat(F.lit("\0"), F.xxhash64(id_col).cast("string")))).join(found, "_key", "left")
    method = F.when(F.col("_blocked"), "block").otherwise(default)
    return judged.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "component")
