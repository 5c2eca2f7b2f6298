"""URL verdicts by rules for hosts and paths, carried to aliases through redirects and canonical links. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stash


@dataclass(frozen=True)
class Rule:
    """A verdict (``allow`` or ``block``) for a host with its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or the end); empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def node(url: Column) -> Column:
    """What a url stands for in the graph: the url without its fragment, with scheme and host in lower case and ``/`` for an empty path; null for a url without ``://``."""
    start = F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    rest = F.regexp_extract(F.substring(url, F.length(start) + 1, F.length(url)), r"^([^#]*)", 1)
    low = F.translate(start, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(start != "", F.concat(low, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _without_dots(url: Column) -> Column:
    """The url without ``.`` and ``..`` segments in its path."""
    form = r"^([^/?#]*://[^/?#]*)([^?#]*)(.*)$"
    segments = F.split(F.regexp_extract(url, form, 2), "/", -1)
    dots = lambda x: x.isin(".", "..")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), step)
    kept = F.when(dots(F.element_at(segments, -1)), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(url.rlike(r"^[^/?#]*://[^/?#]*[^?#]*/\.\.?(?:[/?#]|$)"), F.concat(F.regexp_extract(url, form, 1), F.array_join(kept, "/"), F.regexp_extract(url, form, 3))).otherwise(url)


def resolved(url: Column, target: Column) -> Column:
    """A target as seen from a page: absolute, or null where the page's url has no ``://`` to resolve it against."""
    base = F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(base, F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1)))
    full = F.when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^([^/?#]*:)", 1), target)).when(target.startswith("/"), F.concat(base, target))
    full = full.when(target.startswith("?"), F.concat(base, path, target)).when(target.startswith("#"), F.concat(F.regexp_extract(url, r"^([^#]*)", 1), target)).otherwise(F.concat(folder, target))
    return _without_dots(F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target).when(base != "", full))


def html_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``a, b`` from a page to the targets of its canonical link and of its refresh redirect. Relative targets are resolved against the page's url."""
    links = F.filter(F.regexp_extract_all(F.col("html"), F.lit(r"(?i)(<link\b[^>]*>|<meta\b[^>]*>)"), 1), lambda x: x.rlike(r"(?i)rel\s*=\s*[\"']?canonical\b|http-equiv\s*=\s*[\"']?refresh\b"))
    target = F.regexp_extract("link", r"(?i)(?:\bhref\s*=\s*|\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*)[\"']?\s*([^\"'>\s]+)", 1)
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    found = pages.select(pages[url].alias("url"), pages[html].alias("html")).where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    found = found.select("url", F.explode(links).alias("link")).select("url", target.alias("target")).where("target <> ''")
    return found.select(node(F.col("url")).alias("a"), node(resolved(F.col("url"), F.col("target"))).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None, *, url: str = "url", html: str | None = "html", broadcast_rules: int = 100_000) -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, verdict``; columns of these names in the input are replaced.

    The longest rule that fits a url decides it (of two as long the one with the longer host, then the allowing one). ``rules`` are a list, or a
    table ``host, path, verdict`` of any size; hosts are compared in lower case. A url without a rule takes the decision of its redirect class:
    block if some member's rule blocks and no member's rule allows; else allow (an explicit allow goes before a carried block). Classes are
    the connected components over the canonical and refresh links in ``html`` and over ``redirects(from_url, to_url)``, with relative targets
    resolved against their page. A null url, or one without ``://``, has an empty host and path, no rule unless one has an empty host, and no
    aliases: allow. Repeated rows are judged each; an empty table gives no rows.

    Distinct hosts and paths are matched, once each: a host's suffixes find the lengths of the paths that rules have there, and host and path
    prefix of such a length find the rule by an equality join, so no url meets all rules of a host. Up to ``broadcast_rules`` rules are broadcast.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    own = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c in pages.columns])
    host, path = host_path(F.col(url))
    edges = html_links(own, url=url, html=html) if html in own.columns else None
    if redirects is not None:
        more = redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")).where("a is not null and b is not null")
        edges = more if edges is None else edges.unionByName(more)
    judged = own.withColumns({"host": host, "path": path})
    urls = judged.select("host", "path")
    if edges is not None:
        edges = stash(edges.distinct())
        ends = edges.select(F.explode(F.array("a", "b")).alias("n")).distinct().select("n", *[c.alias(x) for c, x in zip(host_path(F.col("n")), ("host", "path"), strict=True)])
        urls = urls.unionByName(ends.select("host", "path"))
    hits = stash(_fit(urls.distinct(), rules, broadcast_rules)).select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("hit").alias("_hit"))
    judged = judged.join(hits, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    if edges is None:
        return judged.select(*own.columns, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit("allow")).alias("verdict"))
    known = ends.join(hits, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p"))).select("n", F.col("_hit.verdict").alias("v"))
    parts = connected_components(edges)
    by_part = known.join(parts, F.col("n") == F.col("node")).groupBy("component").agg(F.min("v").alias("least"))
    blocked = parts.join(by_part.where("least = 'block'"), "component").select(F.col("node").alias("_node"))
    out = judged.withColumn("_n", node(F.col(url))).join(blocked, F.col("_n") == F.col("_node"), "left")
    verdict = F.coalesce("_hit.verdict", F.when(F.col("_node").isNotNull(), "block"), F.lit("allow"))
    return out.select(*own.columns, "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"))


def _fit(urls: DataFrame, rules: DataFrame, broadcast_rules: int) -> DataFrame:
    """``host, path, hit`` of the distinct urls that a rule fits; the hit is ``struct<rule, verdict>`` of the longest."""
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select(F.coalesce(low, F.lit("")).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), "verdict").where("verdict in ('allow', 'block')").groupBy("rh", "rp").agg(F.min("verdict").alias("verdict"))
    rules = stash(rules)
    total, labels = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("rh", "[.]", -1)))).first()
    small = (lambda df: F.broadcast(df)) if total <= broadcast_rules else (lambda df: df)
    lengths = rules.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths"))  # at most one entry for each length that a path can have
    own = F.split("host", "[.]", -1)
    # No rule has more labels than the longest, so longer suffixes are not asked for.
    count = F.least(F.size("labels"), F.lit(labels or 1))
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."))
    asked = urls.withColumn("labels", own).select("host", "path", F.explode(suffixes).alias("rh")).join(small(lengths), "rh")
    fit = asked.select("host", "path", "rh", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).select("host", "path", "rh", F.substring("path", F.lit(1), F.col("n")).alias("rp"))
    rank = F.struct(F.length("rh") + F.length("rp"), F.length("rh"), "verdict")
    found = fit.join(small(rules), ["rh", "rp"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), "verdict"), rank).alias("hit"))
    return found
