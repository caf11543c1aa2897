"""URL filtering with redirect equivalence, with DataFrame functions only.

Rules decide by host suffix and path prefix. Pages that redirect or point to a
canonical address are aliases of it: the connected components over these edges
carry block decisions to every alias that no rule decides, unless a member is
explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import join_counted, materialise
from covarium.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that the urls of one host are dealt to.
SALTS = 16
#: (action, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """A url without its fragment, A-Z lower-cased in scheme and host, by which aliases are matched."""
    plain = F.substring_index(url, "#", 1)
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)(.*)$"
    scheme, user, host, rest = (F.regexp_extract(plain, parts, k) for k in range(1, 5))
    return F.when(plain.rlike(parts), F.concat(F.translate(scheme, UPPER, LOWER), user, F.translate(host, UPPER, LOWER), rest)).otherwise(plain)


def _resolved(base: Column, link: Column) -> Column:
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link != "", F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: addresses that a page's canonical link or refresh redirect makes one; a null where it names none."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = pages.where(url.contains("://") & F.lower(html).rlike("canonical|http-equiv")).select(url.alias("url"), F.explode(tags).alias("tag"))
    quoted = r"""\s*=\s*["']?([^"'\s>]+)"""
    canonical = F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b")
    refresh = F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")
    link = F.when(canonical, F.regexp_extract("tag", r"(?is)\bhref" + quoted, 1)).when(refresh, F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    # step by step, as what a step uses several times is not to be computed so often
    stated = found.where(canonical | refresh).select("url", F.trim(F.regexp_replace(link, "&amp;", "&")).alias("link"))
    resolved = stated.select("url", _resolved(F.col("url"), F.col("link")).alias("target"))
    return resolved.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b"))


def decide(urls: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Add ``host, path, rule, action`` to rows with a ``url``: those of the longest rule that fits.

    A host meets the rules of its suffixes once; the rows then join their host's
    few rules, of which there are copies for each salt so that a hot host is dealt
    to many tasks, and test the path. Of two rules alike the allowing one holds.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(a, h, p) for a, h, p in rules], "action string, rule_host string, prefix string")
    dealt = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.pmod(F.xxhash64("url"), F.lit(SALTS)).alias("salt"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = dealt.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    rule = F.concat("rule_host", "prefix")
    known = (
        hosts.join(table, "rule_host")
        .groupBy("host")
        .agg(F.collect_list(F.struct(F.length(rule).alias("size"), (F.col("action") == "allow").alias("allows"), "prefix", rule.alias("rule"), "action")).alias("rules"))
        .select("host", "rules", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["prefix"]))
    best = F.array_max(fits)
    found = dealt.join(known, ["host", "salt"], "left").select(*urls.columns, "host", "path", best.alias("best"))
    return found.select(*urls.columns, "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = tuple(RULES), extra_edges: DataFrame | None = None) -> DataFrame:
    """Judge every page: ``page_id, url, host, path, rule, verdict``.

    The longest fitting rule decides. A page that none fits is judged by its
    aliases: blocked if a rule blocks one of them and allows none, else allowed.
    ``extra_edges`` adds observed redirects as two columns of urls. Null urls and
    those without ``://`` have an empty host and path, fit no rule and are
    allowed. Repeated rows come back each; an empty table gives an empty one;
    other columns than page_id, url and html are not read.
    """
    rules = list(rules)
    decided = decide(pages.select("page_id", "url"), rules)
    edges = alias_edges(pages)
    if extra_edges is not None:
        a, b = extra_edges.columns
        edges = edges.unionByName(extra_edges.select(address(F.col(a)).alias("a"), address(F.col(b)).alias("b")))
    parts, _ = materialise(connected_components(edges))
    members = decide(parts.select(F.col("vertex").alias("url"), "component"), rules)
    verdicts = members.groupBy("component").agg((F.max((F.col("action") == "block").cast("int")) > 0).alias("blocked"), (F.max((F.col("action") == "allow").cast("int")) > 0).alias("allowed"), F.count(F.lit(1)).alias("n"))
    blocked = verdicts.where("blocked and not coalesce(allowed, false)").select("component", "n", F.lit(True).alias("doomed"))
    doomed = join_counted(parts, blocked, "component", parts.count()).select(F.col("vertex").alias("alias"), "doomed")
    return decided.join(doomed, address(F.col("url")) == F.col("alias"), "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("action", F.when(F.col("doomed"), "block").otherwise("allow")).alias("verdict")
    )
