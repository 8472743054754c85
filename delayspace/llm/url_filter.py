"""URL filters with redirect equivalence.

Rules (host, path) judge a URL directly. Redirect and canonical-link edges make URLs aliases of one another; a
component of aliases that holds a blocked URL is blocked as a whole, unless it holds an explicitly
allowed one, which has precedence. A URL's own rule always stands.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A tag as it is looked for in html, one that holds a ``<`` left out, so that unclosed ones are passed over once; what it must hold; what its target is.
CANONICAL = (r"(?i)<link\b[^<>]*>", r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""")
REFRESH = (r"(?i)<meta\b[^<>]*>", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""")
BASE = (r"(?i)<base\b[^<>]*>", r"(?i)\bhref\b", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""")


def targets_in(html, tag: str, holds: str, target: str) -> F.Column:
    """Targets of all tags of a kind that hold what they must."""
    found = F.filter(F.regexp_extract_all(html, F.lit(tag), 0), lambda x: F.rlike(x, F.lit(holds)))
    return F.filter(F.transform(found, lambda x: F.regexp_extract(x, target, 1)), lambda x: x != "")


def host_of(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url) -> F.Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _judged(df: DataFrame, url: str, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    host, path = host_of(F.col(url)), path_of(F.col(url))
    df = df.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are asked first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("said", verdict)


def resolved(link, url) -> F.Column:
    """``link`` as a URL with a host, read on the page ``url``; null where it has none, or stays on the page."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path, folder = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    rest = F.substring(link, F.length(path) + 1, F.length(link))
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    # of /a/./b/../c there stays /a/c, and a last dot or two name a folder
    names = F.split(F.regexp_replace(whole, r"/(\.\.?)$", "/$1/"), "/")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    plain = F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(names, 2, F.size(names)), F.array().cast("array<string>"), step), "/"))
    at_path = F.when(path == "", path_of(url)).otherwise(plain)
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")) | F.startswith(link, F.lit("#")) | (link == "") | (origin == ""), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .otherwise(F.concat(origin, at_path, rest))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's URL and each URL that its html redirects to or names as canonical, relative ones resolved against the page's, or its base element's."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    found = F.concat(targets_in(html, *CANONICAL), targets_in(html, *REFRESH))
    plain = lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))
    links = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("a"), plain(F.coalesce(F.try_element_at(targets_in(html, *BASE), F.lit(1)), F.lit(""))).alias("base"), F.explode(found).alias("b"))
    links = links.select("a", F.coalesce(F.when(F.col("base") != "", resolved(F.col("base"), F.col("a"))), F.col("a")).alias("base"), plain(F.col("b")).alias("b"))
    return links.select("a", resolved(F.col("b"), F.col("base")).alias("b")).where("b IS NOT NULL")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict.

    ``redirects`` (a, b) adds edges to those in the html. A URL without a rule takes its component's verdict, and
    allow where that has none. Null and malformed URLs have an empty host and path, no alias, and are allowed.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    rules = tuple(rules)
    pages_ = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), *([F.col(html_col).alias("_html")] if html_col else []))
    own = _judged(pages_.select("_id", "_url"), "_url", rules)
    edges = redirects.select("a", "b") if redirects is not None else None
    if html_col:
        linked = link_edges(pages_, "_url", "_html")
        edges = linked if edges is None else edges.union(linked)
    if edges is not None:
        edges = cut(edges, "links")  # looked at twice, and far smaller than the pages
    if edges is None or edges.isEmpty():
        through = own.withColumn("passed", F.lit(None).cast("string"))
    else:
        nodes = _judged(connected_components(edges), "node", rules)
        # 'allow' < 'block': the smallest verdict of a component has precedence
        verdicts = nodes.groupBy("component").agg(F.min("said").alias("passed")).where("passed IS NOT NULL")
        aliases = nodes.join(verdicts, "component").select("node", "passed")
        through = own.join(aliases, own["_url"] == aliases["node"], "left")
    return through.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("said", "passed", F.lit("allow")).alias("verdict"))
