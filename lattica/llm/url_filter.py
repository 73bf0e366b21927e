"""URL filter by rules and by link-graph propagation, with DataFrame functions only.

Hosts are nodes, links between pages of different hosts are edges, weighted by their number. Trust is a personalised
PageRank that starts at trusted hosts, along the links; distrust is the same from blocked hosts, against the links'
direction: who links to a blocked host is distrusted (Gyöngyi et al. 2004; Krishnan, Raj 2006). A host is a blocked seed
if a block rule decides on half of its pages or more, and a trusted one if an allow rule decides on a page of it and it
isn't a blocked seed. A host that is linked but has no page in the table is judged so by the different addresses that
links to it name, an empty path being /.
A host is blocked if its distrust is over its trust and over a threshold times the mean host's share. Pages and links name
a host alike: user and port are no part of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import join_hot, stage, unstage

#: TOLERANCE: error of all scores together that is left, as a part of the score over which a host is judged. FINEST: the
#: least error that sums of doubles can tell.
DAMPING, TOLERANCE, FINEST, THRESHOLD = 0.85, 1e-3, 1e-12, 1.0
_LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+[^?#"'\s>]*)"""


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and its subdomains where the path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def told(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the query.
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bare_host(host: Column) -> Column:
    """A host's name in the graph: without user and port, in lower case."""
    return _lower(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", ""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    good = url.isNotNull() & (at > 0)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(good, _lower(host)).otherwise(""), F.when(good, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Number of the longest rule that fits (ties: the first), else null."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].told), -i)):
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, path, weight) of links between different hosts, by the path that they name. A page without a host or
    without html, null or empty, has none; a very long html is searched whole."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    links = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1))
    to = F.substring_index("link", "/", 1)
    path = F.substring(F.col("link"), F.length(to) + 1, F.length("link"))
    found = pages.select(bare_host(host).alias("src"), F.explode(links).alias("link"))
    found = found.select("src", bare_host(to).alias("dst"), F.when(path == "", "/").otherwise(path).alias("path"))
    found = found.where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst", "path").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def host_edges(links: DataFrame) -> DataFrame:
    """(src, dst, weight) of host_links."""
    return links.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = FINEST) -> DataFrame:
    """(host, score): PageRank along edges (src, dst, weight) that starts anew at seeds (host, share), whose shares sum
    to 1. Rank at hosts without an edge starts anew too. A round makes the error damping times as large at most, so it is
    under change * damping / (1 - damping) after a round; the rounds end when that is under tolerance. Each round's scores
    are staged, so a round's plan doesn't grow."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    steps = stage(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "steps")
    scores = stage(seeds.select("host", F.col("share").alias("score")), "scores")
    if steps.isEmpty():
        return scores
    while True:
        came = scores.join(steps, scores["host"] == steps["src"]).groupBy("dst").agg((damping * F.sum(F.col("score") * F.col("share"))).alias("came"))
        moved = came.agg(F.coalesce(F.sum("came"), F.lit(0.0))).first()[0]
        new = came.select(F.col("dst").alias("host"), F.col("came").alias("part"))
        new = new.unionAll(seeds.select("host", F.col("share") * F.lit(1.0 - moved)))
        new = stage(new.groupBy("host").agg(F.sum("part").alias("score")), "scores")
        both = new.join(scores.select("host", F.col("score").alias("old")), "host", "full")
        change = both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        unstage(scores)
        scores = new
        if change * damping < max(tolerance, FINEST) * (1 - damping):
            unstage(steps)
            return scores


def judge_urls(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    threshold: float = THRESHOLD, damping: float = DAMPING,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages.

    A page that a rule fits has the rule's verdict; any other is blocked if its host's distrust is over its trust and at
    least threshold times 1 / hosts (linked ones too), and allowed if not. A null url, or one without ://, has an empty host, which no rule
    fits and no link reaches. Rows that repeat an id are judged each. trust and distrust are 0 for unreached hosts; where
    they are equal, the page is allowed. An empty table has no rows. Other columns of pages are not read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    slim = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), bare_host(host).alias("node"))
    slim = slim.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    allows = F.col("fits").isin([i for i, r in enumerate(rules) if r.verdict == "allow"])
    blocks = F.col("fits").isin([i for i, r in enumerate(rules) if r.verdict == "block"])
    counts = F.count_if(allows).alias("allowed"), F.count_if(blocks).alias("blocked"), F.count(F.lit(1)).alias("n")
    crawled = slim.where("node <> ''").groupBy(F.col("node").alias("host")).agg(*counts).withColumn("pages", F.col("n"))
    links = stage(host_links(pages, url_col, html_col), "links")
    named = links.select(F.col("dst").alias("host"), "path").distinct().withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    named = named.groupBy("host").agg(*counts).withColumn("pages", F.lit(0).cast("long"))
    hosts = crawled.unionByName(named.join(crawled.select("host"), "host", "left_anti"))
    blocked = F.when(2 * F.col("blocked") >= F.col("n"), F.col("blocked")).otherwise(0)
    allowed = F.when(2 * F.col("blocked") < F.col("n"), F.col("allowed")).otherwise(0)
    hosts = stage(hosts.select("host", "pages", allowed.alias("allowed"), blocked.alias("blocked")), "hosts")
    n_hosts, n_pages, allowed, blocked = hosts.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("pages", "allowed", "blocked"))).first()
    edges = stage(host_edges(links), "edges")
    unstage(links)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    scores, ranks = hosts.select("host", "pages"), []
    for name, seeded, n, links in (("trust", "allowed", allowed, edges), ("distrust", "blocked", blocked, back)):
        seeds = hosts.where(F.col(seeded) > 0).select("host", (F.col(seeded) / F.lit(max(1, n))).alias("share"))
        rank = page_rank(links, seeds, damping, TOLERANCE * threshold / max(1, n_hosts))
        ranks.append(rank)
        rank = rank.select("host", F.col("score").alias(name))
        scores = scores.join(rank, "host", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    scores = stage(scores.withColumnRenamed("host", "node"), "ranked")
    unstage(hosts, edges, *ranks)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * max(1, n_hosts) >= threshold)
    names, verdicts = (F.lit([getattr(r, c) for r in rules]) for c in ("told", "verdict"))
    out = join_hot(slim, scores, ["node"], "pages", n_pages, F.xxhash64("id", "path"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.get(names, F.col("fits")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("fits")), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
