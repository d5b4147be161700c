"""URL filter: rules first, then trust and distrust spread over the host graph.

Everything is DataFrame functions.

1. *Parts*: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
   lower-cased; the path goes on to ``?``, ``#`` or the end.
2. *Rules* (action, host, path) fit the host itself and its subdomains if the path starts with the
   rule's; the longest one that fits wins.  A rule becomes one expression, so the list is meant to
   be short (some hundreds); millions of hosts belong into the seeds of the graph.
3. *Graph*: one scan gives every page's own url and the absolute ``href`` targets of its links as
   (source host, target host, rule's action); they are counted before the shuffle, so a host with
   a third of all pages is a few rows.  An edge weighs its share of the source's links to others.
4. *Seeds*: hosts of which ``seed_share`` or more of all urls seen are allowed (trusted) or blocked.
5. *Propagation*: trust is the personalised PageRank of the trusted seeds, sum over k of
   (damping * P)^k, along the links.  Distrust runs them backwards from the blocked seeds, a
   linking host taking its own share, so it reads as the chance that a walk from the host ends
   among blocked ones, whatever the size of the graph.  Only hosts with mass take part in a
   round; rounds end when damping^k falls under ``precision`` or no mass is left.
6. *Threshold* per host: blocked if distrust is ``block_at`` or more and more than the trust.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, and is allowed,
as is a host that no link reaches; null or empty html has no links; relative links stay in their
host and are no edges; the links of a page without a host are no edges but count as urls seen; very
long pages are scanned whole; repeated rows come back and count as often as they are there; rules
of one length go by their text; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SEED_SHARE, DAMPING, PRECISION, BLOCK_AT = 0.9, 0.85, 0.01, 0.25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)://([^/?#]*)([^?#]*)"
LINK = r"(?is)<a(?:rea)?\s[^<>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s<>]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does."""
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def host_links(pages: DataFrame, url_col: str, html_col: str, rules) -> DataFrame:
    """``(src, dst, action, n)``: links between hosts, and each page's own url with src = dst."""
    url = F.col(url_col).cast("string")
    links = F.coalesce(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(LINK), F.lit(1)), F.array().cast("array<string>"))
    seen = pages.select(host_of(url).alias("src"), F.explode(F.concat(
        F.array(F.struct(url.alias("url"), F.lit(True).alias("own"))),
        F.transform(links, lambda u: F.struct(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u).alias("url"),
                                              F.lit(False).alias("own"))))).alias("u"))
    dst, path = host_of(F.col("u.url")), path_of(F.col("u.url"))
    own = F.col("u.own")
    return (seen.select("src", dst.alias("dst"), rule_of(dst, path, rules)[1].alias("action"), own.alias("own"))
            .filter("dst <> ''").groupBy("src", "dst", "action", "own").agg(F.count("*").alias("n")))


def host_scores(links: DataFrame, seed_share: float = SEED_SHARE, damping: float = DAMPING,
                precision: float = PRECISION) -> DataFrame:
    """``(host, trust, distrust)`` of all hosts with either."""
    part = lambda a: F.sum(F.when(F.col("action") == a, F.col("n")).otherwise(0))
    urls = links.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("n"), part("allow").alias("allow"), part("block").alias("block"))
    mass = staged(urls.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("allow") / F.col("n")).alias("share")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("block") / F.col("n")).alias("share")))).alias("s"))
        .filter(F.col("s.share") >= seed_share).select("host", "s.kind", F.lit(1.0).alias("mass")), "url-seeds")
    edges = links.filter("not own and src <> dst and src <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    edges = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    flow = staged(edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "share")
                  .union(edges.select(F.lit("distrust"), "dst", "src", "share")), "url-flow")
    total = mass
    for _ in range(math.ceil(math.log(precision) / math.log(damping))):
        mass = staged(mass.join(flow, ["kind", "host"]).groupBy("to", "kind")
                      .agg(F.sum(F.col("mass") * F.col("share") * damping).alias("mass"))
                      .select(F.col("to").alias("host"), "kind", "mass"), "url-mass")
        if mass.isEmpty():
            break
        total = total.union(mass)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k)
    return total.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", seed_share: float = SEED_SHARE, damping: float = DAMPING,
               precision: float = PRECISION, block_at: float = BLOCK_AT) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)`` of every page."""
    links = staged(host_links(pages, url_col, html_col, rules), "url-links")
    scores = staged(host_scores(links, seed_share, damping, precision), "url-scores")
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    told = own.withColumn("rule", rule).withColumn("action", action).join(scores, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    blocked = (distrust >= block_at) & (distrust > trust)
    return told.select("id", "host", "path", "rule",
                       F.coalesce("action", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                       trust.alias("trust"), distrust.alias("distrust"))
