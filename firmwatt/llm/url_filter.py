"""URL filter: rules first, then trust and distrust spread over the links between hosts.

A rule is an action, a host and a path; it fits its host and all subdomains where the url's
path starts with the rule's, and the longest fitting rule decides. For all other urls the
host decides. Every page that a rule allows gives its host one unit of trust, every page
that a rule blocks one unit of distrust. Trust follows the links (personalised PageRank from
the trusted seeds); distrust follows them backwards (who links to blocked pages is suspect).
Both are sums of walks with a damping of 0.85: the power series is added up term by term,
each term a table of its own, until all mass that still moves is below ``REST``, however
long the chains and cycles of hosts are. A host is blocked when its distrust is more than ``RATIO`` times its
trust and at least ``SHARE`` of its number of pages.

Built from DataFrame functions alone. Links are the absolute and the scheme-less ones of
``href`` and ``src``; links within a host say nothing about hosts and are left out. Pages
are reduced to distinct hosts and edges before anything is joined; sums are partial before
each shuffle, so a host with a third of all pages or links is no hot spot. The rules are a
short list of settings and part of the plan.

Defined cases: a null url or one without '://' has an empty host and path, fits no rule and
is allowed; a null html has no links; equal rows each count as a page. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.llm.common import stage

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
# Mass of a term, over all hosts, below which no score of six digits changes, and the terms
# that are summed up together.
REST, FOLD = 1e-8, 16
RATIO, SHARE = 2.0, 0.25
LINK = r"""(?is)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path; both empty for null and where there is no '://'."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of the longest fitting rule and its action; null where none fits."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def judged_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of pages with that link, between different hosts."""
    host, _ = host_and_path(F.col("url"))
    links = F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(F.col("html"), F.lit(""))), F.lit(LINK), 1))
    rows = pages.select(host.alias("src"), F.explode(links).alias("dst")).filter("src != '' and src != dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("pages"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rest: float = REST) -> DataFrame:
    """Scores by (kind, host): the mass of ``seeds`` (kind, host, mass) along ``edges``
    (kind, src, dst, share).

    A term holds at most ``damping`` times the mass of the one before it, so the walk ends; what
    follows the last one is below ``rest * damping / (1 - damping)`` in all. Terms are summed up in
    groups of ``FOLD``, so no plan grows with their number.
    """
    if not 0 < damping < 1 or rest <= 0:
        raise ValueError("damping must lie between 0 and 1, and rest above 0")
    term = stage(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass")))
    terms = [term]
    while (term.agg(F.sum("mass")).first()[0] or 0.0) > rest:
        walked = term.join(edges, (term["kind"] == edges["walk"]) & (term["host"] == edges["src"]))
        term = stage(
            walked.groupBy("kind", "dst")
            .agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))
            .select("kind", F.col("dst").alias("host"), "mass")
        )
        terms.append(term)
        if len(terms) == FOLD:
            terms = [stage(_summed(terms))]
    return _summed(terms).withColumnRenamed("mass", "score")


def _summed(terms: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, terms).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the scores of its host."""
    rows = judged_by_rules(pages, rules)
    hosts = stage(
        rows.groupBy("host").agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("found.action") == "allow").alias("allowed"),
            F.count_if(F.col("found.action") == "block").alias("blocked"),
        )
    )
    links = stage(host_edges(pages))
    both = links.select(F.lit("trust").alias("walk"), "src", "dst", "pages").unionByName(
        links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "pages")
    )
    out = both.groupBy("walk", "src").agg(F.sum("pages").alias("all"))
    edges = stage(both.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("pages") / F.col("all")).alias("share")))
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", F.col("allowed").cast("double").alias("mass")).unionByName(
        hosts.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").cast("double").alias("mass"))
    )
    scores = spread(seeds.filter("mass > 0"), edges).groupBy("host").agg(
        *[F.round(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)), 6).alias(k) for k in ("trust", "distrust")]
    )
    ranked = hosts.join(scores, "host", "left").select(
        F.col("host").alias("of_host"),
        "pages",
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
    bad = (F.col("distrust") > RATIO * F.col("trust")) & (
        F.col("distrust") >= F.round(SHARE * (1 - DAMPING) * F.col("pages"), 6)
    )
    ranked = stage(ranked.withColumn("bad", bad & (F.col("of_host") != "")))
    method = F.when(F.coalesce("bad", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(ranked, F.col("host") == F.col("of_host"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.action"), method).alias("verdict"),
        "trust",
        "distrust",
    )
