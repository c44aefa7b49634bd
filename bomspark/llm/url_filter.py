"""URL filter: longest host/path rule first, link-graph propagation for the rest.

Trust spreads from allowed hosts along links (personalised PageRank); distrust spreads
from blocked hosts against links (who links to a blocked host is distrusted). A host is
blocked when its distrust reaches a threshold and exceeds its trust. Scores are carried on
until no host's changes by the tolerance; as each round shrinks changes by the damping, their
number doesn't depend on the graph, and an error says so if they don't settle.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule
and the default verdict. Null html has no links. Repeated rows are judged alike. Hosts
nobody links to keep their own seed score. Of rules of one length the last given wins. Urls
and pages may be of any length. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

Rule = tuple[str, str, str]  # verdict, host, path

LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct links (src, dst) between different hosts, with 1/out-degree and 1/in-degree."""
    host, _ = split_url(F.col(url))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    edges = materialize(
        links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct(), "edges"
    )
    out = edges.groupBy("src").agg((1 / F.count("*")).alias("w_out"))
    into = edges.groupBy("dst").agg((1 / F.count("*")).alias("w_in"))
    return edges.join(out, "src").join(into, "dst")


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 300, tolerance: float = 1e-6, every: int = 8) -> DataFrame:
    """(host, trust, distrust) at the fixed point; seeds is (host, good, bad), scaled so that
    an unlinked seed of weight w scores w. Lineage is cut every few steps, where the largest
    change of any host since then decides whether to go on."""
    if edges.isEmpty():
        return seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    ahead = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("w_out") * damping).alias("t"), F.lit(0.0).alias("d"))
    back = edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("w_in") * damping).alias("d"))
    ways = materialize(ahead.unionByName(back), "weighted-edges")
    last = scores = given = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for step in range(1, iterations + 1):
        moved = ways.join(scores, "host").select(F.col("to").alias("host"), (F.col("t") * F.col("trust")).alias("trust"), (F.col("d") * F.col("distrust")).alias("distrust"))
        scores = given.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % every == 0 or step == iterations:
            scores = materialize(scores, "ranks")
            change = scores.alias("a").join(last.alias("b"), "host", "full").agg(
                F.max(F.abs(F.coalesce("a.trust", F.lit(0.0)) - F.coalesce("b.trust", F.lit(0.0))) + F.abs(F.coalesce("a.distrust", F.lit(0.0)) - F.coalesce("b.distrust", F.lit(0.0))))
            ).first()[0]
            last = scores
            if (change or 0.0) <= tolerance:
                return scores
    raise RuntimeError(f"scores still change by {change} after {iterations} rounds")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", block_at: float = 0.5, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A host's seed weights are the shares of its pages that rules allow and block."""
    host, path = split_url(F.col(url))
    ruled = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    seeds = materialize(
        ruled.where("host <> ''").groupBy("host").agg(F.avg((F.coalesce("m.verdict", F.lit("")) == "allow").cast("double")).alias("good"), F.avg((F.coalesce("m.verdict", F.lit("")) == "block").cast("double")).alias("bad")), "seeds"
    )
    scores = propagate(seeds, host_edges(pages, url, html))
    bad = scores.where((F.col("distrust") >= block_at) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("found"))
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", "found", F.lit(default)).alias("verdict"))
