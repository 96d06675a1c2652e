"""URL filters: rules on host and path, and propagation of trust and distrust over links between hosts."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.decontaminate import LOWER, UPPER, bounded
from folioflow.llm.shared import cut

#: host and path of a URL; nothing where there is no ://.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of a link that names one.
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (verdict, host/path) that fits; nulls where none does. A rule fits its host and all hosts below."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda x: len(x[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, least_change: float = 1e-7) -> DataFrame:
    """(kind, host, score): personalised PageRank, for each kind by itself, from seeds (kind, host, seed; sum 1) over edges (kind, source, target, share).

    What hosts without links hold goes back to the seeds, which makes scores those of walks that end
    there, brought to a sum of 1; so a round only moves what came in the round before. Rounds end when
    no host's score grew by more than least_change of itself, so all hosts that any links reach are
    reached and small scores are as exact as large ones. This ends by itself: what moves shrinks by
    damping each round.
    """
    scores = cut(seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"), ((1 - damping) * F.col("seed")).alias("new")))
    if not edges.isEmpty():
        sources = edges.select(F.col("kind").alias("of"), "source", "target", "share")
        for k in count(1):
            here = scores.filter("new > 0").select("kind", "host", "new")
            moved = sources.join(here, (F.col("of") == F.col("kind")) & (F.col("source") == F.col("host")))
            moved = moved.select("kind", F.col("target").alias("host"), (damping * F.col("new") * F.col("share")).alias("new"))
            both = scores.select("kind", "host", "score", F.lit(0.0).alias("new")).unionByName(moved.select("kind", "host", F.col("new").alias("score"), "new"))
            scores = cut(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("new").alias("new")))
            if k % 4 == 0 and scores.filter(F.col("new") > least_change * F.col("score")).isEmpty():
                break
    sums = scores.groupBy("kind").agg(F.sum("score").alias("all"))
    return scores.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], damping: float = 0.85, least_change: float = 1e-7, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of pages (page_id, url, html).

    Seeds of trust are the hosts with pages that a rule allows, seeds of distrust those with pages that
    a rule blocks, each by its number of such pages. Trust follows links between hosts, distrust goes
    against them. Where no rule fits, a host is blocked if its distrust is more than ratio times its
    trust, by a millionth of it at least, so that rounding decides nothing; hosts that neither reaches
    are allowed. Hosts of links are taken like those of urls, user part and port included. There is no
    bound on the length of a way from a seed.

    Null urls and urls without :// have an empty host, which is a host like any other but has no links.
    Null html has no links. Rows may repeat, and count as often. Other columns are ignored.
    """
    at = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    at = at.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    seeds = at.filter(F.col("ruled").isNotNull()).groupBy(F.col("ruled").alias("kind"), "host").agg(F.count("*").cast("double").alias("n"))
    seeds = cut(seeds)
    sums = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = cut(seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed")))
    links = pages.filter(F.col("html").isNotNull()).select(host_of("url").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("target"))
    links = links.select("source", F.translate("target", UPPER, LOWER).alias("target")).filter("source != target and source != ''")
    links = cut(links.groupBy("source", "target").agg(F.count("*").alias("n")))
    kinds = links.select(F.lit("allow").alias("kind"), "source", "target", "n").unionByName(links.select(F.lit("block").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    out = kinds.groupBy("kind", "source").agg(F.sum("n").alias("all"))
    edges = cut(kinds.join(out, ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("all")).alias("share")))
    scores = propagate(edges, seeds, damping, least_change)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    hosts = cut(scores.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")))
    joined = at.join(bounded(hosts, 200_000), "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    method = F.when(F.col("distrust") > ratio * (1 + 1e-6) * F.col("trust"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
