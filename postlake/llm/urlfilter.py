"""URL verdicts from rules, and from trust and distrust carried along host links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from postlake.sources.scratch import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute links in a page: the host behind the scheme or behind //.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: Rounds end early once no host moves by TOLERANCE of its own rank, however many hosts there are.
DAMPING, ROUNDS, TOLERANCE = 0.85, 60, 1e-4
#: A host is blocked if its distrust exceeds its trust and this many times the mean share.
BLOCK_OVER_MEAN = 1.0
#: Hosts sent to every executor at most; beyond it they are joined.
BROADCAST_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ? or # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or NULLs.

    A rule fits its host and all subdomains where the path starts with its path. Of rules with
    the same text, a block wins. The list is part of the plan: keep it to some hundreds.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict,
    trust, distrust.

    The longest fitting rule decides. Other pages get their host's verdict: trust is the
    personalised PageRank of hosts by the share of their pages that rules allow, along links; distrust that
    of hosts by the share that rules block, against links, so it reaches hosts that link to
    bad ones. Hosts that neither reaches are allowed. Links of a host to itself do not
    count; a host without links gives its rank back to the seeds. NULL urls, and urls
    without ://, have an empty host and path and take no part in the graph. NULL or empty
    html has no links. Repeated rows are judged alike; other columns are ignored.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    urls = read.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    hosts = cut_lineage(urls.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("ruled"), F.lit("")) == "allow").cast("double")).alias("allowed"),
        F.avg((F.coalesce(F.col("ruled"), F.lit("")) == "block").cast("double")).alias("blocked")), "hosts")
    ranks = host_ranks(hosts, host_links(read))
    found = urls.join(F.broadcast(ranks) if ranks.count() <= BROADCAST_HOSTS else ranks, "host", "left")
    return found.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of links between different hosts, each once however many pages carry it."""
    # Links are told apart in their page and combined per task before they are shuffled.
    targets = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1),
        lambda h: F.translate(F.regexp_replace(h, r"^.*@|:\d*$", ""), UPPER, LOWER)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.where("src <> dst AND dst <> ''").distinct()


def host_ranks(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust, bad) of every host; `hosts` has allowed and blocked shares.

    Trust and distrust are one table of (way, host) and advance together. Every round
    joins ranks with links by the sending host and sums them by the receiving one, with
    map-side combination; the table is written down, so lineage stays short.
    """
    both = links.select(F.lit("trust").alias("way"), F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degree = both.groupBy("way", "a").agg(F.count(F.lit(1)).alias("degree"))
    edges = cut_lineage(both.join(degree, ["way", "a"]), "links")
    named = hosts.select(
        "host", F.explode(F.create_map(F.lit("trust"), "allowed", F.lit("distrust"), "blocked")).alias("way", "share"))
    linked = edges.select("way", F.col("a").alias("host"), F.lit(True).alias("sends")).unionAll(
        edges.select("way", "b", F.lit(False)))
    nodes = named.withColumn("sends", F.lit(False)).unionByName(linked.withColumn("share", F.lit(0.0))).groupBy("way", "host").agg(
        F.max("share").alias("share"), F.max("sends").alias("sends"))
    totals = {r["way"]: r["s"] for r in nodes.groupBy("way").agg(F.sum("share").alias("s")).collect()}
    total = F.when(F.col("way") == "trust", totals.get("trust") or 0.0).otherwise(totals.get("distrust") or 0.0)
    seed = F.when(total > 0, F.col("share") / total).otherwise(0.0)
    state = cut_lineage(nodes.select(
        "way", "host", "sends", seed.alias("seed"), seed.alias("rank"), F.lit(0.0).alias("moved")), "ranks")
    sent = F.sum(F.when(F.col("sends"), F.col("rank")).otherwise(0.0)).alias("s")
    sums = {r["way"]: r["s"] for r in state.groupBy("way").agg(sent).collect()}
    for _ in range(0 if edges.isEmpty() else ROUNDS):  # without links the seeds keep all rank
        given = state.select("way", F.col("host").alias("a"), "rank").join(edges, ["way", "a"]).groupBy(
            "way", F.col("b").alias("host")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        # What seeds and hosts without links hold back returns to the seeds.
        passed = F.when(F.col("way") == "trust", sums.get("trust") or 0.0).otherwise(sums.get("distrust") or 0.0)
        rank = DAMPING * F.coalesce("got", F.lit(0.0)) + (1 - DAMPING * passed) * F.col("seed")
        state = cut_lineage(state.join(given, ["way", "host"], "left").select(
            "way", "host", "sends", "seed", rank.alias("rank"),
            F.when(rank > 0, F.abs(rank - F.col("rank")) / rank).alias("moved")), "ranks")
        ended = state.groupBy("way").agg(sent, F.max("moved").alias("moved")).collect()
        sums, moved = {r["way"]: r["s"] for r in ended}, max((r["moved"] or 0.0 for r in ended), default=0.0)
        if moved < TOLERANCE:
            break
    found = state.groupBy("host").agg(
        F.sum(F.when(F.col("way") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("way") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    found = cut_lineage(found, "ranks")
    mean = 1 / max(1, found.count())
    return found.withColumn(
        "bad", (F.col("distrust") > F.col("trust")) & (F.col("distrust") > BLOCK_OVER_MEAN * mean))
