"""URL filters: host and path rules, and trust and distrust propagated over the link graph.

A url that a rule fits gets the verdict of the longest one. For the rest, hosts are scored: trust is a personalised
PageRank from hosts of allowed urls along links, distrust one from hosts of blocked urls against them (who links to a bad
host is suspect). A host is blocked where its distrust exceeds ``threshold`` times its trust.

Links are counted per host pair before any join. Each round passes on only what the last one brought, until less than
``TOLERANCE`` of the seeds' mass is still on its way; no number of links limits how far scores reach. Where a walk ends at
a host without links, its mass is lost, alike for both scores. Pages of the test tables link to their own host only, so
there the scores are those of the seeds; the propagation shows in the tests.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed unless its
(empty) host is blocked. Null html has no links. Equal scores allow. Repeated rows each get their result and count as
seeds and links each. Tables without allowed or blocked urls propagate zeros. An empty table gives no rows. Only
``page_id``, ``url`` and ``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import settle

#: Of the seeds' mass, 1 in all: what may still be on its way when rounds end; with a damping of 0.85 after 128 rounds at most.
TOLERANCE, MAX_ROUNDS = 1e-9, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, verdict)

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.endswith(F.col("host"), F.lit("." + self.host))
        return host & F.startswith(F.col("path"), F.lit(self.path))


RULES = tuple(Rule.parse(v, t) for v, t in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    out = df.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr("_rest", F.length(host) + 1), r"^[^?#]*", 0)
    return out.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path}).drop("_rest")


def longest_rule(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; of equally long ones the earlier."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(str(r))):
        text, verdict = F.when(rule.fits(), str(rule)).otherwise(text), F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: absolute links between different hosts, counted over all pages."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    each = with_host_and_path(pages, "url").select(F.col("host").alias("src"), F.explode(links).alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    hosts = with_host_and_path(each.withColumn("link", full), "link").select("src", F.col("host").alias("dst"))
    return hosts.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, score``: ``edges`` (``a, b, n``) pass score from a to b in proportion to n; ``seeds`` (``host, weight``)."""
    total = seeds.agg(F.sum("weight").alias("w")).first()["w"] or 0
    step = settle(seeds.where("weight > 0").select("host", (F.col("weight") * ((1 - damping) / float(max(total, 1)))).alias("score")), "seeds")
    parts = [step]
    if edges.isEmpty() or step.isEmpty():
        return step
    out = edges.groupBy("a").agg(F.sum("n").alias("out"))
    shares = settle(edges.join(out, "a").select("a", "b", (F.col("n") / F.col("out") * damping).alias("share")), "shares")
    for _ in range(MAX_ROUNDS):
        passed = shares.join(step, shares["a"] == step["host"]).groupBy(F.col("b").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("score"))
        step = settle(passed, "scores")
        left = step.agg(F.sum("score").alias("s")).first()["s"] or 0.0
        parts.append(step)
        if len(parts) > 8 or left < tolerance:
            parts = [settle(reduce(DataFrame.union, parts).groupBy("host").agg(F.sum("score").alias("score")), "scores")]
        if left < tolerance:
            return parts[0]
    raise RuntimeError(f"scores did not settle in {MAX_ROUNDS} rounds")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, threshold: float = 1.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages``."""
    text, verdict = longest_rule(rules)
    ruled = with_host_and_path(pages.select("page_id", "url")).withColumns({"rule": text, "ruled": verdict})
    seeds = settle(ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "seed-hosts")
    edges = settle(host_edges(pages), "host-edges")
    forward = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    backward = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    trust = personalised_rank(forward, seeds.select("host", F.col("good").alias("weight")), damping)
    distrust = personalised_rank(backward, seeds.select("host", F.col("bad").alias("weight")), damping)
    hosts = seeds.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    hosts = settle(hosts.na.fill(0.0), "host-scores")
    by_host = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return ruled.join(hosts, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")
