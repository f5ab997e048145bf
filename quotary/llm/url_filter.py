"""URL filter with link-graph propagation, in DataFrame functions only.

Rules decide the pages that they fit. For the others two personalised
PageRanks run over host edges: trust flows from hosts with allowed pages along
the edges, distrust from hosts with blocked pages against them. A host is
blocked if its share of distrust reaches a threshold.

Host edges are the absolute links of the pages, counted by pair of hosts, and
the step from a host to the nearest host of the table above it, since a name is
handed out by the one above. Hosts that are only linked to are nodes like any
other; having no pages, they are seeds by what the rules say of the links to
them. Propagation goes on until what is still to be passed on is less than a
tolerance of the whole. A host whose share of distrust equals the threshold is
blocked.

A null url, or one without ``://``, has an empty host and path; no rule fits it
and it is allowed. Repeated pages count each. An empty table gives an empty
result; columns other than id, url and html are not looked at.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quotary.llm.common import settled, shared_dir, take

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)\bhref\s*=\s*[\x22']?(?:https?:)?//([^?#\x22'\s<>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        on = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return on & F.col("path").startswith(self.path)


RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def with_host(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of ``url``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    return (pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
            .withColumn("host", F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The longest fitting rule's name and verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        name, verdict = F.when(rule.fits(), rule.name).otherwise(name), F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return pages.withColumn("rule", name).withColumn("verdict", verdict)


def link_counts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(src, dst, weight, trust, distrust): links between different hosts, and how many of them go to urls that a rule allows or blocks."""
    links = pages.where("host <> '' and html is not null").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    links = links.select("src", F.translate(F.regexp_extract("link", r"^([^/]*)", 1), _UPPER, _LOWER).alias("host"),
                         F.regexp_extract("link", r"^[^/]*(.*)$", 1).alias("path")).where("host <> '' and src <> host")
    return ruled(links, rules).groupBy("src", F.col("host").alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("trust"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("distrust"))


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, and the steps from hosts of the table to the nearest one above."""
    known = hosts.select(F.col("host").alias("dst"))
    labels = F.split("host", r"\.")
    above = hosts.select(F.col("host").alias("src"), F.posexplode(F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("far", "dst")).where("dst <> ''")
    near = (above.join(known, "dst", "left_semi").groupBy("src").agg(F.min_by("dst", "far").alias("dst"))
            .select("src", "dst", F.lit(1.0).alias("weight")))
    return links.select("src", "dst", "weight").unionByName(near).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def link_seeds(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds (host, trust, distrust) and those that links make of hosts without pages."""
    outside = links.groupBy(F.col("dst").alias("host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return seeds.unionByName(outside.join(seeds.select("host"), "host", "left_anti"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust): PageRank from seeds (host, trust, distrust), the second over turned edges.

    What a host gets in a round is passed on in the next, each round a written
    table; the rank is the sum over rounds. They end once the rank still to be
    passed on is less than ``tolerance``, which damping brings about after
    log(tolerance) / log(damping) rounds at the latest, however long the chains
    of links. Rank that a host without edges would pass on is dropped; only
    the ratio of the two ranks is used.
    """
    spark = edges.sparkSession
    turned = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = turned.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    shares = settled(turned.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    each = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("trust").cast("double").alias("rank")),
                                          F.struct(F.lit("distrust").alias("kind"), "host", F.col("distrust").cast("double").alias("rank"))))
                        .alias("s")).select("s.*").where("rank > 0")
    total = each.groupBy("kind").agg(F.sum("rank").alias("total"))
    moving = each.join(F.broadcast(total), "kind").select("kind", "host", ((1 - damping) * F.col("rank") / F.col("total")).alias("rank"))  # two rows
    folder, schema = f"{shared_dir(spark)}/{uuid.uuid4().hex}", "kind string, host string, rank double"
    for number in itertools.count():
        seen = Observation()
        moving.observe(seen, F.sum("rank").alias("rank")).write.parquet(f"{folder}/round={number}")
        if damping * (seen.get["rank"] or 0.0) < tolerance * (1 - damping):
            break
        now = spark.read.schema(schema).parquet(f"{folder}/round={number}")
        moving = (now.join(shares, (now["kind"] == shares["kind"]) & (now["host"] == shares["src"]))
                  .select(shares["kind"], F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
                  .groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
    rank = spark.read.schema(schema).parquet(*[f"{folder}/round={i}" for i in range(number + 1)])
    return rank.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, tolerance: float = 1e-4,
               id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust and distrust of its host."""
    rules = RULES if rules is None else rules
    pages = ruled(with_host(take(pages, page_id=id, url=url, html=html)), rules)
    named = pages.where("host <> ''")
    hosts = settled(named.groupBy("host").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("trust"),
                                              F.count(F.when(F.col("verdict") == "block", 1)).alias("distrust")))
    links = settled(link_counts(pages, rules))
    scores = propagate(settled(host_edges(links, hosts)), settled(link_seeds(links, hosts)), tolerance=tolerance)
    both = pages.select("page_id", "host", "path", "rule", "verdict").join(scores, "host", "left")
    doubt = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    spread = F.when(doubt >= threshold, "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("verdict", spread).alias("verdict"),
                       F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
