"""URL filter: rules by host and path, then trust and distrust over the host graph.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest fitting rule decides. Other pages are judged by their host: personalised
PageRank spreads trust along links from the hosts with allowed pages, and
distrust against them (towards hosts that link to bad ones) from the hosts with
blocked pages; a host whose distrust is at least ``BLOCK_SHARE`` of both is
blocked, any other allowed. Both walks run as one iteration of a join and a sum
over host edges, until the mass still to come is below ``TOLERANCE`` and no host is
reached for the first time, so a host is judged however far it is from the seeds. Mass that
reaches a host without onward links is dropped and each walk normalised, which
is the same as sending it back to the seeds.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule
and is allowed; null html has no links; links within a host are no edges; of two
rules with the same text the blocking one holds; rows that repeat are judged
alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, dropped, staged, table

#: The rules of the contract (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
TOLERANCE = 1e-6
BLOCK_SHARE = 0.5
#: Host of an absolute or protocol-relative link.
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url) -> tuple:
    """(host, path) columns."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return (ascii_lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def _suffixes(host):
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "."))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host in ``hosts`` that has any; ``rules``
    is (rule_host, rule_path, verdict). Joined on the host's domains."""
    r = rules.select("rule_host", F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("length"), F.concat("rule_host", "rule_path").alias("rule"),
        "verdict", F.col("rule_path").alias("path")).alias("r"))
    return (hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host")).join(r, "rule_host")
            .groupBy("host").agg(F.collect_set("r").alias("rules")))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; ``pages`` has host and html."""
    to = F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), ascii_lower)
    return (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(to).alias("dst"))
            .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
              max_iterations: int | None = None) -> DataFrame:
    """(walk, host, mass): personalised PageRank of each walk, summing to 1.
    ``seeds``: (walk, host, weight); ``edges``: (walk, src, dst, n). Raises if
    ``max_iterations`` rounds do not reach the end; without it the walk ends by itself:
    the mass to come shrinks by ``damping`` a round, and each further round finds a new host."""
    out = edges.groupBy("walk", "src").agg(F.sum("n").alias("out_n"))
    steps = staged(edges.join(out, ["walk", "src"]).select(
        "walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out_n") * damping).alias("share")), "steps")
    start = seeds.join(seeds.groupBy("walk").agg(F.sum("weight").alias("all")), "walk").where("all > 0").select(
        "walk", "host", (F.col("weight") / F.col("all")).alias("mass"))
    # Mass on the move and mass so far, by host reached.
    state = staged(start.groupBy("walk", "host").agg(F.sum("mass").alias("moving"), F.sum("mass").alias("mass")), "mass")
    hosts, rounds = state.count(), 0
    while True:
        onward = state.where("moving > 0").join(steps, ["walk", "host"]).select(
            "walk", F.col("dst").alias("host"), (F.col("moving") * F.col("share")).alias("moving"))
        last, state = state, staged(
            state.select("walk", "host", F.lit(0.0).alias("moving"), "mass")
            .union(onward.select("walk", "host", "moving", F.col("moving").alias("mass")))
            .groupBy("walk", "host").agg(F.sum("moving").alias("moving"), F.sum("mass").alias("mass")), "mass")
        dropped(last)
        rounds += 1
        before = hosts
        left, hosts = state.agg(F.coalesce(F.sum("moving"), F.lit(0.0)), F.count(F.lit(1))).first()
        if left * damping / (1 - damping) < tolerance and hosts == before:
            break
        if rounds == max_iterations:
            raise RuntimeError(f"the walk did not end in {rounds} rounds: {left} of the mass still moves")
    sums = state.select("walk", "host", "mass")
    return sums.join(sums.groupBy("walk").agg(F.sum("mass").alias("all")), "walk").select(
        "walk", "host", (F.col("mass") / F.col("all")).alias("mass"))


def url_verdicts(pages: DataFrame, rules: DataFrame, block_share: float = BLOCK_SHARE, **walk) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    host, path = split_url(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    edges = staged(host_edges(p), "edges")
    by_host = fitting_rules(p.select("host").where("host <> ''").distinct(), rules)
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    ruled = staged(p.drop("html").join(by_host, "host", "left")
                   .select("page_id", "host", "path", best.alias("b"))
                   .select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("ruled")), "ruled")
    walk_of = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("walk")
    seeds = ruled.where("ruled is not null").groupBy(walk_of, "host").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst", "n").union(
        edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    mass = propagate(staged(seeds, "seeds"), both, **walk)
    scores = mass.groupBy(F.col("host").alias("m_host")).agg(
        F.sum(F.when(F.col("walk") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("walk") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    scores = staged(scores, "host-scores")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust > 0) & (distrust >= block_share * (trust + distrust))
    return ruled.join(scores, ruled["host"] == scores["m_host"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "rule_host string, rule_path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)
