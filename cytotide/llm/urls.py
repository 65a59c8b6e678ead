"""URL filter: host and path rules, and trust propagated over the host graph.

A rule (action, host, path) fits a host and its subdomains where the url's
path starts with the rule's; the longest fitting rule decides. Urls that no
rule fits are judged by their host. Hosts that pages link to (absolute links
of anchors) are the edges of a graph. Trust starts at hosts with a page that
an allow rule passes and follows the links; distrust starts at hosts that a
block rule covers as a whole and follows the links backwards, to hosts that
link to them. Both are personalised PageRank with damping DAMPING, a host's
rank divided among its edges. Distrust of a host that many link to is thus
divided among them all, so a third score, exposure, follows the links backwards
too, but a host gets the mean over its own links, whoever else links there. A
host is blocked where its distrust or its exposure is at least THRESHOLD and
greater than its trust.

Defined results: a null url and one without ``://`` has an empty host and
path, which no rule and no edge concerns, and is allowed; null html has no
links; repeated pages and links count once; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick, sized_broadcast

DAMPING = 0.85
#: A seed starts with 1 - DAMPING, so this is a part of what one link from a seed with few links passes on.
THRESHOLD = 0.01
#: Propagation ends when what is still under way is below this part of what the seeds started with.
TOLERANCE = 1e-4
ROUNDS_A_CHECKPOINT = 4
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return _part(url, 2)


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (action, rule, whole), null if none fits; ``whole``: it covers its host."""
    out = F.lit(None).cast("struct<action: string, rule: string, whole: boolean>")
    for action, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(at + start).alias("rule"),
                                    F.lit(start == "/").alias("whole"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts, from the absolute links of anchors."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)),
                                         lambda u: host(F.when(u.startswith("//"), F.concat(F.lit(":"), u)).otherwise(u))))
    return (pages.select(host(F.col("url")).alias("src"), F.explode(links).alias("dst"))
            .where("src <> '' and dst <> '' and src <> dst").distinct())


def rounds_of(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which what is under way is below the tolerance."""
    return ceil(log(tolerance) / log(damping))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): personalised PageRank of kind 'trust' along the edges and of 'distrust' against them, and 'exposure'.

    Exposure goes against the edges too, divided by the edges of the host that
    it comes to instead of the one that it comes from.

    ``seeds`` has (kind, host). The rank is summed as it spreads: every round
    passes on what arrived in the last one, times damping, until nothing is under way or,
    as it shrinks by that factor at least, what is left is below the tolerance. A few
    rounds are one job, whose sums are written.
    """
    along = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), F.col("src").alias("of"))
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("next"), F.col("dst").alias("of"))
    ways = along.unionByName(against).unionByName(against.withColumn("kind", F.lit("exposure")).withColumn("of", F.col("next")))
    fan = ways.groupBy("kind", "of").agg(F.count(F.lit(1)).alias("fan"))
    ways = materialize(ways.join(fan, ["kind", "of"]).drop("of"))

    state = materialize(seeds.select("kind", "host").distinct().withColumn("moving", F.lit(1.0 - damping)).withColumn("score", F.col("moving")))
    if ways.isEmpty():
        return state.drop("moving")
    done, most = 0, rounds_of(damping, tolerance)
    while done < most:
        came, parts = state, [state.select("kind", "host", F.lit(0.0).alias("moving"), "score")]
        for turn in range(now := min(ROUNDS_A_CHECKPOINT, most - done)):
            came = (ways.join(came.select("kind", "host", "moving").where("moving > 0"), ["kind", "host"])
                    .groupBy("kind", F.col("next").alias("host")).agg((F.sum(F.col("moving") / F.col("fan")) * damping).alias("moving")))
            last = F.col("moving") if turn == now - 1 else F.lit(0.0)
            parts.append(came.select("kind", "host", last.alias("moving"), F.col("moving").alias("score")))
        state = materialize(reduce(DataFrame.unionByName, parts).groupBy("kind", "host")
                            .agg(F.sum("moving").alias("moving"), F.sum("score").alias("score")))
        done += now
        if state.where("moving > 0").isEmpty():
            break
    return state.drop("moving")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = DAMPING,
          threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, exposure) per page; the scores are the host's.

    Pages are read twice, first for links and seeds. Scores of hosts are
    broadcast if their measured size allows.
    """
    d = pick(pages, "page_id", "url", "html")
    located = d.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = located.withColumn("hit", deciding_rule(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("hit.action") == "allow", "trust").when((F.col("hit.action") == "block") & F.col("hit.whole"), "distrust")
    seeds = ruled.select(kind.alias("kind"), "host").where("kind is not null").distinct()
    seeds = seeds.unionByName(seeds.where("kind = 'distrust'").withColumn("kind", F.lit("exposure")))
    scores = propagate(materialize(host_edges(d)), seeds, damping)
    kinds = ("trust", "distrust", "exposure")
    by_host = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in kinds])
    out = (ruled.join(sized_broadcast(by_host), "host", "left")
           .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in kinds}))
    against = F.greatest("distrust", "exposure")
    bad = (against >= threshold) & (against > F.col("trust"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                      F.coalesce(F.col("hit.action"), F.when(bad, "block").otherwise("allow")).alias("verdict"), *kinds)
