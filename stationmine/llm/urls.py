"""URL filter by rules and link-graph propagation (operator 11).

Rules name a host, with all its subdomains, and the start of a path; the longest that fits decides. Pages no rule fits are
judged by their host. Hosts are the nodes of a graph, and an edge leads from a host to each other host that
its pages link to. Trust starts at hosts with allowed pages and follows links (personalised PageRank: what a
host passes on is dealt evenly among those it links to); distrust starts at hosts with blocked pages and
follows links backwards, so it reaches those who link there. A host is blocked where distrust holds more than its share of both.

Scores are whole numbers: a page is worth UNIT, each division rounds down. So results do not depend on the
order of additions, and a propagation that stands still has reached its end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationmine.scale import cut, join_small

#: Worth of one page that a rule allows or blocks.
UNIT = 1 << 20
#: A host passes on 17 of 20 parts of its score.
PASSED, PARTS = 17, 20
ROUNDS = 30
#: Percent of trust and distrust together that distrust must exceed to block a host.
PERCENT = 50
#: Hosts with more links than this are split, so that no task holds all links of one.
HUB = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of each link of a page: ``href`` of an ``a`` with ``//`` behind an optional scheme.
LINK = (
    r"""(?i)<a(?:[ \t\n\f\r/][^<>]*?)?[ \t\n\f\r"'/]href[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*"""
    r"""(?:[a-z][a-z0-9+.-]*:)?//([^/?#"' \t\n\f\r>\\]+)"""
)
_SPLIT = r"://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    """``allow`` or ``block`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the path; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: what fits each host, longest first; hosts without any are left out.

    A host meets rules through each of its suffixes of whole labels. Its list is as long as the rules of its domains.
    """
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ordered = rules.filter("host <> ''").select(
        F.col("host").alias("end"),
        F.struct(
            (-F.length("host") - F.length("path")).alias("order"),
            F.concat("host", "path").alias("rule"),
            (F.col("verdict") != "block").alias("allows"),  # of two equal rules, the one that blocks
            "path",
        ).alias("one"),
    ).distinct()
    met = join_small(hosts.select("host", F.explode(ends).alias("end")), ordered, ["end"])
    return met.groupBy("host").agg(F.array_sort(F.collect_list("one")).alias("rules"))


def ruled(located: DataFrame, rules: DataFrame) -> DataFrame:
    """``located`` (host, path and more) with ``rule`` and ``allows``, both null where no rule fits."""
    lists = cut(host_rules(located.select("host").distinct(), rules))
    fit = F.element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), 1)
    return (
        join_small(located, lists, ["host"], "left")
        .withColumn("_fit", F.when(F.exists("rules", lambda r: F.startswith(F.col("path"), r["path"])), fit))
        .select(*located.columns, "_fit.rule", "_fit.allows")
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: every pair of different hosts of which one links to the other."""
    found = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to")
    )
    return found.select("src", F.translate("to", UPPER, LOWER).alias("dst")).filter("src <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, score: seeds (host, score) and what reaches each host along the edges (src, dst).

    A round deals PASSED / PARTS of each host's score evenly among the hosts it leads to; PARTS - PASSED
    parts of its seed are added. Hosts without edges pass nothing on. Ends early where nothing changes.
    """
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    hubs = cut(degrees.filter(F.col("degree") > HUB).select("src", F.ceil(F.col("degree") / HUB).cast("int").alias("parts")))
    place = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")
    dealt = cut(join_small(edges, hubs, ["src"], "left").select("src", "dst", place.alias("part")))
    base = F.expr(f"score * {PARTS - PASSED} div {PARTS}")
    reached = edges.select(F.col("dst").alias("host")).union(edges.select("src")).distinct()
    nodes = (
        seeds.select("host", base.alias("base"))
        .union(reached.select("host", F.lit(0).cast("long")))
        .groupBy("host").agg(F.sum("base").alias("base"))
        .join(degrees.withColumnRenamed("src", "host"), "host", "left")
        .join(hubs.withColumnRenamed("src", "host"), "host", "left")
    )
    nodes = cut(nodes)
    state = nodes.select("*", F.col("base").alias("score"))
    for _ in range(rounds):
        shares = state.filter("degree > 0").select(
            F.col("host").alias("src"),
            F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
            F.expr(f"score * {PASSED} div ({PARTS} * degree)").alias("share"),
        )
        got = dealt.join(shares.filter("share > 0"), ["src", "part"]).groupBy("dst").agg(F.sum("share").alias("got"))
        held = state.select(*nodes.columns, F.col("score").alias("before"))
        new = held.join(got.withColumnRenamed("dst", "host"), "host", "left")
        state = cut(new.select(*nodes.columns, "before", (F.col("base") + F.coalesce("got", F.lit(0))).alias("score")))
        if state.filter("score <> before").isEmpty():
            break
        state = state.drop("before")
    return state.select("host", "score")


def judge(pages: DataFrame, rules: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per page.

    ``rules`` holds verdict, host and path. ``verdict`` is the longest fitting rule's; where none fits, ``block`` if
    distrust is more than ``percent`` of the host's trust and distrust, else ``allow``, so hosts that nothing
    reaches are allowed. A host's seeds are its pages that rules allow or block.

    Urls that are null or hold no ``://`` have an empty host and path, fit no rule and are allowed. Null html has no links, relative links lead nowhere
    else, links in tags with a stray `<` are not seen, and links to the own host do not count. Repeated pages count as often as they occur. Only ``page_id``, ``url`` and ``html`` are read. No rows: no rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = cut(ruled(cut(located), rules))
    counts = known.filter("allows IS NOT NULL").groupBy("host", "allows").agg((F.count(F.lit(1)) * UNIT).alias("score"))
    counts = cut(counts)
    edges = cut(host_edges(pages))
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    trust = propagate(edges, counts.filter("allows").select("host", "score"), rounds)
    distrust = propagate(backwards, counts.filter("NOT allows").select("host", "score"), rounds)
    zero = F.lit(0).cast("long")
    both = (
        trust.select("host", F.col("score").alias("trust"), zero.alias("distrust"))
        .union(distrust.select("host", zero, "score"))
        .groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    blocked = exact("distrust") * 100 > (exact("trust") + exact("distrust")) * percent
    scored = join_small(known, cut(both), ["host"], "left")
    decided = F.coalesce(F.col("allows"), ~blocked, F.lit(True))
    return scored.select(
        "page_id", "host", "path", "rule", F.when(decided, "allow").otherwise("block").alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )
