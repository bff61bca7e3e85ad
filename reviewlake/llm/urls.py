"""Verdicts on urls: rules first, then trust and distrust that spread over the links between hosts.

Hosts are nodes. An edge goes from a page's host to a host that its html links to, weighted by the number of links; a host
counts as linking once to its parent domain. Trust starts at hosts with pages that a rule allows and follows the
links (personalised PageRank); distrust starts at hosts with pages that a rule blocks and follows them backwards, so that
linking to blocked hosts counts against a host. A page without a rule is blocked if its host's distrust reaches the threshold
and exceeds its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.shared import keep

Rule = tuple[str, str, str]
"""Verdict (allow or block), host, path."""

RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
                     ("block", "net", "/es/"), ("block", "net", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A link to another host: an absolute address or one that begins with two slashes.
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


MOST_LABELS = 127
"""Labels of the longest name in DNS."""


def host_and_path(df: DataFrame, url: str) -> DataFrame:
    """Add ``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and ``path`` (from there up
    to ``?``, ``#`` or the end); both are empty for a null url or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return (df.withColumn("_rest", F.coalesce(rest, F.lit("")))
            .withColumn("host", F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one, from the columns ``host`` and ``path``.

    A rule fits its host and all subdomains if the path begins with the rule's. The rules are part of the plan, so there
    should be no more than some hundreds.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, family: bool = True) -> DataFrame:
    """``src, dst, weight``: links between different hosts. ``pages`` has ``host`` and ``html``.

    With ``family`` a host of more than two labels also links to its parent domain, and so on upwards: a subdomain vouches
    for its domain, and answers for it. A name of more labels than DNS allows links to its last ``MOST_LABELS`` at once.
    """
    linked = (pages.filter("host <> '' and html is not null")
              .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
              .withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("dst <> src")
              .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    if not family:
        return linked
    hosts = (pages.select("host").distinct().unionByName(linked.select(F.col("dst").alias("host"))).distinct())
    labels = F.split("host", r"\.")
    split = hosts.withColumn("all_labels", labels)
    labels = F.slice("all_labels", F.greatest(F.lit(1), F.size("all_labels") - MOST_LABELS + 1), MOST_LABELS)
    up = (split.withColumn("labels", labels).filter(F.size("labels") >= 3)
          .select(F.explode(F.transform(F.sequence(F.lit(1), F.size("labels") - 2), lambda i: F.struct(
              F.concat_ws(".", F.slice("labels", i, F.size("labels") - i + 1)).alias("src"),
              F.concat_ws(".", F.slice("labels", i + 1, F.size("labels") - i)).alias("dst")))).alias("e"))
          .select("e.src", "e.dst"))
    longer = (split.filter(F.size("all_labels") > MOST_LABELS)
              .select(F.col("host").alias("src"), F.concat_ws(".", labels).alias("dst")))
    up = up.unionByName(longer).distinct()
    return (linked.unionByName(up.withColumn("weight", F.lit(1.0)))
            .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def spread_scores(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20,
                  rounds_at_once: int = 5) -> DataFrame:
    """``kind, host, score`` after ``rounds`` of propagation.

    ``seeds``: ``kind`` (trust or distrust), ``host``, ``mass``. Trust goes from ``src`` to ``dst`` by the share of the
    source's links, distrust from ``dst`` to ``src`` by the share of the target's. Every round is a join with the edges and
    one sum by host; what is left of the start's mass after ``rounds`` is below ``damping ** rounds``.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
    ways = keep(edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("at"),
                                              F.col("dst").alias("to"), (F.col("weight") / F.col("all")).alias("share"))
                .unionByName(edges.join(into, "dst").select(
                    F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"),
                    (F.col("weight") / F.col("all")).alias("share"))))
    start = keep(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("part")))
    scores = start.withColumnRenamed("part", "score")
    for i in range(rounds):
        moved = (scores.withColumnRenamed("host", "at").join(ways, ["kind", "at"])
                 .select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("part")))
        scores = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("part").alias("score"))
        if i % rounds_at_once == rounds_at_once - 1:
            scores = keep(scores)
    return scores


def judge_pages(pages: DataFrame, rules: list[Rule] = RULES, threshold: float = 0.5, damping: float = 0.85,
                rounds: int = 20, family: bool = True) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages`` (``page_id, url, html``).

    The mass that a host starts with is the share of its pages that rules allow, or block. Scores are divided by what a
    host of only such pages gets from itself; so a ``threshold`` of 0.5 means: as distrusted as a host with half of its pages
    blocked. A page of the empty host is allowed unless a rule says otherwise, as are pages of hosts that nothing is known about.
    Nulls: a null url has an empty host and path, null html has no links; repeated rows get a row each and count as often.
    Very long urls and pages are read whole; an empty table gives no rows. Other columns are not looked at.
    """
    name, kind = rule_of(rules)
    rows = host_and_path(pages.select("page_id", "url", "html"), "url")
    ruled = rows.withColumn("rule", name).withColumn("ruled", kind)
    mass = (ruled.filter("host <> ''").groupBy("host")
            .agg(F.avg((F.coalesce(F.col("ruled"), F.lit("")) == "allow").cast("double")).alias("trust"),
                 F.avg((F.coalesce(F.col("ruled"), F.lit("")) == "block").cast("double")).alias("distrust")))
    seeds = (mass.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust"))
                         .alias("kind", "mass")).filter("mass > 0"))
    scores = spread_scores(keep(host_edges(rows, family)), seeds, damping, rounds)
    by_host = (scores.groupBy(F.col("host").alias("score_host"))
               .agg(*[F.round(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)) / (1 - damping), 6)
                      .alias(k) for k in ("trust", "distrust")]))
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return (ruled.drop("html", "url").join(by_host, F.col("host") == F.col("score_host"), "left")
            .withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"))
