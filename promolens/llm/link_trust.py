"""URL filters: rules by host and path, and for the rest trust and distrust along the links between hosts.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path
goes on up to ``?``, ``#`` or the end. A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's; the longest rule wins, of equally long ones the one with the longer host, then block.

Pages without a rule take the verdict of their host. Hosts are the nodes of a graph whose edges are the
absolute links of pages to other hosts, weighed by their number. The share of a host's pages that a rule allows
is its seed of trust, the share that a rule blocks its seed of distrust. Trust follows the links (personalised
PageRank from the trusted seeds), distrust goes against them (a host that links to blocked hosts is distrusted):
``score = seed + damping * sum over neighbours of score * share of their links``, for a fixed number of rounds.
What a host without links would send is left out, which in PageRank proper changes all scores by one
factor. A host is blocked if its distrust exceeds its trust by at least ``threshold`` (in units of a host all of
whose pages a rule blocks); a host that no seed reaches is allowed.

SQL functions only. Pages of hosts with over 1/1,000 of all pages (so at most 1,000 hosts) meet their verdicts
by broadcast, the others by a shuffle on the host; edges of a host with very many neighbours are dealt out
over salted copies of its score.

Nulls and edges: a null url, or one without ``://``, has an empty host and path and the verdict ``allow``; a null html
has no links; repeated rows are pages of their own; a null page_id stays null; an empty table gives an empty
result. Extra columns are ignored, whatever their names; very long pages only cost their scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store

# Fixed values of the contract: (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ALLOW, BLOCK = "allow", "block"
DAMPING = 0.85
ROUNDS = 20
#: Rounds planned as one job, between stored scores.
STRIDE = 5
THRESHOLD = 0.5
#: A host with more than this part of all pages is hot; there are at most 1 / HOT of them.
HOT = 0.001
#: Neighbours of a host that meet one copy of its score.
FAN = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^<>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule and its verdict, both null if none fits. ``rules`` is a list, sent with the plan."""
    split = [(verdict, text, *text.partition("/")[::2]) for verdict, text in rules]
    order = sorted(split, key=lambda r: (-len(r[1]), -len(r[2]), r[0] != BLOCK, r[1]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), text, verdict) for verdict, text, h, p in order]
    null = F.lit(None).cast("string")
    return (F.coalesce(*[F.when(f, F.lit(text)) for f, text, _ in fits], null),
            F.coalesce(*[F.when(f, F.lit(verdict)) for f, _, verdict in fits], null))


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, html, host, path, rule, verdict (null without a rule)."""
    url = F.col("url").cast("string")
    p = pages.select("page_id", F.col("html").cast("string").alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return p.withColumns({"rule": rule, "verdict": verdict})


def links(p: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    found = p.where("host <> '' AND html IS NOT NULL").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    return found.withColumn("dst", lower_ascii(F.col("dst"))).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _ways(edges: DataFrame, fan: int) -> DataFrame:
    """kind, u, salt, v, w: where a score of u goes, in equal shares by links; distrust goes against them."""
    both = edges.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "n"),
                                          F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("u"), F.col("src").alias("v"), "n"))).alias("e")).select("e.*")
    out = both.groupBy("kind", "u").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("salts"))
    return (both.join(out, ["kind", "u"])
            .select("kind", "u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), "salts", "v", (F.col("n") / F.col("all")).alias("w")))


def host_scores(p: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, fan: int = FAN) -> DataFrame:
    """host, pages, trust, distrust of every host that has pages or is linked to."""
    hosts = store(p.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("verdict") == ALLOW, 1)).alias("good"),
        F.count(F.when(F.col("verdict") == BLOCK, 1)).alias("bad")), "hosts")
    edges = store(links(p), "links")
    share = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("pages")).alias("seed")),
                              F.struct(F.lit("distrust").alias("kind"), (F.col("bad") / F.col("pages")).alias("seed"))))
    seeds = hosts.select(F.col("host").alias("u"), share.alias("s")).select("s.kind", "u", "s.seed").where("seed > 0")
    scores = seeds.withColumnRenamed("seed", "score")
    if not edges.isEmpty():                        # without links the seeds are the scores
        seeds = store(seeds, "seeds")
        ways = store(_ways(edges, fan), "ways")
        copies = ways.groupBy("kind", "u").agg(F.first("salts").alias("salts"))
        scores = store(seeds.withColumnRenamed("seed", "score"), "scores")
        for at in range(rounds):
            sent = (scores.join(copies, ["kind", "u"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
                    .join(ways.drop("salts"), ["kind", "u", "salt"]).select("kind", F.col("v").alias("u"), (F.col("score") * F.col("w") * damping).alias("score")))
            scores = sent.unionByName(seeds.withColumnRenamed("seed", "score")).groupBy("kind", "u").agg(F.sum("score").alias("score"))
            if (at + 1) % STRIDE == 0 or at + 1 == rounds:
                scores = store(scores, "scores")
    wide = scores.groupBy(F.col("u").alias("host")).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    none = F.lit(0.0)
    return (hosts.select("host", "pages").join(wide, "host", "full")
            .select("host", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust")))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, hot: float = HOT, **how) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of ``pages``."""
    p = parsed(pages, rules)
    hosts = store(host_scores(p, **how).withColumn("by_host", F.when(F.col("distrust") - F.col("trust") >= threshold, BLOCK).otherwise(ALLOW)), "host-verdicts")
    total = hosts.agg(F.sum("pages").alias("n"))
    large = F.broadcast(hosts.where(F.col("pages") > total.scalar() * hot).select("host", "by_host"))     # at most 1 / hot rows
    met = p.drop("html").join(large, "host", "left")
    out = ["page_id", "host", "path", "rule"]
    verdict = F.coalesce("verdict", "by_host", F.when(F.col("host") == "", F.lit(ALLOW)))
    rest = met.where(verdict.isNull()).drop("by_host").join(hosts.select("host", "by_host"), "host")
    return (met.where(verdict.isNotNull()).select(*out, verdict.alias("verdict"))
            .unionByName(rest.select(*out, F.col("by_host").alias("verdict"))))
