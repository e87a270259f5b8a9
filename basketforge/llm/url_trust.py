"""URL filters: rules, and trust and distrust spread over links between hosts.

A url is first judged by rules of host and path. Where none fits, its host is
judged by the link graph: personalised PageRank starts from hosts that the allow
rules name and follows links; distrust starts from hosts that the block rules
name and follows links backwards, so that hosts which link to blocked ones take a
share. A host whose distrust, over all hosts' distrust, exceeds its trust, over
all hosts' trust, by more than ``MARGIN`` is blocked; others are allowed.

Links are hosts of the crawl that a page names in absolute links or in its text;
an edge weighs the number of the source's pages that name the target.

Defined cases: a null url, or one without ``://``, has an empty host and path, no
rule and no edges, and is allowed; null html names no hosts; without seeds or
edges every host without a rule is allowed; repeated rows are judged once each
and count as pages; a null page_id is carried along; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.session import dropped, staged
from basketforge.sources.tables import table

#: (verdict, host, path), as the contract of the query gives them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Most mass, of one, that may still move when the rounds end.
UNSETTLED = 1e-3
ROUNDS_A_WRITE = 4
MARGIN = 0.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that hold host names, and what stands between two: a dot that no letter or digit follows.
#: No pattern repeats a group: Java matches those by recursion.
HOST_RUN, BETWEEN = r"[a-z0-9][a-z0-9.-]*", r"\.[.-]+|\.$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (name, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) -> src, dst, weight between different hosts of the crawl."""
    hosts = pages.select(F.col("host").alias("dst")).where("host <> ''").distinct()
    runs = F.filter(F.regexp_extract_all(F.lower(F.col("html").cast("string")), F.lit(HOST_RUN), F.lit(0)), lambda r: r.contains("."))
    named = F.filter(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.split(r, BETWEEN)))), lambda h: h.contains("."))
    mentions = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(named).alias("dst")).where("src <> dst")
    # Summed before the join: a host with a third of all pages is a few rows by then.
    return mentions.groupBy("src", "dst").agg(F.count("*").alias("weight")).join(hosts, "dst", "left_semi").select("src", "dst", "weight")


def spread(edges: DataFrame, seeds: DataFrame, unsettled: float = UNSETTLED) -> DataFrame:
    """Personalised PageRank on (kind, src, dst, weight) from seeds (kind, node): kind, node, rank; staged.

    What a host without links holds returns to the seeds. A round moves at most
    ``DAMPING`` times what the one before it moved, so the rounds end when what they
    could still move, the last change times DAMPING / (1 - DAMPING), is less than
    ``unsettled`` in either kind; that is after log(unsettled) / log(DAMPING) at most,
    some 60.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = staged(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    # One row a kind: how many seeds it has.
    numbers = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    start = staged(seeds.join(F.broadcast(numbers), "kind").select("kind", "node", (1 / F.col("n")).alias("part")), "seeds")
    rank, before = start.select("kind", "node", F.col("part").alias("rank")), None
    while True:
        for nth in range(ROUNDS_A_WRITE):
            old = rank
            moved = rank.withColumnRenamed("node", "src").join(shares, ["kind", "src"]).select("kind", F.col("dst").alias("node"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
            passed = moved.groupBy("kind", "node").agg(F.sum("rank").alias("rank"))
            kept = passed.groupBy("kind").agg(F.sum("rank").alias("moved"))
            back = start.join(F.broadcast(kept), "kind", "left").select("kind", "node", (F.col("part") * (1 - F.coalesce("moved", F.lit(0.0)))).alias("rank"))
            last = nth == ROUNDS_A_WRITE - 1
            # The last round before a write also carries what each host had.
            none = F.lit(0.0).alias("old")
            rows = passed.select("*", none).union(back.select("*", none))
            rows = rows.union(old.select("kind", "node", F.lit(0.0), "rank")) if last else rows
            rank = rows.groupBy("kind", "node").agg(F.sum("rank").alias("rank"), *([F.sum("old").alias("old")] if last else []))
        rank = staged(rank, "ranks")
        change = rank.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("c")).agg(F.max("c")).first()[0] or 0.0
        dropped(before)
        if change * DAMPING / (1 - DAMPING) < unsettled:
            dropped(shares, start)
            return rank
        before, rank = rank, rank.drop("old")


def host_verdicts(pages: DataFrame) -> DataFrame:
    """``pages`` (host, rule, html) -> host, trust, distrust, blocked for hosts that either reaches."""
    edges = staged(host_edges(pages), "host-edges")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    kind = F.when(F.col("rule.verdict") == "allow", "trust").otherwise("distrust")
    seeds = pages.where("rule is not null").select(kind.alias("kind"), F.col("host").alias("node")).distinct()
    ranks = spread(both, seeds)
    dropped(edges)
    wide = ranks.groupBy("node").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    return wide.select(F.col("node").alias("host"), "trust", "distrust", (F.col("distrust") - F.col("trust") > MARGIN).alias("blocked"))


def judge(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    verdicts = host_verdicts(rows)
    there = rows.drop("html").join(verdicts, "host", "left")
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return there.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce("rule.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op9_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))
