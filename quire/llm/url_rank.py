"""URL verdicts from rules and from trust that flows over links between hosts.

Rules decide where one fits.  Elsewhere a host's trust, a personalised PageRank
that starts from allowed hosts and follows links, is set against its distrust,
which starts from blocked hosts and follows links backwards: who links to a
blocked host is suspect.  Hosts are linked by the absolute references in their
pages and with the domains above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import cut, ready, small

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, ROUNDS = 0.85, 12
#: By what share distrust must exceed trust: scores shrink as hosts grow in number, so they are never compared rounded.
TOLERANCE = 1e-9
#: Hosts are sent to every task up to this number, and joined by a shuffle beyond it.
BROADCAST_HOSTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/"'?#\s>]+)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and every domain above it, longest first."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, every: int = 4) -> DataFrame:
    """Personalised PageRank in each ``kind``: ``edges`` (kind, src, dst, share), ``seeds`` (kind, host, start).

    Shares of a source add up to one; so do the starts of a kind.  A host without
    links passes nothing on.  Returns kind, host and score.
    """
    state = seeds.select("kind", "host", F.col("start").alias("score"))
    restart = seeds.select("kind", "host", (F.col("start") * (1 - damping)).alias("score"))
    for i in range(1, rounds + 1):
        flow = edges.join(state.withColumnRenamed("host", "src"), ["kind", "src"])
        flow = flow.select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        state = flow.union(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % every == 0:
            state = cut(state)
    return state


def _shares(edges: DataFrame, kind: str) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(out, "src").select(F.lit(kind).alias("kind"), "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A verdict for every row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    A rule fits its host and the hosts below it if the path starts with the
    rule's; of several the longest counts.  Where none fits, a host is blocked if
    its distrust exceeds its trust, however small both are, else allowed; the two
    are rounded only as they are shown.  Null urls and urls without
    ``://`` have an empty host and path, fit no rule and are allowed; null html
    has no links.  Repeated rows are judged alike; links count once for each page
    row that holds them.
    """
    spark = ready(pages.sparkSession)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    table = spark.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string, rule string")
    # what rules may fit a host, found once for each host by an equi-join on its domains
    hosts = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    near = hosts.select("host", F.explode(domains(F.col("host"))).alias("rule_host")).join(table, "rule_host")
    near = cut(near.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "rule_path", "rule_verdict")).alias("rules")))
    fits = "array_max(filter(rules, r -> startswith(path, r.rule_path)))"
    ruled = rows.select("page", "host", "path").join(small(near, BROADCAST_HOSTS), "host", "left").withColumn("fit", F.expr(fits))
    given = ruled.where("fit is not null").groupBy("host", F.col("fit.rule_verdict").alias("verdict")).agg(F.count("*").alias("n"))
    given = given.join(hosts, "host").select(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", (F.col("n") / F.col("pages")).alias("weight"))
    given = cut(given)
    sums = given.groupBy("kind").agg(F.sum("weight").alias("total"))
    seeds = cut(given.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("start")))  # two sums at most
    links = rows.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst"))
    above = hosts.select(F.explode(domains(F.col("host"))).alias("dst")).distinct().where("instr(dst, '.') > 0")
    above = above.select(F.col("dst").alias("src"), F.expr("substring(dst, instr(dst, '.') + 1)").alias("dst")).where("instr(dst, '.') > 0")
    edges = links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    tree = above.union(above.select("dst", "src")).withColumn("weight", F.lit(1.0))
    edges = cut(edges.union(tree).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    scores = rank(cut(_shares(edges, "trust").union(_shares(back, "distrust"))), seeds)
    scores = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    facts = cut(hosts.select("host").join(near, "host", "left").join(scores, "host", "left").select("host", "rules", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("trust", "distrust")]))
    out = rows.select("page", "host", "path").join(small(facts, BROADCAST_HOSTS), "host", "left").withColumn("fit", F.expr(fits))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("fit.rule_verdict", F.when(distrust > trust * (1 + TOLERANCE), "block").otherwise("allow"))
    return out.select(F.col("page").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))
