"""URL rules and link-graph propagation over hosts (native expressions only).

Method: every url is split into host and path and judged by the longest fitting rule.
Hosts with allowed pages seed a personalised PageRank along the links between hosts
(trust); hosts with blocked pages seed one against the links (distrust: who links to
blocked hosts is suspect). A host whose distrust exceeds its trust, however small both
are, is blocked for all of its pages that no rule fits.

Defined results for odd input: a null url, or one without ``://``, has an empty host
and path, no rule and the verdict allow; null html has no links; repeated rows count
as often as they occur; an empty table gives an empty result; further columns are
ignored; relative links stay inside their host and make no edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.session import table

#: The rules of the contract as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    #: Rounds go on until no score has grown by more than this share of itself in
    #: ``CHECKED`` rounds, however far a host is from a seed.
    tolerance: float = 1e-7
    #: A host is blocked when its distrust exceeds its trust by this share of the trust:
    #: scores shrink as a corpus grows, so no absolute difference decides.
    margin: float = 1e-5


#: After so many rounds the scores are written and compared.
CHECKED = 4


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s).*?://[^/?#]*(/[^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. The rule list is a
    parameter of a few entries, folded into the expression."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = None
    for verdict, h, p in ranked:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    step = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    step = step.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    return step.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted before the shuffle."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""), F.lit(1))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return (
        pages.select(host_of(F.coalesce(F.col("url"), F.lit(""))).alias("src"), F.explode(links).alias("link"))
        .select("src", host_of(full).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, how: Propagation = Propagation()) -> DataFrame:
    """(host, kind, score): one PageRank per kind, in one set of rounds. ``seeds`` has
    (host, kind, seed) with seeds of a kind summing to 1; ``edges`` (kind, src, dst,
    share) with shares of a (kind, src) summing to 1. Mass of hosts without out-edges
    is lost, as in the usual damped form without redistribution.

    Each round is one join on the source host and one pre-aggregated sum; every fourth
    round is written to the shared folder, so that lineage stays short, and compared with
    the last one written. Scores only grow from round to round, by at most ``damping`` of
    the last growth, so the rounds end: about 110 after the last host is reached in a graph
    with cycles, at once in one without. Without edges no round is run."""
    base = seeds.select("host", "kind", ((1 - how.damping) * F.col("seed")).alias("score"))
    if edges.isEmpty():
        return base
    base = shared.stored(base, "link-base")
    links, last = edges.withColumnRenamed("src", "host"), base
    while True:
        score = last
        for _ in range(CHECKED):
            flow = score.join(links, ["host", "kind"]).select(F.col("dst").alias("host"), "kind", (how.damping * F.col("score") * F.col("share")).alias("score"))
            score = flow.unionByName(base).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        score = shared.stored(score, "link-rank")
        grown = score.join(last.withColumnRenamed("score", "before"), ["host", "kind"], "left").where(F.col("before").isNull() | (F.col("score") > F.col("before") * (1 + how.tolerance)))
        if grown.isEmpty():
            return score
        last = score


def judge(pages: DataFrame, rules=RULES, how: Propagation = Propagation()) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    rows = shared.stored(parsed(pages, rules), "link-pages")
    counted = (
        rows.where(F.col("host") != "")
        .groupBy("host")
        .agg(F.sum((F.col("ruled") == "allow").cast("double")).alias("allow"), F.sum((F.col("ruled") == "block").cast("double")).alias("block"))
    )
    counted = shared.stored(counted.na.fill(0.0, ["allow", "block"]), "link-hosts")
    kinds = counted.select(
        "host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (("trust", "allow"), ("distrust", "block"))))).alias("s")
    ).select("host", "s.kind", "s.n").where("n > 0")
    totals = kinds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = kinds.join(F.broadcast(totals), "kind").select("host", "kind", (F.col("n") / F.col("total")).alias("seed"))  # two rows
    links = shared.stored(host_edges(pages), "link-edges")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out_of = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = both.join(out_of, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    edges = shared.stored(edges, "link-shares")
    score = propagate(seeds, edges, how)
    per_host = score.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    blocked = per_host.select("host", (F.col("distrust") > F.col("trust") * (1 + how.margin)).alias("host_blocked"))
    out = shared.with_small(rows, shared.stored(blocked, "link-verdicts"), "host")
    method = F.when(F.coalesce("host_blocked", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def op10_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    return judge(table(spark, sf_dir, "pages"))


def _oracle(rounds: int = 200, damping: float = Propagation.damping, margin: float = Propagation.margin) -> str:
    # Flows by the length of their way; far more rounds than it takes to settle.
    fits = {h + p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in RULES}
    verdicts = {h + p: v for v, h, p in RULES}
    order = sorted(fits, key=lambda r: -len(r))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r in order) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{verdicts[r]}'" for r in order) + " END"
    host = "translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, {host.format(u='url')} AS host, regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's') AS path, html FROM u),
q AS (SELECT *, {rule} AS rule FROM s),
rows_ AS (SELECT *, {ruled} AS ruled FROM q),
hosts AS (SELECT host, sum(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END)::DOUBLE AS a, sum(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END)::DOUBLE AS b FROM rows_ WHERE host <> '' GROUP BY host),
seeds AS (SELECT host, 'trust' AS kind, a / (SELECT sum(a) FROM hosts) AS seed FROM hosts WHERE a > 0
          UNION ALL SELECT host, 'distrust', b / (SELECT sum(b) FROM hosts) FROM hosts WHERE b > 0),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\b(?:href|src)\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^\\s"''<>]+)', 1)) AS link FROM rows_),
hops AS (SELECT src, {host.format(u="CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM found),
links AS (SELECT src, dst, count(*) AS n FROM hops WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
both_ AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
edges AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_),
flows AS (SELECT 0 AS k, host, kind, {1 - damping} * seed AS score FROM seeds
          UNION ALL SELECT k + 1, e.dst, e.kind, sum({damping} * f.score * e.share) FROM flows f JOIN edges e ON f.host = e.src AND f.kind = e.kind WHERE k < {rounds} GROUP BY k, e.dst, e.kind),
blocked AS (SELECT host FROM flows GROUP BY host
            HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > coalesce(sum(score) FILTER (kind = 'trust'), 0) * {1 + margin})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_
"""


ORACLE = _oracle()
