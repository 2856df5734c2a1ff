"""Quality rules judged per document and per host (native expressions only).

Method: document rules -> failures counted per host -> host failure rates shrunk with
an empirical beta prior -> hosts whose shrunk rate is over a threshold are rejected ->
verdicts joined back to the documents.

Defined results for odd input: a null text is an empty one (no words, base_failed);
a null host is no host, so such documents are judged by their own rules alone;
repeated rows are judged (and counted) as often as they occur; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.session import table

#: White space of words, and the characters counted as symbols.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host is rejected when its shrunk failure rate reaches this.
    max_host_rate: float = 0.75
    #: Weight (in documents) given to the prior when host rates have no spread or the
    #: moments give no usable beta distribution.
    fallback_strength: float = 10.0


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window occurring at least twice in the text."""
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    keyed = F.transform(
        at,
        lambda i: F.struct(
            F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"),
            i.alias("i"),
        ),
    )
    return F.array_sort(keyed)


def _repeated_positions(ranked: Column, count: Column) -> Column:
    """Window starts whose key equals that of a neighbour in key order."""
    none = F.array().cast("array<int>")
    pairs = F.zip_with(
        F.slice(ranked, 1, F.greatest(count - 1, F.lit(0))),
        F.slice(ranked, 2, F.greatest(count - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none),
    )
    return F.when(count >= 2, F.flatten(pairs)).otherwise(none)


def features(docs: DataFrame, host: str, rules: HostRules = HostRules()) -> DataFrame:
    """doc_id, host and the document-level counts; no shuffle."""
    text = shared.whole_text()
    # Each projection holds one array that the next one uses more than once.
    step = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), text.alias("t"))
    step = step.select(
        "doc_id", "host", "t",
        F.filter(F.split("t", shared.SPACE_CLASS), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
    )
    step = step.select(
        "doc_id", "host", "w", F.size("w").alias("n"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    kept = ["doc_id", "host", "n", "word_chars", "n_symbols", "n_dup_lines"]
    step = step.select(*kept, _repeat_words(F.col("w"), F.col("n")).alias("ranked"))
    step = step.select(*kept, _repeated_positions(F.col("ranked"), F.greatest(F.col("n") - 2, F.lit(0))).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(i, i + 1, i + 2)))))
    step = step.select(
        "doc_id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size("hits") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """host, n_docs, n_failed, rate, host_rejected from (host, base_failed) rows.

    The beta prior comes from the moments of the host rates: mean m and variance v give
    the strength m(1-m)/v - 1. One row holds it, joined by a constant key."""
    per_host = (
        judged.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    moments = per_host.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)
    prior = moments.select(
        F.lit(1).alias("k"), F.col("m"), F.coalesce(strength, F.lit(rules.fallback_strength)).alias("strength")
    )
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return (
        per_host.withColumn("k", F.lit(1))
        .join(F.broadcast(prior), "k")  # one row whatever the input
        .select("host", "n_docs", "n_failed", shrunk.alias("rate"))
        .withColumn("host_rejected", F.col("rate") >= rules.max_host_rate)
    )


def judge(docs: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """Counts and verdicts for every document. The slim counts are written once, so the
    texts are read once."""
    counts = shared.stored(features(docs, host, rules), "host-rules")
    hosts = shared.stored(host_verdicts(counts, rules).select("host", "host_rejected"), "host-verdicts")
    out = shared.with_small(counts, hosts, "host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), pos AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM pos
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), j AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
), h AS (
  SELECT host, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS k FROM j WHERE host IS NOT NULL GROUP BY host
), m AS (
  SELECT avg(CAST(k AS DOUBLE) / n) AS m, var_pop(CAST(k AS DOUBLE) / n) AS v FROM h
), p AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 10.0 END AS s FROM m
), bad AS (
  SELECT host FROM h, p WHERE (k + m * s) / (n + s) >= 0.75
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND host NOT IN (SELECT host FROM bad)) IS NOT FALSE AND NOT base_failed AS kept
FROM j
"""
