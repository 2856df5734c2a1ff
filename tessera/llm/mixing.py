"""Mixing sources to target weights by Poisson replication.

Every row draws its number of copies from a Poisson distribution whose mean is its
source's target repetition rate, by inverting the distribution at a uniform number
hashed from (seed, doc_id): the draw depends on nothing else, so a lost task draws the
same again. Rows are exploded by their count and shuffled globally by a hashed key.

Defined results for odd input: a null source is a source of its own; a null doc_id
hashes as the empty string; null texts are kept; repeated rows draw alike and share
shuffle keys; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.session import table

#: Exponent of the default target weights: a source of n rows gets weight n ** 0.5.
TEMPERATURE = 0.5
#: Poisson terms beyond mean + 12 * sqrt(mean) + 24 are below double precision.
TAIL_SIGMAS, TAIL_FLAT = 12, 24


def uniform(seed: int, *cols: str) -> Column:
    """52 hashed bits in [0, 1); md5 keeps it reproducible in other engines."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ... up to where the tail vanishes."""
    last = F.ceil(rate + TAIL_SIGMAS * F.sqrt(rate) + TAIL_FLAT).cast("int")
    logs = F.transform(F.sequence(F.lit(1), last), lambda k: F.ln(rate) - F.ln(k.cast("double")))
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, x):
        log = acc["log"] + x
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(logs, start, step)["all"]


def rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, temperature: float = TEMPERATURE, expected_rows: Column | None = None) -> DataFrame:
    """(source key, rate, cdf). ``weights`` (source, weight) overrides the tempered
    default; sources without a weight get rate 0. The expected number of copies is the
    number of input rows unless ``expected_rows`` says otherwise."""
    key = F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))
    counts = docs.groupBy(key.alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("source_key"), F.col("weight").cast("double"))
        counts = counts.join(given.groupBy("source_key").agg(F.sum("weight").alias("weight")), "source_key", "left").na.fill(0.0, ["weight"])
    total = counts.agg(F.sum("n").alias("rows"), F.sum("weight").alias("all_weight")).withColumn("k", F.lit(1))
    both = counts.withColumn("k", F.lit(1)).join(F.broadcast(total), "k")  # one row
    rate = (expected_rows if expected_rows is not None else F.col("rows")) * F.col("weight") / F.col("all_weight") / F.col("n")
    return both.select("source_key", rate.cast("double").alias("rate")).where("rate > 0").select("source_key", "rate", cumulative(F.col("rate")).alias("cdf"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``poisson_mix`` with the columns of ``docs`` alone, among them its own
    mix_copy and mix_key, if it has such."""
    inner = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    keys = docs.select(inner).select("own", F.col("own.doc_id").alias("doc_id"), F.col(f"own.`{how.get('source', 'source')}`").alias(how.get("source", "source")))
    return poisson_mix(keys, **how).select("own.*")


def poisson_mix(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, seed: int = 17, temperature: float = TEMPERATURE, expected_rows: Column | None = None, shuffle: bool = True) -> DataFrame:
    """All columns of ``docs`` plus mix_copy (from 0) and mix_key (the global order).
    Incoming columns of these two names are replaced (``mixed`` keeps them)."""
    spark = docs.sparkSession
    cdf = shared.stored(rates(docs, source, weights, temperature, expected_rows), "mix-rates")
    mine = ("mix_copy", "mix_key")
    # The row travels as one struct, so no column of it can clash with the names below.
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in mine)).alias("row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(source).cast("string"), F.lit("\u0000")).alias("source_key"),
    )
    # A source has about rate + 12 * sqrt(rate) + 24 terms; their bytes are counted before a broadcast.
    drawn = shared.with_small(keyed, cdf, "source_key", "inner", 20_000).select("row", "id", "cdf", uniform(seed, "id").alias("u"))
    drawn = drawn.select("row", "id", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("n")).where("n > 0")
    out = drawn.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("mix_copy"))
    text = F.concat_ws("|", F.lit(f"{seed}s"), "id", F.col("mix_copy").cast("string"))
    out = out.withColumn("mix_key", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))
    if shuffle:
        # Hashed keys are uniform, so equal key ranges hold equal shares.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartition(parts, "mix_key").sortWithinPartitions("mix_key", "id")
    return out.select("row.*", *mine)


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = poisson_mix(docs)
    return mixed.select(
        "doc_id", "source", F.col("mix_copy").alias("copy"), F.col("mix_key").alias("shuffle_key"), F.length("text").cast("long").alias("text_chars")
    )


ORACLE = f"""
WITH n AS (SELECT coalesce(source, chr(0)) AS k, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT k, n, pow(n, {TEMPERATURE}) AS w FROM n),
r AS (SELECT k, (SELECT sum(n) FROM n) * w / (SELECT sum(w) FROM w) / n AS rate FROM w),
t AS (SELECT k, rate, unnest(range(0, 1 + CAST(ceil(rate + {TAIL_SIGMAS} * sqrt(rate) + {TAIL_FLAT}) AS BIGINT))) AS x FROM r),
p AS (SELECT k, x, exp(x * ln(rate) - rate - lgamma(x + 1)) AS p FROM t),
c AS (SELECT k, x, sum(p) OVER (PARTITION BY k ORDER BY x) AS c FROM p),
l AS (SELECT k, list(c ORDER BY x) AS cdf FROM c GROUP BY k),
d AS (SELECT doc_id, source, text, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS n
      FROM documents JOIN l ON coalesce(source, chr(0)) = k),
e AS (SELECT doc_id, source, text, unnest(range(0, n)) AS copy FROM d)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, ('0x' || substr(md5('17s|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key, CAST(length(text) AS BIGINT) AS text_chars
FROM e
"""
