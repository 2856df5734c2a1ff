"""N-gram language models by condition and perplexity differences.

Leave-one-out models are not rebuilt per transcript: a transcript's own counts are
subtracted from those of its condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.session import stored


def ngram_rows(tokens: DataFrame, keys: list[str], column: str = "tokens", n: int = 3) -> DataFrame:
    """(keys, ctx, nxt), one row per padded n-gram; ctx is its first n - 1 tokens."""
    # The padded array gets a projection of its own, so that it is built once per row.
    padded = tokens.select(*keys, text.pad(F.col(column), n).alias("padded"))
    grams = padded.select(*keys, F.explode(text.ngrams(F.col("padded"), n)).alias("g"))
    return grams.select(*keys, F.array_join(F.slice("g", 1, n - 1), " ").alias("ctx"), F.element_at("g", n).alias("nxt"))


def counts(grams: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """n-gram counts and context totals per group."""
    full = grams.groupBy(*by, "ctx", "nxt").agg(F.count(F.lit(1)).alias("cnt"))
    return full, full.groupBy(*by, "ctx").agg(F.sum("cnt").alias("total"))


def log_probability(cnt: Column, total: Column, vocabulary: int, alpha: float = 10.0, smoothing: bool = True) -> Column:
    """ln p; without smoothing an unseen n-gram counts as certain (0)."""
    if smoothing:
        return F.ln((cnt + alpha) / (total + vocabulary * alpha))
    return F.when((cnt == 0) | (total == 0), 0.0).otherwise(F.ln(cnt.cast("double") / F.nullif(total, F.lit(0))))


#: A context with over one in so many n-grams is frequent; how many contexts are watched for it.
FREQUENT, WATCHED = 1000, 10_000


def frequent_contexts(grams: DataFrame, by: list[str]) -> list[int]:
    """Hashes of the contexts that hold over a thousandth of all n-grams (fewer than a thousand
    contexts). They only say how n-grams are counted, so estimates do."""
    code = F.xxhash64(*by, "ctx").alias("h")
    top = F.expr(f"approx_top_k(h, {FREQUENT}, {WATCHED})").alias("top")
    found = grams.select(code).agg(F.count(F.lit(1)).alias("n"), top).first()
    return [x["item"] for x in found["top"] or () if x["count"] * FREQUENT > found["n"]]


def _gathered(grams: DataFrame, unit: list[str], within: list[str], names: dict[str, str]) -> DataFrame:
    """own, own_total, cnt_x and total_x of every (unit, ctx, nxt); n-grams are shuffled once, by
    their context, and counted where they are."""
    placed = grams.repartition(*within, "ctx")
    own = placed.groupBy(*unit, "dx", "ctx", "nxt").agg(F.count(F.lit(1)).alias("own"))
    over = lambda c, *by: F.sum(c).over(Window.partitionBy(*within, "ctx", *by))
    met = own.withColumn("own_total", over("own", *(u for u in unit if u not in within)))
    side = {k: F.when(F.col("dx") == dx, F.col("own")).otherwise(0) for k, dx in names.items()}
    met = met.withColumns({f"cnt_{k}": over(c, "nxt") for k, c in side.items()})
    return met.withColumns({f"total_{k}": over(c) for k, c in side.items()})


def _joined(grams: DataFrame, unit: list[str], within: list[str], names: dict[str, str]) -> DataFrame:
    """The same for frequent contexts, of which no task gets a whole one: counts are added up
    in parts and joined back."""
    own = stored(grams.groupBy(*unit, "dx", "ctx", "nxt").agg(F.count(F.lit(1)).alias("own")), "ngram-counts")
    # Both conditions' counts side by side: one aggregation, one join each for n-grams and
    # contexts.
    pooled = lambda k: F.sum(F.when(F.col("dx") == names[k], F.col("own")).otherwise(0))
    model = own.groupBy(*within, "ctx", "nxt").agg(pooled("a").alias("cnt_a"), pooled("b").alias("cnt_b"))
    totals = model.groupBy(*within, "ctx").agg(F.sum("cnt_a").alias("total_a"), F.sum("cnt_b").alias("total_b"))
    # Totals meet the distinct n-grams, so the counts of transcripts are joined once.
    met = own.join(model.join(F.broadcast(totals), [*within, "ctx"]), [*within, "ctx", "nxt"])
    return met.join(own.groupBy(*unit, "ctx").agg(F.sum("own").alias("own_total")), [*unit, "ctx"])


def perplexity(grams: DataFrame, unit: list[str], meta: DataFrame | None, conditions: tuple[str, str], vocabulary: int, alpha: float = 10.0, leave_one_out: bool = False, within: list[str] | None = None) -> DataFrame:
    """(unit, ppl of each condition, P_diff = second - first) for (unit, ctx, nxt) rows.
    ``meta`` has (unit's last key, dx), or is None where the rows have dx themselves, which saves
    a join of all n-grams; ``within`` are keys of the unit that models are kept apart by
    (sources)."""
    within = within or []
    names = dict(zip(("a", "b"), conditions))
    rows = grams if meta is None else grams.join(meta, unit[-1], "left")
    rows = rows.select(*unit, "dx", "ctx", "nxt")
    hot = frequent_contexts(rows, within)
    is_hot = F.xxhash64(*within, "ctx").isin(*hot)
    scores = []
    for k, dx in names.items():
        cnt, total = F.col(f"cnt_{k}"), F.col(f"total_{k}")
        if leave_one_out:
            same = F.col("dx").eqNullSafe(F.lit(dx)).cast("long")
            cnt, total = cnt - same * F.col("own"), total - same * F.col("own_total")
        scores.append((log_probability(cnt, total, vocabulary, alpha) * F.col("own")).alias(f"ln_{k}"))
    met = _gathered(rows.where(~is_hot) if hot else rows, unit, within, names).select(*unit, "own", *scores)
    if hot:
        met = met.unionByName(_joined(rows.where(is_hot), unit, within, names).select(*unit, "own", *scores))
    ppl = [F.exp(-F.sum(f"ln_{k}") / F.sum("own")).alias(f"ppl_{k}") for k in names]
    return met.groupBy(*unit).agg(*ppl).withColumn("P_diff", F.col("ppl_b") - F.col("ppl_a"))


def seen_contexts(grams: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """How many n-grams have a context that the model knows."""
    met = grams.join(totals.select("ctx", "total"), "ctx", "left")
    return met.groupBy(*by).agg(F.count_if(F.coalesce("total", F.lit(0)) > 0).alias("seen"), F.count_if(F.coalesce("total", F.lit(0)) == 0).alias("unseen"))


def size_log(grams: DataFrame, unit: str) -> DataFrame:
    """One row: how many units have n-grams, and the sum, least, most and mean of their
    numbers."""
    n = grams.groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("ngrams"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
