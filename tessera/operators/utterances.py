"""Utterances and word times: identifiers by change, concatenation in order, times filled
inside utterances, speakers found by time overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def number_utterances(df: DataFrame, group: list[str], order: str, by: list[str], out: str = "uttID") -> DataFrame:
    """A new number whenever one of ``by`` differs from the row before."""
    w = Window.partitionBy(*group).orderBy(order)
    changed = F.lit(False)
    for c in by:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    flagged = df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_changed", F.col("_first") | changed)
    return flagged.withColumn(out, F.sum(F.col("_changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first", "_changed")


def join_words(df: DataFrame, group: list[str], order: str, word: str, out: str = "full_text") -> DataFrame:
    """Words of a group joined in order; one row per group."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(packed, lambda x: x["w"]), " ").alias(out))


def last_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row per key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_long(df: DataFrame, column: str, more_than: int = 1) -> DataFrame:
    """Rows whose text is known and has more than so many blank-separated pieces."""
    return df.where(F.col(column).isNotNull() & (text.word_count(F.col(column)) > more_than))


def fill_times(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Missing s and e spread evenly between the utterance's first start and last end.
    Rows without an utterance are dropped, as grouping by it would."""
    w = Window.partitionBy(*group)
    ranked = w.orderBy(order)
    known = df.where(" and ".join(f"`{g}` is not null" for g in group))
    known = known.withColumns({
        "_i": F.row_number().over(ranked) - 1, "_n": F.count(F.lit(1)).over(w), "_a": F.min("s").over(w), "_b": F.max("e").over(w),
    })
    usable = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_b") > F.col("_a"))
    step = (F.col("_b") - F.col("_a")) / F.col("_n")
    s = F.when(usable, F.coalesce("s", F.col("_a") + step * F.col("_i"))).otherwise(F.col("s"))
    e = F.when(usable, F.coalesce("e", F.col("_a") + step * (F.col("_i") + 1))).otherwise(F.col("e"))
    return known.withColumn("_s", s).withColumn("e", e).withColumn("s", F.col("_s")).drop("_i", "_n", "_a", "_b", "_s")


def speaker_by_time(queries: DataFrame, refs: DataFrame, key: list[str]) -> DataFrame:
    """For each query interval (key, q, s, e) the speaker of the reference interval (key,
    pos, s, e, speaker) with the largest overlap, or else the nearest midpoint; the first
    of equals. Invalid intervals never match.

    Time is cut into slots as long as a transcript's mean reference interval (or its mean
    distance, if that is longer), so intervals reach into about three slots each. Intervals
    meet in the slots that both reach into, and a pair counts in the first of these. Queries
    without any overlap look for the nearest midpoint in their own slot, the last one of an
    earlier slot and the first of a later slot, found over one row per slot."""
    valid = F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("e") >= F.col("s"))
    k = F.struct(*key).alias("_k")
    r = refs.where(valid).select(k, F.col("pos").alias("_pos"), F.col("s").cast("double").alias("_s"), F.col("e").cast("double").alias("_e"), F.col("speaker").alias("_speaker"))
    span = F.max("_e") - F.min("_s")
    slots = r.groupBy("_k").agg(F.min("_s").alias("_t0"), F.coalesce(F.nullif(F.greatest(F.avg(F.col("_e") - F.col("_s")), span / F.count(F.lit(1))), F.lit(0.0)), F.lit(1.0)).alias("_w"), F.max("_e").alias("_t1"))
    slot = lambda x: F.floor((x - F.col("_t0")) / F.col("_w"))
    inside = lambda x: F.greatest(F.col("_t0"), F.least(F.col("_t1"), x))
    r = r.join(slots, "_k")
    asked = queries.where(valid).select(*key, "q", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e")).distinct().withColumn("_k", k).join(slots, "_k")
    q = asked.select("_k", "q", "s", "e", "_t0", "_w", "_t1")

    reach = lambda a, b: F.explode(F.sequence(slot(a), slot(b)))
    # Only slots between the first and the last reference are filled.
    near = q.where((F.col("e") >= F.col("_t0")) & (F.col("s") <= F.col("_t1")))
    near = near.select("_k", "q", "s", "e", slot(inside(F.col("s"))).alias("_first"), reach(inside(F.col("s")), inside(F.col("e"))).alias("_slot"))
    there = r.select("_k", "_pos", "_s", "_e", "_speaker", slot(F.col("_s")).alias("_from"), reach(F.col("_s"), F.col("_e")).alias("_slot"))
    met = near.join(there, ["_k", "_slot"]).where(F.col("_slot") == F.greatest("_first", "_from"))
    overlap = F.least("e", "_e") - F.greatest("s", "_s")
    best = met.where(overlap > 0).groupBy("_k", "q", "s", "e").agg(F.min(F.struct((-overlap).alias("o"), F.col("_pos").alias("p"), F.col("_speaker").alias("speaker")))["speaker"].alias("speaker_true"))

    alone = q.join(best.select("_k", "q", "s", "e"), ["_k", "q", "s", "e"], "left_anti").withColumn("_m", (F.col("s") + F.col("e")) / 2)
    alone = alone.select("_k", "q", "s", "e", "_m", slot(inside(F.col("_m"))).alias("_slot"))
    mids = r.withColumn("_rm", (F.col("_s") + F.col("_e")) / 2).select("_k", slot(F.col("_rm")).alias("_slot"), F.struct("_rm", "_pos", "_speaker").alias("x"))
    # The last of a slot is the first of those with the largest midpoint.
    ends = mids.groupBy("_k", "_slot").agg(F.min("x").alias("low"), F.max(F.struct(F.col("x._rm").alias("m"), (-F.col("x._pos")).alias("p"), F.col("x").alias("x")))["x"].alias("high"))
    every = ends.unionByName(alone.select("_k", "_slot").distinct().join(ends.select("_k", "_slot"), ["_k", "_slot"], "left_anti"), allowMissingColumns=True)
    order = Window.partitionBy("_k").orderBy("_slot")
    around = every.select(
        "_k", "_slot", F.last("high", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("low", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later")
    )
    own = alone.join(mids, ["_k", "_slot"]).select("_k", "q", "s", "e", "_m", "x")
    sides = alone.join(around, ["_k", "_slot"]).select("_k", "q", "s", "e", "_m", F.explode(F.array("earlier", "later")).alias("x")).where("x is not null")
    closest = own.unionByName(sides).groupBy("_k", "q", "s", "e").agg(F.min(F.struct(F.abs(F.col("_m") - F.col("x._rm")).alias("d"), F.col("x._pos").alias("p"), F.col("x._speaker").alias("speaker")))["speaker"].alias("speaker_true"))
    found = best.unionByName(closest).select("_k", "q", F.col("s").alias("_qs"), F.col("e").alias("_qe"), "speaker_true")
    same = (F.col("_k") == F.col("_fk")) & (F.col("q") == F.col("_fq")) & (F.col("s") == F.col("_qs")) & (F.col("e") == F.col("_qe"))
    out = queries.withColumn("_k", k).join(found.withColumnsRenamed({"_k": "_fk", "q": "_fq"}), same, "left")
    return out.drop("_k", "_fk", "_fq", "_qs", "_qe")
