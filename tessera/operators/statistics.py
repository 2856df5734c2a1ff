"""Grouped statistics: correlations with levels and roll-up, agreement, stability, rank
sums, trimmed means, box statistics.

Everything that needs order inside a group (ranks, quantiles, trimmed means, rank sums)
rests on ``positions``: equal values are counted first, the distinct ones are range
partitioned over the cluster, and prefix sums over partitions give how many rows stand
before each. A group may hold most of the rows; no task or buffer ever holds a group."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import safe_corr
from tessera.session import stored


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def pearson_p(r: float | None, n: int | None) -> float | None:
    """Two-sided p of a Pearson r from n pairs."""
    if r is None or n is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_inc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def normal_two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


@F.pandas_udf(T.DoubleType())
def pearson_p_of(r, n):
    """Vector form for summary tables."""
    import pandas as pd

    return pd.Series([pearson_p(None if a != a else a, b) for a, b in zip(r.astype(float), n)], dtype="float64")


def correlate_by(df: DataFrame, group: str, target: str, columns: list[str], absolute: bool = True, include_all: bool = False, least: int = 2) -> DataFrame:
    """r of every column with the target per group, over rows where all are known."""
    full = df.select(group, target, *columns).na.drop(subset=[target, *columns])
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        r = safe_corr(F.col(c), F.col(target))
        aggs.append((F.abs(r) if absolute else r).alias(c))
    grouped = full.rollup(group) if include_all else full.groupBy(group)
    out = grouped.agg(*aggs).where(F.col("n") >= least)
    return out.withColumn(group, F.coalesce(group, F.lit("ALL"))) if include_all else out


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per key and column."""
    return df.unpivot(keys, columns, name, value)


def positions(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, n, before, total, sums) for every distinct known value of a group: its
    rows, the rows of smaller values, and all rows of the group. ``sums`` are further
    aggregates of the value's rows. Null keys are a group."""
    return positions_of(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *((c.alias(k)) for k, c in (sums or {}).items())), keys, value)


def positions_of(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As ``positions``, from (keys, value, n) with one row per value of a group."""
    key = F.struct(*keys).alias("_key") if keys else F.lit(0).alias("_key")
    ordered = counted.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    placed = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "positions").withColumn("_part", F.shiftright("_at", 33)).withColumn("_key", key)
    # One row for each partition that a group reaches into.
    group = Window.partitionBy("_key")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_key", "_part").agg(F.sum("n").alias("_in"))
    parts = parts.select("_key", "_part", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_base"), F.sum("_in").over(group).alias("total"))
    inside = Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    out = placed.join(parts, ["_key", "_part"]).withColumn("before", F.col("_base") + F.col("_within"))
    return out.select(*counted.columns, "before", "total")


#: Mean rank of a value's rows, by its position.
MEAN_RANK = "before + (n + 1) / 2.0"


def with_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the rank of ``value`` in its group, ties sharing their mean rank."""
    own = F.struct(*keys, value)
    ranks = positions(df, keys, value).select(own.alias("_own"), F.expr(MEAN_RANK).alias(out))
    return df.withColumn("_own", own).join(ranks, "_own", "left").drop("_own")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the number (from 1) of each row in its group by ``order``; equal rows are
    numbered as they come. Without keys the whole frame is numbered, over all tasks."""
    own = positions_of(df.withColumns({"n": F.lit(1), "_order": F.struct(*order)}), keys, "_order")
    return own.withColumn(out, F.col("before") + 1).select(*df.columns, out)


def quantiles_of(placed: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, q, n): exact quantiles with linear interpolation, as an array, of ``positions``."""
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    covers = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value).cast("double")))
    ends = [x for k in at for x in (covers(F.floor(k)), covers(F.ceil(k)), F.max(k - F.floor(k)))]
    names = [f"_{i}" for i in range(len(ends))]
    found = placed.groupBy(*keys).agg(*(e.alias(c) for e, c in zip(ends, names)), F.max("total").alias("n"))
    low, high, part = names[::3], names[1::3], names[2::3]
    return found.select(*keys, F.array(*(F.col(a) + (F.col(b) - F.col(a)) * F.col(c) for a, b, c in zip(low, high, part))).alias("q"), "n")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    return quantiles_of(positions(df, keys, value), keys, value, probs)


def rank_trimmed_of(placed: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, trimmed) without the int(share * n) lowest and highest rows of ``positions``."""
    cut = F.floor(F.col("total") * share)
    kept = F.greatest(F.lit(0), F.least(F.col("before") + F.col("n"), F.col("total") - cut) - F.greatest("before", cut))
    return placed.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * kept), F.sum(kept)).alias("trimmed"))


def pairs_with_manual(df: DataFrame, source: str, unit: str, value: str, manual: str) -> DataFrame:
    """(source, unit, a, b): manual and automatic value of every unit known to both."""
    mean = df.groupBy(source, unit).agg(F.avg(value).alias("v"))
    hand = mean.where(F.col(source) == manual).select(unit, F.col("v").alias("a"))
    return mean.where(F.col(source) != manual).join(hand, unit).select(source, unit, "a", F.col("v").alias("b")).na.drop()


def agreement(df: DataFrame, source: str, unit: str, value: str, manual: str) -> DataFrame:
    """Pearson, Spearman and mean absolute difference of z scores per source."""
    p = stored(pairs_with_manual(df, source, unit, value, manual), "agreement")
    means = p.groupBy(source).agg(*(f(c).alias(f"_{k}{c}") for c in "ab" for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    p = with_ranks(with_ranks(p, [source], "a", "ra"), [source], "b", "rb")
    p = p.withColumn("_of", F.struct(source)).join(means.select(F.struct(source).alias("_of"), *(f"_{k}{c}" for c in "ab" for k in "ms")), "_of")
    z = lambda c: (F.col(c) - F.col(f"_m{c}")) / F.nullif(F.col(f"_s{c}"), F.lit(0.0))
    return p.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col("a"), F.col("b")).alias("pearson_r"), safe_corr(F.col("ra"), F.col("rb")).alias("spearman_rho"),
        F.avg(F.abs(z("a") - z("b"))).alias("mad_z"),
    ).where("n >= 3")


def stability(df: DataFrame, source: str, unit: str, value: str, manual: str, mode: int = 0) -> DataFrame:
    """Mean relative (mode 0) or absolute difference from manual: by source, then over
    sources."""
    p = pairs_with_manual(df, source, unit, value, manual)
    gap = F.abs(F.col("a") - F.col("b"))
    if mode == 0:
        gap = F.try_divide(gap, (F.abs("a") + F.abs("b")) / 2)
    return p.withColumn("d", gap).groupBy(source).agg(F.avg("d").alias("d")).agg(F.avg("d").alias("stability"))


def trimmed_by_rank(df: DataFrame, group: str, value: str, share: float = 0.10) -> DataFrame:
    """Mean without the int(share * n) lowest and highest."""
    return rank_trimmed_of(positions(df.select(group, value).na.drop(), [group], value), [group], value, share)


def trimmed_by_quantile(df: DataFrame, group: str, value: str, share: float = 0.10) -> DataFrame:
    """Mean of values between the two quantiles, both included; the plain mean for fewer
    than three values. The distinct values with their numbers are enough."""
    placed = positions(df.select(group, value), [group], value)
    q = quantiles_of(placed, [group], value, [share, 1 - share]).select(F.struct(group).alias("_of"), "q")
    met = placed.withColumn("_of", F.struct(group)).join(q, "_of")
    inside = (F.col("total") < 3) | ((F.col(value) >= F.col("q")[0]) & (F.col(value) <= F.col("q")[1]))
    weight = F.when(inside, F.col("n")).otherwise(0)
    return met.groupBy(group).agg(F.try_divide(F.sum(F.col(value) * weight), F.sum(weight)).alias("trimmed"))


def rank_sum(df: DataFrame, group: str, flag: str, value: str) -> DataFrame:
    """Mann-Whitney U of flag = 1 against flag = 0 per group, and the AUC."""
    rows = df.select(group, flag, value).na.drop()
    placed = positions(rows, [group], value, {"ones": F.count_if(F.col(flag) == 1), "zeros": F.count_if(F.col(flag) == 0)})
    sums = placed.groupBy(group).agg(
        F.sum(F.when(F.col("ones") > 0, F.col("ones") * F.expr(MEAN_RANK))).alias("r1"), F.sum("ones").alias("n1"), F.sum("zeros").alias("n0")
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.withColumn("u", u).withColumn("auc", F.try_divide(F.col("u"), F.col("n1") * F.col("n0")))


def u_ways(n1: int, n0: int) -> list[int]:
    """In how many ways each U = 0 .. n1 * n0 comes about without ties: the product of
    (1 - q^(n0 + i)) / (1 - q^i) over i = 1 .. n1, one running difference and one running
    sum over the coefficients for each i."""
    few, many = min(n1, n0), max(n1, n0)
    size = few * many + 1
    ways = np.array([1] + [0] * (size - 1), object)
    for i in range(1, few + 1):
        ways[many + i :] = ways[many + i :] - ways[: max(size - many - i, 0)]
        for start in range(min(i, size)):
            ways[start::i] = np.cumsum(ways[start::i])
    return ways.tolist()


def mann_whitney_p(u: float, n1: int, n0: int, tie_term: float = 0.0) -> float:
    """Two-sided p: exact without ties when the smaller group has at most 8, otherwise
    normal with tie and continuity correction. ``tie_term`` is the sum of t^3 - t."""
    if min(n1, n0) == 0:
        return float("nan")
    top = max(u, n1 * n0 - u)
    if min(n1, n0) <= 8 and tie_term == 0:
        ways = u_ways(n1, n0)
        return min(1.0, 2 * sum(ways[int(round(top)) :]) / sum(ways))
    n = n1 + n0
    sd = sqrt(n1 * n0 / 12 * ((n + 1) - tie_term / (n * (n - 1))))
    # The correction may turn the sign of a U next to its mean; such a p is 1.
    return min(1.0, erfc((top - n1 * n0 / 2 - 0.5) / sd / sqrt(2))) if sd else 1.0


def box_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and p1/p99."""
    placed = positions(df, group, value)
    q = quantiles_of(placed, group, value, [0.01, 0.25, 0.5, 0.75, 0.99])
    q = q.select(*group, *(F.col("q")[i].alias(n) for i, n in enumerate(("p1", "q1", "median", "q3", "p99"))))
    met = placed.select(*group, F.col(value).alias("_v")).join(q, group)
    iqr = F.col("q3") - F.col("q1")
    ends = met.groupBy(*group).agg(
        F.min(F.when(F.col("_v") >= F.col("q1") - 1.5 * iqr, F.col("_v"))).alias("low"), F.max(F.when(F.col("_v") <= F.col("q3") + 1.5 * iqr, F.col("_v"))).alias("high")
    )
    return q.join(ends, group)


def tie_terms(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, tie_term): the sum of t^3 - t over values that t rows share."""
    t = df.select(group, value).na.drop().groupBy(group, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    return t.groupBy(group).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie_term"))


@F.pandas_udf(T.DoubleType())
def mann_whitney_p_of(u, n1, n0, tie_term):
    """Vector form for summary tables."""
    import pandas as pd

    return pd.Series([mann_whitney_p(float(a), int(b), int(c), float(d)) for a, b, c, d in zip(u, n1, n0, tie_term)], dtype="float64")


def group_cells(df: DataFrame, group: str, flag: str, value: str) -> DataFrame:
    """Per group: mean and deviation in percent of flag = 0 and flag = 1 as text cells,
    their difference, U, the sizes and the tie term."""
    of = lambda k: 100 * F.when(F.col(flag) == k, F.col(value))
    cell = lambda k: F.format_string("%.1f $\\pm$ %.1f", F.avg(of(k)), F.stddev_samp(of(k)))
    cells = df.groupBy(group).agg(cell(0).alias("cn_cell"), cell(1).alias("ad_cell"), (F.avg(of(1)) - F.avg(of(0))).alias("delta"))
    return cells.join(rank_sum(df, group, flag, value).select(group, "u", "n1", "n0"), group).join(tie_terms(df, group, value), group)


def classification_metrics(df: DataFrame, by: list[str], y: str, proba: str) -> DataFrame:
    """Accuracy, F1 of the positive class (predicted at 0.5 or more) and AUC per group;
    F1 is 0 without a true positive, AUC null with one class only."""
    rows = df.select(*by, F.col(y).alias("_y"), F.col(proba).alias("_p")).na.drop()
    placed = positions(rows, by, "_p", {"ones": F.count_if(F.col("_y") == 1)})
    hit, ones = F.col("_p") >= 0.5, F.col("ones")
    zeros = F.col("n") - ones
    total = lambda x, test=F.lit(True): F.sum(F.when(test, x).otherwise(0)).cast("double")
    yes, no = total(ones), total(zeros)
    u = F.sum(ones * F.expr(MEAN_RANK)) - yes * (yes + 1) / 2
    return placed.groupBy(*by).agg(
        F.sum("n").alias("n"), (total(F.when(hit, ones).otherwise(zeros)) / total(F.col("n"))).alias("acc"),
        F.coalesce(F.try_divide(2 * total(ones, hit), yes + total(F.col("n"), hit)), F.lit(0.0)).alias("f1"), F.try_divide(u, yes * no).alias("auc"),
    )


def fold_spread(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, sd) over the rows (folds) of a table of metrics; sd with ddof 0."""
    return long_form(metrics, [], columns).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def regression_metrics_by(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """As ``regression_metrics``, per group."""
    e = F.col(y) - F.col(pred)
    return df.select(*by, y, pred).na.drop().groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), safe_corr(F.col(y), F.col(pred)).alias("r")
    )


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    e = F.col(y) - F.col(pred)
    r2 = 1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))
    return df.select(y, pred).na.drop().agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), safe_corr(F.col(y), F.col(pred)).alias("r")
    )


