"""Sliding-window coherence of embedded tokens.

Trailing windows of W tokens are embedded as weighted means of their distinct tokens'
vectors; each valid window is compared with the mean of the other valid ones. The
vocabulary travels to the tokens by a join (one shuffle or a size-checked broadcast,
Spark's choice), so it may be large; windows are then built per transcript in Arrow
batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Coherence:
    window: int = 10
    least_tokens: int = 3
    weighting: str = "logfreq"
    aggregation: str = "mean"
    trim: float = 0.10
    entropy_alpha: float = 0.5
    normalize: bool = True

    def __post_init__(self):
        if self.weighting not in ("logfreq", "freq", "none"):
            raise ValueError(f"unknown weighting: {self.weighting}")
        if self.aggregation not in ("mean", "p10", "trimmed"):
            raise ValueError(f"unknown aggregation: {self.aggregation}")


def steady_entropy(vocab: DataFrame) -> DataFrame:
    """entropy as a sigmoid of its z score; all 1 if any value is missing or not finite
    or there is no spread."""
    x = F.col("entropy").cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    stats = vocab.agg(F.avg(F.when(~odd, x)).alias("m"), F.stddev_pop(F.when(~odd, x)).alias("sd"), F.max(odd.cast("int")).alias("odd"))
    flat = (F.col("odd") == 1) | (F.col("sd") < 1e-8) | F.col("sd").isNull()
    value = F.when(flat, 1.0).otherwise(1 / (1 + F.exp(-(x - F.col("m")) / (F.col("sd") + 1e-8))))
    one = F.broadcast(stats.withColumn("k", F.lit(1)))  # one row
    return vocab.withColumn("k", F.lit(1)).join(one, "k").withColumn("entropy", value).drop("k", "m", "sd", "odd")


#: Windows that are embedded together.
CHUNK = 512


def window_vectors(m: np.ndarray, factors: np.ndarray, ids: np.ndarray, how: Coherence) -> np.ndarray:
    """The vectors of all valid trailing windows, in order. Counts of a window's tokens are
    differences of running counts, for some windows and the tokens that they touch at a time."""
    out = [np.zeros((0, m.shape[1]))]
    for first in range(0, len(ids), CHUNK):
        begin = max(0, first - how.window + 1)
        seen, place = np.unique(ids[begin : first + CHUNK], return_inverse=True)
        running = np.zeros((len(place) + 1, len(seen)), np.int32)
        running[np.arange(1, len(place) + 1), place] = 1
        np.cumsum(running, axis=0, out=running)
        ends = np.arange(first, min(first + CHUNK, len(ids))) + 1 - begin
        counts = running[ends] - running[np.maximum(ends - how.window, 0)]
        counts, seen = counts[:, seen >= 0], seen[seen >= 0]
        base = np.log10(counts + 1.0) if how.weighting == "logfreq" else counts.astype(float) if how.weighting == "freq" else (counts > 0).astype(float)
        weight = base * factors[seen]
        total = weight.sum(axis=1)
        valid = (counts.sum(axis=1) >= how.least_tokens) & (total != 0)
        e = weight[valid] @ m[seen] / total[valid, None]
        out.append(e[np.linalg.norm(e, axis=1) > 0])
    return np.concatenate(out)


def score_tokens(vectors, factors: np.ndarray, ids: np.ndarray, how: Coherence) -> float:
    """One transcript: ids per token (-1: not in the vocabulary), vectors and entropy
    factors per id."""
    if not len(ids) or not len(vectors):
        return 0.0
    m = np.asarray(vectors, np.float64)
    if how.normalize:
        norm = np.linalg.norm(m, axis=1)
        m = m / np.where(norm == 0, 1, norm)[:, None]
    windows = window_vectors(m, np.asarray(factors, float), np.asarray(ids), how)
    if len(windows) < 2:
        return 0.0
    e = windows
    others = (e.sum(axis=0) - e) / (len(e) - 1)
    size = np.linalg.norm(e, axis=1) * np.linalg.norm(others, axis=1)
    cos = np.divide((e * others).sum(axis=1), size, out=np.zeros(len(e)), where=size > 0)
    if how.aggregation == "p10":
        return float(np.quantile(cos, 0.10))
    if how.aggregation == "mean" or not 0 < how.trim < 0.5 or len(cos) < 3:
        return float(cos.mean())
    lo, hi = np.quantile(cos, [how.trim, 1 - how.trim])
    # Both ends are inside, whatever the last digit of an interpolated end or of equal windows is.
    kept = cos[(cos >= lo - 1e-12) & (cos <= hi + 1e-12)]
    return float((kept if len(kept) else cos).mean())


def checked(vocab: DataFrame) -> DataFrame:
    """``vocab`` if its vectors have one length and no missing or infinite component, and no
    token or id is missing; an error otherwise."""
    broken = F.col("token").isNull() | F.col("id").isNull() | F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = vocab.agg(F.count_if(F.coalesce(broken, F.lit(True))).alias("broken"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if r.broken:
        raise ValueError(f"{r.broken} entries of the vocabulary have no token, id or finite vector")
    if r.least != r.most or r.least == 0:
        raise ValueError(f"vectors have {r.least} to {r.most} dimensions")
    return vocab


def without_stop_words(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Token rows that are not in the list (token)."""
    return tokens.join(stop.select("token"), "token", "left_anti").select(*tokens.columns)


def coherence(tokens: DataFrame, vocab: DataFrame, keys: list[str], how: Coherence = Coherence()) -> DataFrame:
    """(keys, gc) from (keys, pos, token) rows and vocab (token, id, vec, entropy).
    A token that stands twice in the vocabulary takes its largest id."""
    last = steady_entropy(vocab).groupBy("token").agg(F.max(F.struct("id", "vec", "entropy")).alias("x")).select("token", "x.*")
    factor = (1 - how.entropy_alpha) + how.entropy_alpha * F.least(F.greatest(F.col("entropy"), F.lit(0.0)), F.lit(1.0))
    met = tokens.join(last.select("token", "id", "vec", factor.alias("factor")), "token", "left")
    # One vector per distinct token of a transcript, ids per position.
    places = met.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(-1)).alias("id")))), lambda x: x["id"]).alias("ids"))
    words = met.where("id is not null").groupBy(*keys, "id").agg(F.first("vec").alias("vec"), F.first("factor").alias("factor"))
    words = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "vec", "factor"))).alias("words"))
    packed = places.join(words, keys, "left")

    @F.arrow_udf(T.DoubleType())
    def solve(ids: pa.Array, known: pa.Array, vecs: pa.Array, factors: pa.Array) -> pa.Array:
        out = []
        for i, k, v, f in zip(ids, known, vecs, factors):
            n = len(k) if k.is_valid else 0
            if not n:
                out.append(0.0)
                continue
            flat = lambda x: x.values.to_numpy(zero_copy_only=False)
            m = v.values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            have = flat(k)
            place = np.searchsorted(have, flat(i))
            place = np.where((place < n) & (have[np.minimum(place, n - 1)] == flat(i)), place, -1)
            out.append(score_tokens(m, flat(f), place, how))
        return pa.array(out, pa.float64())

    part = lambda name: F.transform("words", lambda x: x[name])
    return packed.select(*keys, solve("ids", part("id"), part("vec"), part("factor")).alias("gc"))
