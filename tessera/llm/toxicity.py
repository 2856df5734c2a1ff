"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters, reads digits and signs inside
words as the letters they stand for, and turns everything that is not a letter into
single blanks. Lexicon entries are whole words (`` idiot ``) or word beginnings
(`` lowei``); both start with a blank. Weights are log odds learned from labelled rows;
phrases around an entry that are as rare in toxic rows as in any are exceptions, and a
match inside one does not count. The summed weight is normalised by the length and
turned into a probability by a logistic curve fitted to the labelled rows.

Training uses at most ``most_labels`` labelled rows (those with the smallest hash of
doc_id), which also bounds what is broadcast; of several texts of one labelled doc_id the
smallest trains. The lexicon keeps the ``most_entries`` entries and ``most_exceptions``
phrases that tell most: the size of the model, not a cut of the rows. Scoring covers
every row.

Defined results for odd input: null and empty texts have no match and get the score of
such rows; null labels and doc_ids do not train; several labels of one doc_id count
as toxic if any is; where labels teach no lexicon (none, or of one kind only) all rows
get the smoothed base rate, at most 0.4; repeated rows score alike; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.session import table

#: Letters that look like Latin ones (Cyrillic, Greek), and the letters
#: that digits and signs stand for inside words.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝгтмнквαβεικνορτυχο", "aeopcyxijsdhlqwrtmhkbabeikvoptuxo"))
STANDS_FOR = dict(zip("013457@$!", "oieastasi"))
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {i: chr(i - 0xFF01 + 0x21).lower() for i in range(0xFF01, 0xFF5F)}
_FOLD |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_INSIDE = re.compile(r"[013457@$!]+(?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")
_STANDS = {ord(k): v for k, v in STANDS_FOR.items()}
_MARKED = re.compile(r"[013457@$!]")


def fold(text: str) -> str:
    """Folded text with a blank before and after every word."""
    t = unicodedata.normalize("NFC", text).lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    if _MARKED.search(t):
        t = _INSIDE.sub(lambda m: m[0].translate(_STANDS), t)
    return " " + _OTHER.sub(" ", t).strip() + " "


@dataclass(frozen=True)
class Training:
    most_labels: int = 50_000
    most_entries: int = 2_000
    most_exceptions: int = 1_000
    shortest_prefix: int = 4
    longest_prefix: int = 7
    #: Times an entry must occur in labelled rows; the likelihood-ratio limit grows with
    #: the number of entries tried.
    least_rows: int = 4
    #: An exception phrase occurs in at least so many clean rows.
    least_clean: int = 5
    folds: int = 5


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


class Matcher:
    """The automaton over the entries, and one over the exception phrases."""

    def __init__(self, model: Model):
        self.model = model
        self.entries, self.phrases = self._automaton(model.weights), self._automaton(dict.fromkeys(model.exceptions, 0.0))

    @staticmethod
    def _automaton(items: dict[str, float]):
        import ahocorasick

        if not items:
            return None
        a = ahocorasick.Automaton()
        for k, w in items.items():
            a.add_word(k, (len(k), w))
        a.make_automaton()
        return a

    def matches(self, folded: str) -> dict[int, float]:
        """Position of the blank before each matched word -> largest weight."""
        found: dict[int, float] = {}
        if self.entries is None:
            return found
        for end, (n, w) in self.entries.iter(folded):
            at = end - n + 1
            if w > found.get(at, 0.0):
                found[at] = w
        if found and self.phrases is not None:
            for end, (n, _) in self.phrases.iter(folded):
                for at in [x for x in found if end - n + 1 <= x < end]:
                    del found[at]
        return found

    def features(self, text: str) -> tuple[float, int, str, list[int]]:
        folded = fold(text)
        found = self.matches(folded)
        return sum(found.values()), max(folded.count(" ") - 1, 0), folded, list(found)

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = inputs(total, words)
        return 1 / (1 + np.exp(-(self.model.bias + x @ np.array(self.model.slopes))))


def inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Summed weight, and summed weight by the root of the length; both damped."""
    return np.stack([np.log1p(total), np.log1p(10 * total / np.sqrt(np.maximum(words, 1)))], axis=1)


_matchers: dict[str, Matcher] = {}


def matcher(model: Model) -> Matcher:
    k = model.key()
    if k not in _matchers:
        _matchers.clear()
        _matchers[k] = Matcher(model)
    return _matchers[k]


def fold_of(col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, how: Training) -> DataFrame:
    """text, toxic of the bounded labelled sample outside fold 0."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(fold_of("id", how.folds) != 0)
        .orderBy(F.xxhash64("id"), "id")
        .limit(how.most_labels)
    )
    rows = docs.select(F.col("doc_id").alias("id"), shared.whole_text().alias("text"))
    # most_labels rows at most are broadcast, and come back: one text of each id.
    return rows.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _entry_counts(rows: DataFrame, how: Training) -> DataFrame:
    def count(batches):
        n, bad = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(fold(text).split())
                got = {f" {w} " for w in words}
                for k in range(how.shortest_prefix, how.longest_prefix + 1):
                    got.update(" " + w[:k] for w in words if len(w) > k)
                n.update(got)
                if toxic:
                    bad.update(got)
            if len(n) > 400_000:
                yield _pairs(n, bad)
                n, bad = Counter(), Counter()
        yield _pairs(n, bad)

    return rows.mapInArrow(count, "entry string, n long, bad long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _pairs(n: Counter, bad: Counter) -> pa.RecordBatch:
    keys = list(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], ["entry", "n", "bad"]
    )


def _ratio(t: Column, n: Column, p: float) -> Column:
    """Twice the log likelihood ratio of t of n against the rate p, for t/n over p."""
    a = F.when(t > 0, t * F.ln(t / (n * p))).otherwise(0.0)
    b = F.when(n > t, (n - t) * F.ln((n - t) / (n * (1 - p)))).otherwise(0.0)
    return F.when(t > n * p, 2 * (a + b)).otherwise(0.0)


def learn(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Three passes over the labelled sample; only bounded tables reach the driver."""
    rows = shared.stored(training_rows(docs, labels, how), "toxic-rows")
    size, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # Without a lexicon nothing tells rows apart, and none is called toxic.
    base = min((bad + 0.5) / (size + 1.0), 0.4)
    model = Model(bias=float(np.log(base / (1 - base))))
    if not bad or bad == size:
        return model
    counts = shared.stored(_entry_counts(rows, how).where(F.col("n") >= how.least_rows), "toxic-entries")
    limit = 2 * float(np.log(20 * max(counts.count(), 1)))
    ratio = _ratio(F.col("bad").cast("double"), F.col("n").cast("double"), bad / size)
    chosen = counts.withColumn("g", ratio).where(F.col("g") > limit).orderBy(F.desc("g"), "entry").limit(how.most_entries).collect()
    for r in chosen:
        odds = np.log((r.bad + 0.5) / (bad + 1)) - np.log((r.n - r.bad + 0.5) / (size - bad + 1))
        model.weights[r.entry] = round(float(odds), 6)
    if not model.weights:
        return model
    first = model

    def phrases(batches):
        m = Matcher(first)
        n, bad_n = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                _, _, folded, at = m.features(text)
                got = set()
                for x in at:
                    end = folded.index(" ", x + 1)
                    before, after = folded.rfind(" ", 0, x), folded.find(" ", end + 1)
                    if before >= 0:
                        got.add(folded[before : end + 1])
                    if after > 0:
                        got.add(folded[x : after + 1])
                n.update(got)
                if toxic:
                    bad_n.update(got)
        yield _pairs(n, bad_n)

    seen = rows.mapInArrow(phrases, "entry string, n long, bad long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    exempt = seen.where((F.col("n") - F.col("bad") >= how.least_clean) & (F.col("bad") <= F.col("n") * (bad / size)))
    model.exceptions = sorted(r.entry for r in exempt.orderBy(F.desc("n"), "entry").limit(how.most_exceptions).collect())
    final = model

    def measure(batches):
        m = Matcher(final)
        for batch in batches:
            got = [m.features(t)[:2] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column("toxic")], ["total", "words", "toxic"])

    # Bounded by most_labels rows of three numbers.
    points = rows.mapInArrow(measure, "total double, words long, toxic int").toPandas().sort_values(["total", "words", "toxic"])
    model.bias, model.slopes = _logistic(inputs(points.total.to_numpy(), points.words.to_numpy()), points.toxic.to_numpy())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, tuple[float, float]]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), tuple(float(v) for v in w[1:])


def scored(text: str, model: Model) -> Column:
    """A struct (score, n_matches) of a text column. Only the texts go to Python; the
    rows they belong to stay in the JVM."""

    @F.pandas_udf("score double, n_matches long")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = matcher(model)
        for texts in batches:
            total, words, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                total[i], words[i], _, found = m.features(t)
                n[i] = len(found)
            yield pd.DataFrame({"score": m.score(total, words), "n_matches": n})

    return work(text)


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """(row, score, n_matches); row is a struct of the given columns (doc_id by default),
    so that none of them can clash."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns or ["doc_id"])).alias("row"), shared.whole_text().alias("text"))
    return rows.select("row", scored("text", model).alias("found")).select("row", "found.score", "found.n_matches")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the limit."""
    return score(docs, model, docs.columns).where(F.col("score") < limit).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    how = Training()
    model = learn(docs, table(spark, sf_dir, "labels"), how)
    return score(docs, model).select("row.doc_id", "score").select(
        "doc_id", (fold_of("doc_id", how.folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
