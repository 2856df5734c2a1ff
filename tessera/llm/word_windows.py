"""Incremental removal of repeated 50-word windows: a log-structured fingerprint index.

Batches in ascending doc_id order are merge-joined with sorted immutable runs of the
fingerprints of earlier windows and then become runs themselves, which are compacted.
The runs hold one fingerprint per group of neighbouring windows (their anchor); hits
are verified with digests of all the words around an anchor or 128 bits of every window, so
the result is that of comparing every window. A word goes if a window over it also starts in a document with a smaller
doc_id; windows are judged on the input.

Defined results for odd input: null and empty texts have no words and stay; a null
doc_id counts as the smallest; repeated rows (one doc_id) never remove each other; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import repeats, shared, windows
from tessera.llm.runs import BY_DOCUMENT
from tessera.session import table

WIDTH, GRAM, BATCHES = 50, 25, 4


def _read(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = shared.utf8(col)
    begin, end, firsts = shared.word_bounds(raw, offs)
    # Two independent hashes of a word: windows that differ in one word differ in both.
    return np.stack([shared.word_hashes(raw, begin, end, salt=k) for k in (1, 2)], axis=1), firsts


def _fingerprints(symbols: np.ndarray, e: windows.Entries, width: int, gram: int) -> list[pa.Array]:
    """key, context: the anchor's hash, and a digest of the words that the windows cover."""
    data, digest = memoryview(symbols.view(np.uint8).reshape(-1)), hashlib.blake2b
    context = [digest(data[16 * a : 16 * b], digest_size=16).digest() for a, b in zip(e.start.tolist(), (e.start + e.count - 1 + width).tolist())]
    return [pa.array(e.gram.view(np.int64)), pa.array(context, pa.binary())]


def _whole(data: bytes) -> tuple[int, str]:
    found = data.split()
    return len(found), hashlib.sha256(b" ".join(found)).hexdigest()


def words(width: int = WIDTH, gram: int = GRAM) -> repeats.Symbols:
    return repeats.Symbols(width, gram, "key", "key long, context binary", _read, _fingerprints, _whole)


def word_spans(touched: DataFrame, again: DataFrame, how: repeats.Symbols) -> DataFrame:
    """Stored (doc, mark, a, b) word spans (may overlap) of the windows that also start in
    a document with a smaller doc_id."""
    contexts = shared.stored(again.groupBy("key", "context").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")), "word-contexts")
    judged = shared.stored(shared.with_groups(again, contexts, ["key", "context"]), "word-judged")
    whole = repeats.spans(judged.where("first < doc"), how.width)
    # Entries in the first document of their context may still repeat window by window.
    open_ = judged.where("first = doc").join(repeats.with_many_contexts(contexts), "key", "left_semi").select(*repeats.ROW, "start", "count", F.lit(True).alias("alone"))
    each = repeats.exploded_windows(touched, open_, how, "word")
    earliest = each.groupBy("window", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("window", "check", "first")
    single = each.join(earliest, ["window", "check"]).where("first < doc")
    found = shared.stored(whole.unionByName(repeats.window_spans(single, how.width)), "word-spans")
    shared.discard(contexts, judged, each)
    return found


def _cut(data: bytes, merged) -> tuple[int, int, str]:
    found = data.split()
    keep = found
    if merged is not None:
        ends = [0, *merged[1].tolist()]
        keep = [w for x, y in zip(ends, [*merged[0].tolist(), len(found)]) for w in found[x:y]]
    return len(found), len(found) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()


GONE = "n_words long, n_removed long, kept_sha256 string"


def _untouched() -> list[Column]:
    return [F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")]


def removed_words(docs: DataFrame, how: repeats.Symbols | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    how = how or words()
    rows = repeats.keyed(docs)
    entries, digests, _ = repeats.scanned(rows, how, "word")
    again = repeats.repeated_entries(entries, how, BY_DOCUMENT, F.col("lo") < F.col("hi"), batches, "word-runs")
    touched = repeats.touched_rows(rows, again, "word")
    found = word_spans(touched, again, how)
    shared.discard(again)
    return repeats.digested(docs, touched, digests, found, _cut, GONE, _untouched())


class WindowIndex:
    """Incremental removal: the runs of all batches so far stay, and every ``add`` gives the rows
    of its own documents, as one call over all of them would. New ids are above earlier ones."""

    def __init__(self, spark: SparkSession, how: repeats.Symbols | None = None, saved: str | None = None):
        self.history = repeats.History(spark, how or words(), BY_DOCUMENT, "word")
        if saved:
            self.history.restore(saved)

    def add(self, docs: DataFrame, batches: int = 1) -> DataFrame:
        earlier, how = self.history.part("rows"), self.history.how
        if earlier is not None:
            top, low = earlier.agg(F.max("doc")).first()[0], docs.agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.SMALLEST)))).first()[0]
            if top is not None and low is not None and low <= top:
                raise ValueError("new documents must have larger ids than those in the index")
        rows, digests, touched, again = self.history.add(docs, F.col("lo") < F.col("hi"), batches)
        found = word_spans(touched, again, how)
        own = touched.join(rows.select(*repeats.ROW).distinct(), repeats.ROW, "left_semi")
        return repeats.digested(docs, own, digests, found, _cut, GONE, _untouched())

    def save(self, folder: str) -> None:
        self.history.save(folder)


def passage_anchors(rows: DataFrame, how: repeats.Symbols, batches: int = BATCHES) -> DataFrame:
    """The stored entries of keyed rows whose anchor occurs again, for ``passages``."""
    entries, _, scan = repeats.scanned(rows, how, "passage", digests=False)
    again = repeats.repeated_entries(entries, how, BY_DOCUMENT, F.col("n") > 1, batches, "passage-runs")
    shared.discard(scan)
    return again


def passages(touched: DataFrame, again: DataFrame, how: repeats.Symbols) -> DataFrame:
    """Stored (doc, mark, a, b) word spans (may overlap) of the windows that stand in
    several documents, in all of these. Rows of one doc_id and text are one document."""
    place = F.struct("doc", "mark")
    contexts = again.groupBy("key", "context").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min(F.struct("doc", "mark", "start", "count")).alias("one"), F.count(F.lit(1)).alias("n"))
    contexts = shared.stored(contexts.select("key", "context", "one", "n", (F.col("first") == F.col("last")).alias("alone")), "passage-contexts")
    judged = shared.stored(shared.with_groups(again, contexts.select("key", "context", "alone", "n"), ["key", "context"]), "passage-judged")
    whole = repeats.spans(judged.where("not alone"), how.width)
    # All entries of a context in one document only; one entry stands for any other context.
    several = repeats.with_many_contexts(contexts)
    fields = ["doc", "mark", "start", "count", "alone"]
    open_ = judged.where("alone").select("key", *fields).unionByName(contexts.where("not alone").select("key", "one.*", "alone")).join(several, "key", "left_semi").select(*fields)
    each = repeats.exploded_windows(touched, open_, how, "passage")
    ends = each.groupBy("window", "check").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.bool_and("alone").alias("alone"))
    single = each.where("alone").join(ends.where("first < last or not alone").select("window", "check"), ["window", "check"], "left_semi")
    found = shared.stored(whole.unionByName(repeats.window_spans(single, how.width)), "passage-spans")
    shared.discard(contexts, judged, each)
    return found


def op6_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    return removed_words(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), x AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w
), s AS (
  SELECT doc_id, i, string_agg(x, ' ') OVER v AS s, count(*) OVER v AS n FROM x
  WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM s WHERE n = 50) WHERE f < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
