"""Byte-exact removal of repeated 400-byte strings: a logarithmic family of suffix
arrays.

Each batch of documents gets a sparse suffix array: its suffixes that start at
content-defined anchors, in the order of their leading 96 bytes (``head``); suffixes with
equal heads are one entry of the index with their number, and their positions are kept
beside it. An anchor lies in every 400-byte string, at a place that only the string's
bytes decide, so a string that stands twice has an anchor whose suffixes share their
heads. A new batch is merge-scanned in suffix order against the levels for matches of
that length and becomes a level itself; levels of equal size merge. The arrays are
partitioned: buckets by a hash of the head, in byte order inside each.

Matching suffixes are then extended in both directions to the exact byte. The surroundings
of an anchor (all strings that have it) are compared as a whole by a 128-bit digest;
where they differ between the suffixes of one head, blocks of 16 neighbouring strings are
compared by what they share and what they cover, and where only the former is equal each
string, by 128 bits of two hashes. All are counted over the cluster, so a head that very
many texts share is nobody's single task. A string is removed wherever it stands if it starts
at two places or more; strings are judged on the input.

Defined results for odd input: null and empty texts have no bytes; repeated rows are
each other's matches; null doc_ids are rows like any other; an empty table gives an
empty result; further columns are ignored. Texts of any length are read in segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import repeats, shared, windows, word_windows
from tessera.llm.runs import BY_NUMBER
from tessera.session import table

#: Bytes of a repeated string, leading bytes of a suffix that order it, batches, strings
#: that are compared together before each is.
WIDTH, HEAD, BATCHES, BLOCK = 400, 96, 8, 16


def _suffixes(raw: np.ndarray, e: windows.Entries, width: int, gram: int) -> list[pa.Array]:
    """head, key, context: the suffix's leading bytes, a hash of them, and a digest of
    the bytes that the windows cover."""
    m = len(e.row)
    heads = np.lib.stride_tricks.sliding_window_view(raw, gram)[e.anchor] if m else np.zeros((0, gram), np.uint8)
    head = pa.FixedSizeBinaryArray.from_buffers(pa.binary(gram), m, [None, pa.py_buffer(np.ascontiguousarray(heads))]).cast(pa.binary())
    data, digest = memoryview(raw), hashlib.blake2b
    context = [digest(data[a:b], digest_size=16).digest() for a, b in zip(e.start.tolist(), (e.start + e.count - 1 + width).tolist())]
    return [head, pa.array(context, pa.binary())]


def _whole(data: bytes) -> tuple[int, str]:
    return len(data), hashlib.sha256(data).hexdigest()


def suffixes(width: int = WIDTH, head: int = HEAD) -> repeats.Symbols:
    return repeats.Symbols(width, head, "head", "head binary, context binary", shared.utf8, _suffixes, _whole)


def repeated_bytes(entries: DataFrame, how: repeats.Symbols, batches: int = BATCHES) -> DataFrame:
    """The stored entries whose head stands at two places or more."""
    return repeats.repeated_entries(entries.withColumn("key", repeats.entry_key(how)), how, BY_NUMBER, F.col("n") > 1, batches, "byte-levels")


def byte_spans(touched: DataFrame, again: DataFrame, how: repeats.Symbols) -> DataFrame:
    """Stored (doc, mark, a, b) byte spans (may overlap) of the strings that stand twice."""
    one = F.min(F.struct(*repeats.ROW, *repeats.RUN)).alias("one")
    contexts = shared.stored(again.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), one), "byte-contexts")
    found = repeats.spans(shared.with_groups(again, contexts.where("n > 1").select("key", "context", "n"), ["key", "context"]), how.width)
    open_ = contexts.join(repeats.with_many_contexts(contexts), "key", "left_semi").select("one.*", (F.col("n") == 1).alias("alone"))
    # The same with blocks of windows: keys that stand once can hold no repeated string.
    parts = repeats.blocks(touched, open_, how, BLOCK, "byte")
    key, context = ["key", "key2"], ["context", "context2"]
    one = F.min(F.struct(*repeats.ROW, "start", "count")).alias("one")
    covers = parts.groupBy(*key, *context).agg(F.count(F.lit(1)).alias("n"), one, F.bool_or("alone").alias("any"))
    covers = shared.stored(covers, "byte-covers")
    twice = parts.where("alone").join(covers.where("n > 1 and any").select(*key, *context), key + context, "left_semi")
    found = found.unionByName(repeats.spans(twice, how.width))
    several = covers.groupBy(*key).agg(F.count(F.lit(1)).alias("n_covers")).where("n_covers > 1").select(*key)
    rest = covers.join(several, key, "left_semi").select("one.*", (F.expr("n = 1 and any")).alias("alone"))
    each = repeats.exploded_windows(touched, rest, how, "byte")
    often = each.groupBy("window", "check").agg(F.count(F.lit(1)).alias("n"), F.bool_or("alone").alias("any")).where("n > 1 and any").select("window", "check")
    single = each.where("alone").join(often, ["window", "check"], "left_semi")
    found = shared.stored(found.unionByName(repeats.window_spans(single, how.width)), "byte-spans")
    shared.discard(contexts, parts, covers, each)
    return found


def _cut(data: bytes, merged) -> tuple[int, int, int, str]:
    if merged is None:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest()
    kept, n = cut_spans(data, *merged)
    return len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()


def cut_spans(data: bytes, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int]:
    """What is left without the merged spans, and their number."""
    ends = [0, *b.tolist()]
    return b"".join(data[x:y] for x, y in zip(ends, [*a.tolist(), len(data)])), len(a)


GONE = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _untouched() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [F.col("n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256")]


def removed_bytes(docs: DataFrame, how: repeats.Symbols | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    how = how or suffixes()
    rows = repeats.keyed(docs)
    entries, digests, _ = repeats.scanned(rows, how, "byte")
    again = repeated_bytes(entries, how, batches)
    touched = repeats.touched_rows(rows, again, "byte")
    found = byte_spans(touched, again, how)
    shared.discard(again)
    return repeats.digested(docs, touched, digests, found, _cut, GONE, _untouched())


class SuffixIndex:
    """Incremental removal: the levels of all batches so far stay. A string that stands in an
    earlier and in a new batch goes from both, so every ``add`` gives the rows of the documents
    that it adds and of the earlier ones that share a head with them."""

    def __init__(self, spark: SparkSession, how: repeats.Symbols | None = None, saved: str | None = None):
        self.history = repeats.History(spark, how or suffixes(), BY_NUMBER, "byte")
        if saved:
            self.history.restore(saved)

    def add(self, docs: DataFrame, batches: int = 1) -> DataFrame:
        rows, digests, touched, again = self.history.add(docs, F.col("n") > 1, batches)
        # Strings that only earlier documents share count as well: all entries of touched rows.
        heads = self.history.part("entries").join(touched.select(*repeats.ROW).distinct(), repeats.ROW, "left_semi").select("key").distinct()
        again = shared.stored(self.history.part("entries").join(heads, "key", "left_semi"), "byte-again")
        every = repeats.touched_rows(self.history.part("rows"), again, "byte")
        found = byte_spans(every, again, self.history.how)
        return repeats.digested(docs, touched, digests, found.join(touched.select(*repeats.ROW).distinct(), repeats.ROW, "left_semi"), _cut, GONE, _untouched())

    def save(self, folder: str) -> None:
        self.history.save(folder)


def without_repeats(docs: DataFrame, text: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with repeated strings taken out of their texts, where a cut would fall
    inside a character the whole character stays; all other columns are kept, and
    n_chars, where there is one, is counted anew. Null texts become empty. With ``words``
    passages of so many words that stand in several documents go too, however few bytes
    they have."""
    source = docs if text == "text" else docs.withColumn("text", F.col(text))
    how, rows = suffixes(), repeats.keyed(source)
    entries, _, scan = repeats.scanned(rows, how, "byte", digests=False)
    again = repeated_bytes(entries, how)
    shared.discard(scan)
    marks = again.select(*repeats.ROW)
    if words:
        reader = word_windows.words(words, words // 2)
        passages = word_windows.passage_anchors(rows, reader)
        marks = marks.unionByName(passages.select(*repeats.ROW))
    touched = repeats.touched_rows(rows, marks, "byte")
    found = [byte_spans(touched, again, how).withColumn("in_words", F.lit(False))]
    if words:
        found.append(word_windows.passages(touched, passages, reader).withColumn("in_words", F.lit(True)))
        shared.discard(passages)
    shared.discard(again, touched)
    spans = found[0].unionByName(found[-1]) if words else found[0]
    return _without(source, docs.columns, text, spans)


def _without(source: DataFrame, columns: list[str], text: str, spans: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for t, at in zip(texts, spans):
            if t is None or at is None:
                out.append(None)
                continue
            data = t.encode("utf-8", "surrogatepass")
            out.append(cut_characters(data, in_bytes(data, at)))
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = repeats.keyed(source, keep=True).join(repeats.per_row(spans, ["a", "b", "in_words"], "spans").hint("shuffle_hash"), repeats.ROW, "left")
    # Only touched texts go to Python.
    joined = joined.withColumn("cut", cut(F.when(F.col("spans").isNotNull(), F.col("text")), "spans"))
    out = joined.withColumn("plain", F.coalesce("cut", "text"))
    n_chars = F.length("plain").cast(dict(source.dtypes).get("n_chars", "long"))
    return out.select(*(F.col("plain").alias(c) if c == text else n_chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in columns))


def in_bytes(data: bytes, spans) -> list[tuple[int, int]]:
    """The spans as byte positions; those that count words (``in_words``) are turned."""
    if any(s["in_words"] for s in spans):
        begin, end, _ = shared.word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return [(int(begin[s["a"]]), int(end[s["b"] - 1])) if s["in_words"] else (s["a"], s["b"]) for s in spans]


def cut_characters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which shrink to whole characters."""
    inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    whole, end = [], 0
    a, b = windows.merge_spans(np.array([s[0] for s in spans]), np.array([s[1] for s in spans]))
    for x, y in zip(a.tolist(), b.tolist()):
        while inner(x):
            x += 1
        while y > x and inner(y):
            y -= 1
        whole.append(data[end:x])
        end = max(x, y)
    whole.append(data[end:])
    return b"".join(whole).decode("utf-8", "surrogatepass")


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    return removed_bytes(table(spark, sf_dir, "documents"))
