"""The common course of the two repeated-window operators: anchor entries of all rows,
an index of sorted runs, and exact resolution of the windows around repeated anchors.

1. One pass over the texts gives anchor entries (``windows``): (key, context, row key,
   start, count), and what the result says of a text that keeps everything.
2. Batches of entries go through the index; anchors that occur once are gone after it.
3. Of the others, entries with equal contexts share all of their windows, whatever the
   number of copies. Only one entry per distinct context has to be looked at further, and
   only where an anchor has several contexts.
4. For those, every window is hashed (128 bits) and counted over the cluster, in
   ``suffix_levels`` after the same step with blocks of neighbouring windows.

Nothing here compares pairs or gathers an anchor in one task: every step counts by a
hash, and the work is linear in the entries however large a group of copies is. Rows are
identified by (doc, mark): doc_id (null as the smallest) and a hash of doc_id and text;
identical rows share a mark. Texts are shuffled only where they are touched by a repeat
(and once to find these), always as the streamed side of a hash join, so they are never
sorted. Intermediate tables are deleted as soon as nothing reads them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared, windows
from tessera.llm.runs import SortedRuns, Value

SMALLEST = -(1 << 63)
ROW = ["doc", "mark"]
#: A run of windows: its first start, their number, and the anchor's distance from the start.
RUN = ["start", "count", "lead"]


def keyed(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc, mark, text; with ``keep`` also row, a struct of all columns but text."""
    text = shared.whole_text()
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] if keep else []
    return docs.select(*row, F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("doc"), F.xxhash64("doc_id", text).alias("mark"), text.alias("text"))


def doc_id(kind: str) -> Column:
    """The document's own id again."""
    return F.when(F.col("doc") != SMALLEST, F.col("doc")).cast(kind).alias("doc_id")


@dataclass(frozen=True)
class Symbols:
    """Symbols of string arrays: ``read`` gives all of them and each row's first one,
    ``describe`` the key and the context of entries, ``digest`` the number of symbols and
    the digest of a text of which nothing goes."""

    width: int
    gram: int
    key: str
    kinds: str
    read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    describe: Callable[[np.ndarray, windows.Entries, int, int], list[pa.Array]]
    digest: Callable[[bytes], tuple[int, str]]

    def names(self) -> list[str]:
        return [k.split()[0] for k in self.kinds.split(", ")]


def _entry_batch(symbols: np.ndarray, firsts: np.ndarray, e: windows.Entries, some: pa.RecordBatch, how: Symbols) -> list[pa.Array]:
    at = pa.array(e.row)
    return [
        *how.describe(symbols, e, how.width, how.gram), some.column("doc").take(at), some.column("mark").take(at),
        pa.array((e.start - firsts[e.row]).astype(np.int32)), pa.array(e.count.astype(np.int32)), pa.array((e.anchor - e.start).astype(np.int32)),
    ]


def scanned(rows: DataFrame, how: Symbols, tag: str, digests: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(entries, digests, the stored table of both): one pass over the texts."""
    names = [*how.names(), *ROW, *RUN]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in shared.text_slices(batch, "text"):
                symbols, firsts = how.read(some.column("text"))
                cols = _entry_batch(symbols, firsts, windows.entries(symbols, firsts, how.width, how.gram), some, how)
                m = len(cols[0])
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.int64()), pa.nulls(m, pa.string())], [*names, "n", "sha"])
                if digests:
                    raw, offs = shared.utf8(some.column("text"))
                    data = memoryview(raw)
                    n, sha = zip(*(how.digest(bytes(data[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())))
                    none = [pa.nulls(len(n), c.type) for c in cols]
                    none[-5], none[-4] = some.column("doc"), some.column("mark")
                    yield pa.RecordBatch.from_arrays([*none, pa.array(n, pa.int64()), pa.array(sha, pa.string())], [*names, "n", "sha"])

    table = shared.stored(rows.select("doc", "mark", "text").mapInArrow(work, f"{how.kinds}, doc long, mark long, start int, count int, lead int, n long, sha string"), tag + "-scan")
    return table.where("count is not null").select(*names), table.where("n is not null").select("doc", "mark", "n", "sha"), table


def batch_number(doc: str, lo: int, step: int, batches: int) -> Column:
    """0 .. batches - 1, in integers: doubles round where ids span over 2**53. Ids below
    ``lo`` (null ids) come first."""
    return F.when(F.col(doc) < lo, 0).otherwise(F.least(F.expr(f"(`{doc}` - {lo}L) div {step}L"), F.lit(batches - 1))).cast("int")


def repeated_entries(entries: DataFrame, how: Symbols, values: dict[str, Value], repeated: Column, batches: int, tag: str, index: SortedRuns | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """The entries (stored, with ``key``) whose anchor fulfils ``repeated`` after all
    batches. Batches ascend in doc, so what a batch is probed against came before. With
    an ``index`` that has the ``earlier`` entries, the new ones are added to it, and the
    result has entries of both at the anchors of new ones."""
    lo, hi = entries.agg(F.min("doc"), F.max("doc")).first()
    columns = list(dict.fromkeys(["key", "context", *ROW, *RUN]))
    if lo is None:
        return shared.stored(entries.select(*columns), tag + "-again")
    step = max(1, -(-(hi - max(lo, -1) + 1) // batches))
    number = batch_number("doc", max(lo, 0), step, batches)
    kept, index, found = index, index or SortedRuns(entries.sparkSession, tag, how.key, values), []
    for b in range(batches):
        found.append(index.add(entries.where(number == b).select(how.key, *ROW, "start")))
    if kept is None:
        index.close()
    keys = found[0]
    for part in found[1:]:
        keys = keys.unionByName(part)
    # The slim side is written first, so that the join's sides are plain shuffles and AQE
    # can split an anchor that very many entries share.
    keys = shared.stored(keys.where(repeated).select(entry_key(how).alias("key")).distinct(), tag + "-keys")
    every = entries if earlier is None else earlier.unionByName(entries)
    again = shared.stored(every.select(*columns).join(keys, "key", "left_semi"), tag + "-again")
    shared.discard(*found, keys)
    return again


def with_many_contexts(contexts: DataFrame) -> DataFrame:
    """Anchors with several distinct contexts."""
    return contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n_contexts")).where("n_contexts > 1").select("key")


def touched_rows(rows: DataFrame, again: DataFrame, tag: str) -> DataFrame:
    """The rows (stored) with a repeated anchor."""
    return shared.stored(rows.join(again.select(*ROW).distinct().hint("shuffle_hash"), ROW, "left_semi"), tag + "-rows")


def per_row(wanted: DataFrame, fields: list[str], name: str) -> DataFrame:
    """An array per row, bounded by the row's length."""
    return wanted.groupBy(*ROW).agg(F.collect_list(F.struct(*fields)).alias(name))


def _located(touched: DataFrame, wanted: DataFrame, how: Symbols, fields: list[str], work_on: Callable, schema: str) -> DataFrame:
    """``work_on`` over the texts with the ``fields`` of the wanted entries: symbols, row,
    first symbol of its row, and the fields of every entry; it yields the rows' entry
    numbers and the columns of ``schema`` before (doc, mark)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in shared.text_slices(batch, "text"):
                symbols, firsts = how.read(some.column("text"))
                lists = some.column("at")
                offs = lists.offsets.to_numpy()
                row, flat = np.repeat(np.arange(len(lists)), np.diff(offs)), lists.values.slice(offs[0], offs[-1] - offs[0])
                values = {f: flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields if f != "alone"}
                for owner, cols in work_on(symbols, firsts[row], **values):
                    at, who = pa.array(row[owner]), pa.array(owner)
                    yield pa.RecordBatch.from_arrays([*cols, some.column("doc").take(at), some.column("mark").take(at), flat.field("alone").take(who)], names)

    found = touched.select(*ROW, "text").join(per_row(wanted, fields, "at").hint("shuffle_hash"), ROW)
    return found.mapInArrow(work, schema)


def exploded_windows(touched: DataFrame, wanted: DataFrame, how: Symbols, tag: str) -> DataFrame:
    """Stored (window, check, doc, mark, start, alone): two hashes of every window of the
    ``wanted`` entries (doc, mark, start, count, alone)."""

    def work_on(symbols, base, start, count):
        # Some windows at a time, however long a row is.
        ends, i = np.cumsum(count), 0
        while i < len(count):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + windows.SEGMENT, "right")))
            s, owner = _each(base[i:j] + start[i:j], count[i:j])
            owner += i
            one, two = windows.hashes_at(symbols, s, s + how.width, (1, 2))
            yield owner, [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array((s - base[owner]).astype(np.int32))]
            i = j

    return shared.stored(_located(touched, wanted, how, ["start", "count", "alone"], work_on, "window long, check long, start int, doc long, mark long, alone boolean"), tag + "-each")


def blocks(touched: DataFrame, wanted: DataFrame, how: Symbols, size: int, tag: str) -> DataFrame:
    """Stored (key, key2, context, context2, doc, mark, start, count, alone): the windows of
    the ``wanted`` entries (doc, mark, start, count, lead, alone) in blocks of up to ``size``
    whose bounds depend on the distance from the anchor alone. The key is a hash of what all
    windows that a block can have share, the context one of all they cover: equal windows
    have equal keys, and equal contexts have equal windows."""

    def work_on(symbols, base, start, count, lead):
        # Distances of an entry's windows from their anchor: lead, lead - 1, ..., lead - count + 1.
        top, low = lead // size, (lead - count + 1) // size
        k, owner = _each(low, top - low + 1)
        near, far = np.maximum(size * k, (lead - count + 1)[owner]), np.minimum(size * k + size - 1, lead[owner])
        anchor = (base + start + lead)[owner]
        core = windows.hashes_at(symbols, anchor - size * k, anchor - size * k - size + 1 + how.width, (1, 2))
        cover = windows.hashes_at(symbols, anchor - far, anchor - near + how.width, (1, 2))
        yield owner, [
            *(pa.array(h.view(np.int64)) for h in (*core, *cover)),
            pa.array((anchor - far - base[owner]).astype(np.int32)), pa.array((far - near + 1).astype(np.int32)),
        ]

    schema = "key long, key2 long, context long, context2 long, start int, count int, doc long, mark long, alone boolean"
    return shared.stored(_located(touched, wanted, how, [*RUN, "alone"], work_on, schema), tag + "-blocks")


def _each(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin, begin + 1, ... for every entry, and the entry of each."""
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(begin)), count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + begin[owner], owner


def spans(entries: DataFrame, width: int) -> DataFrame:
    """(doc, mark, a, b) of the symbols that all windows of entries cover."""
    return entries.select(*ROW, F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + width).alias("b"))


def window_spans(each: DataFrame, width: int) -> DataFrame:
    return each.select(*ROW, F.col("start").alias("a"), (F.col("start") + width).alias("b"))


def digested(docs: DataFrame, touched: DataFrame, digests: DataFrame, found: DataFrame, cut: Callable[[bytes, list], tuple], gone: str, untouched: list[Column]) -> DataFrame:
    """The digest columns of all rows: for touched ones (with their spans ``found``) by
    ``cut`` (types in ``gone``), for all others from the first pass."""
    kind = dict(docs.dtypes)["doc_id"]
    names = [g.split()[0] for g in gone.split(", ")]
    kinds = [pa.string() if g.endswith("string") else pa.int64() for g in gone.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in shared.text_slices(batch, "text"):
                raw, offs = shared.utf8(some.column("text"))
                data, lists = memoryview(raw), some.column("spans")
                out = []
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    at = lists[i].values if lists[i].is_valid else None
                    merged = windows.merge_spans(*(at.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("a", "b"))) if at is not None else None
                    out.append(cut(bytes(data[a:b]), merged))
                yield pa.RecordBatch.from_arrays([some.column("doc"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc", *names])

    joined = touched.join(per_row(found, ["a", "b"], "spans").hint("shuffle_hash"), ROW, "left").select("doc", "text", "spans")
    some = joined.mapInArrow(work, f"doc long, {gone}").select(doc_id(kind), *names)
    others = digests.join(touched.select(*ROW).distinct(), ROW, "left_anti").select(doc_id(kind), *untouched)
    return some.unionByName(others)


class History:
    """An index that outlives a call: runs, entries, texts and digests of all documents added
    so far, in the shared folder. ``save`` writes what ``opened`` needs to go on, in this
    session or another one."""

    PARTS = ("rows", "entries", "digests")

    def __init__(self, spark: SparkSession, how: Symbols, values: dict[str, Value], tag: str):
        self.spark, self.how, self.values, self.tag = spark, how, values, tag
        self.index = SortedRuns(spark, tag + "-runs", how.key, values)
        self.folders: dict[str, list[str]] = {p: [] for p in self.PARTS}

    def part(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(*self.folders[name]) if self.folders[name] else None

    def add(self, docs: DataFrame, repeated: Column, batches: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(rows, digests, touched, again): the new rows and the digests of untouched ones, and the
        touched rows and repeated entries of new and earlier documents."""
        rows = shared.stored(keyed(docs), self.tag + "-history")
        found, sums, _ = scanned(rows, self.how, self.tag)
        entries, digests = shared.stored(found.withColumn("key", entry_key(self.how)), self.tag + "-entries"), shared.stored(sums, self.tag + "-digests")
        again = repeated_entries(entries, self.how, self.values, repeated, batches, self.tag + "-runs", self.index, self.part("entries"))
        for p, df in zip(self.PARTS, (rows, entries, digests)):
            self.folders[p].append(df._stored_at)
        return rows, digests, touched_rows(self.part("rows"), again, self.tag), again

    def save(self, folder: str) -> None:
        state = json.dumps({"index": self.index.state(), "folders": self.folders})
        self.spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").parquet(folder)

    def restore(self, folder: str) -> None:
        state = json.loads(self.spark.read.parquet(folder).first().state)
        self.index = SortedRuns.restored(self.spark, state["index"], self.values)
        self.folders = state["folders"]


def entry_key(how: Symbols) -> Column:
    """The anchor's key, a hash where the index is ordered by more than 64 bits."""
    return F.xxhash64(how.key) if how.key != "key" else F.col("key")
