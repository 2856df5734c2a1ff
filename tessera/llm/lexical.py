"""Ranked lexical search by a threshold-seeded join.

One pass over the texts keeps, for every document, its number of terms and its hits (terms
of the items, how often). From these come the corpus counts and, per term, the stored
impacts: the largest and the kth largest that any document has for it. As k documents
have at least the kth impact of a term, the largest such value over an item's terms is a
lower bound (``floor``) of the item's kth score, before any document is scored.

An item's terms are ordered by their largest possible contribution. The longest suffix
whose bounds sum to less than the floor is pruned: a document that has no term before it
cannot be among the first k, whatever it holds of the rest. Candidates come from the join
of hits and kept terms; a candidate whose kept score and the suffix's bound together stay
below the floor goes, every other one is rescored exactly on all terms. A task raises its
floors by the kth score that it has found itself. Only the first k of a task and item
leave it, and the first k of all tasks are the result; comparisons are strict, so equal
scores at the limit are all kept for the order by document.

Items are taken in blocks of about ``block_entries`` (item, term) entries, the bound of what is
broadcast; each block meets all documents. Scores are 64-bit integers.

Defined results for odd input: null texts and texts without terms have no score; items
without terms give no rows; rows of one doc_id or item_id are documents or items of their
own; among equal scores a null doc_id comes first; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.session import table


@dataclass(frozen=True)
class Ranking:
    best: int = 20
    #: About as many (item, term) entries go through the documents together.
    block_entries: int = 500_000
    #: (document, item) scores that a task holds at a time.
    cells: int = 1 << 22


#: Bytes of terms, with A-Z folded; all others part terms. Bytes from 0x80 are the
#: characters beyond ASCII.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Stored (item, item_id, term, times): one row per distinct term of an item."""

    def work(batches):
        for batch in batches:
            rows: list[tuple] = []
            for item, i, text in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), batch.column("text")):
                rows += [(item, i, t, n) for t, n in Counter(terms_of(text.as_buffer().to_pybytes())).items()]
            item, i, term, times = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(i, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], ["item", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), shared.whole_text().alias("text"))
    return shared.stored(rows.mapInArrow(work, "item long, item_id long, term binary, times long"), "lexical-items")


def hits(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Stored (doc, n, terms, times) of every document: its number of terms, and which of
    the vocabulary it has (their numbers, ascending) how often. The vocabulary is that of a
    block of items."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def work(batches):
        number = known.value
        for batch in batches:
            for some in shared.text_slices(batch, "text"):
                raw, offs = shared.utf8(some.column("text"))
                data = memoryview(raw)
                sizes, lens, terms, times = [], [], [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    found = terms_of(bytes(data[a:b]))
                    counts = Counter(found)
                    held = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                    sizes.append(len(found))
                    lens.append(len(held))
                    terms += [t for t, _ in held]
                    times += [n for _, n in held]
                ends = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((terms, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([some.column("doc"), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), shared.whole_text().alias("text"))
    return shared.stored(rows.mapInArrow(work, "doc long, n long, terms array<int>, times array<bigint>"), "lexical-hits")


def saturation(n: np.ndarray, times: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's part of a score before its weight, by a document's terms ``n``."""
    m = 75 + 25 * n * documents // length
    return 1_000_000_000 * times // (1000 * times + 12 * m)


def impacts(found: DataFrame, documents: int, length: int, how: Ranking) -> DataFrame:
    """(term, df, most, kth) of the terms that occur: the largest and the kth largest
    saturation in their documents (0 where fewer than k have the term). The first k are
    cut in every partition before the shuffle."""
    m = F.expr(f"75 + (25L * n * {documents}L) div {length}L")
    part = F.expr("(1000000000L * x.times) div (1000 * x.times + 12 * m)")
    posted = found.select(m.alias("m"), F.explode(F.arrays_zip("terms", "times")).alias("x")).select(F.col("x.terms").alias("term"), part.alias("part"))
    first = posted.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part")))).where(F.col("place") <= how.best)
    ends = first.groupBy("term").agg(F.max("part").alias("most"), F.coalesce(F.max(F.when(F.col("place") == how.best, F.col("part"))), F.lit(0)).alias("kth"))
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(ends, "term")


@dataclass
class Seeded:
    """A block of items with weighted terms: entries by term, those that are kept and
    those that are pruned, and each item's floor and the bound of its pruned suffix."""

    items: int
    kept: tuple[np.ndarray, np.ndarray, np.ndarray]
    pruned: tuple[np.ndarray, np.ndarray, np.ndarray]
    floor: np.ndarray
    rest: np.ndarray

    def size(self) -> int:
        return sum(x.nbytes for x in (*self.kept, *self.pruned, self.floor, self.rest))


def _by_term(item, term, weight, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(terms + 1)), item[order], weight[order]


def seeded(item: np.ndarray, term: np.ndarray, weight: np.ndarray, most: np.ndarray, kth: np.ndarray, items: int, terms: int) -> Seeded:
    """Floors and suffixes from (item, term, times * weight, largest, kth) entries."""
    floor = np.zeros(items, np.int64)
    np.maximum.at(floor, item, weight * kth)
    bound = weight * most
    order = np.lexsort((bound, item))  # each item's terms, smallest bound first
    item, term, weight, bound = item[order], term[order], weight[order], bound[order]
    upto = np.cumsum(bound)
    first = np.searchsorted(item, np.arange(items))
    upto -= np.concatenate([[0], upto])[first][item]
    cut = upto < floor[item]
    rest = np.zeros(items, np.int64)
    np.maximum.at(rest, item[cut], upto[cut])
    return Seeded(items, _by_term(item[~cut], term[~cut], weight[~cut], terms), _by_term(item[cut], term[cut], weight[cut], terms), floor, rest)


def _met(index: tuple[np.ndarray, np.ndarray, np.ndarray], row: np.ndarray, term: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The join of hits and entries by term: row, item, contribution."""
    starts, item, weight = index
    n = starts[term + 1] - starts[term]
    at = np.repeat(starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(row, n), item[at], np.repeat(part, n) * weight[at]


class Best:
    """The first k (score, doc) of every item so far, and the floors that they raise."""

    def __init__(self, seeds: Seeded, best: int):
        self.best, self.floor = best, np.maximum(seeds.floor, 1)
        none = np.zeros(0, np.int64)
        self.item, self.score, self.doc, self.null = none, none, none, np.zeros(0, bool)

    def add(self, item, score, doc, null) -> None:
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, ~null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.best]
        full = order[place == self.best - 1]
        self.item, self.score, self.doc, self.null = item[place < self.best], score[keep], doc[keep], null[keep]
        self.floor[item[place == self.best - 1]] = np.maximum(self.floor[item[place == self.best - 1]], score[full])


def _scored(batch: pa.RecordBatch, seeds: Seeded, found: Best, documents: int, length: int, how: Ranking) -> None:
    size, lists = batch.column("n").to_numpy(), batch.column("terms")
    offs = lists.offsets.to_numpy()
    terms, times = (batch.column(c).values.to_numpy() for c in ("terms", "times"))
    doc = batch.column("doc").fill_null(0).to_numpy()
    null = batch.column("doc").is_null().to_numpy(zero_copy_only=False)
    step = max(1, how.cells // seeds.items)
    for lo in range(0, batch.num_rows, step):
        hi = min(lo + step, batch.num_rows)
        a, b = offs[lo], offs[hi]
        row = np.repeat(np.arange(hi - lo), np.diff(offs[lo : hi + 1]))
        term = terms[a:b]
        part = saturation(size[lo:hi][row], times[a:b], documents, length)
        scores = np.zeros((hi - lo) * seeds.items, np.int64)
        r, i, x = _met(seeds.kept, row, term, part)
        np.add.at(scores, r * seeds.items + i, x)
        grid = scores.reshape(hi - lo, seeds.items)
        candidate = (grid > 0) & (grid + seeds.rest >= found.floor)
        # Rescored on the pruned terms too: only rows that hold a candidate.
        again = candidate.any(axis=1)[row]
        r, i, x = _met(seeds.pruned, row[again], term[again], part[again])
        of = candidate[r, i]
        np.add.at(scores, r[of] * seeds.items + i[of], x[of])
        r, i = np.nonzero(candidate & (grid >= found.floor))
        found.add(i, grid[r, i], doc[lo:hi][r], null[lo:hi][r])


def ranked(docs: DataFrame, items: DataFrame, how: Ranking = Ranking()) -> DataFrame:
    """item_id, rank, doc_id, score: the first ``best`` documents of every item."""
    spark = docs.sparkSession
    asked = item_terms(items)
    blocks = max(1, -(-asked.count() // how.block_entries))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        one = _ranked_block(spark, docs, part, how)
        out = one if out is None else out.unionByName(one)
    return out


def _ranked_block(spark: SparkSession, docs: DataFrame, asked: DataFrame, how: Ranking) -> DataFrame:
    entries = asked.toArrow()  # bounded by block_entries
    coded = pa.chunked_array(entries.column("term")).combine_chunks().dictionary_encode() if entries.num_rows else None
    schema = "item long, item_id long, score long, doc_id long"
    found = None
    if coded is not None:
        vocabulary = coded.dictionary.to_pylist()
        held = hits(docs, vocabulary)
        documents, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if length:
            weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).alias("weight")
            stats = impacts(held, documents, length, how).select("term", weight, "most", "kth").toArrow()  # bounded by the vocabulary
            found = _search(spark, held, entries, coded.indices.to_numpy(), stats, len(vocabulary), documents, length, how, schema)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    placed = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= how.best)
    return placed.select("item_id", "rank", "doc_id", "score")


def _search(spark, held, entries, term, stats, terms, documents, length, how, schema) -> DataFrame:
    number = entries.column("item").to_numpy()
    names, item = np.unique(number, return_inverse=True)
    first = np.unique(item, return_index=True)[1]
    item_id = entries.column("item_id").combine_chunks().take(pa.array(first))
    tables = np.zeros((3, terms), np.int64)
    at = stats.column("term").to_numpy()
    for k, c in enumerate(("weight", "most", "kth")):
        tables[k, at] = stats.column(c).to_numpy()
    weight, most, kth = tables[:, term]
    seeds = seeded(item, term, entries.column("times").to_numpy() * weight, most, kth, len(names), terms)
    ready = spark.sparkContext.broadcast((seeds, names, item_id))

    def work(batches):
        seeds, names, item_id = ready.value
        found = Best(seeds, how.best)
        for batch in batches:
            if batch.num_rows:
                _scored(batch, seeds, found, documents, length, how)
        doc = pa.array(found.doc, pa.int64(), mask=found.null)
        yield pa.RecordBatch.from_arrays([pa.array(names[found.item]), item_id.take(pa.array(found.item)), pa.array(found.score), doc], ["item", "item_id", "score", "doc_id"])

    return shared.stored(held.mapInArrow(work, schema), "lexical-found")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS t FROM documents
), totals AS (
  SELECT count(*) FILTER (len(t) > 0)::BIGINT AS docs, sum(len(t))::BIGINT AS total FROM d
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY doc_id, n, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), totals
), q AS (
  SELECT item_id, unnest({_TERMS}) AS term FROM benchmark
), s AS (
  SELECT q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) CROSS JOIN totals GROUP BY q.item_id, p.doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
