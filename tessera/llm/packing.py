"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method: bin completion with branch and bound. The pieces are reduced to how many there
are of each length (at most ``capacity`` lengths, whatever the corpus size). For the
largest remaining length the search enumerates undominated fillings of the space beside
it, best fit first; the first dive gives the incumbent, other branches are cut when the
space they waste already reaches the incumbent's. A filling is applied as many times as
the counts allow, so the plan has at most a few entries per length.

Pieces then look up their place: a piece's rank among all pieces of its length comes
from ranks inside the partitions plus the sums of earlier partitions, and the plan maps
(length, rank) to a sequence and an offset. Nothing of corpus size reaches the driver.

Defined results for odd input: a null text is empty and packs as one end id; null
doc_ids and repeated rows are packed as rows of their own; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import shared, tokens
from tessera.session import table

CAPACITY = 2048


def dominated(items: list[tuple[int, int]], waste: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether some of the items (length, number), or none of them, can be exchanged for
    one longer length that is left over, inside the waste: the exchange fills more and
    gives shorter items back."""
    if not waste:
        return False
    sums = 1  # bit t: some of the items have t tokens
    for size, n in items:
        step = 1
        while n:  # n copies as 1, 2, 4, ... of them
            take = min(step, n)
            sums |= sums << size * take
            n -= take
            step *= 2
    used, window = dict(items), (1 << waste) - 1
    return any(counts[x] > used.get(x, 0) and (sums >> (x - waste) if x >= waste else sums << (waste - x)) & window for x in lengths)


def fillings(space: int, lengths: list[int], counts: dict[int, int], most: int, nodes: int = 4000) -> list[list[int]]:
    """Up to ``most`` fillings of ``space``, least waste first and, at equal waste, with
    larger items first; dominated ones only where no other is found. ``lengths`` ascend.
    Each step takes a number of items of one length, so the search is as deep as a
    filling has lengths. ``nodes`` bounds its steps, never what is packed: every piece is
    in some filling in the end. ``most`` exact fillings end it early."""
    found: list[tuple[int, list[tuple[int, int]]]] = []
    poor: list[tuple[int, list[tuple[int, int]]]] = []
    left = [nodes]
    chosen: list[tuple[int, int]] = []

    def search(space: int, top: int) -> bool:
        left[0] -= 1
        k = bisect_right(lengths, space, 0, top)
        took = False
        while k:
            k -= 1
            for n in range(min(counts[lengths[k]], space // lengths[k]), 0, -1):
                took = True
                chosen.append((lengths[k], n))
                stop = search(space - n * lengths[k], k)
                chosen.pop()
                if stop or left[0] <= 0:
                    return stop or bool(found)
        if not took:
            kept = poor if dominated(chosen, space, lengths, counts) else found
            kept.append((space, list(chosen)))
            kept.sort(key=lambda x: x[0])
            del kept[most:]
            return most <= len(found) and found[-1][0] == 0
        return False

    search(space, len(lengths))
    return [[size for size, n in items for _ in range(n)] for _, items in found or poor]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, most_nodes: int = 20_000, width: int = 3) -> tuple[list[tuple[list[int], int]], int]:
    """((items of a sequence, times) ..., lower bound on sequences). ``most_nodes``
    bounds the branch-and-bound steps; the incumbent is complete whatever the bound."""
    total = sum(k * n for k, n in histogram.items())
    bound = -(-total // capacity)
    over_half = sum(n for k, n in histogram.items() if 2 * k > capacity)
    bound = max(bound, over_half)
    best: list[tuple[list[int], int]] | None = None
    best_bins = None
    budget = most_nodes

    # A branch is (counts, steps, sequences, waste, filling to start with, depth); the
    # stack makes the search depth first.
    stack: list[tuple] = [(dict(histogram), [], 0, 0, None, 0)]
    while stack and (best is None or (budget > 0 and best_bins > bound)):
        counts, steps, bins, waste, items, depth = stack.pop()
        lengths = sorted(k for k, n in counts.items() if n)
        while lengths:
            budget -= 1
            if best is not None and (budget <= 0 or waste > (best_bins - 1) * capacity - total):
                break  # no better than the incumbent
            if items is None:
                largest = lengths[-1]
                counts[largest] -= 1
                options = fillings(capacity - largest, lengths, counts, width if depth < 4 else 1) or [[]]
                counts[largest] += 1
                for other in options[:0:-1]:
                    stack.append((dict(counts), list(steps), bins, waste, [largest, *other], depth + 1))
                depth += 1
                items = [largest, *options[0]]
            need: dict[int, int] = {}
            for x in items:
                need[x] = need.get(x, 0) + 1
            times = min(counts[x] // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * times
            steps.append((items, times))
            bins += times
            waste += times * (capacity - sum(items))
            lengths = [k for k in lengths if counts[k]]
            items = None
        if not lengths and (best is None or bins < best_bins):
            best, best_bins = steps, bins
    return best or [], bound


class Places:
    """(length, rank) -> (sequence, offset), as sorted arrays of a few entries per
    length."""

    def __init__(self, steps: list[tuple[list[int], int]]):
        rows, used, first = [], {}, 0
        for items, times in steps:
            sizes: dict[int, int] = {}
            for x in items:
                sizes[x] = sizes.get(x, 0) + 1
            offset = 0
            for x, n in sizes.items():
                at = used.get(x, 0)
                rows.append((x, at, n, first, offset))
                used[x] = at + n * times
                offset += x * n
            first += times
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = (self.rows[:, 0] << 44) + self.rows[:, 1]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 44) + rank, "right") - 1
        size, begin, n, first, offset = self.rows[at].T
        within = rank - begin
        return first + within // n, offset + within % n * size


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document; only documents longer than the capacity are cut,
    and their first piece takes the remainder. ``rank_in_part`` counts earlier pieces of
    the same length in the task. With ``keep_ids`` the ids come too (little-endian)."""

    def cut(batches):
        from pyspark import TaskContext

        enc, part = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in shared.text_slices(batch, "text", 8 << 20):
                ids, lens = tokens.with_end(*enc(some.column("text")), end_id)
                n = -(-lens // capacity)
                row = np.repeat(np.arange(len(lens)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = lens - (n - 1) * capacity
                length = np.where(number == 0, head[row], capacity)
                start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                firsts = np.searchsorted(ordered, ordered, "left")
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - firsts
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(length)
                spans = list(zip((4 * (ends - length)).tolist(), (4 * ends).tolist()))
                cols = {
                    "doc_id": some.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(number.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                    "part": pa.array(np.full(len(row), part, np.int32)),
                    "rank_in_part": pa.array(rank),
                }
                if keep_ids:
                    cols["ids"] = pa.array([raw[a:b] for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def pack(cut: DataFrame, capacity: int = CAPACITY, most_nodes: int = 20_000) -> DataFrame:
    """``cut`` must be a stored table of pieces; adds sequence_id and offset."""
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(by_length), F.lit(0))).select("length", "part", "base")
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps, _ = plan(histogram, capacity, most_nodes)
    places = Places(steps)

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank_in_part").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = places(length, rank)
            kept = batch.drop_columns(["part", "rank_in_part", "base"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    extra = [c for c in cut.columns if c not in ("part", "rank_in_part")]
    types = dict(cut.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in extra) + ", sequence_id long, offset long"
    ranked = cut.join(bases, ["length", "part"]).select(*extra, "part", "rank_in_part", "base")
    return ranked.mapInArrow(place, schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared.prepare(spark)
    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(shared.stored(cut, "pieces"))
