"""Near duplicates of embeddings by cross-polytope hashing.

Vectors are turned by pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform); the nearest signed axis is a hash. A bucket of a table joins several
of them, so many that a bucket holds few unrelated vectors however large the table gets.
Every vector stands in its own bucket of each table and probes those that it would have
fallen into next. Two vectors meet where one stands in a bucket that the other stands in or
probes; the number of tables follows from the share of simulated pairs at the cosine limit
that meet, so that such a pair meets nowhere with a probability of at most ``miss``.

Equal vectors are one class and go on as one row. Buckets with one row or without a
standing one are dropped before any vector is shuffled. Members meet in blocks of bounded
size: a bucket of many members is cut into parts, and every pair of parts is a block of its
own. In a block all cosines are computed in double precision. A linked pair that meets in
several buckets counts in the first of them only, which either vector's own buckets
tell, so no pair ever leaves a task: what leaves is, for each class, the number of its links, and
a spanning forest of the block's links.

Defined results for odd input: vectors that are null, empty, zero, or hold null or
non-finite components, and rows with a null vec_id, link with nothing; so do vectors of
different lengths with each other; rows of one vec_id are separate vectors; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.components import components
from tessera.session import table


@dataclass(frozen=True)
class CrossPolytope:
    cosine: float = 0.9
    #: Probability that a pair at the limit meets in no table.
    miss: float = 0.002
    #: Further buckets that a vector probes in each table.
    probes: int = 3
    #: Buckets of a table for every vector.
    spread: int = 32
    #: Rows of a bucket that go into one part.
    block: int = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row (a power of two long), not scaled."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def width_for(length: int) -> int:
    """A power of two; short vectors are padded, as few axes have few rotations."""
    return max(16, 1 << max(length - 1, 0).bit_length())


#: Axes of a rotated vector that are looked at for probes, and most places of a bucket's
#: hashes that a probe changes.
NEXT_AXES, CHANGES = 4, 2


@lru_cache
def _choices(hashes: int, axes: int) -> np.ndarray:
    """Which axis of each hash (0: the nearest) the candidates for probes take."""
    rows = [(0,) * hashes]
    for k in range(1, min(CHANGES, hashes) + 1):
        for places in combinations(range(hashes), k):
            for values in product(range(1, axes), repeat=k):
                row = [0] * hashes
                for p, v in zip(places, values):
                    row[p] = v
                rows.append(tuple(row))
    return np.array(rows)


class Tables:
    """The tables for vectors of one length."""

    def __init__(self, length: int, hashes: int, tables: int, probes: int):
        self.width = width_for(length)
        self.length, self.hashes, self.tables = length, hashes, tables
        self.axes = min(NEXT_AXES, self.width)
        self.choices = _choices(hashes, self.axes)
        self.probes = min(probes, len(self.choices) - 1)
        rng = np.random.default_rng([length, 7])
        self.signs = rng.choice([-1.0, 1.0], size=(tables, hashes, 3, self.width))

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Buckets of unit vectors, rows x tables x (1 + probes), each one's own first."""
        out = np.empty((len(unit), self.tables, self.probes + 1), np.int64)
        padded = np.zeros((len(unit), self.width))
        padded[:, : self.length] = unit
        for t in range(self.tables):
            axis, gap = [], []
            for h in range(self.hashes):
                y = padded
                for signs in self.signs[t, h]:
                    y = hadamard(y * signs)
                size = np.abs(y)
                near = np.argsort(-size, axis=1, kind="stable")[:, : self.axes]
                size = np.take_along_axis(size, near, 1) / np.linalg.norm(y, axis=1, keepdims=True)
                axis.append(2 * near + (np.take_along_axis(y, near, 1) < 0))
                gap.append((size[:, :1] - size) ** 2)
            code, loss = np.zeros((len(unit), len(self.choices)), np.uint64), np.zeros((len(unit), len(self.choices)))
            for h in range(self.hashes):
                pick = self.choices[:, h]
                code = code * np.uint64(2 * self.width) + axis[h][:, pick].astype(np.uint64)
                loss += gap[h][:, pick]
            best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes + 1]
            salt = np.uint64((t << 32) + self.length)
            out[:, t] = shared.mix64(shared.mix64(np.take_along_axis(code, best, 1)) ^ shared.mix64(np.array([salt]))).view(np.int64)
        return out


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows of buckets meet, and the first bucket in which they do."""
    mine = (b == a[:, :, :1]).any(axis=2)
    theirs = (a == b[:, :, :1]).any(axis=2)
    either = mine | theirs
    first = (np.arange(len(a)), either.argmax(axis=1))
    top = np.iinfo(np.int64).max
    where = np.minimum(np.where(mine[first], a[(*first, 0)], top), np.where(theirs[first], b[(*first, 0)], top))
    return either.any(axis=1), where


@lru_cache
def tables_for(length: int, vectors: int, how: CrossPolytope) -> Tables:
    """Hashes a bucket by the number of vectors, tables by simulated pairs at the limit."""
    width = width_for(length)
    hashes = max(1, ceil(log(max(vectors * how.spread, 2)) / log(2 * width) - 1e-9))
    rng = np.random.default_rng(length)
    a, b = rng.normal(size=(2, 4000, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    size = np.linalg.norm(b, axis=1, keepdims=True)
    b = how.cosine * a + (1 - how.cosine**2) ** 0.5 * b / np.where(size > 1e-9, size, 1)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    trial = Tables(length, hashes, 4, how.probes)
    x, y = trial(a), trial(b)
    share = np.mean([meeting(x[:, t : t + 1], y[:, t : t + 1])[0].mean() for t in range(4)])
    # The lower end of the estimate; at least two tables.
    share = min(max(share - 3 * (share * (1 - share) / 16000) ** 0.5, 1e-4), 1 - 1e-9)
    return Tables(length, hashes, max(2, ceil(log(how.miss) / log(1 - share))), how.probes)


def _vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components as doubles and each row's first one."""
    offs = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offs[0], offs[-1] - offs[0]).to_numpy(zero_copy_only=False).astype(np.float64), offs - offs[0]


def _units(flat: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of one length; scaled first, so that squares stay in range."""
    n = offs[rows[0] + 1] - offs[rows[0]]
    x = flat[offs[rows][:, None] + np.arange(n)]
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_class(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that can link, all others, stored classes (class, vec, n, least))."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vec = F.col("vec")
    usable = F.col("vec_id").isNotNull() & vec.isNotNull() & F.coalesce(F.forall(vec, sound), F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").select("vec_id", "vec")
    # -0.0 equals 0.0 in grouping and in joins.
    classes = good.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = shared.stored(classes.withColumn("class", F.monotonically_increasing_id()), "polytope-classes")
    return good, rows.where("not usable").select("vec_id"), classes


def posts(classes: DataFrame, vectors: int, how: CrossPolytope) -> DataFrame:
    """Stored (bucket, class, own): every class in its own buckets and those it probes."""

    def work(batches):
        for batch in batches:
            flat, offs = _vectors(batch.column("vec"))
            number = batch.column("class").to_numpy()
            length = np.diff(offs)
            for n in np.unique(length).tolist():
                tables = tables_for(n, vectors, how)
                rows = np.flatnonzero(length == n)
                for some in np.array_split(rows, -(-len(rows) // 4096)):
                    buckets = tables(_units(flat, offs, some))
                    own = np.zeros(buckets.shape, bool)
                    own[:, :, 0] = True
                    each = np.repeat(number[some], buckets.shape[1] * buckets.shape[2])
                    yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(each), pa.array(own.ravel())], ["bucket", "class", "own"])

    return shared.stored(classes.select("class", "vec").mapInArrow(work, "bucket long, class long, own boolean"), "polytope-posts")


def blocks(posted: DataFrame, how: CrossPolytope) -> DataFrame:
    """(bucket, i, j, part, class): the members of buckets where classes can meet, in blocks
    of two parts (or one with itself)."""
    shape = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("own")).alias("standing")).where("rows > 1 and standing > 0")
    parts = F.ceil(F.col("rows") / how.block).cast("int")
    met = posted.join(shape.select("bucket", parts.alias("parts")), "bucket")
    met = met.select("bucket", "class", "parts", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n - 1 linked by (a, b) the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Linked pairs that are held, and whose buckets are compared at a time.
HELD_PAIRS, PAIRS = 1 << 20, 1 << 16


class BlockLinks:
    """Links of the classes of some blocks: vectors and buckets once per class."""

    def __init__(self, number: np.ndarray, weight: np.ndarray, lists: pa.Array, tables, how: CrossPolytope):
        self.number, first, self.of_row = np.unique(number, return_index=True, return_inverse=True)
        self.weight, self.how = weight[first], how
        flat, offs = _vectors(lists)
        self.length = np.diff(offs)[first]
        self.units, self.place, self.buckets, self.tables = {}, np.empty(len(first), np.int64), {}, {}
        for n in np.unique(self.length).tolist():
            of = np.flatnonzero(self.length == n)
            self.units[n], self.place[of] = _units(flat, offs, first[of]), np.arange(len(of))
            self.tables[n], self.buckets[n] = tables(n), [np.zeros(len(of), bool), None]
        self.held: dict[int, list] = {n: [] for n in self.units}
        self.out: list[list] = [[], [], []]

    def add(self, lo: int, hi: int, bucket: int, part: np.ndarray, alike: bool) -> None:
        """The linked pairs of the rows lo .. hi - 1, which are a block."""
        rows = self.of_row[lo:hi]
        for n in [int(self.length[rows[0]])] if (self.length[rows] == self.length[rows[0]]).all() else np.unique(self.length[rows]).tolist():
            of = np.flatnonzero(self.length[rows] == n)
            unit = self.units[n][self.place[rows[of]]]
            left, right = (of, of) if alike else (of[part[lo:hi][of] == part[lo]], of[part[lo:hi][of] != part[lo]])
            a, b = np.nonzero(unit @ unit.T >= self.how.cosine) if alike else np.nonzero(self.units[n][self.place[rows[left]]] @ self.units[n][self.place[rows[right]]].T >= self.how.cosine)
            if alike:
                a, b = a[a < b], b[a < b]
            if len(a):
                self.held[n].append((rows[left[a]], rows[right[b]], np.full(len(a), bucket)))
            if sum(len(x[0]) for x in self.held[n]) > HELD_PAIRS:
                self.settle(n)

    def settle(self, n: int) -> None:
        """Pairs count in the first bucket in which they meet; the links of a class are added
        up, and a forest stands for the links."""
        if not self.held[n]:
            return
        a, b, bucket = (np.concatenate(x) for x in zip(*self.held[n]))
        self.held[n] = []
        have, _ = self.buckets[n]
        need = np.unique(np.concatenate([self.place[a], self.place[b]]))
        need = need[~have[need]]
        for some in np.array_split(need, -(-len(need) // 4096)) if len(need) else []:
            found = self.tables[n](self.units[n][some])
            if self.buckets[n][1] is None:
                self.buckets[n][1] = np.empty((len(have), *found.shape[1:]), np.int64)
            self.buckets[n][1][some] = found
        have[need] = True
        x, y, own = self.place[a], self.place[b], self.buckets[n][1]
        first = np.concatenate([meeting(own[x[k : k + PAIRS]], own[y[k : k + PAIRS]])[1] for k in range(0, len(x), PAIRS)])
        a, b = a[first == bucket], b[first == bucket]
        size = len(self.number)
        links = np.zeros(size, np.int64)
        np.add.at(links, a, self.weight[b])
        np.add.at(links, b, self.weight[a])
        some, label = np.flatnonzero(links), forest(a, b, size)
        moved = np.flatnonzero(label != np.arange(size))
        for out, values in zip(self.out, ((some, moved), (np.full(len(some), -1), self.number[label[moved]]), (links[some], np.zeros(len(moved), np.int64)))):
            out.append(np.concatenate([self.number[v] if out is self.out[0] else v for v in values]))

    def result(self) -> pa.RecordBatch:
        for n in self.held:
            self.settle(n)
        u, v, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in self.out)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=v < 0), pa.array(n)], ["u", "v", "n"])


def linked(met: DataFrame, classes: DataFrame, vectors: int, how: CrossPolytope) -> DataFrame:
    """Stored (u, v, n): n linked vectors for class u (v null), or a link of the forest."""
    spark = met.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "i", "j"]
    rows = met.join(classes.select("class", "n", "vec"), "class").repartition(parts, *keys).sortWithinPartitions(*keys, "part", "class")

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        bucket, i, j, part, number, weight = (t.column(c).to_numpy() for c in (*keys, "part", "class", "n"))
        links = BlockLinks(number, weight, t.column("vec").combine_chunks(), lambda n: tables_for(n, vectors, how), how)
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            # A class stands in a bucket once.
            if hi - lo > 1:
                links.add(lo, hi, bucket[lo], part, i[lo] == j[lo])
        return links.result()

    def work(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size += batch.nbytes
            if size > shared.BATCH_BYTES and held:
                where = [batch.column(c).to_numpy() for c in keys]
                last = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in keys]
                change = np.ones(batch.num_rows, bool)
                change[0] = any(w[0] != x for w, x in zip(where, last))
                change[1:] = np.any([w[1:] != w[:-1] for w in where], axis=0)
                if change.any():
                    cut = int(np.flatnonzero(change)[-1])
                    yield solve([*held, batch.slice(0, cut)])
                    held, batch = [], batch.slice(cut)
                    size = batch.nbytes
            held.append(batch)
        if held:
            yield solve(held)

    return shared.stored(rows.select(*keys, "part", "class", "n", "vec").mapInArrow(work, "u long, v long, n long"), "polytope-links")


def near_vectors(vectors: DataFrame, how: CrossPolytope = CrossPolytope()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, others, classes = by_class(vectors)
    count = classes.count()
    posted = posts(classes, count, how)
    found = linked(blocks(posted, how), classes, count, how)
    shared.discard(posted)
    links = found.where("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"), "polytope-components").withColumnRenamed("node", "class")
    named = classes.join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = shared.stored(named.select("vec", "n", "least", "root", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "polytope-named")
    smallest = shared.stored(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "polytope-roots")
    named = shared.with_groups(named.withColumnRenamed("n", "rows"), smallest, "root")
    named = shared.stored(named.select("vec", "n_links", "component_id", F.col("rows").alias("n")), "polytope-classes")
    out = shared.with_groups(rows, named, "vec").select("vec_id", "n_links", "component_id")
    out = out.unionByName(others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def op11_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9 * a.size * b.size
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
), n AS (
  SELECT u, count(*) AS n FROM l GROUP BY u
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
