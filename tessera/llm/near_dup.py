"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents with equal shingle sets form a class and go on as one. Each class is posted
under its (coordinate, value) pairs; pairs nobody shares are dropped, and a class with
fewer shared ones than the match threshold has no partner. Two classes that match in
``matches`` of ``coordinates`` places share one of their rarest ``shared - matches + 1``
pairs (prefix), so only those are joined; the other places are compared (skipped to)
only for classes that met there. Candidates over the match threshold are confirmed on
the full shingle sets.

Groups of very many near copies are not expanded into pairs. First every class is tested
against the most central class under its prefix pairs only, and components are formed.
Then, where posting lists still have several components, the collisions of their members
outside the largest component with all members are counted in the same way (prefix, skip,
threshold, full sets), in blocks of bounded size, and only links leave a block. So every
pair is either connected already or counted. A value that most documents share is never
joined on: it comes last in the order, and the last ``matches - 1`` pairs of a class are
outside its prefix.

The match threshold is set so that a pair exactly at the similarity limit is missed with
a probability of at most ``miss`` (1e-7).

Defined results for odd input: texts without words have no shingles and no links; a null
doc_id is a document of its own row with component null, kept; rows of one doc_id are
separate documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.components import components, forest_roots
from tessera.session import table


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    percent: int = 80
    coordinates: int = 64
    miss: float = 1e-7
    #: About as many rows and bytes of sets as meet in one block.
    block: int = 2048
    block_bytes: int = 8 << 20

    def matches(self) -> int:
        """Least number of equal coordinates that a pair at the limit has, but for a
        probability of ``miss``."""
        p, k, tail = self.percent / 100, self.coordinates, 0.0
        for t in range(k + 1):
            tail += comb(k, t) * p**t * (1 - p) ** (k - t)
            if tail > self.miss:
                return max(t, 1)
        return k


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = shared.mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:k], seeds[k:] | np.uint64(1)


def shingle_sets(col: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after the other, and the number
    per row."""
    raw, offs = shared.utf8(col)
    begin, end, firsts = shared.word_bounds(raw, offs)
    roll = shared.Rolling(shared.word_hashes(raw, begin, end, lower=True))
    sets = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b == a:
            sets.append(np.zeros(0, np.uint64))
            continue
        at = np.arange(a, max(b - shingle, a) + 1)
        sets.append(np.unique(roll.of(at, np.minimum(at + shingle, b))))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Upper 32 bits of the smallest permuted hash per coordinate, rows x k; rows
    without shingles are left out."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), k), np.uint32)
    xors, odds = _multipliers(k)
    with np.errstate(over="ignore"):
        for i in range(k if len(starts) else 0):
            out[:, i] = np.minimum.reduceat((sets ^ xors[i]) * odds[i], starts) >> np.uint64(32)
    return out


def described(docs: DataFrame, how: NearDup) -> DataFrame:
    """Stored rows (doc_id, mark, n_shingles, class, class2, sig): the class is two
    independent sums over the shingle set."""

    def work(batches):
        for batch in batches:
            for some in shared.text_slices(batch, "text"):
                sets, sizes = shingle_sets(some.column("text"), how.shingle)
                has = sizes > 0
                sig = signatures(sets, sizes, how.coordinates)
                starts = (np.cumsum(sizes) - sizes)[has]
                one, two = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                if len(starts):
                    one[has] = shared.mix64(np.add.reduceat(shared.mix64(sets), starts))
                    two[has] = np.add.reduceat(shared.mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(has, how.coordinates, 0))]).astype(np.int32)), pa.array(sig.reshape(-1).view(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("mark"), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
                    ["doc_id", "mark", "n_shingles", "class", "class2", "sig"],
                )

    text = shared.whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return shared.stored(rows.mapInArrow(work, "doc_id long, mark long, n_shingles long, class long, class2 long, sig array<int>"), "near-rows")


def posting_lists(classes: DataFrame, how: NearDup) -> DataFrame:
    """Stored (class, tokens, prefix, weight) of classes with enough shared pairs:
    tokens (f, t, k) ascend in frequency, the first ``prefix`` of them are joined."""
    least = how.matches()
    posted = classes.select("class", F.posexplode("sig").alias("k", "v")).select("class", F.expr("(cast(k as long) << 32) | (cast(v as long) & 4294967295L)").alias("t"))
    often = posted.groupBy("t").agg(F.count(F.lit(1)).cast("int").alias("f")).where("f > 1")
    kept = posted.join(often, "t").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("tokens"))
    kept = kept.where(F.size("tokens") >= least)
    weight = F.aggregate("tokens", F.lit(0.0), lambda a, x: a + F.ln(x["f"].cast("double")))
    return shared.stored(kept.select("class", "tokens", (F.size("tokens") - least + 1).alias("prefix"), F.round(weight, 6).alias("weight")), "near-lists")


def _prefix_postings(lists: DataFrame) -> DataFrame:
    return lists.select("class", "weight", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("x")).select("class", "weight", "x.t")


def hub_pairs(lists: DataFrame, how: NearDup) -> DataFrame:
    """For each class its best central partner over the match threshold: (u, v)."""
    posts = _prefix_postings(lists)
    hubs = posts.groupBy("t").agg(F.max(F.struct("weight", "class"))["class"].alias("hub"))
    met = posts.join(hubs, "t").where("class <> hub").groupBy("class", "hub").agg(F.count(F.lit(1)).alias("met"))
    mine = lists.select("class", F.col("tokens.t").alias("a"))
    theirs = lists.select(F.col("class").alias("hub"), F.col("tokens.t").alias("b"))
    counted = met.join(mine, "class").join(theirs, "hub").select("class", "hub", F.size(F.array_intersect("a", "b")).alias("n"))
    best = counted.where(F.col("n") >= how.matches()).groupBy("class").agg(F.max(F.struct("n", "hub"))["hub"].alias("v"))
    return best.select(F.col("class").alias("u"), "v")


def confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    a = sets.select(F.col("class").alias("u"), F.col("set").alias("x"))
    b = sets.select(F.col("class").alias("v"), F.col("set").alias("y"))

    def work(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                good.append(100 * both >= how.percent * (len(p) + len(q) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])

    # Sizes alone rule out most false candidates before sets meet.
    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(work, "u long, v long")


def full_sets(docs: DataFrame, places: DataFrame, how: NearDup) -> DataFrame:
    """Stored (class, set) of the classes in ``places`` (class, doc_id, mark, many), one row
    a class: a row that is repeated (only where the class has ``many`` rows) gives its set
    several times, of which one is kept."""

    def work(batches):
        for batch in batches:
            for some in shared.text_slices(batch, "text"):
                sets, sizes = shingle_sets(some.column("text"), how.shingle)
                raw, ends = sets.tobytes(), np.cumsum(sizes) * 8
                yield pa.RecordBatch.from_arrays(
                    [some.column("class"), some.column("many"), pa.array([raw[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())], ["class", "many", "set"]
                )

    text = shared.whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = rows.join(places, ["doc_id", "mark"]).select("class", "many", "text")
    found = shared.stored(found.mapInArrow(work, "class long, many boolean, set binary"), "near-sets")
    once = shared.stored(found.where("many").select("class", "set").dropDuplicates(["class"]), "near-once")
    return found.where("not many").select("class", "set").unionByName(once)


def _inverted(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the rows in order, and the row that has each."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(rows)), np.array([len(x) for x in rows], np.int64))[order]


def _found(flat: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in the ordered ``flat`` of every occurrence of the values."""
    lo = np.searchsorted(flat, values, "left")
    n = np.searchsorted(flat, values, "right") - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def remaining_links(lists: DataFrame, roots: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Stored links (u, v) between the roots of components, from the posting lists that still have
    several. The members of all lists with one largest component meet by it; those
    outside it are counted against all others by their collisions, in blocks bounded by
    rows and bytes, and give at most one link to each component: classes that meet under a
    prefix pair are counted on all their shared pairs, and those over the match threshold
    on the full sets. No pair of the same component is looked at and no unlinked pair
    leaves a task."""
    least = how.matches()
    known = lists.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    posts = known.select("class", "root", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))["t"]).alias("t"))
    per_root = posts.groupBy("t", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = per_root.groupBy("t").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most").select("t", "main")
    member = posts.join(shared.stored(open_, "near-open"), "t").select("main", "class", "root").distinct()
    member = member.join(sets.select("class", F.octet_length("set").alias("size")), "class").withColumn("outside", F.col("root") != F.col("main"))
    member = shared.stored(member, "near-members")
    blocks = lambda test: F.greatest(F.ceil(F.count_if(test) / how.block), F.ceil(F.sum(F.when(test, F.col("size")).otherwise(0)) / how.block_bytes)).cast("int")
    shape = shared.stored(member.groupBy("main").agg(blocks(F.lit(True)).alias("right"), blocks(F.col("outside")).alias("left")), "near-shape")
    placed = member.join(shape, "main")
    mine = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = placed.select("main", "class", "root", every("left").alias("i"), mine("right").alias("j"), F.lit(False).alias("asks"))
    left = placed.where("outside").select("main", "class", "root", mine("left").alias("i"), every("right").alias("j"), F.lit(True).alias("asks"))
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = lists.select("class", "prefix", F.col("tokens.t").alias("token"))
    met = right.unionByName(left).join(sets, "class").join(marked, "class").repartition(parts, "main", "i", "j").sortWithinPartitions("main", "i", "j", "asks")

    def group(t: pa.Table, us: list, vs: list) -> None:
        asks = t.column("asks").to_numpy()
        mid = int(np.searchsorted(asks, True))
        root = t.column("root").to_numpy()
        tokens = [x.values.to_numpy() for x in t.column("token")]
        prefix = t.column("prefix").to_numpy()
        heads = [x[:n] for x, n in zip(tokens, prefix.tolist())]
        flat, owner = _inverted(heads[:mid])
        long = np.array([len(x) for x in tokens])
        places, first = np.concatenate(tokens), np.cumsum(long) - long
        sets: list = []
        for x in range(mid, t.num_rows):
            met = np.unique(owner[_found(flat, heads[x])])
            met = met[root[met] != root[x]]
            if not len(met):
                continue
            # Skipped to: the other places of the classes that met.
            at = np.repeat(first[met] - (np.cumsum(long[met]) - long[met]), long[met]) + np.arange(long[met].sum())
            same = np.add.reduceat(np.isin(places[at], tokens[x]).astype(np.int64), np.cumsum(long[met]) - long[met])
            met = met[same >= least]
            if not len(met):
                continue
            if not sets:
                values = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("set")]
                sets = [values, np.array([len(v) for v in values]), *_inverted(values[:mid])]
            values, sizes, shingles, holder = sets
            both = np.bincount(holder[_found(shingles, values[x])], minlength=mid)[met]
            y = met[100 * both >= how.percent * (sizes[met] + sizes[x] - both)]
            if len(y):
                y = y[np.unique(root[y], return_index=True)[1]]
                us.append(np.full(len(y), root[x]))
                vs.append(root[y])

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([t.column(c).to_numpy() for c in ("main", "i", "j")])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), t.num_rows]
        us: list = []
        vs: list = []
        for a, b in zip(cuts, cuts[1:]):
            group(t.slice(a, b - a), us, vs)
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *us])), pa.array(np.concatenate([none, *vs]))], ["u", "v"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            size += batch.nbytes
            if size > how.block_bytes and batch.num_rows:
                keys = np.stack([batch.column(c).to_numpy() for c in ("main", "i", "j")])
                change = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
                if len(change):
                    cut = int(change[-1])
                    yield solve([*held, batch.slice(0, cut)])
                    held, batch = [], batch.slice(cut)
                    size = batch.nbytes
            if batch.num_rows:
                held.append(batch)
        if held:
            yield solve(held)

    cols = ["main", "i", "j", "asks", "root", "prefix", "token", "set"]
    return shared.stored(met.select(*cols).mapInArrow(work, "u long, v long").distinct(), "near-rest")


def _joined_up(roots: DataFrame, upper: DataFrame) -> DataFrame:
    """The roots after their own components ``upper`` (node, root) are applied; nodes that
    only ``upper`` knows were components of one class."""
    upper = shared.stored(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "near-upper")
    alone = upper.select(F.col("root").alias("node")).join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.unionByName(alone).join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, mark, n_shingles, root, component_id, kept for every row. The root tells components
    apart that have the same smallest doc_id, as two texts of one doc_id can."""
    rows = described(docs, how)
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("class", "class2").agg(F.min(F.struct("doc_id", "mark")).alias("place"), F.min("sig").alias("sig"), (F.count(F.lit(1)) > 1).alias("many"))
    lists = posting_lists(classes.select("class", "sig"), how)
    first = shared.stored(hub_pairs(lists, how), "near-hubs")
    # Every class that can have a partner; the texts are shuffled once for all of them.
    places = classes.select("class", "place.doc_id", "place.mark", "many").join(lists.select("class"), "class", "left_semi")
    sets = full_sets(docs, places, how)
    links = shared.stored(confirmed(first, sets, how), "near-links")
    # A partner is always the more central of the two: these links are a forest.
    roots = shared.stored(forest_roots(links, "near-forest"), "near-roots")
    more = remaining_links(lists, roots, sets, how)
    if not more.isEmpty():
        roots = shared.stored(_joined_up(roots, components(more, "near-components")), "near-roots")
    own = usable.groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    own = own.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    own = shared.stored(own, "near-classes")
    groups = shared.stored(own.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "near-groups")
    named = shared.stored(shared.with_groups(own.select("class", "root", F.col("n").alias("rows")), groups, "root"), "near-named")
    slim = ["doc_id", "mark", "n_shingles"]
    linked = shared.with_groups(usable.select(*slim, "class"), named.select("class", "root", "component_id", F.col("rows").alias("n")), "class")
    alone = rows.where("not (n_shingles > 0 and doc_id is not null)").select(*slim, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    out = linked.select(*slim, "root", "component_id").unionByName(alone)
    return out.select(*slim, "root", "component_id", (F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest (doc_id, text hash). Texts of
    one doc_id that are not linked are components of their own.
    Rows without words are all kept. Only what goes is joined back, by key."""
    found = shared.stored(near_duplicates(docs, how).select("doc_id", "mark", "n_shingles", "root", "component_id"), "near-found")
    linked = found.where("n_shingles > 0 and doc_id is not null")
    first = linked.groupBy("root").agg(F.min(F.when(F.expr("doc_id = component_id"), F.col("mark"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = shared.with_groups(linked, shared.stored(first, "near-first"), "root").where("doc_id <> component_id or mark <> stays").select(F.col("doc_id").alias("gone_doc"), F.col("mark").alias("gone_mark")).distinct()
    text = shared.whole_text()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("mark"))
    rows = rows.join(gone, (F.col("doc") == F.col("gone_doc")) & (F.col("mark") == F.col("gone_mark")), "left_anti")
    # The same row several times: only where the slim table shows any.
    again = linked.where("doc_id = component_id").groupBy("doc_id", "mark").count().where("count > 1")
    if not again.isEmpty():
        # Rows of no such key, among them those without words or doc_id, are left alone.
        twice = again.select(F.col("doc_id").alias("twice_doc"), F.col("mark").alias("twice_mark"))
        same = (F.col("doc") == F.col("twice_doc")) & (F.col("mark") == F.col("twice_mark"))
        rows = rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc", "mark"]))
    return rows.select("row.*")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"), NearDup(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), x AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM w
), g AS (
  SELECT doc_id, n, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM x
), s AS (
  SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(n - 2, 1)
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN z a ON a.doc_id = u JOIN z b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""
