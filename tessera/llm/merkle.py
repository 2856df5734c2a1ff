"""Merkle manifest of a table: one tree of leaf digests per group, one over the groups.

The leaves of a group stand in order. While a group has several nodes, every ``fanout``
consecutive ones become the hash of their hexadecimal digests, the last run of a level
with fewer, even one. What remains is the group's subroot; the subroots, in the order of
their groups, make the root in the same way.

Leaves get their positions from a range partitioning and prefix sums over partitions.
Aligned blocks of ``fanout ** depth`` leaves are gathered (a bound that no group's size
changes), each as one contiguous matrix of 64-byte digests that is reshaped by the fanout
and hashed row by row, level after level, into the block's top. The tops are the leaves of
the next tier, so a tree of N leaves takes log(N) / log(block) tiers, and no task ever
holds more than a block. The stored tiers are the manifest. Siblings are found going down:
a block gets the path above its top and adds its own levels, where the sibling run of leaf
i at level l follows from i // fanout ** l alone.

Defined results for odd input: a null field is hashed as such; null groups are one group,
before all others; in a group null ids come first, and rows of one id are ordered by their
leaf (equal rows are interchangeable); a table with one row has its leaf as root and no
siblings; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.session import table

#: Bytes of a hexadecimal digest.
HEX = 64
#: The tree over the subroots.
CROWN = "crown"


@dataclass(frozen=True)
class Shape:
    fanout: int = 2
    #: Levels of an aligned block; it has fanout ** depth leaves.
    depth: int = 12

    def block(self) -> int:
        return self.fanout**self.depth

    def height(self, nodes: int) -> int:
        """Levels until one node is left."""
        h = 0
        while nodes > 1:
            nodes, h = -(-nodes // self.fanout), h + 1
        return h


def digest(fields: list[Column]) -> Column:
    """sha256 of the fields one after the other: ``-`` if null, else UTF-8 bytes, ``:``, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def tree_key(group: Column) -> Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def positioned(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """The rows with ``pos`` (0 ..) and ``total`` in their tree, by ``order``. Rows that are
    equal in all of it are dealt over partitions by where they were read."""
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "tie"]
    sorted_ = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    sorted_ = shared.stored(sorted_, tag).withColumn("part", F.shiftright("at", 33))
    # One row for each partition of a tree.
    parts = sorted_.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("tree")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(every).alias("total"))
    placed = sorted_.join(parts, ["tree", "part"])
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


def matrix(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, HEX)


def _hashed(data: bytes, step: int) -> bytes:
    view = memoryview(data)
    return "".join([hashlib.sha256(view[i : i + step]).hexdigest() for i in range(0, len(data), step)]).encode()


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: whole runs are rows of the reshaped matrix; the rest is one more."""
    whole = len(nodes) // fanout * fanout
    above = _hashed(nodes[:whole].reshape(-1, fanout * HEX).tobytes(), fanout * HEX)
    if whole < len(nodes):
        above += _hashed(nodes[whole:].tobytes(), fanout * HEX)
    return matrix(above)


def levels(leaves: np.ndarray, fanout: int, height: int) -> list[np.ndarray]:
    """The leaves and ``height`` levels above them."""
    out = [leaves]
    for _ in range(height):
        out.append(parents(out[-1], fanout))
    return out


def _column_bytes(col: pa.ChunkedArray) -> bytes:
    """All values of a column of digests, one after the other."""
    return shared.utf8(pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string()))[0].tobytes()


TIER = "tree string, block long, total long, leaves binary, top string"


def tier(nodes: DataFrame, shape: Shape, tag: str, carried: dict[str, str]) -> DataFrame:
    """Stored blocks of ``nodes`` (tree, pos, total, leaf): one row per block with its
    digests as one binary and its top. ``carried`` (name: type) are further columns of the
    nodes, kept as arrays in order of position."""
    width, lists = shape.block(), list(carried)

    def work(key, rows):
        rows = rows.sort_by("pos")
        leaves = _column_bytes(rows.column("leaf"))
        total = rows.column("total")[0].as_py()
        top = levels(matrix(leaves), shape.fanout, min(shape.depth, shape.height(total)))[-1]
        whole = {c: pa.array([rows.column(c).to_pylist()], pa.list_(rows.column(c).type)) for c in lists}
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "total": [total], "leaves": pa.array([leaves], pa.binary()), "top": [top.tobytes().decode()], **whole})

    schema = ", ".join([TIER, *(f"`{c}` array<{t}>" for c, t in carried.items())])
    blocked = nodes.select("tree", F.expr(f"pos div {width}").alias("block"), "pos", "total", "leaf", *lists)
    return shared.stored(blocked.groupBy("tree", "block").applyInArrow(work, schema), tag)


def tiers(nodes: DataFrame, shape: Shape, tag: str, carried: dict[str, str]) -> list[DataFrame]:
    """The tiers over the nodes, until every tree has one block."""
    out = [tier(nodes, shape, tag, carried)]
    width = shape.block()
    while (out[-1].agg(F.max("total")).first()[0] or 0) > width:
        above = out[-1].select("tree", F.col("block").alias("pos"), F.expr(f"(total + {width - 1}) div {width}").alias("total"), F.col("top").alias("leaf"))
        out.append(tier(above, shape, tag, {}))
    return out


@dataclass
class Manifest:
    shape: Shape
    #: Tiers of the groups' trees, from the leaves up, and of the tree over the subroots.
    tiers: list[DataFrame]
    crown: list[DataFrame]
    #: tree, pos, subroot of every group.
    subroots: DataFrame
    carried: dict[str, str]


def manifest(leaves: DataFrame, order: list[str], shape: Shape = Shape(), carried: dict[str, str] | None = None) -> Manifest:
    """The manifest of ``leaves`` (tree, the ``order`` columns, leaf, ``carried``)."""
    carried = carried or {}
    own = tiers(positioned(leaves, order, "merkle-leaves"), shape, "merkle-tier", carried)
    tops = own[-1].select(F.lit(CROWN).alias("tree"), F.col("tree").alias("name"), F.col("top").alias("leaf"))
    subroots = shared.stored(positioned(tops, ["name"], "merkle-tops"), "merkle-subroots")
    crown = tiers(subroots, shape, "merkle-crown", {})
    return Manifest(shape, own, crown, subroots.select(F.col("name").alias("tree"), "pos", F.col("leaf").alias("subroot")), carried)


PATH = "array<struct<before string, after string>>"


def _siblings(nodes: np.ndarray, fanout: int) -> tuple[list[str], list[str]]:
    """What stands before and after each node in its run."""
    data, before, after = nodes.tobytes().decode(), [], []
    for j in range(len(nodes)):
        first = j // fanout * fanout
        last = min(first + fanout, len(nodes))
        before.append(data[first * HEX : j * HEX])
        after.append(data[(j + 1) * HEX : last * HEX])
    return before, after


def downward(own: DataFrame, above: DataFrame, shape: Shape, carried: dict[str, str]) -> DataFrame:
    """(tree, pos, leaf, path, subroot, root, carried) of every node of a tier, by the path
    ``above`` (tree, block, path, subroot, root) of its block's top."""
    names = ["tree", "pos", "leaf", "path", "subroot", "root", *carried]
    entry = pa.struct([("before", pa.string()), ("after", pa.string())])

    def one(row: dict) -> pa.RecordBatch:
        leaves = matrix(row["leaves"])
        n, height = len(leaves), min(shape.depth, shape.height(row["total"]))
        pool: list[tuple[str, str]] = []
        places = np.empty((n, height + len(row["path"])), np.int64)
        for l, nodes in enumerate(levels(leaves, shape.fanout, height)[:height]):
            places[:, l] = len(pool) + np.arange(n) // shape.fanout**l
            pool += zip(*_siblings(nodes, shape.fanout))
        places[:, height:] = len(pool) + np.arange(len(row["path"]))
        pool += [(x["before"], x["after"]) for x in row["path"]]
        pairs = pa.StructArray.from_arrays([pa.array([p[k] for p in pool], pa.string()) for k in (0, 1)], fields=list(entry))
        paths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * places.shape[1], pa.int32()), pairs.take(pa.array(places.ravel())))
        digests = row["leaves"].decode()
        same = [pa.array([row[c]] * n, pa.string()) for c in ("tree", "subroot", "root")]
        return pa.RecordBatch.from_arrays(
            [same[0], pa.array(row["block"] * shape.block() + np.arange(n)), pa.array([digests[i * HEX : (i + 1) * HEX] for i in range(n)]), paths, *same[1:], *(row[c] for c in carried)], names
        )

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("tree", "block", "total", "leaves", "path", "subroot", "root")}
                yield one(row | {c: batch.column(c)[i].values for c in carried})

    fields = ["block", "total", "leaves", *carried]
    schema = ", ".join([f"tree string, pos long, leaf string, path {PATH}, subroot string, root string", *(f"`{c}` {t}" for c, t in carried.items())])
    return own.select("tree", *fields).join(above, ["tree", "block"]).select("tree", *fields, "path", "subroot", "root").mapInArrow(work, schema)


def proofs(m: Manifest) -> DataFrame:
    """(tree, pos, leaf, path, subroot, root, carried) of every leaf: ``path`` has, level by
    level up to the root, the digests before and after the leaf's own node in its run."""
    top = m.crown[-1]
    nowhere = F.array().cast(PATH)
    above = top.select("tree", "block", nowhere.alias("path"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    for own in reversed(m.crown):
        found = downward(own, above, m.shape, {})
        above = found.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    above = above.withColumnRenamed("block", "pos").drop("tree", "subroot").join(m.subroots, "pos").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    above = shared.stored(above, "merkle-above")
    for k, own in reversed(list(enumerate(m.tiers))):
        found = downward(own, above, m.shape, {} if k else m.carried)
        above = found if not k else shared.stored(found.select("tree", F.col("pos").alias("block"), "path", "subroot", "root"), "merkle-above")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    return F.aggregate(path, leaf, lambda own, x: F.sha2(F.concat(x["before"], own, x["after"]), 256))


def beside(path: Column) -> Column:
    """All digests of a path, one after the other."""
    return F.concat_ws("", F.transform(path, lambda x: F.concat(x["before"], x["after"])))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, and the leaf ``claimed`` of a copy whose n_chars are one too many
    in every seventh document by the checksum of its id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = [F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(c) for c in FIELDS]
    return docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", digest([F.col(c) for c in FIELDS]).alias("leaf"), digest(changed).alias("claimed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    made = manifest(document_leaves(docs), ["doc_id", "leaf"], carried={"doc_id": dict(docs.dtypes)["doc_id"], "claimed": "string"})
    found = proofs(made).withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(beside(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))



#: The checksum bit by bit: digits are folded in, and after each one come eight steps.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')]),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT))"""


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (n_chars if f == "n_chars" else f for f in FIELDS)]
    return f"sha256({' || '.join(parts)})"


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + hit)')} AS claimed
  FROM (SELECT *, CASE WHEN {_CRC32} % 7 = 0 THEN 1 ELSE 0 END AS hit FROM documents)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM d
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, total FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (total + 1) // 2 FROM nodes WHERE total > 1 GROUP BY lang, level, pos // 2, total
), tops AS (
  SELECT lang, h, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1
), crown AS (
  SELECT 0 AS level, pos, h, total FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (total + 1) // 2 FROM crown WHERE total > 1 GROUP BY level, pos // 2, total
), root AS (
  SELECT h AS root, level AS height FROM crown WHERE total = 1
), ways AS (
  SELECT l.doc_id, l.lang, s.level, (l.pos >> s.level) & 1 AS odd, n.h FROM leaves l
  JOIN (SELECT DISTINCT lang, level FROM nodes WHERE total > 1) s ON s.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = s.level AND n.pos = xor(l.pos >> s.level, 1)
  UNION ALL
  SELECT l.doc_id, l.lang, t.height + s.level, (t.pos >> s.level) & 1, n.h FROM leaves l
  JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang
  JOIN (SELECT DISTINCT level FROM crown WHERE total > 1) s ON true
  LEFT JOIN crown n ON n.level = s.level AND n.pos = xor(t.pos >> s.level, 1)
), paths AS (
  SELECT doc_id, list(CASE WHEN h IS NULL THEN '-' WHEN odd = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS way, string_agg(h, '' ORDER BY level) AS beside FROM ways GROUP BY doc_id
), folds AS (
  SELECT l.doc_id, l.leaf, t.h AS subroot, r.root, sha256(coalesce(p.beside, '')) AS proof_sha256,
         list_reduce(coalesce(p.way, []), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END), l.claimed) AS folded_root
  FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root r LEFT JOIN paths p USING (doc_id)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
