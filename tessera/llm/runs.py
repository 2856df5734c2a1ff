"""A family of immutable sorted runs, merged geometrically.

A run is a Parquet table bucketed by its key and sorted by it inside each bucket, so
probing and merging are merge joins of sorted buckets without a shuffle. Every new batch
becomes a run of level 0 after it has been probed against all older runs; two runs of
one level merge into one of the next, so n batches leave at most log2(n) + 1 runs and
each entry is rewritten at most log2(n) times. Runs that were merged are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared


@dataclass
class Run:
    name: str
    folder: str
    level: int


@dataclass(frozen=True)
class Value:
    """A column of a run: how it is gathered from a batch, and from two runs."""

    gather: Callable[[], Column]
    merge: Callable[[Column, Column], Column]


def added(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


#: How often a key occurs, its smallest and its largest document.
BY_DOCUMENT = {
    "n": Value(lambda: F.count(F.lit(1)), added),
    "lo": Value(lambda: F.min("doc"), F.least),
    "hi": Value(lambda: F.max("doc"), F.greatest),
}
#: How often a key occurs.
BY_NUMBER = {"n": Value(lambda: F.count(F.lit(1)), added)}


class SortedRuns:
    """Runs of (key, the columns of ``values``). ``state`` describes them; with it another
    session goes on where this one stopped."""

    def __init__(self, spark: SparkSession, tag: str, key: str, values: dict[str, Value]):
        self.spark, self.tag, self.key, self.values = spark, tag, key, values
        self.folder = shared.new_folder(spark, tag)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []
        # Each bucket is one sorted file: scans need not sort it again.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def state(self) -> dict:
        return {"tag": self.tag, "key": self.key, "folder": self.folder, "buckets": self.buckets, "runs": [[r.name, r.folder, r.level, self.spark.table(r.name).schema.json()] for r in self.runs]}

    @staticmethod
    def restored(spark: SparkSession, state: dict, values: dict[str, Value]) -> SortedRuns:
        """The runs of another session, whose tables this one has to be told of."""
        out = SortedRuns(spark, state["tag"], state["key"], values)
        out.folder, out.buckets = state["folder"], state["buckets"]
        for name, folder, level, schema in state["runs"]:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(schema)))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY (`{out.key}`) SORTED BY (`{out.key}`) INTO {out.buckets} BUCKETS LOCATION '{folder}'")
            out.runs.append(Run(name, folder, level))
        return out

    def _write(self, entries: DataFrame, level: int) -> Run:
        name = f"{self.tag}_{uuid.uuid4().hex}".replace("-", "_")
        folder = f"{self.folder}/{name}"
        (
            entries.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", folder)
            .option("compression", "zstd").option("parquet.block.size", 16 << 20).format("parquet").saveAsTable(name)
        )
        return Run(name, folder, level)

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")
        shared.remove(self.spark, run.folder)

    def add(self, batch: DataFrame) -> DataFrame:
        """Stored (key, values) over ``batch`` and all earlier ones for the keys of the
        batch that occur twice or more."""
        # The aggregation's own exchange has as many partitions as there are buckets.
        new = self._write(self._dealt(batch).groupBy(self.key).agg(*(v.gather().alias(c) for c, v in self.values.items())), 0)
        found = self.spark.table(new.name)
        for old in self.runs:
            found = self._join(found, self.spark.table(old.name), "left")
        found = shared.stored(found.where("n > 1"), self.tag + "-found")
        self.runs.append(new)
        while len(self.runs) > 1 and self.runs[-1].level == self.runs[-2].level:
            b, a = self.runs.pop(), self.runs.pop()
            merged = self._join(self.spark.table(a.name), self.spark.table(b.name), "full")
            self.runs.append(self._write(merged, a.level + 1))
            self._drop(a)
            self._drop(b)
        return found

    def _dealt(self, batch: DataFrame) -> DataFrame:
        """By key into as many partitions as there are buckets, where the session's own number
        of partitions is another one."""
        same = int(self.spark.conf.get("spark.sql.shuffle.partitions")) == self.buckets
        return batch if same else batch.repartition(self.buckets, self.key)

    def _join(self, a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        b = b.select(self.key, *(F.col(c).alias(c + "_") for c in self.values))
        both = a.hint("merge").join(b, self.key, how)
        return both.select(self.key, *(v.merge(F.col(c), F.col(c + "_")).alias(c) for c, v in self.values.items()))

    def close(self) -> None:
        """Delete the index; without it, later batches could be added."""
        for run in self.runs:
            self._drop(run)
        self.runs = []
        shared.remove(self.spark, self.folder)
