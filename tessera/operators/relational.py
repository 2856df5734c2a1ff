"""Relational steps of the pipeline: metadata, availability, combination, positional
pairing, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import numbered


def canonical(df: DataFrame, synonyms: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their canonical names: the canonical name wins where it is present,
    otherwise the first synonym that is."""
    for name, others in synonyms.items():
        if name in df.columns:
            continue
        found = next((c for c in others if c in df.columns), None)
        if found is not None:
            df = df.withColumnRenamed(found, name)
        elif name in required:
            raise ValueError(f"no column for {name}")
    return df


def recode(column: Column, mapping: dict) -> Column:
    """Mapped values, others unchanged."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(table, column), column)


def merge_with_meta(features: DataFrame, meta: DataFrame, key: str = "pID") -> DataFrame:
    """Left join; Spark broadcasts the metadata when its measured size is small."""
    return features.join(meta, key, "left")


def availability(files: DataFrame, unit: str, source: str, sources: list[str]) -> DataFrame:
    """One 0/1 column per source."""
    return files.groupBy(unit).agg(*(F.max((F.col(source) == s).cast("int")).alias(s) for s in sources))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns; those that are not there are no error."""
    return df.drop(*names)


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, found with partial results of every task."""
    return df.orderBy(*order).limit(n)


def pair_by_position(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], part_a: str | None = None, part_b: str | None = None) -> DataFrame:
    """Rows of two frames paired by rank inside each part, or, without parts, in the whole
    frames."""
    ra = numbered(a, [part_a] if part_a else [], order_a, "_rn")
    rb = numbered(b, [part_b] if part_b else [], order_b, "_rn")
    same = ra["_rn"] == rb["_rn"]
    return ra.join(rb, (ra[part_a] == rb[part_b]) & same if part_a else same).drop(rb["_rn"])


def combine(base: DataFrame, tables: list[DataFrame], keys: list[str], required: list[str]) -> DataFrame:
    """Left joins on the keys, then only rows where all required values are known."""
    for t in tables:
        base = base.join(t, keys, "left")
    return base.na.drop(subset=required)


def order_by_mean(df: DataFrame, name: str, value: str) -> DataFrame:
    """name and its place by ascending mean, unknown means last."""
    mean = df.groupBy(name).agg(F.avg(value).alias("mean"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").asc_nulls_last(), name)))
