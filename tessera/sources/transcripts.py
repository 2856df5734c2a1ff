"""Transcript sources and sinks: a catalogue of per-source folders read as one frame, and
a sink that only writes what is missing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import canonical
from tessera.sources import workbooks

#: Synonyms of the canonical transcript columns, in order.
SYNONYMS = {
    "speaker_id": ["pID", "Speaker", "speaker", "speaker_ID"],
    "word": ["text", "content", "result"],
    "s": ["s_ts", "start", "start_ts", "start_time", "t0"],
    "e": ["e_ts", "end", "end_ts", "end_time", "t1"],
    "uttID": ["utteranceID", "uID"],
}


@dataclass(frozen=True)
class Source:
    """One transcript source: a folder with one file per participant."""

    name: str
    path: str
    ext: str = "parquet"
    use_ids: tuple[str, ...] = field(default=())


def read_files(spark: SparkSession, path: str, ext: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Files of one kind below a folder; csv, tsv, parquet and xlsx."""
    kind = ext.lstrip(".").lower()
    if kind == "parquet":
        return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    if kind in ("csv", "tsv"):
        return spark.read.option("pathGlobFilter", f"*.{kind}").option("header", header).option("sep", "\t" if kind == "tsv" else sep).csv(path)
    if kind == "xlsx":
        return workbooks.read_workbooks(spark, path)
    raise ValueError(f"unsupported file type: {ext}")


def participant(source: str, file: str = "_metadata.file_name") -> Column:
    """The participant id in a file's name: all before the first dot; for source IU the
    first three parts between underscores, in lower case."""
    name = F.split(F.col(file), r"\.")[0]
    return F.lower(F.concat_ws("_", F.slice(F.split(name, "_"), 1, 3))) if source == "IU" else name


def read_source(spark: SparkSession, source: Source, place: tuple[str, str] | None = None) -> DataFrame:
    """srcID, pID and the canonical columns; numbers that cannot be read are null. With
    ``place`` two columns of these names order a file's rows: where the piece that was read
    begins, and the row in it."""
    raw = read_files(spark, source.path, source.ext)
    sheets = workbooks.FILE in raw.columns
    where = [F.lit(0).cast("long") if sheets else F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    order = [c.alias(n) for c, n in zip(where, place or ())]
    df = raw.select(participant(source.name, workbooks.FILE if sheets else "_metadata.file_name").alias("_pid"), *order, *(F.col(f"`{c}`") for c in raw.columns if c != workbooks.FILE))
    df = canonical(df, SYNONYMS).withColumns({"srcID": F.lit(source.name)}).withColumnRenamed("_pid", "_participant")
    for c in ("s", "e"):
        if c in df.columns:
            df = df.withColumn(c, F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None).cast("double")))
    if source.use_ids:
        df = df.where(F.col("_participant").isin(*source.use_ids))
    rest = [c for c in df.columns if c not in ("srcID", "_participant", "pID")]
    return df.select("srcID", F.col("_participant").alias("pID"), *rest)


def read_catalogue(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All sources as one frame with a srcID column."""
    frames = [read_source(spark, s) for s in sources]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_missing(df: DataFrame, path: str, keys: tuple[str, ...] = ("srcID", "pID")) -> DataFrame:
    """Append what is not yet written below ``path`` (partitioned by the first key) and
    return the rows written; running it again writes nothing."""
    done = written_keys(df.sparkSession, path, keys)
    fresh = df if done is None else df.join(done, list(keys), "left_anti")
    fresh.write.mode("append").partitionBy(keys[0]).parquet(path)
    return fresh


def written_keys(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame | None:
    """The distinct keys below ``path``, or nothing where nothing was written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.listStatus(where):
        return None
    return spark.read.parquet(path).select(*keys).distinct()


def read_vectors(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(token, id, vec) of a table whose first column is the index and whose others are
    the dimensions; ``id`` is unique."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    index, *dims = raw.columns
    vec = F.array(*(F.expr(f"try_cast(`{c}` AS double)") for c in dims))
    return raw.select(F.col(f"`{index}`").alias("token"), F.monotonically_increasing_id().alias("id"), vec.alias("vec"))


def read_entropy(spark: SparkSession, path: str) -> DataFrame:
    """(token, entropy) of a table with an index column."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("token"), F.expr(f"try_cast(`{raw.columns[1]}` AS double)").alias("entropy"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(token) of a list without header, a word a line, further columns apart by tabs."""
    raw = spark.read.option("header", False).option("sep", "\t").csv(path)
    return raw.select(F.trim("_c0").alias("token")).where("token <> ''").distinct()
