"""Session helpers shared by the queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "tessera", cores: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    n = cores or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":")
    if REPO not in have:
        env["PYTHONPATH"] = ":".join([REPO, *filter(None, have)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where it is
    unset, a local session gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="tessera-stored-"))
    return "file://" + _local_folder[0]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once however often it is
    used, and a lost executor costs a second read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-stored/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` has written, once no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tessera-stored")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
