"""Streaming forms of the batch operators: running error profiles, sessions of talk, trailing
windows of tokens and incremental files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators.alignment import alignment_ops

UTTERANCES = T.StructType([
    T.StructField("pID", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("speaker", T.StringType()), T.StructField("full_text", T.StringType()),
])


def read_utterances(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of utterances; the checkpoint remembers what was read."""
    return spark.readStream.schema(UTTERANCES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def talk_sessions(utterances: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Per participant and speaker, stretches of talk with no longer gap; late rows are
    waited for up to the watermark."""
    u = utterances.withWatermark("ts", late)
    return u.groupBy(F.session_window("ts", gap), "pID", "speaker").agg(F.count(F.lit(1)).alias("n_utterances"), F.sum(F.size(text.tokenize(F.col("full_text")))).alias("n_tokens"))


def running_profile(pairs: DataFrame) -> DataFrame:
    """Counts of (op, ref, hyp) over a stream of (ref, hyp) token arrays, for update or
    complete output."""
    ops = pairs.select("ref", "hyp", F.explode(alignment_ops("ref", "hyp")).alias("o"))
    return ops.select("o.op", F.get("ref", "o.ref_idx").alias("ref"), F.get("hyp", "o.hyp_idx").alias("hyp")).groupBy("op", "ref", "hyp").agg(F.count(F.lit(1)).alias("n"))


def trailing_windows(tokens: DataFrame, width: int = 10) -> DataFrame:
    """(pID, pos, token, window) of (pID, pos, token): a token and up to ``width`` - 1 before it."""
    w = Window.partitionBy("pID").orderBy("pos").rowsBetween(1 - width, 0)
    return tokens.select("pID", "pos", "token", F.collect_list("token").over(w).alias("window"))


WINDOWS = T.StructType([T.StructField("pID", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("token", T.StringType()), T.StructField("window", T.ArrayType(T.StringType()))])
RECENT = T.StructType([T.StructField("last", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


def trailing_windows_stream(tokens: DataFrame, width: int = 10) -> DataFrame:
    """The same over a stream, for append output. A participant's state is the last ``width`` - 1
    tokens. Tokens are ordered inside a batch; one that is not behind the last position
    of its participant has come too late or twice, and is dropped, so a batch that is
    delivered again changes nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, recent = state.get if state.exists else (None, [])
        recent = list(recent)
        got = pd.concat([b[["pos", "token"]] for b in batches]).drop_duplicates("pos").sort_values("pos")
        if last is not None:
            got = got[got["pos"] > last]
        out = []
        for pos, token in zip(got["pos"].tolist(), got["token"].tolist()):
            recent = [*recent, token][-width:]
            out.append((key[0], pos, token, recent))
        if out:
            state.update((out[-1][1], recent[1 - width :] if width > 1 else []))
        yield pd.DataFrame(out, columns=WINDOWS.names)

    known = tokens.where("pID is not null and pos is not null and token is not null")
    return known.groupBy("pID").applyInPandasWithState(step, WINDOWS, RECENT, "append", "NoTimeout")
