"""Speaker labels for all recognised transcripts of a catalogue, as one run that can be
repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import alignment, utterances
from tessera.session import stored
from tessera.sources import transcripts

#: Fixed value: the label of a participant's own words.
PARTICIPANT = "PAR"


def placed(words: DataFrame) -> DataFrame:
    """Words with ``pos``, their number in their file. Files are read in pieces whose order
    is known by where they begin."""
    w = Window.partitionBy("srcID", "pID").orderBy("_start", "_row")
    return words.withColumn("pos", F.row_number().over(w) - 1).drop("_start", "_row")


def read_words(spark: SparkSession, sources: list[transcripts.Source]) -> DataFrame:
    """srcID, pID, pos, word, s, e, uttID, speaker_id of all sources; columns that a source
    lacks are null."""
    out = None
    for source in sources:
        one = transcripts.read_source(spark, source, ("_start", "_row"))
        for c, kind in (("word", "string"), ("s", "double"), ("e", "double"), ("uttID", "string"), ("speaker_id", "string")):
            one = one.withColumn(c, F.col(c).cast(kind) if c in one.columns else F.lit(None).cast(kind))
        one = one.select("srcID", "pID", "_start", "_row", "word", "s", "e", "uttID", "speaker_id")
        out = one if out is None else out.unionByName(one)
    return placed(out)


def label_catalogue(spark: SparkSession, sources: list[transcripts.Source], out: str, skip: tuple[str, ...] = (), keep: str | None = PARTICIPANT) -> DataFrame:
    """Label the words of all sources but the first, which is the reference, and append
    those of the participant below ``out`` (partitioned by source); returns what was written.
    Participants in ``skip`` or without a reference are left out. A source's participants
    that were written before are not aligned again, so a second run does nothing."""
    hand = read_words(spark, sources[:1]).where(~F.col("pID").isin(*skip)) if skip else read_words(spark, sources[:1])
    timed = utterances.fill_times(hand.where("uttID is not null"), ["pID", "uttID"], "pos").unionByName(hand.where("uttID is null"))
    hand = stored(timed.select("pID", "pos", "word", "s", "e", F.col("speaker_id").alias("speaker")), "label-reference")
    heard = read_words(spark, sources[1:]).join(hand.select("pID").distinct(), "pID", "left_semi")
    done = transcripts.written_keys(spark, out, ("srcID", "pID"))
    if done is not None:
        heard = heard.join(done, ["srcID", "pID"], "left_anti")
    heard = stored(heard.select("srcID", "pID", "pos", "word", "s", "e", "uttID"), "label-words")
    refs = hand.join(heard.select("srcID", "pID").distinct(), "pID")
    labelled = alignment.label_speakers(refs, heard, ["srcID", "pID"])
    named = labelled.withColumnRenamed("speaker_true", "speaker_id")
    kept = stored(named.where(F.col("speaker_id") == keep) if keep is not None else named, "label-kept")
    return transcripts.write_missing(kept, out)
