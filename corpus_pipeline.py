"""The corpus pipeline over ``documents``: toxicity, near duplicates, repeated passages,
source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``. ``run`` writes each result as Parquet
in the shared folder and reads it again for the next stage.

Defined results for odd input, in every stage: an empty table stays empty; null texts are read
as empty (toxicity and near duplicates keep them as they are, repeated passages make them
empty); further columns, whatever their names, are kept by all stages but the last. Rows of
one doc_id are documents of their own, but for passages and mixing, where the same doc_id
means the same document and the same number of copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dup, packing, shared, suffix_levels, toxicity
from tessera.session import table

VOCABULARY = "byte_bpe_50k.json"
#: The shortest passage that counts as repeated has over 50 words.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores as toxic go. Without labels of both kinds none
    does; rows that are null or empty score by the base rate, which is below the limit."""
    shared.prepare(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, 0.8): the one with
    the smallest doc_id, among texts of that id the one with the smallest hash, and of a
    repeated row one. Rows without words or without a doc_id all stay."""
    shared.prepare(spark)
    return near_dup.without_near_duplicates(docs, near_dup.NearDup(shingle=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand in several documents, and 400-byte strings
    that stand at several places, are cut out of the texts. Characters that a cut would part
    stay whole; n_chars is counted anew; a text may become empty. Repeated rows lose what
    they share with each other in bytes."""
    shared.prepare(spark)
    return suffix_levels.without_repeats(docs, words=PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to their target weights and shuffled globally. A null source is a
    source; rows of one doc_id draw alike, null ids as one."""
    shared.prepare(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces are packed into sequences of 2048; an empty text is a piece of one token."""
    shared.prepare(spark)
    return packing.pack(shared.stored(packing.pieces(docs, public_tokenizers.path(VOCABULARY)), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.stored(docs, name.replace(" ", "-"))
    return docs
