"""The roles of the pipeline read out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.session import ship_package, table


#: More turns than a conversation, and more words than an utterance, can have.
TURNS = 1 << 32


def start(spark: SparkSession) -> None:
    ship_package(spark)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pID, utt_pos, speaker, full_text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("pID"), F.col("turn").alias("utt_pos"), F.col("role").alias("speaker"), F.col("text").alias("full_text"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pID (one per user turn) and its normalised tokens."""
    u = utterances(spark, sf_dir).where("speaker = 'user'")
    return u.select((F.col("pID") * TURNS + F.col("utt_pos")).alias("pID"), text.tokenize(text.normalize(F.col("full_text"))).alias("ref"))


def hypotheses(refs: DataFrame) -> DataFrame:
    """srcID, src_rank, pID, ref, hyp: the reference itself (Hand) and three fixed edits
    by token position."""
    r = F.col("ref")
    nothing = F.array().cast("array<string>")
    pick = lambda f: F.flatten(F.transform(r, f))
    edits = [
        ("Hand", 0, r),
        ("Det_drop", 1, pick(lambda t, i: F.when(i % 7 == 3, nothing).otherwise(F.array(t)))),
        ("Det_sub", 2, pick(lambda t, i: F.when((i % 5 == 1) & (i > 0), F.array(F.get(r, i - 1))).otherwise(F.array(t)))),
        ("Det_dup", 3, pick(lambda t, i: F.when(i % 11 == 5, F.array(t, t)).when(i % 7 == 3, nothing).otherwise(F.array(t)))),
    ]
    options = F.array(*[F.struct(F.lit(n).alias("srcID"), F.lit(k).alias("src_rank"), h.alias("hyp")) for n, k, h in edits])
    return refs.select("pID", "ref", F.explode(options).alias("x")).select("x.srcID", "x.src_rank", "pID", "ref", "x.hyp")


#: The same as SQL, one relation per step.
PAIRS_SQL = r"""
ref AS (
  SELECT conv_id * 4294967296 + turn AS pID, regexp_extract_all(trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g')), '[a-z0-9]+(?:''[a-z0-9]+)?') AS ref
  FROM conversations WHERE role = 'user'
), pairs AS (
  SELECT 'Hand' AS srcID, pID, ref, ref AS hyp FROM ref
  UNION ALL SELECT 'Det_drop', pID, ref, list_filter(ref, lambda t, i: (i - 1) % 7 <> 3) FROM ref
  UNION ALL SELECT 'Det_sub', pID, ref, list_transform(ref, lambda t, i: CASE WHEN (i - 1) % 5 = 1 THEN ref[i - 1] ELSE t END) FROM ref
  UNION ALL SELECT 'Det_dup', pID, ref, flatten(list_transform(ref, lambda t, i: CASE WHEN (i - 1) % 11 = 5 THEN [t, t] WHEN (i - 1) % 7 = 3 THEN [] ELSE [t] END)) FROM ref
), coded AS (
  SELECT srcID, pID, ref, hyp, list_distinct(list_concat(ref, hyp)) AS v FROM pairs
), errors AS (
  SELECT srcID, pID, len(ref) AS n, len(hyp) AS m,
         levenshtein(array_to_string(list_transform(ref, lambda t: chr(list_position(v, t)::INTEGER)), ''),
                     array_to_string(list_transform(hyp, lambda t: chr(list_position(v, t)::INTEGER)), '')) AS d
  FROM coded
), wer AS (
  SELECT srcID, pID, CASE WHEN n > 0 THEN d::DOUBLE / n WHEN m = 0 THEN 0.0 ELSE 1.0 END AS wer FROM errors
)
"""


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pID, dx, mmse, srcID, n_chars of labelled documents."""
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(la, "doc_id").select(
        F.col("doc_id").alias("pID"), F.when(F.col("quality") == 1, "Control").otherwise("ProbableAD").alias("dx"),
        F.pmod(F.col("n_chars"), F.lit(31)).cast("double").alias("mmse"), F.col("source").alias("srcID"), "lang", "n_chars",
    )


META_SQL = """
meta AS (
  SELECT d.doc_id AS pID, CASE WHEN quality = 1 THEN 'Control' ELSE 'ProbableAD' END AS dx, CAST(n_chars % 31 AS DOUBLE) AS mmse, source AS srcID, lang, n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)
"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """srcID (view stands for Hand), pID, value."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("srcID"), F.col("user_id").alias("pID"), "value")
