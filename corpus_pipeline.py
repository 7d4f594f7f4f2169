"""A corpus cleaned in five stages, each one of the training-data operators over all that the stage before kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import scratch
from folio.llm.bpe import encode_texts
from folio.llm.decontaminate import drop_contaminated
from folio.llm.jaccard import jaccard_components
from folio.llm.linededup import dedup_lines
from folio.llm.toxicity import score_column, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a calibrated score under 0.5. Null and empty texts score as such; extra columns are dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = score_column(spark, train(docs, labels, "doc_id", "text", "toxic"), F.col("text"))
    return docs.select(*COLUMNS).withColumn("score", score).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated occurrences of cross-site boilerplate lines; ``n_chars`` follows the text.

    A document may end up empty and stays. A null text stays null and keeps its ``n_chars``.
    """
    out = dedup_lines(docs.select(*COLUMNS), "doc_id", "text", "source")
    n_chars = F.when(F.size("removed") > 0, F.length("clean").cast("long")).otherwise(F.col("record.n_chars"))
    return out.select("record.doc_id", F.col("clean").alias("text"), "record.lang", "record.source", n_chars.alias("n_chars"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id. Empty texts and null ids are in no group.

    Rows of one id are one document and stay or go together.
    """
    found = jaccard_components(docs, "doc_id", "text")
    gone = scratch.materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's shingles."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document left."""
    return encode_texts(docs, "doc_id", "text")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard", jaccard), ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]

#: The trees' scores can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
