"""Training-data pipeline over ``documents``: toxicity, line dedup, near-duplicates, repeated passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. ``run`` applies them to the documents of a folder.

Edge cases: an empty table gives no rows. A null text is never toxic, has no lines or passages, is near nothing, and is packed as the end
token. Rows that repeat a doc_id share their fate; rows with a null doc_id are scored and packed, and no dedup stage touches them. Further
columns of documents are carried to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm import chunk_dedup, line_dedup, near_dups, packing, toxicity
from repoloom.llm.queries import table, vocabulary
from repoloom.llm.sampling import id_bucket
from repoloom.session import ensure_checkpoint_dir


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.7; labels of a third of the ids are held out as in the query of the operator."""
    labels = table(spark, sf_dir, "labels").filter(id_bucket("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=tuple(docs.columns), names=("__score", "__toxic"))
    return scored.filter("__toxic = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly equal an earlier line.

    Where such lines make up 80 % of a document, it is a copy as a whole and stays whole: the next stage drops documents of that similarity.
    """
    return _recounted(line_dedup.dedup_lines(docs, spare=0.8))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words a shingle, similarity 0.8 or more."""
    return near_dups.keep_first(docs, k=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds; a document of nothing else goes."""
    cut = chunk_dedup.dedup_chunks(docs)
    removed = cut.columns[-2]  # its name differs where docs have a column n_removed
    emptied = (F.col(removed) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _recounted(cut.filter(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of sequences of 1024, with their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]

# Learned scores, chunk boundaries and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between them is written to the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
