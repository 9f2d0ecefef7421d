"""Registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm import chunk_dedup, filter_audit, kmeans_tree, license_scan, line_dedup, line_quality, near_dups, preference, turn_repair
from repoloom.llm.sampling import id_bucket

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file installed on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_chunk_dedup")
def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every document without passages that an earlier document holds, and the documents that hold them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.dedup_chunks(docs).withColumn("kept_in", F.array_join(F.col("kept_in").cast("array<string>"), ","))


@query("op4_line_quality", line_quality.SQL)
def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return line_quality.quality_rules(table(spark, sf_dir, "documents"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line to remove, with the earlier line that it equals or that is one word away."""
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens."""
    from repoloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


@query("op1_preference_pairs", preference.SQL)
def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, chosen and rejected completion of one pair per conversation, with the trained spans."""
    rows = preference.format_pairs(preference.pairs_from_conversations(table(spark, sf_dir, "conversations")))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    return rows.withColumn("spans", spans)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id's crc32 is not 2 modulo 4."""
    from repoloom.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    return identify(docs, fit(docs.filter(~held_out)), held_out)


@query("op8_nbest_pieces")
def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, as digests, and whether decoding them gives the text again."""
    from repoloom.llm.nbest import encode_n_best

    return encode_n_best(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), n=4, with_ids=False)


@query("op9_nearest_vectors")
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of ids whose crc32 is not 1 modulo 3."""
    from repoloom.llm.toxicity import fit, score, with_held_out

    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 3) == 1
    scorer = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score(with_held_out(docs, held_out), scorer, keep=("doc_id", "held_out"))


@query("op11_filter_audit", filter_audit.SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes and repeats, for every source and every order of the filters."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_license_scan", license_scan.oracle())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases, and the licenses whose names or notices stand in each document."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@query("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest repair and its digest."""
    rows = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(rows), rows)
