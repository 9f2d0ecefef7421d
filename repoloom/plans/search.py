"""Embedding and similarity-search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.operators import embedding as em
from repoloom.operators import pruned_search as ps
from repoloom.operators import search as se
from repoloom.operators.chunking import word_chunks
from repoloom.operators.run_totals import embedding_totals, write_observed
from repoloom.plans.catalog import register
from repoloom.plans.corpus import _CHUNK_SQL, _fresh_store
from repoloom.plans.views import table
from repoloom.session import cut_lineage
from repoloom.sources.store import save_bucketed


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean vector of the label's rows."""
    parts = vectors(spark, sf_dir).select("label", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One number per dimension, so each list is as long as a vector.
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("query_vector")
    ).select(F.col("label").cast("long").alias("query_id"), "query_vector")


QUERY_SQL = """q AS (
  SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS query_vector FROM (
    SELECT label, i, avg(x) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label),
scored AS (
  SELECT query_id, vec_id, round(list_inner_product(query_vector, embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
  WHERE rank <= {k})"""


@register("c7_e5_top_k_search", f"WITH {QUERY_SQL.format(k=30)} SELECT query_id, vec_id, score, rank FROM hits")
def top_k_search(spark, sf_dir):
    return se.top_k(vectors(spark, sf_dir), label_queries(spark, sf_dir), 30)


@register("e5_store_top_k_grid", f"WITH {QUERY_SQL.format(k=20)} SELECT query_id, vec_id, score, rank FROM hits")
def store_top_k_grid(spark, sf_dir):
    """Queries in several blocks, as a side too large for one broadcast takes them."""
    return se.top_k(
        vectors(spark, sf_dir), label_queries(spark, sf_dir), fixed.STORE_TOP_K, max_broadcast_values=300
    )


@register(
    "c1_hits_to_documents",
    f"""WITH {QUERY_SQL.format(k=30)} SELECT h.query_id, h.rank, h.vec_id, h.score, e.label::BIGINT AS label
    FROM hits h JOIN embeddings e USING (vec_id)""",
)
def hits_to_documents(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hits = se.top_k(v, label_queries(spark, sf_dir), 30)
    return se.hit_texts(hits, v.select("vec_id", "label")).select("query_id", "rank", "vec_id", "score", "label")


_HIT_TEXT_SQL = f"""WITH {QUERY_SQL.format(k=30)},
texts AS (SELECT h.query_id, h.rank, 'src/' || source || '.md' AS file_path, text FROM hits h JOIN documents ON doc_id = vec_id),
per_file AS (SELECT query_id, file_path, min(rank) AS first_rank, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS body,
  count(*) AS texts FROM texts GROUP BY 1, 2)"""


def _text_hits(spark, sf_dir):
    v = vectors(spark, sf_dir).drop("label")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.concat(F.lit("src/"), "source", F.lit(".md")).alias("file_path"), "text"
    )
    return se.hit_texts(se.top_k(v, label_queries(spark, sf_dir), 30), docs)


@register("d2_hits_by_file", _HIT_TEXT_SQL + " SELECT query_id, file_path, first_rank, body, texts FROM per_file")
def hits_by_file(spark, sf_dir):
    return se.hits_by_file(_text_hits(spark, sf_dir)).select(
        "query_id", "file_path", "first_rank", F.array_join("texts", "\n\n").alias("body"),
        F.size("texts").alias("texts"),
    )


@register(
    "h30_context_blocks",
    _HIT_TEXT_SQL
    + """ SELECT query_id, chr(10) || chr(10) || '----------' || string_agg('## File Path: ' || file_path || chr(10) || chr(10) || body,
    chr(10) || chr(10) ORDER BY first_rank) AS context_text FROM per_file GROUP BY 1""",
)
def context_blocks(spark, sf_dir):
    return se.context_blocks(_text_hits(spark, sf_dir))


_HOLES = "CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 7 = 1 THEN [] WHEN vec_id % 3 = 0 THEN embedding[1:32] ELSE embedding END"
_HOLES_SQL = f"holes AS (SELECT vec_id, label, {_HOLES} AS vector FROM embeddings)"


def holes(spark, sf_dir):
    """Vectors with null, empty and short ones among them."""
    v = F.col("vector")
    return vectors(spark, sf_dir).withColumn(
        "vector",
        F.when(F.col("vec_id") % 7 == 0, F.lit(None))
        .when(F.col("vec_id") % 7 == 1, F.array().cast("array<float>"))
        .when(F.col("vec_id") % 3 == 0, F.slice(v, 1, 32))
        .otherwise(v),
    )


@register("b9_valid_vectors", f"WITH {_HOLES_SQL} SELECT vec_id, len(vector) AS size FROM holes WHERE len(vector) > 0")
def valid_vectors(spark, sf_dir):
    return em.valid_vectors(holes(spark, sf_dir)).select("vec_id", F.size("vector").cast("long").alias("size"))


@register(
    "d1_majority_size",
    f"""WITH {_HOLES_SQL}, sizes AS (SELECT len(vector) AS s, count(*) AS n, min(vec_id) AS first FROM holes WHERE len(vector) > 0 GROUP BY 1)
    SELECT vec_id, label::BIGINT AS label FROM holes WHERE len(vector) = (SELECT s FROM sizes ORDER BY n DESC, first LIMIT 1)""",
)
def majority_size(spark, sf_dir):
    return em.majority_size(holes(spark, sf_dir)).select("vec_id", "label")


@register(
    "g6_vector_sizes",
    f"""WITH {_HOLES_SQL} SELECT len(vector) AS vector_size, count(*) AS vectors, min(vec_id) AS first_position
    FROM holes WHERE len(vector) > 0 GROUP BY 1""",
)
def vector_sizes(spark, sf_dir):
    return em.vector_sizes(holes(spark, sf_dir))


@register(
    "e7_batch_numbers",
    "SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 10)::BIGINT AS batch_no FROM embeddings",
)
def batch_numbers(spark, sf_dir):
    return em.batch_numbers(vectors(spark, sf_dir).select("vec_id"), "vec_id", 10)


@register(
    "d8_embedding_stats",
    f"""WITH {_HOLES_SQL} SELECT label::BIGINT AS label, count(*) AS total, count(*) FILTER (len(vector) > 0) AS valid,
    count(*) FILTER (NOT coalesce(len(vector) > 0, false)) AS empty, count(*) FILTER (vector IS NULL) AS failed FROM holes GROUP BY 1""",
)
def embedding_stats(spark, sf_dir):
    run = holes(spark, sf_dir).withColumn("embed_status", F.when(F.col("vector").isNull(), "error").otherwise("ok"))
    return em.embedding_stats(run, ["label"])


@register(
    "u2_normalise",
    """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, round(unnest(list_transform(embedding, lambda x: x::DOUBLE * 3 / n)), 6) AS value FROM (
    SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) * (x::DOUBLE * 3)))) AS n FROM embeddings)""",
)
def normalise(spark, sf_dir):
    tripled = F.transform("vector", lambda x: x.cast("double") * 3)
    unit = em.normalise(tripled)
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(unit).alias("i", "value")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value")
    )


@register(
    "u2_inner_product",
    """SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def inner_product(spark, sf_dir):
    a = vectors(spark, sf_dir).select("vec_id", "vector")
    b = vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    return a.join(b, "vec_id").select("vec_id", se.similarity(F.col("vector"), F.col("other")).alias("score"))


_EMBED_SQL = """words AS (
  SELECT {id} AS id, unnest(string_split(text, ' ')) AS w FROM {table}),
buckets AS (
  SELECT id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 256) AS bucket, count(*)::DOUBLE AS n FROM words WHERE w <> '' GROUP BY 1, 2),
weights AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM buckets)"""


@register(
    "u1_embed_questions",
    f"WITH {_EMBED_SQL.format(id='item_id', table='benchmark')} SELECT id AS item_id, bucket, round(weight, 4) AS weight FROM weights",
)
def embed_questions(spark, sf_dir):
    rows = em.embed_texts(table(spark, sf_dir, "benchmark"), em.hashing_embedder, batch=10)
    return rows.select("item_id", F.posexplode("vector").alias("bucket", "w")).filter("w <> 0").select(
        "item_id", "bucket", F.round(F.col("w").cast("double"), 4).alias("weight")
    )


_RETRIEVAL_SQL = f"""WITH {_EMBED_SQL.format(id='item_id', table='benchmark').replace('words AS', 'q_words AS').replace('FROM words', 'FROM q_words')
  .replace('buckets AS', 'q_buckets AS').replace('FROM buckets', 'FROM q_buckets').replace('weights AS', 'q AS')},
chunks AS ({_CHUNK_SQL.format(size=1000, step=700).replace('words AS', 'WITH words AS', 1)}),
numbered AS (SELECT doc_id * (SELECT max(chunk_no) + 1 FROM chunks) + chunk_no AS vec_id, text FROM chunks),
{_EMBED_SQL.format(id='vec_id', table='numbered').replace('words AS', 'c_words AS').replace('FROM words', 'FROM c_words')},
scored AS (SELECT q.id AS query_id, c.id AS vec_id, round(sum(q.weight::FLOAT::DOUBLE * c.weight::FLOAT::DOUBLE), 6) AS score
  FROM q JOIN weights c ON q.bucket = c.bucket GROUP BY 1, 2)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 30"""


def _chunk_vectors(spark, sf_dir):
    chunks = word_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    embedded = em.valid_vectors(em.embed_texts(chunks, em.hashing_embedder)).select("doc_id", "chunk_no", "vector")
    embedded = cut_lineage(embedded)
    # As many places per document as the longest one has chunks: ids are distinct and in order, and an overflow raises.
    places = (embedded.agg(F.max("chunk_no")).first()[0] or 0) + 1
    return embedded.select((F.col("doc_id") * F.lit(places).cast("long") + F.col("chunk_no")).alias("vec_id"), "vector")


def _questions(spark, sf_dir):
    asked = em.embed_texts(table(spark, sf_dir, "benchmark"), em.hashing_embedder)
    return asked.select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"))


@register("u1_question_retrieval", _RETRIEVAL_SQL)
def question_retrieval(spark, sf_dir):
    """Benchmark texts against all document chunks: chunks are embedded and stored once, then searched in one pass."""
    path, _ = _fresh_store(spark, "balls")
    ps.write_balls(_chunk_vectors(spark, sf_dir), path, stored=True)
    return ps.search(spark, path, _questions(spark, sf_dir), 30)


@register("e5_pruned_search", f"WITH {QUERY_SQL.format(k=30)} SELECT query_id, vec_id, score, rank FROM hits")
def pruned_search(spark, sf_dir):
    """The search over all vectors from stored balls."""
    path, _ = _fresh_store(spark, "balls")
    ps.write_balls(vectors(spark, sf_dir), path, block_rows=32)
    return ps.search(spark, path, label_queries(spark, sf_dir), 30)


@register(
    "c1_bucketed_documents",
    f"""WITH {QUERY_SQL.format(k=30)} SELECT h.query_id, h.rank, h.vec_id, h.score, e.label::BIGINT AS label
    FROM hits h JOIN embeddings e USING (vec_id)""",
)
def bucketed_documents(spark, sf_dir):
    """Hits joined to rows that are stored in buckets of their id."""
    path, _ = _fresh_store(spark, "bucketed")
    v = vectors(spark, sf_dir)
    stored = save_bucketed(v.select("vec_id", "label"), f"bucketed_{uuid.uuid4().hex}", path, "vec_id", 16)
    hits = se.top_k(v, label_queries(spark, sf_dir), 30)
    return se.hit_texts(hits, stored).select("query_id", "rank", "vec_id", "score", "label")


@register(
    "d8_observed_totals",
    f"""WITH {_HOLES_SQL} SELECT count(*) AS total, count(*) FILTER (len(vector) > 0) AS valid,
    count(*) FILTER (NOT coalesce(len(vector) > 0, false)) AS empty, count(*) FILTER (vector IS NULL) AS failed FROM holes""",
)
def observed_totals(spark, sf_dir):
    """Totals of an embedding run, observed while it is written."""
    path, _ = _fresh_store(spark, "observed")
    run = holes(spark, sf_dir).withColumn("embed_status", F.when(F.col("vector").isNull(), "error").otherwise("ok"))
    return spark.createDataFrame([write_observed(run, path, embedding_totals())], "total long, valid long, empty long, failed long")
