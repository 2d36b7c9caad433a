"""Vectors of texts kept by content, so that a text is embedded once, whatever chunk or run it comes from.

The cache is a Parquet table, key, vector and model, that only grows. Its key is a digest of the text and its rows are partitioned by
model, so vectors of two models never meet. A row says the same whoever wrote it; rows that two runs or a lost job write twice, or
a part of a job's rows, are therefore right as they are, and readers take one of equal keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .retrieval import rerank

CACHE = "key string, vector array<float>, model string"


def content_key(text: Column) -> Column:
    """Of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def cached(spark: SparkSession, path: str, model: str) -> DataFrame:
    """key and vector of a model; none where the table isn't there yet."""
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("model").parquet(path)
    return spark.read.schema(CACHE).parquet(path).where(F.col("model") == model).select("key", "vector")


def misses(chunks: DataFrame, cache: DataFrame, text: str = "body") -> DataFrame:
    """key and text of the different texts without a vector. Copies become one before the shuffle, and of the cache only keys are read."""
    body = F.coalesce(F.col(text), F.lit(""))
    return chunks.select(content_key(body).alias("key"), body.alias("text")).groupBy("key").agg(F.any_value("text").alias("text")).join(cache.select("key"), "key", "left_anti")


def fill(path: str, chunks: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame], text: str = "body") -> int:
    """Computes the vectors that chunks lack, appends them, and says how many they were. embed turns key and text into key and
    vector; it may leave out texts, which stay misses."""
    seen = Observation()
    new = embed(misses(chunks, cached(chunks.sparkSession, path, model), text)).select("key", F.col("vector").cast("array<float>").alias("vector"), F.lit(model).alias("model"))
    new.where("vector IS NOT NULL").observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy("model").parquet(path)
    return seen.get["n"]


def with_vectors(chunks: DataFrame, cache: DataFrame, text: str = "body") -> DataFrame:
    """chunks with key and vector; null for a miss. A text that many chunks share is one key: a skewed join, which adaptive
    execution splits on the side of the chunks."""
    return chunks.withColumn("key", content_key(F.col(text))).join(cache.groupBy("key").agg(F.any_value("vector").alias("vector")), "key", "left")


def rerank_cached(hits: DataFrame, path: str, model: str, embed: Callable[[DataFrame], DataFrame], to: list[float], id: str = "chunk_id", text: str = "body", head: int = 24, weight: float = 0.5) -> DataFrame:
    """`retrieval.rerank` by vectors of the cache, for which those that the head lacks are computed first; only the head is looked up.
    The cosine of a miss is 0."""
    spark = hits.sparkSession
    first = hits.orderBy(F.desc("score"), id).limit(head)
    fill(path, first, model, embed, text)
    wanted = first.select(content_key(F.col(text)).alias("key")).distinct()
    few = cached(spark, path, model).join(F.broadcast(wanted), "key", "left_semi")  # at most `head` keys
    near = F.coalesce(cosine(F.col("vector"), F.lit([float(x) for x in to])), F.lit(0.0))
    return rerank(with_vectors(hits, few, text), (near + 1) / 2, id, head, weight).drop("key", "vector")
