"""A corpus pipeline of the operators in ctxspark.llm: each stage takes what its predecessor kept.

All stages but the last return the columns of what they were given, whatever their names, and carry them unread; only doc_id and
text (and n_chars, which line_dedup sets) matter. Any column may be null, ids may repeat, texts of any length are read whole,
and no rows give no rows. What a stage does with null and empty texts, repeated rows and ties stands at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.llm.common import written
from ctxspark.llm.decontam import decontaminate
from ctxspark.llm.linededup import dedup_lines
from ctxspark.llm.packing import pack
from ctxspark.llm.simhash import keep_one
from ctxspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't rejected, by a model of those that have a label. Null and empty texts stay; repeated rows have one
    score and go or stay together; without a label among the documents all stay."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without the lines that ten or more documents share; n_chars follows. No document goes: a null text becomes empty, as
    does one that loses all its lines. Repeated rows are documents of their own, so ten of them lose their lines."""
    kept = dedup_lines(docs)
    fields = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return kept.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies (five-word shingles, similarity 0.8): that with the least id (null last),
    then the least text hash; of rows equal in both any one. Null and empty texts are one group."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark. Null and empty texts stay; repeated rows go or stay together; without
    benchmark items all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, each with its place in a training sequence. A null or empty text is one piece of
    one id; repeated rows are packed each; among pieces of a length it doesn't matter which goes where."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SimHash candidates, learned scores and packing can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the stages' results are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
