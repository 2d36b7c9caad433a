"""What the operators of this subpackage share: shared storage, text keys and small expressions.

Row identity. ``doc_id`` may be null or repeated, so operators that must find a row again use the key
(doc_id, 128-bit hash of the text), compared null-safely; rows that agree in it are equal for every operator here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, as in tests, one is set here, but only
    if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="ctxspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ctxspark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is read by column."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole rows of docs as one struct column `row` beside the given columns, so that no name of docs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[e.alias(n) for n, e in columns.items()])


def arrow_schema(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The fields of the kept columns and those of a DDL string."""
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + T.StructType.fromDDL(more).fields)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def hash128(col: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds; as a pair they tell 10**12 strings apart."""
    return [F.xxhash64(col), F.xxhash64(F.lit(0x5EED), col)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows take long to work on: if it comes in fewer parts than there are cores (a small table in
    one file), its rows are dealt out first."""
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
