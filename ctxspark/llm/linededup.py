"""Line dedup with levelled sorted runs.

A line's key is the line without white space at both ends, A-Z lower-cased; it is kept as a 128-bit hash. Batches of
documents arrive one after another. Each is reduced to (hash, documents that have it) and sorted by hash; a merge anti-join
with the sealed runs takes away what is already known to be too frequent, and the rest becomes a new run of level 0. As soon
as a level holds ``fan`` runs they are merged into one of the next level, and keys that have reached ``min_docs`` move to the
sealed runs. A run is a Parquet folder in the shared folder, sorted by hash in each file, so nothing depends on an executor.

Only hashes are shuffled, and counted before they are. Texts are shuffled once, to meet the keys their document loses.

Edge cases: a null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped; a document whose lines
all go keeps the empty string; repeated rows count as documents of their own; a line twice in a document counts once and goes
twice; texts of any length are read whole; other columns are carried in a struct, so that no name clashes; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash128, new_folder, packed, text_or_empty, texts, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, n long"


def line_keys(text: Column) -> Column:
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda x: F.trim(x, F.lit(SPACE)))


class LineRuns:
    """The runs of one index. ``add`` takes (h1, h2, n) of a batch; ``frequent`` gives the hashes of at least min_docs."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fan: int = 3):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.levels: list[list[str]] = [[]]
        self.sealed: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _write(self, run: DataFrame) -> str:
        path = new_folder(self.spark, "run")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> None:
        if self.sealed:
            batch = batch.join(self._read(self.sealed).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(batch.select("h1", "h2", "n")))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan:
                self._compact(k)

    def _compact(self, k: int) -> None:
        path = new_folder(self.spark, "run")
        merged = self._read(self.levels[k]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        merged.withColumn("full", F.col("n") >= self.min_docs).sortWithinPartitions("full", "h1", "h2").write.partitionBy("full").parquet(path)
        full = {r.full for r in self.spark.read.schema(f"{RUN}, full boolean").parquet(path).select("full").distinct().collect()}
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k] = []
        if True in full:  # these keys leave the levels for good
            self.sealed.append(f"{path}/full=true")
        if False in full:
            self.levels[k + 1].append(f"{path}/full=false")

    def frequent(self) -> DataFrame:
        runs = self._read([p for level in self.levels for p in level]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        found = runs.where(F.col("n") >= self.min_docs).select("h1", "h2")
        return found.unionByName(self._read(self.sealed).select("h1", "h2")).distinct() if self.sealed else found


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan: int = 2) -> DataFrame:
    """Every row of docs as the struct `row`, with n_lines, n_dropped and kept, the text of the lines that stay."""
    spark = docs.sparkSession
    whole = text_or_empty(F.col(text))
    keys = F.array_distinct(F.filter(line_keys(whole), lambda k: F.char_length(k) >= min_chars))
    row = [F.col(doc_id).alias("_id"), *[h.alias(n) for h, n in zip(hash128(whole), ("_t1", "_t2"))]]
    batch = F.pmod(F.xxhash64(F.col(doc_id), F.lit("batch")), F.lit(batches)).cast("int")
    # What a row is known by is computed before the lines are dealt out, not for each of them.
    each = docs.select(*row, batch.alias("batch"), keys.alias("keys")).select("_id", "_t1", "_t2", "batch", F.explode("keys").alias("key")).select("_id", "_t1", "_t2", "batch", *[h.alias(n) for h, n in zip(hash128(F.col("key")), ("h1", "h2"))])

    counted = new_folder(spark, "line-batches")
    each.groupBy("batch", "h1", "h2").agg(F.count("*").alias("n")).write.partitionBy("batch").parquet(counted)
    runs = LineRuns(spark, min_docs, fan)
    arrived = spark.read.schema(f"{RUN}, batch int").parquet(counted)
    for k in range(batches):
        runs.add(arrived.where(F.col("batch") == k))

    # Written, so that both sides of the join are shuffled for it and a hot line's rows can be split. What a document loses are
    # places of lines: taking them from all its places is linear, however many they are.
    places = F.filter(F.transform(line_keys(whole), lambda k, i: F.struct(k.alias("key"), i.alias("at"))), lambda x: F.char_length(x["key"]) >= min_chars)
    lines_of = docs.select(*row, places.alias("lines")).select("_id", "_t1", "_t2", F.explode("lines").alias("line")).select("_id", "_t1", "_t2", F.col("line.at").alias("at"), *[h.alias(n) for h, n in zip(hash128(F.col("line.key")), ("h1", "h2"))])
    lost = lines_of.join(written(runs.frequent(), "frequent-lines").hint("merge"), ["h1", "h2"], "left_semi").groupBy("_id", "_t1", "_t2").agg(F.collect_set("at").alias("_lost"))
    t1, t2 = hash128(whole)
    mine = packed(docs, whole=whole, id=F.col(doc_id), t1=t1, t2=t2)
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    joined = mine.join(lost, on, "left").select("row", "whole", "_lost")
    whole = F.col("whole")
    lines = F.split(whole, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lost"))
    # Both as arguments of a lambda, which are computed once; an expression within a lambda is computed for each element.
    kept = F.transform(F.array(F.struct(lines.alias("lines"), left.alias("left"))), lambda x: F.transform(x["left"], lambda i: F.get(x["lines"], i)))[0]
    joined = joined.withColumn("_lines", F.when(F.col("_lost").isNull(), lines).otherwise(kept))
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("_lines")).cast("long").alias("n_dropped"), F.array_join("_lines", "\n").alias("kept"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = dedup_lines(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: keys and lines side by side; `drop` are the keys of at least 10 documents.
LINES_SQL = """
  l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
  k AS (SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
"""
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""
