"""An index kept by changes: rows of a key are replaced or deleted together, and a change costs the buckets it falls into.

Rows lie in hash buckets of their key. A change writes the buckets it touches anew, in a folder of its epoch, and then one
manifest that says where each bucket is now; readers follow the newest complete manifest. An epoch that runs again writes the
same over its own folder, from the manifest before it, so a repeated micro-batch changes nothing. Buckets are bounded in number;
keys of one bucket are split among tasks when they are written. Old rows and new ones are shuffled once: they meet what becomes of
their keys in the same partition in which they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a part of a bucket, about: as many keys as that are written by one task.
PART_ROWS = 100_000


class BucketIndex:
    def __init__(self, spark: SparkSession, target: str, key: str = "path", stamp: str = "mtime", buckets: int = 64):
        self.spark, self.target, self.key, self.stamp, self.buckets = spark, target.rstrip("/"), key, stamp, buckets

    def _epochs(self, what: str) -> list[int]:
        """Epochs with a complete folder below target/what."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.target}/{what}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def latest(self) -> int | None:
        return max(self._epochs("manifest"), default=None)

    def manifest(self, epoch: int | None) -> dict[int, int]:
        """Where each bucket with rows is: the epoch that wrote it. At most `buckets` entries."""
        if epoch is None:
            return {}
        rows = self.spark.read.schema("bucket int, written long").parquet(f"{self.target}/manifest/epoch={epoch}").collect()
        return {r.bucket: r.written for r in rows}

    def _rows(self, places: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.target}/data/epoch={e}/_bucket={b}" for b, e in sorted(places.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema, epoch: int | None = None) -> DataFrame:
        """All rows as of an epoch, the newest if none is given."""
        return self._rows(self.manifest(self.latest() if epoch is None else epoch), schema)

    def apply(self, changes: DataFrame, epoch: int, deleted: str = "deleted") -> list[int]:
        """Puts a batch of changes into the index and returns the buckets it wrote. A key's rows in the batch replace all it had;
        if any of them is marked as deleted, it has none."""
        schema = type(changes.schema)([f for f in changes.schema.fields if f.name != deleted])
        staged = f"{self.target}/staged/epoch={epoch}"
        changes.write.mode("overwrite").parquet(staged)
        part = self.spark.read.schema(changes.schema).parquet(staged)
        marks = part.groupBy(self.key).agg((~F.bool_or(F.coalesce(deleted, F.lit(False)))).alias("_comes"))
        return self._replace(part.select(*schema.names), marks, epoch, part.count())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _replace(self, rows: DataFrame, marks: DataFrame, epoch: int, n: int) -> list[int]:
        """Writes an epoch: keys in marks (key, _comes) lose the rows they had and, where _comes, get theirs of rows (n in all); other
        keys stay as they are, whatever rows there are of them."""
        before = max((e for e in self._epochs("manifest") if e < epoch), default=None)
        places = self.manifest(before)
        data = f"{self.target}/data/epoch={epoch}"
        touched = sorted(r[0] for r in marks.select(self._bucket().alias("b")).distinct().collect())
        old = self._rows({b: places[b] for b in touched if b in places}, rows.schema)
        # Whole rows, so that a key's name can't clash; a key's mark comes with null columns.
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
        key = F.col(self.key).alias("_key")
        all_ = old.select(self._bucket().alias("_bucket"), key, F.lit(0).alias("_side"), F.lit(None).cast("boolean").alias("_comes"), row)
        new = rows.select(self._bucket().alias("_bucket"), key, F.lit(1).alias("_side"), F.lit(None).cast("boolean").alias("_comes"), row)
        all_ = all_.unionByName(new.where(F.col("_bucket").isin(touched)))
        all_ = all_.unionByName(marks.select(self._bucket().alias("_bucket"), key, F.lit(2).alias("_side"), "_comes", F.lit(None).cast(rows.schema).alias("_row")))
        splits = 1 + (n + old.count()) // (self.buckets * PART_ROWS)
        split = F.pmod(F.xxhash64(F.lit(1), F.col("_key").cast("string")), F.lit(splits)).cast("int")
        comes = F.max("_comes").over(Window.partitionBy("_bucket", "_split", "_key"))
        kept = all_.withColumn("_split", split).repartition("_bucket", "_split").withColumn("_comes", comes)
        kept = kept.where(((F.col("_side") == 0) & F.col("_comes").isNull()) | ((F.col("_side") == 1) & F.col("_comes")))
        kept.select("_row.*", "_bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(data)
        there = {r[0] for r in self.spark.read.parquet(data).select("_bucket").distinct().collect()} if self._has_rows(data) else set()
        now = {b: e for b, e in places.items() if b not in touched} | dict.fromkeys(there, epoch)
        manifest = self.spark.createDataFrame(sorted(now.items()), "bucket int, written long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.target}/manifest/epoch={epoch}")
        return touched

    def _has_rows(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return any(s.isDirectory() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))

    def sync(self, rows: DataFrame, full: bool = False) -> dict[str, int]:
        """Makes the index hold these rows: keys with another stamp are replaced, keys that aren't there any more deleted. Returns how
        many keys were scanned, updated, skipped and deleted, and the rows written; if nothing changed, nothing is written."""
        epoch = self.latest()
        have = self.read(rows.schema, epoch).groupBy(F.col(self.key).alias("_key")).agg(F.max(self.stamp).alias("_stamp"))
        want = rows.groupBy(self.key).agg(F.max(self.stamp).alias("_new"), F.count("*").alias("_n"))
        both = want.join(have, F.col(self.key).eqNullSafe(F.col("_key")), "full")
        known, there = F.col("_stamp").isNotNull(), F.col("_n").isNotNull()
        same = known & there & F.col("_new").eqNullSafe(F.col("_stamp")) & F.lit(not full)
        state = F.when(~there, "deleted").when(same, "skipped").otherwise("updated")
        states = both.select(F.coalesce(self.key, "_key").alias("_key"), state.alias("_state"), "_n").persist()
        try:
            n = {r["_state"]: (r.n, r.rows) for r in states.groupBy("_state").agg(F.count("*").alias("n"), F.sum("_n").alias("rows")).collect()}
            out = {"scanned": sum(n.get(s, (0, 0))[0] for s in ("updated", "skipped")), **{s: n.get(s, (0, 0))[0] for s in ("updated", "skipped", "deleted")}, "rows": n.get("updated", (0, 0))[1] or 0}
            if out["updated"] or out["deleted"]:
                marks = states.where("_state != 'skipped'").select(F.col("_key").alias(self.key), (F.col("_state") == "updated").alias("_comes"))
                self._replace(rows, marks, 0 if epoch is None else epoch + 1, out["rows"])
            return out
        finally:
            states.unpersist()

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest `keep`, and the bucket folders that none of these names; returns how many folders went."""
        jvm = self.spark._jvm
        kept = self._epochs("manifest")[-keep:]
        used = {(b, e) for m in kept for b, e in self.manifest(m).items()}
        gone = 0
        for what in ("manifest", "staged", "data"):
            top = jvm.org.apache.hadoop.fs.Path(f"{self.target}/{what}")
            fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in fs.listStatus(top) if fs.exists(top) else []:
                epoch = int(s.getPath().getName().split("=")[1])
                if what != "data":
                    if kept and epoch < kept[0]:
                        fs.delete(s.getPath(), True)
                    continue
                for b in fs.listStatus(s.getPath()):
                    name = b.getPath().getName()
                    if name.startswith("_bucket=") and kept and epoch <= kept[-1] and (int(name.split("=")[1]), epoch) not in used:
                        fs.delete(b.getPath(), True)
                        gone += 1
        return gone


def index_stream(changes: DataFrame, index: BucketIndex, checkpoint: str):
    """Keeps an index by the micro-batches of a stream of changes (with `deleted`); returns the running query."""
    return changes.writeStream.foreachBatch(lambda batch, epoch: index.apply(batch, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
