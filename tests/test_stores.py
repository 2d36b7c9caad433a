"""The index kept by changes, tables in versions, and compacted journals."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import presence
from ctxspark.sources import versioned
from ctxspark.streaming.index import BucketIndex, index_stream

ROW = "path string, mtime long, body string"


def rows(df):
    return sorted(((r.path, r.mtime, r.body) for r in df.collect()), key=str)


def table(spark, items):
    return spark.createDataFrame(items, ROW)


def test_index_follows_its_files(spark, tmp_path):
    rng, index = random.Random(1), BucketIndex(spark, f"{tmp_path}/ix", buckets=8)
    now = {f"f{i}": (1, [f"{i}-{k}" for k in range(i % 4 + 1)]) for i in range(60)}
    flat = lambda: [(p, m, b) for p, (m, bs) in now.items() for b in bs]
    assert index.sync(table(spark, flat())) == {"scanned": 60, "updated": 60, "skipped": 0, "deleted": 0, "rows": len(flat())}
    assert rows(index.read(table(spark, []).schema)) == sorted(flat(), key=str)
    for step in range(2, 5):
        gone, new = rng.sample(sorted(now), 3), f"n{step}"
        for p in gone[:2]:
            del now[p]
        now[gone[2]] = (step, [f"again {step}"])
        now[new] = (step, ["x", None])
        got = index.sync(table(spark, flat()))
        assert got == {"scanned": len(now), "updated": 2, "skipped": len(now) - 2, "deleted": 2, "rows": 3}
        assert rows(index.read(table(spark, []).schema)) == sorted(flat(), key=str)
    before = index.latest()
    assert index.sync(table(spark, flat()))["updated"] == 0 and index.latest() == before
    assert index.sync(table(spark, []))["deleted"] == len(now) and rows(index.read(table(spark, []).schema)) == []


def test_a_sync_shuffles_rows_once_and_writes_them_once(spark, tmp_path, monkeypatch):
    """Parts of a bucket, null keys and stamps, and keys that stay; nothing but the index's own files is written."""
    from ctxspark.streaming import index as module

    monkeypatch.setattr(module, "PART_ROWS", 20)
    rng, index = random.Random(2), BucketIndex(spark, f"{tmp_path}/ix", buckets=3)
    first = [(f"f{i}" if i else None, 1, f"{i}-{k}") for i in range(90) for k in range(3)]
    later = [(p, 2 if p is None or p.endswith("3") else m, f"{b} new" if p is None or p.endswith("3") else "not looked at") for p, m, b in first if p is None or not p.endswith("7")] + [("g", None, None)]
    want = [x for x in later if x[1] != 1] + [x for x in first if x[0] and x[0][-1] not in "37"]
    plans, write = [], type(spark.range(1)).write
    monkeypatch.setattr(type(spark.range(1)), "write", property(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write.fget(df)))
    for items, held in ((first, first), (later, want)):
        index.sync(table(spark, rng.sample(items, len(items))))
        assert rows(index.read(table(spark, []).schema)) == sorted(held, key=str)
    assert sorted(os.listdir(f"{tmp_path}/ix")) == ["data", "manifest"]
    data = [p for p in plans if "_bucket" in p]
    assert len(data) == 2 and all(p.count("Exchange hashpartitioning(_bucket") == 1 and "Join" not in p.split("InMemoryRelation")[0] for p in data)


def test_a_change_costs_its_bucket(spark, tmp_path):
    index = BucketIndex(spark, f"{tmp_path}/ix", buckets=8)
    index.sync(table(spark, [(f"f{i}", 1, "x") for i in range(80)]))
    change = spark.createDataFrame([("f3", 2, "y", False)], f"{ROW}, deleted boolean")
    assert len(index.apply(change, 1)) == 1
    places = index.manifest(1)
    assert sorted(places.values()) == [0] * 7 + [1]
    once = rows(index.read(table(spark, []).schema))
    index.apply(change, 1)  # the batch runs again
    assert index.manifest(1) == places and rows(index.read(table(spark, []).schema)) == once
    assert ("f3", 1, "x") in rows(index.read(table(spark, []).schema, 0))  # the version before can still be read
    index.apply(spark.createDataFrame([("f3", None, None, True), ("no", None, None, True)], f"{ROW}, deleted boolean"), 2)
    assert "f3" not in {r[0] for r in rows(index.read(table(spark, []).schema))}
    kept = rows(index.read(table(spark, []).schema))
    assert index.vacuum(1) >= 2 and rows(index.read(table(spark, []).schema)) == kept


def test_an_unfinished_epoch_is_not_seen(spark, tmp_path):
    index = BucketIndex(spark, f"{tmp_path}/ix", buckets=4)
    index.sync(table(spark, [("a", 1, "x"), ("b", 1, "x")]))
    index.apply(spark.createDataFrame([("a", 2, "y", False)], f"{ROW}, deleted boolean"), 1)
    os.unlink(f"{tmp_path}/ix/manifest/epoch=1/_SUCCESS")
    assert index.latest() == 0 and rows(index.read(table(spark, []).schema)) == [("a", 1, "x"), ("b", 1, "x")]


def test_index_by_stream(spark, tmp_path):
    index, schema = BucketIndex(spark, f"{tmp_path}/ix", buckets=4), f"{ROW}, deleted boolean"
    batches = [[("a", 1, "x", False), ("a", 1, "y", False), ("b", 1, "z", False)], [("a", 2, "w", False), ("b", None, None, True), ("c", 2, "v", False)], [("c", 3, "u", False)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        index_stream(stream(), index, f"{tmp_path}/cp").awaitTermination()
        assert rows(index.read(table(spark, []).schema)) == [("a", 2, "w"), ("c", 3, "u")]


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(versioned.VersionedDataSource)
    return f"{tmp_path}/t"


def read(spark, path, **options):
    return sorted(tuple(r) for r in spark.read.format("versioned").options(**options).load(path).collect())


def files_in(path):
    return {f"data/{d}/{f}" for d in os.listdir(f"{path}/data") for f in os.listdir(f"{path}/data/{d}")}


def test_versions(spark, store):
    df = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").repartition(3)
    df(1, 2, 3).write.format("versioned").mode("overwrite").save(store)
    df(4).write.format("versioned").mode("append").save(store)
    assert read(spark, store) == [(i, f"t{i}") for i in (1, 2, 3, 4)]
    df(9).write.format("versioned").mode("overwrite").save(store)
    assert read(spark, store) == [(9, "t9")] and read(spark, store, version=2) == [(i, f"t{i}") for i in (1, 2, 3, 4)]
    assert versioned.version(store)["rows"] == 1 and versioned.versions(store) == [1, 2, 3]
    df().write.format("versioned").mode("append").save(store)
    assert read(spark, store) == [(9, "t9")]
    df(5).write.format("versioned").mode("overwrite").option("keep", 1).save(store)
    assert versioned.versions(store) == [5] and read(spark, store) == [(5, "t5")] and files_in(store) == set(versioned.version(store)["files"])
    with pytest.raises(Exception, match="another schema"):
        spark.createDataFrame([(1,)], "other int").write.format("versioned").mode("append").save(store)
    assert read(spark, store) == [(5, "t5")]


def test_a_failed_job_leaves_the_old_version(spark, store):
    spark.range(10).write.format("versioned").mode("overwrite").save(store)
    before = files_in(store)
    late = F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise(F.col("id"))
    with pytest.raises(Exception):
        spark.range(0, 400, 1, 4).select(late.cast("long").alias("id")).write.format("versioned").mode("append").save(store)
    assert read(spark, store) == [(i,) for i in range(10)] and versioned.versions(store) == [1]
    assert files_in(store) == before


def test_two_writers(spark, store):
    from pyspark.sql.types import StructType

    schema = StructType().add("id", "long")
    one, two = versioned._Writer(store, schema, False, 0), versioned._Writer(store, schema, False, 0)
    import pyarrow as pa

    said = [w.write(iter([pa.RecordBatch.from_pylist([{"id": k}])])) for k, w in ((1, one), (2, two))]
    one.commit([said[0]])
    with pytest.raises(RuntimeError):
        two.commit([said[1]])
    assert read(spark, store) == [(1,)] and files_in(store) == set(versioned.version(store)["files"])


JOURNAL = "seq long, agent_id string, ts long, kind string, state string, note string"


def test_compacted_journals_fold_alike(spark):
    rng = random.Random(3)
    kinds = ["check_in", "update", "update", "check_out", "decision", "outcome"]
    events = [(i, f"a{rng.randrange(5)}", i * 10, rng.choice(kinds), rng.choice([None, f"s{i}"]), rng.choice([None, f"n{i}"])) for i in range(120)]
    j = spark.createDataFrame(events, JOURNAL)
    of = lambda df: sorted(str(r) for r in presence.fold(df, ["state", "note"]).collect())
    for upto in (-1, 0, 37, 80, 119):
        c = presence.compact(j, ["state", "note"], upto)
        assert of(c) == of(j)
        assert c.where("kind IN ('decision', 'outcome')").count() == j.where("kind IN ('decision', 'outcome')").count()
        assert of(presence.compact(c, ["state", "note"], 100)) == of(j)
    whole = presence.compact(j, ["state", "note"], 119)
    assert whole.where("kind NOT IN ('decision', 'outcome')").count() <= 5
    assert sorted(map(str, presence.compact(whole, ["state", "note"], 119).collect())) == sorted(map(str, whole.collect()))
    assert presence.compact(j.limit(0), ["state"], 5).count() == 0
