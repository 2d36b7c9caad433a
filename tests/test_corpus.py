"""One search over documents and defects, answers with padding, citations within a budget, and vectors kept by content."""

import re

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import text as tx
from ctxspark.operators import records, retrieval, vectorcache

DEFECT = "id string, status string, subsystem string, summary string"


def corpus(spark, docs, defects):
    d = spark.createDataFrame(docs, "chunk_id long, path string, heading string, body string")
    return retrieval.corpus(d, records.defect_chunks(spark.createDataFrame(defects, DEFECT)))


def test_defects_count_and_are_boosted(spark):
    c = corpus(spark, [(1, "a.md", "Physics", "the rapier step"), (2, "b.md", "Lore", "nothing here"), (3, "c.md", None, None)], [("D1", "open", "physics", "rapier is slow"), ("D2", "done", "physics", "rapier"), ("D3", "parked", "physics", "rapier")])
    # Done defects and those of a state without a boost aren't in the corpus.
    assert {r.chunk_id for r in c.collect()} == {"1", "2", "3", "defect D1"}
    got = retrieval.search_corpus(c, "rapier").collect()
    assert [(r.kind, r.chunk_id) for r in got] == [("defect", "defect D1"), ("document", "1")]
    plain = {r.chunk_id: r.score for r in retrieval.search(c.drop("boost"), "rapier", body="text").collect()}
    assert got[0].score == pytest.approx(4 * plain["defect D1"]) and got[1].score == pytest.approx(plain["1"])
    assert retrieval.search_corpus(c, "absent").count() == 0 and retrieval.search_corpus(c.limit(0), "rapier").count() == 0


def padded(parts):
    """In order, by hand: parts is [(long, short)]."""
    end = lambda s: s if s[-1] in ".!?" else s + "."
    said = [end(a) for a, _ in parts if a]
    more = []
    if len(said) < 2 and len(parts) > len(said):
        for _, b in parts[len(said) :]:
            if b and len(said) + len(more) < 2:
                more.append(end(b))
    return " ".join(said + more) or ("(no usable snippets)" if parts else "(no matching documents)")


@pytest.mark.parametrize("bodies", [["rapier one", "rapier two!", "***"], ["rapier one", "***"], ["***", "rapier one"], ["***", "###", "rapier " + "x" * 300], ["***"], ["rapier"], []])
def test_answers_are_padded(spark, bodies):
    hits = spark.createDataFrame([(i, float(10 - i), b) for i, b in enumerate(bodies)], "chunk_id long, score double, body string")

    def cut(b, n):
        s = b[:n].strip() + (" …" if len(b) > n else "")
        return re.sub(r"^[`*#|]+|[`*#|]+$", "", re.sub(r"\s+", " ", s).strip()).strip()

    want = padded([(cut(b, 220), cut(b, 160)) for b in bodies])
    r = retrieval.padded_answer(hits, "rapier").first()
    assert r.answer == want and r.citations == len(bodies)


def test_citations_stop_at_the_budget(spark):
    rows = [(str(i), "p.md", "H", 9.0 - i, "rapier " + "y" * 60) for i in range(5)]
    hits = spark.createDataFrame(rows, "chunk_id string, path string, heading string, score double, body string")
    line = len(f"  [1] p.md - H (score 9.00)\n      {rows[0][4]}\n")
    for used, budget in [(0, 10_000), (0, 3 * line // 4), (100, 3 * line // 4), (10_000, 1)]:
        want, size = 0, used
        for i in range(5):
            if size // 4 + line // 4 > budget and i > 0:
                break
            want, size = want + 1, size + line
        assert [r.rank for r in retrieval.cited(hits, "rapier", budget, used).collect()] == list(range(1, want + 1))


def embed(df):
    """Length and number of blanks; none for a text that says no."""
    return df.where("text != 'no'").select("key", F.array(F.length("text").cast("float"), (F.length("text") - F.length(F.replace("text", F.lit(" ")))).cast("float")).alias("vector"))


def test_vectors_are_computed_once(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    c = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "cc"), (4, None), (5, ""), (6, "no")], "chunk_id long, body string")
    assert vectorcache.fill(path, c.where("chunk_id <= 2"), "m", embed) == 1
    assert vectorcache.fill(path, c, "m", embed) == 2  # cc, and null and empty, which are one text
    assert vectorcache.fill(path, c, "m", embed) == 0
    assert vectorcache.fill(path, c, "other", embed) == 3  # another model has none of these
    assert vectorcache.fill(path, c.limit(0), "m", embed) == 0
    got = {r.chunk_id: r.vector for r in vectorcache.with_vectors(c, vectorcache.cached(spark, path, "m")).collect()}
    assert got == {1: [3.0, 1.0], 2: [3.0, 1.0], 3: [2.0, 0.0], 4: [0.0, 0.0], 5: [0.0, 0.0], 6: None}


def test_rows_written_twice_or_in_part(spark, tmp_path):
    """A rerun that appends what is there, and a job that leaves only some of its files, change no answer."""
    path = f"file://{tmp_path}/cache"
    c = spark.range(40).select(F.col("id").alias("chunk_id"), F.concat(F.lit("t"), F.col("id") % 20).alias("body"))
    assert vectorcache.fill(path, c, "m", embed) == 20
    spark.read.schema(vectorcache.CACHE).parquet(path).limit(7).write.mode("append").partitionBy("model").parquet(path)
    assert vectorcache.with_vectors(c, vectorcache.cached(spark, path, "m")).count() == 40
    # What an embedding failed on stays as it was.
    with pytest.raises(Exception):  # noqa: B017
        vectorcache.fill(path, c.withColumn("body", F.concat("body", F.lit("!"))), "m", lambda df: df.select("key", F.expr("array(cast(raise_error('lost') as float))").alias("vector")))
    assert vectorcache.fill(path, c, "m", embed) == 0


def test_reranking_computes_the_head_only(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    hits = spark.createDataFrame([(i, float(10 - i), "no" if i == 1 else "ab" * (i + 1)) for i in range(6)], "chunk_id long, score double, body string")
    got = {r.chunk_id: r for r in vectorcache.rerank_cached(hits, path, "m", embed, [1.0, 0.0], head=3).collect()}
    assert vectorcache.cached(spark, path, "m").count() == 2
    assert [i for i, r in got.items() if r.head] and {i for i, r in got.items() if r.head} == {0, 1, 2}
    assert got[0].score == pytest.approx(0.5 + 0.5) and got[1].score == pytest.approx(0.5 * 0.9 + 0.5 * 0.5) and got[5].score == 5.0


def test_path_flags(spark):
    rows = [("build/x", False, True), ("a/build/x", False, True), ("a/builds/x", False, False), ("obj/x", False, False), ("a/obj/x", False, True), ("a\\node_modules\\x", False, True), ("x.blend1", False, True), ("target", False, False), ("a/target", False, False), ("My.ENV.txt", True, False), ("k.pem", True, False), ("k.pem.md", False, False), ("a/Secrets.md", True, False), ("", False, False)]
    got = spark.createDataFrame(rows, "path string, s boolean, g boolean").select("path", (tx.looks_secret(F.col("path")) == F.col("s")).alias("s"), (tx.looks_generated(F.col("path")) == F.col("g")).alias("g")).collect()
    assert not [r.path for r in got if not (r.s and r.g)]


def test_similar_splits_each_text_once(spark):
    ideas = spark.createDataFrame([("a", "red fox jumps"), ("b", "red hen"), ("c", None), ("d", "")], "slug string, text string")
    out = retrieval.similar(ideas, "red fox red", threshold=0.1, k=3)
    assert [(r.slug, round(r.similarity, 3)) for r in out.collect()] == [("a", 1.0), ("b", 0.667)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
