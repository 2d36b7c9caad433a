"""The pipeline's stages on the smallest tables, each against what it was given, and on rows made to be awkward."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ctxspark.llm.common import written
from tests.llm import brute


@pytest.fixture(scope="module")
def steps(spark, sf):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        got = written(f(spark, docs, sf), name)
        out[name] = (docs, got)
        docs = got
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps, spark, sf):
    want = spark.read.parquet(f"{sf}/documents.parquet").dtypes
    assert all(got.dtypes == want for name, (_, got) in steps.items() if name != "packing")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_lines(steps):
    before, after = (rows(x) for x in steps["line_dedup"])
    keys = {}
    for k, (_, t) in enumerate(before):
        for line in set(x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")):
            keys.setdefault(line, set()).add(k)
    kept = sorted((d, "\n".join(x for x in t.split("\n") if not x.strip(" \t\n\x0b\x0c\r") or len(keys[x.strip(" \t\n\x0b\x0c\r").lower()]) < 10)) for d, t in before)
    assert sorted(after) == kept


def test_near(steps):
    before, after = (rows(x) for x in steps["near_dedup"])
    texts = sorted({t for _, t in before})
    root = brute.near_components(texts)
    assert len(after) == len({root[i] for i in range(len(texts))})
    assert set(after) <= set(before)


def test_leaks(steps, sf):
    before, after = (rows(x) for x in steps["decontamination"])
    bad = {d for d, _ in brute.leaks(before, brute.rows(sf, "benchmark", "item_id", "text"))}
    assert sorted(after) == sorted(r for r in before if r[0] not in bad)


def test_packed(steps):
    before, after = steps["packing"]
    p = after.toPandas()
    assert set(p.doc_id) == {r.doc_id for r in before.select("doc_id").collect()}
    assert p.groupby("sequence_id")["length"].sum().max() <= 2048


CLASHING = ["row", "doc", "kept", "score", "predicted", "node", "root", "_h1", "_n", "t1", "bad_t1", "sequence_id", "length", "a.b"]


@pytest.fixture(scope="module")
def awkward(spark, sf):
    """Nulls in every column, empty and very long texts, repeated rows, equal and null ids, and columns named like the stages' own."""
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 20)
    copy = " ".join(f"copy{i}" for i in range(40))
    near = copy.replace("copy39", "other")
    alone = lambda n: " ".join(f"word{n}x{i}" for i in range(30))
    big = 10**9
    rows = [(big, None, "en", "s", 1), (big + 1, "", None, None, None), (None, alone(1), "en", None, 3), (None, alone(1), "en", None, 3), (big + 2, alone(2), "de", "s", None), (big + 2, alone(3), "de", "s", 5)]
    rows += [(big + 5, copy, "en", "s", 7), (big + 4, copy, "en", "s", 7), (big + 4, copy, "en", "s", 7), (big + 6, near, "fr", "t", 7), (None, near, None, None, None)]
    rows += [(big + 10, " ".join(f"w{i * i % 99991}" for i in range(150_000)), "en", "s", 9), (big + 11, "before " + item + " after", "en", "s", 9), (big + 12, alone(12) + "\n" + item + "\n" + alone(13), "en", "s", 9)]
    rows += [(big + 20 + k, f"Shared  line\n{alone(20 + k)}\n \tshared  LINE ", "en", "s", 2) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[(F.lit(None) if i % 2 else F.concat(F.lit(n), F.coalesce("doc_id", F.lit(0)))).cast("string").alias(n) for i, n in enumerate(CLASHING)])


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_awkward_toxicity(spark, sf, awkward):
    """None of these has a label, so all stay as they are."""
    assert counted(stage("toxicity")(spark, awkward, sf)) == counted(awkward)


def test_awkward_lines(spark, sf, awkward):
    got, want = stage("line_dedup")(spark, awkward, sf), Counter()
    assert got.columns == awkward.columns
    for r in awkward.collect():
        text = "\n".join(x for x in (r.text or "").split("\n") if x.strip().lower() != "shared  line")
        want[(r[0], text, *r[2:4], len(text), *r[5:])] += 1
    assert counted(got) == want


def test_awkward_near(spark, sf, awkward):
    got = stage("near_dedup")(spark, awkward, sf)
    assert got.columns == awkward.columns and not counted(got) - counted(awkward)
    left = Counter((r.doc_id, (r.text or "")[:30]) for r in got.collect())
    first = lambda text: text[:30]
    texts = {r.text for r in awkward.collect() if r.text}
    near = next(t for t in texts if t.endswith("other"))
    big = 10**9
    assert left[(big, "")] == 1 and left[(big + 1, "")] == 0  # null and empty are copies
    assert left[(None, first("word1x0 word1x1 word1x2 word1x3 word1x4"))] == 1  # repeated rows without an id
    assert left[(big + 4, first(near))] == 1 and sum(n for (_, t), n in left.items() if t == first(near)) == 1
    assert got.count() == len(awkward.select("text").distinct().collect()) - 1 - 1  # null with empty, copy with near


def test_awkward_leaks(spark, sf, awkward):
    got = counted(stage("decontamination")(spark, awkward, sf))
    gone = counted(awkward) - got
    assert {r[0] for r in gone} == {10**9 + 11, 10**9 + 12} and not got - counted(awkward)


def test_awkward_packing(spark, sf, awkward):
    p = stage("packing")(spark, awkward, sf).toPandas()
    assert p[(p.piece == 0)].shape[0] == awkward.count() and p.groupby("sequence_id")["length"].sum().max() <= 2048
    assert sorted(p[p.doc_id.isin([10**9, 10**9 + 1])]["length"]) == [1, 1]
    assert p[p.doc_id == 10**9 + 10].shape[0] > 100


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, sf, awkward, name):
    got = stage(name)(spark, awkward.limit(0), sf)
    assert got.count() == 0 and (name == "packing" or got.columns == awkward.columns)


def test_awkward_chain(spark, sf, awkward):
    docs = awkward
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, sf), name)
    # The different texts, less an empty one, a near copy and the item's two; every one left begins once.
    assert docs.where("piece = 0").count() == len({r.text for r in awkward.collect()}) - 4
