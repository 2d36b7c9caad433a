"""The manifest, the quality classifier and periodic runs against plain versions, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxspark.llm import merkle, periodic, quality
from ctxspark.llm.queries import QUERIES


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# The manifest


def plain_tree(leaves):
    """The root of a list of digests, and each leaf's way of (left, right)."""
    ways, where, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for i, at in enumerate(where):
            run = at - at % 3
            ways[i].append(("".join(now[run:at]), "".join(now[at + 1 : run + 3])))
            where[i] = at // 3
        now = [sha("".join(now[k : k + 3])) for k in range(0, len(now), 3)]
    return now[0], ways


def plain_manifest(rows):
    """leaf, subroot, root and proof of rows (group, order, leaf), as a multiset."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: ([x[2] for x in sorted(groups[g])], *plain_tree([x[2] for x in sorted(groups[g])])) for g in names}
    root, tops = plain_tree([trees[g][1] for g in names])
    return sorted((leaf, subroot, root, tuple(way + tops[k])) for k, g in enumerate(names) for leaf, way in zip(trees[g][0], trees[g][2]) for subroot in [trees[g][1]])


def manifest_rows(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "", "a", "a", "a", "a", "é", "Z"]), rng.choice([None, *range(n)]), sha(str(rng.randrange(n)))) for _ in range(n)]
    return rows, spark.createDataFrame([(*r, "x", 1, "p") for r in rows], "source string, doc_id long, leaf string, row string, pos int, proof string").repartition(5)


@pytest.mark.parametrize(("n", "levels"), [(1, 6), (2, 1), (40, 1), (150, 2), (150, 6)])
def test_manifest(spark, n, levels):
    rows, df = manifest_rows(spark, n, n)
    out = merkle.manifest(df, levels=levels).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert sorted((r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in out) == plain_manifest(rows)
    assert all(r.folded == r.root for r in out)
    assert all(r.row.leaf == r.leaf and r.row.row == "x" and r.row.pos == 1 and r.row.proof == "p" for r in out)
    assert sorted(((r.row.source or "", r.pos) for r in out if r.row.source == "a")) == [("a", k) for k in range(sum(r[0] == "a" for r in rows))]


def test_manifest_nothing_and_repeats(spark):
    _, df = manifest_rows(spark, 5, 1)
    assert merkle.manifest(df.limit(0)).collect() == []
    same = spark.createDataFrame([("a", 1, sha("x"))] * 30, "source string, doc_id long, leaf string")
    out = merkle.manifest(same, levels=1)
    assert sorted(r.pos for r in out.collect()) == list(range(30))
    assert {r.root for r in out.collect()} == {plain_tree([sha("x")] * 30)[0]}


def test_digest(spark):
    df = spark.createDataFrame([(1, None, "é\n"), (None, "", None)], "a long, b string, c string")
    assert [r.h for r in df.select(merkle.digest(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()] == [sha("1:1-3:é\n"), sha("-0:-")]


def test_tampering_is_found(spark, sf):
    from zlib import crc32

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op11_merkle_dataset_manifest"](spark, sf).collect():
        assert r.verified == (crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in texts[r.doc_id])


# Runs


def plain_runs(words, least=6, exponent=4):
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, k, p) for (s, k), p in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


WORDS = st.lists(st.lists(st.sampled_from(["a", "b"]), max_size=40) | st.builds(lambda x, k, y: y + (x * 12)[:k], st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(0, 60), st.lists(st.sampled_from("abc"), max_size=6)), max_size=6)


@settings(max_examples=250, deadline=None)
@given(WORDS)
def test_find_runs(texts):
    ids = np.array([ord(w) for t in texts for w in t], np.int64)
    got = periodic.find_runs(ids, np.array([len(t) for t in texts], np.int64))
    assert [tuple(r) for r in got.tolist()] == [(t, *r) for t, words in enumerate(texts) for r in plain_runs(words)]


def test_minima():
    rng = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 500):
        v = rng.integers(0, 50, n).astype(np.int32)
        lo, hi = np.sort(rng.integers(0, n, (2, 300)), axis=0)
        assert periodic.Minima(v).of(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi)]


RUN_TEXTS = [None, "", " \t\n", "one", "a b " * 9, "x\x0by\x0cz\r" * 5, "é ß " * 4 + "é", "start " + "w " * 50_000, "b a " * 3, "a a a a a b c b c b c b c"]


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic, "GRID", 1000)
    rows = [(i, t, "r") for i, t in enumerate(RUN_TEXTS + RUN_TEXTS)] + [(None, "a " * 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.periodic_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r.row.doc_id
        words = (rows[-1 if i is None else i][1] or "").encode().split()
        words = [w.decode() for w in words]
        runs = [(0, 0, 0)] if len(words) > 10_000 else plain_runs(words)
        if len(words) > 10_000:
            assert [tuple(x) for x in r.runs] == [(1, 50_000, 1)] and r.collapsed == "start w"
            continue
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == plain_collapsed(words, runs) and r.n_words == len(words)
    assert periodic.periodic_runs(df.limit(0)).collect() == []


# Quality


def test_first_split_is_the_best():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=120) > 0.2).astype(float)
    trees = quality.fit(x, y, trees=1, depth=1, bins=200)
    p = 1 / (1 + np.exp(-np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = {}
    for f in range(3):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) >= quality.LEAST_HESSIAN:
                best[f, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, ~left))
    f, cut = max(best, key=best.get)
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == (f, cut)
    left = x[:, f] <= cut
    assert np.allclose(trees.leaf[0], [-quality.RATE * g[s].sum() / (h[s].sum() + quality.RIDGE) for s in (left, ~left)])


def test_flat_trees(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 7)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)), rng.integers(0, 2, 60).astype(float)
    trees = quality.fit(x, y, trees=9, depth=3, bins=8)

    def walk(t, row):
        node = 0
        while node < trees.feature.shape[1]:
            node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node])
        return trees.leaf[t, node - trees.feature.shape[1]]

    assert np.allclose(trees.margin(x), [trees.base + sum(walk(t, r) for t in range(9)) for r in x])
    losses = [np.mean(np.log1p(np.exp(-(2 * y - 1) * quality.fit(x, y, trees=n, depth=3, bins=8).margin(x)))) for n in (1, 5, 20)]
    assert losses == sorted(losses, reverse=True)


def test_no_labels():
    none = quality.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.ones((4, 3))).tolist() == [0.5] * 4
    assert quality.fit(np.ones((9, 3)), np.ones(9)).score(np.ones((2, 3))).min() > 0.9
    assert (quality.fit(np.ones((8, 3)), np.arange(8.0) % 2).score(np.ones((2, 3))) == 0.5).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.96


def test_quality_edges(spark):
    rows = [(1, None, "r"), (2, "", "s"), (3, "!! ## " * 40, None), (3, "!! ## " * 40, None), (None, "Plain words here.", "t"), (9, "word " * 100_000, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (9, None), (77, 1)], "doc_id long, quality int")
    trees = quality.learned(quality.labelled(df, marks))
    out = quality.score(df, trees).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.row.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and {r.row.score for r in out} == {"r", "s", None, "t", "u"}
    assert quality.score(df.limit(0), trees).collect() == []
    empty = quality.learned(quality.labelled(df, marks.limit(0)))
    assert {r.score for r in quality.score(df, empty).collect()} == {0.5}
    x = [r.x for r in quality.with_statistics(df).collect()]
    assert all(len(v) == len(quality.FEATURES) and np.isfinite(v).all() for v in x)
