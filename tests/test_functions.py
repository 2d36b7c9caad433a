"""Scalar functions on small rows."""

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import text as tx
from ctxspark.functions import vectors as vx
from ctxspark.operators import paging


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.lit("The café: é x 42 You_use RUNS"))) == ["café", "é", "42", "runs"]
    assert one(spark, tx.option_tokens(F.lit("Für the Big-box 7"))) == ["big", "box"]
    assert one(spark, tx.idea_tokens(F.lit("the an Big box"))) == ["the", "big", "box"]


@pytest.mark.parametrize("a, b, multiset, both", [("aaa aaa", "aaa", 2.0, 1.0), ("aaa", "aaa aaa", 0.5, 1.0), ("aaa bbb", "bbb ccc", 1 / 3, 1 / 3), ("", "aaa", 0.0, 0.0)])
def test_overlap(spark, a, b, multiset, both):
    x, y = tx.idea_tokens(F.lit(a)), tx.idea_tokens(F.lit(b))
    assert one(spark, tx.overlap(x, y)) == pytest.approx(multiset)
    assert one(spark, tx.overlap(x, y, "set")) == pytest.approx(both)


def test_snippet(spark):
    body = "first line\nsecond has needle here\nthird"
    assert one(spark, tx.snippet(F.lit(body), ["needle"], 12)) == "second has n …"
    assert one(spark, tx.snippet(F.lit(body), ["nothing"], 100)) == "first line second has needle here third"
    assert one(spark, tx.clean(F.lit("  ## a   b\n`"))) == "a b"


@pytest.mark.parametrize("text, heading, idea, defect", [("Hello, World_1!", "hello-world_1", "hello-world-1", "hello-world-1"), ("É a/b", "é-a-b", "a-b", "ab"), ("!!!", "section", "idea", "")])
def test_slugs(spark, text, heading, idea, defect):
    assert one(spark, tx.heading_slug(F.lit(text))) == heading
    assert one(spark, tx.idea_slug(F.lit(text))) == idea
    assert one(spark, tx.defect_slug(F.lit(text))) == defect


@pytest.mark.parametrize("n, shown", [(0, "0"), (999, "999"), (120500, "120,500"), (3_250_000, "3.25M"), (1_230_000_000, "1.23B"), (2 * 10**12, "2T")])
def test_grouped(spark, n, shown):
    assert one(spark, tx.grouped(F.lit(n).cast("long"))) == shown


@pytest.mark.parametrize("a, b, shown", [(0, 0, "0"), (100, 100, "100"), (50, 100, "50.0"), (9994, 10000, "99.9"), (9995, 10000, "99.9")])
def test_percent(spark, a, b, shown):
    assert one(spark, tx.percent(F.lit(a), F.lit(b))) == shown


def test_names(spark):
    assert one(spark, tx.segment(F.lit("a::b::c"))) == "c"
    assert one(spark, tx.normal_symbol(F.lit("::std::vector<std::pair<int, int>>"))) == "vector"
    assert one(spark, tx.folder(F.lit("a/b/c.rs"), 1)) == "a"
    assert one(spark, tx.folder(F.lit("c.rs"), 1)) == "."
    assert one(spark, tx.ago(F.lit(90061))) == "1d 1h ago"


@pytest.mark.parametrize("name, score", [("widget", 0), ("Widget", 1), ("mywidget", 12), ("wiget", 21), ("E", None), ("unrelated", None)])
def test_fuzzy(spark, name, score):
    assert one(spark, tx.fuzzy_score("widget", F.lit(name))) == score


@pytest.mark.parametrize("ok, text, n, want", [(False, "x is required", 0, "invalid"), (False, "no such file", 0, "not_found"), (False, "boom", 0, "error"), (True, "rows\ntruncated by token_budget", 99, "truncated"), (True, "not found: x", 99, "not_found"), (True, "fine\nnot found inside", 99, "ok"), (True, "fine", 0, "empty"), (True, "fine", 25, "low_yield"), (True, "a\n (no matching occurrences)", 99, "not_found")])
def test_outcome(spark, ok, text, n, want):
    assert one(spark, tx.outcome(F.lit(ok), F.lit(text), F.lit(n))) == want


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vx.cosine(a(1, 0), a(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, vx.cosine(a(0, 0), a(1, 1))) == 0
    assert one(spark, vx.top_margin(a(0.96, 0.02, 0.02))) == pytest.approx(0.94)
    assert one(spark, vx.conformal_size(a(0.4, 0.35, 0.25), 0.1)) == 0
    assert one(spark, vx.conformal_size(a(0.96, 0.02, 0.02), 0.1)) == 1
    assert sum(one(spark, vx.softmax_array(a(1, 2, 3)))) == pytest.approx(1)
    assert one(spark, vx.char_precision(F.lit("abcd"), F.lit("abxd"))) == pytest.approx(0.75)


def test_freshness(spark):
    rows = spark.createDataFrame([("2024-01-01", "seed"), ("2023-12-10", "seed"), ("2023-01-01", "seed"), ("2023-01-01", "growing"), ("2030-01-01", "seed"), ("bad", "seed")], "touched string, status string")
    age, band = vx.freshness(F.col("touched"), F.col("status"), F.lit("2024-01-02").cast("date"))
    assert [(r.a, r.b) for r in rows.select(age.alias("a"), band.alias("b")).collect()] == [(1, "fresh"), (23, "due"), (366, "dormant"), (366, "stale"), (0, "fresh"), (0, "fresh")]


def test_budget_and_continuation(spark):
    rows = spark.createDataFrame([(1, 50), (2, 60), (3, 1)], "id int, size int")
    assert [r.id for r in paging.budget_page(rows, F.col("size"), ["id"], 100).orderBy("rank").collect()] == [1]
    assert [r.id for r in paging.budget_page(rows, F.col("size"), ["id"], 10).orderBy("rank").collect()] == [1]
    assert [r.id for r in paging.budget_page(rows, F.col("size"), ["id"], 100, offset=1).orderBy("rank").collect()] == [2, 3]
    token = paging.encode("search", {"q": "x", "token_budget": 5}, 3)
    assert paging.resume(token, "search", {"q": "x"}) == 3
    with pytest.raises(ValueError):
        paging.resume(token, "search", {"q": "y"})
    with pytest.raises(ValueError):
        paging.resume("%%%", "search", {})
