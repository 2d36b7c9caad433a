"""Parsers and file relations on small files."""

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import change, graph
from ctxspark.operators import runtime as rt
from ctxspark.plans import registry
from ctxspark.sources import extract, files

NOTE = """---
title: "Notes"
tags: [one, 'two', one]
---
before

# Top #
text [[other|label]] and ![pic](x.png)
```
# not a heading
[no](link)
```
## Sub
see [a](docs/a_(1).md) and [ext](https://x.y) and [<sp>](<a b.md>)
## Sub
again
"""

CPP = """#include <array>
#include "gauge/tide.hpp"

namespace harbor {
struct Reading { double level; std::string place; long taken; };
// Mean of a day's readings.
double mean_level(const std::array<Reading, 24>& day) {
  double sum = 0;
  for (const auto& r : day) { sum += r.level; }
  return sum / 24; // not mean_level(day)
}
bool flood(const std::array<Reading, 24>& day, double dyke) {
  const char* note = "mean_level(x)";
  if (mean_level(day) > dyke) {
    return true;
  }
  return false;
}
}
"""


def test_sections():
    got = list(extract.sections(NOTE))
    assert [(s["heading"], s["heading_level"], s["anchor"], s["start_line"]) for s in got] == [("", 0, "section", 5), ("Top", 1, "top", 7), ("Sub", 2, "sub", 13), ("Sub", 2, "sub#2", 15)]
    assert got[2]["heading_path"] == ["Top", "Sub"] and got[0]["tags"] == ["one", "two"]
    assert got[1]["end_line"] == 12


def test_links():
    assert [(x["target"], x["is_external"]) for x in extract.links(NOTE)] == [("other", False), ("docs/a_(1).md", False), ("https://x.y", True), ("a b.md", False)]


def test_cpp():
    defs, occ, edges = extract.code_rows("src/tide.cpp", CPP)
    assert {(d["name"], d["kind"]) for d in defs} == {("harbor::Reading", "Record"), ("harbor::mean_level", "Function"), ("harbor::flood", "Function")}
    assert [(e["caller"], e["callee"], e["line"]) for e in edges] == [("harbor::flood", "mean_level", 14)]
    assert {d["name"] for d in defs if d["has_doc"]} == {"harbor::mean_level"}
    assert {d["name"].split("::")[1]: d["end_line"] for d in defs} == {"Reading": 5, "mean_level": 11, "flood": 18}


def test_python():
    defs, occ, edges = extract.python_rows('class A:\n    "doc"\n    def m(self):\n        return helper(1)\n\ndef _p():\n    A().m()\n')
    assert [(d["name"], d["kind"], d["has_doc"], d["exported"]) for d in defs] == [("A", "Record", True, True), ("A::m", "Function", False, True), ("_p", "Function", False, False)]
    assert {(e["caller"], e["callee"]) for e in edges} == {("A::m", "helper"), ("_p", "A"), ("_p", "m")}
    assert extract.python_rows("def (") == ([], [], [])


def test_rust_and_ts():
    defs, _, edges = extract.code_rows("a.rs", "pub fn go(x: u32) -> u32 { step(x) }\nfn step(x: u32) -> u32 { x }\n")
    assert {(d["name"], d["exported"]) for d in defs} == {("go", True), ("step", False)}
    assert [(e["caller"], e["callee"]) for e in edges] == [("go", "step")]
    defs, _, edges = extract.code_rows("a.svelte", "<p>x()</p><script>\nexport function f() { g(); }\n</script>")
    assert [(e["caller"], e["callee"], e["line"]) for e in edges] == [("f", "g", 2)]


def test_fields():
    got = list(extract.record_fields("struct P { int a; std::string s; float* p; };"))
    assert [(f["name"], f["non_pod_reason"]) for f in got] == [("a", None), ("s", "string"), ("p", "pointer")]


def test_tree_and_relations(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/tide.cpp").write_text(CPP)
    (tmp_path / "target/gone.cpp").write_text(CPP)
    (tmp_path / "note.md").write_text(NOTE)
    t = files.tree(spark, str(tmp_path)).cache()
    assert {(r.rel, r.lang) for r in t.collect()} == {("src/tide.cpp", "cpp"), ("note.md", None)}
    assert {(r.target, r.angle) for r in files.includes(t).collect()} == {("gauge/tide.hpp", False), ("array", True)}
    edges = files.call_edges(t)
    assert [r.caller for r in graph.callers(edges, "mean_level").collect()] == ["harbor::flood"]
    assert files.chunks(files.sections(t.where("lang IS NULL"))).count() == 4
    ctx = registry.symbol_context(files.definitions(t), edges, files.fields(t), "Reading")
    assert ctx["layout"].count() == 3
    assert [r.symbols for r in files.symbol_map(t).collect()][0]
    ex = graph.usage_examples(files.occurrences(t), files.lines(t), "mean_level", context=1).collect()
    assert {r.line for r in ex} == {13, 14, 15}


def test_repo_source(spark, tmp_path):
    from ctxspark.sources.repo import RepoDataSource

    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/x.py").write_text("1")
    (tmp_path / ".gitignore").write_text("/skip/\n*.tmp\n")
    (tmp_path / "a.py").write_text("x = 1")
    spark.dataSource.register(RepoDataSource)
    rows = spark.read.format("repo").load(str(tmp_path)).collect()
    assert {(r.rel, r.lang) for r in rows} == {("a.py", "python"), (".gitignore", None)}


def test_trace_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Zone,TIME,calls\nfoo,10,2\nbar,x,1\n,5,1\n")
    rows = files.trace_csv(spark, str(tmp_path / "a.csv")).collect()
    assert {(r.name, r.total_ns, r.counts) for r in rows} == {("foo", 10.0, 2), ("bar", 0.0, 1)}
    assert files.newest(spark, str(tmp_path)).endswith("a.csv")


def test_json_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"seq": 1}\nbroken\n{"seq": 3}\n')
    df = files.json_lines(spark, str(tmp_path / "e.jsonl"), "seq long").cache()
    assert df.where("malformed IS NOT NULL").count() == 1
    assert [r.seq for r in files.tail(df.where("seq IS NOT NULL"), "seq", 1).collect()] == [3]


def test_maps(spark):
    text = spark.createDataFrame([("00400000-00600000 rw-p 00000000 00:00 0 [heap]",), ("7f0000000000-7f0000001000 r-xp 00000000 08:01 5 /usr/lib/libc.so.6",), ("ffffffffff600000-ffffffffff601000 --xp 00000000 00:00 0 [vsyscall]",), ("7ffc0000-7ffd0000 rw-p 0 00:00 0 [stack]",)], "value string")
    got = {r.kind: (int(r.start), int(r.end)) for r in files.memory_maps(text).collect()}
    assert got["heap"][1] - got["heap"][0] == 0x200000
    assert got["vdso"][0] == 0xFFFFFFFFFF600000 and set(got) == {"heap", "image", "vdso", "stack"}


def test_allocations(spark):
    text = spark.createDataFrame([(1, "A 0x10 64"), (2, "A 0x20 32"), (3, "F 0x10 0"), (4, "R 0x20 0x30 100"), (5, "noise")], "ord long, value string")
    ev = files.allocation_lines(text).collect()
    assert [(e.kind, e.ptr, e.size) for e in ev] == [("A", 16, 64), ("A", 32, 32), ("F", 16, 0), ("R", 32, 100)]
    rows = spark.createDataFrame([(1, "A", 16, None, 64), (2, "A", 32, None, 32), (3, "F", 16, None, 0), (4, "R", 32, 48, 100)], "ord long, kind string, ptr long, new_ptr long, size long")
    d = rt.allocation_deltas(rows).groupBy().agg(F.sum("delta")).first()[0]
    assert d == 100


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +3,4 @@
+a
@@ -9 +12,0 @@
--- a/gone.py
+++ /dev/null
@@ -1,3 +0,0 @@
"""


def test_diff(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(DIFF.split("\n"))], "diff string, ord int, text string")
    h = change.hunks(lines).orderBy("first").collect()
    assert [(r.rel, r.first, r.last) for r in h] == [("x.py", 3, 6), ("x.py", 12, 12)]
    spans = spark.createDataFrame([("x.py", "a", 1, 2, "def a()"), ("x.py", "b", 5, 20, "def b(x)")], "rel string, name string, start int, end int, signature string")
    old = spark.createDataFrame([("x.py", "b", "def b()")], "rel string, name string, signature string")
    assert [(r.name, r.change) for r in registry.diff_map(lines, spans, old).collect()] == [("b", "signature")]


def test_scopes_and_warnings(spark):
    d = spark.createDataFrame([("a/.env", 10, "??"), ("target/x.o", 2_000_000, "M"), ("src/m.rs", 5, "M")], "path string, size long, status string")
    assert {(r.path, r.warning) for r in change.warnings(d).collect()} == {("a/.env", "secret"), ("target/x.o", "generated"), ("target/x.o", "binary"), ("target/x.o", "large")}
    assert [(r.folder, r.files) for r in change.untracked_buckets(d).collect()] == [("a", 1)]


def test_garden(spark):
    paths = spark.createDataFrame([("README.md",), ("docs/a.md",), ("docs/b.md",)], "path string")
    links = spark.createDataFrame([("docs/a.md", "b"), ("docs/a.md", "../README.md#x"), ("docs/a.md", "#here"), ("docs/b.md", "nope"), ("docs/b.md", "/docs/a.md?q")], "source string, target string")
    r = graph.resolve_links(links, paths).cache()
    assert {(x.target, x.resolved) for x in r.collect()} == {("b", "docs/b.md"), ("../README.md#x", "README.md"), ("#here", "docs/a.md"), ("nope", None), ("/docs/a.md?q", "docs/a.md")}
    broken, orphans, inbound = graph.garden(r, paths)
    assert [b.target for b in broken.collect()] == ["nope"] and orphans.count() == 0


def test_registry(spark):
    assert len(registry.TOOLS) + len(registry.OUTSIDE) >= 67
    with pytest.raises(NotImplementedError):
        registry.run("task_submit")
    assert registry.tools(spark).count() == len(registry.TOOLS) + len(registry.OUTSIDE)


def test_code_files_are_dealt_out(spark, tmp_path):
    """A table in one row group comes to the parsers in as many parts as there are cores, and more."""
    from ctxspark.plans import catalog

    spark.range(4000).selectExpr("id AS p_partkey", "1 AS p_size", "'x' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parts = catalog.code_files(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 4000
    assert max(r["count"] for r in parts) < 1000
