"""Definitions, occurrences and calls of C++, Rust, TypeScript and C# by their syntax."""

import pytest

from ctxspark.sources import extract, files, trees


def roles(text, name, lang="cpp"):
    return [o["role"] for o in trees.rows(text, lang)[1] if o["name"] == name]


def calls(text, lang="cpp"):
    return [(e["caller"], e["callee"]) for e in trees.rows(text, lang)[2]]


def names(text, lang="cpp"):
    return [(d["name"], d["kind"]) for d in trees.rows(text, lang)[0]]


@pytest.mark.parametrize(
    ("text", "name", "lang", "want"),
    [
        ("struct Buoy { int depth; };", "Buoy", "cpp", ["def"]),
        ("struct Pier { void moor(); };\nvoid Pier::moor() { return; }", "moor", "cpp", ["def", "def"]),
        ("void f() { Pier::moor(); }", "moor", "cpp", ["call"]),
        ("void f() { Pier::moor(); }", "Pier::moor", "cpp", ["call"]),
        ("void f() { Pier::moor(); }", "Pier", "cpp", ["ref"]),
        ("void f(Boat& b) { b.sail(); p->sail(); }", "sail", "cpp", ["call", "call"]),
        ("void f() { build<int>(); std::max<long>(a, b); }", "build", "cpp", ["call"]),
        ("void f() { std::max<long>(a, b); }", "max", "cpp", ["call"]),
        ("struct Hull {};\nclass Ship final : public Hull, private Crew<int> {};", "Hull", "cpp", ["def", "ref"]),
        ("struct Hull;", "Hull", "cpp", ["def"]),
        ("struct Hull make(struct Hull h) { return h; }", "Hull", "cpp", ["ref", "ref"]),
        ("void f() { Grid<int> cells(size()); Tide low(3); auto p = new Tide(4); }", "cells", "cpp", ["ref"]),
        ("void f() { Grid<int> cells(size()); Tide low(3); auto p = new Tide(4); }", "size", "cpp", ["call"]),
        ("void f() { Tide low(3); auto p = new Tide(4); }", "Tide", "cpp", ["ref", "ref"]),
        ('void f() { ecs.system("Drift").run(); ZoneScopedN("Drift"); puts("Drift"); }', "Drift", "cpp", ["def", "def"]),
        ('// sail();\n#define sail() x()\nauto s = R"(sail();)"; /* sail(); */ char c = \'(\';', "sail", "cpp", []),
        ("fn tie() {}\nfn run() { tie(); crate::ropes::tie(); }", "tie", "rust", ["def", "call", "call"]),
        ("trait Knot { fn tie(&self); }", "tie", "rust", ["def"]),
        ("pub const LOW: u8 = 1 << 5;\npub static mut HIGH: i32 = 1;\nfn f() { let x = HIGH; }", "HIGH", "rust", ["def", "ref"]),
        ("pub const LOW: u8 = 1 << 5;", "LOW", "rust", ["def"]),
        ("fn f<'a>(x: &'a str) -> char { log!(x, '\\''); parse::<u8>(x); 'b' }", "log", "rust", ["call"]),
        ("fn f() { parse::<u8>(x); \"parse()\"; r#\"parse(\"#; }", "parse", "rust", ["call"]),
        ("enum Tide { Low(u8), High }\ntype Level = Tide;", "Level", "rust", ["def"]),
        ("function tie() {}\nfunction run() { tie(); new tie(); }", "tie", "ts", ["def", "call", "ref"]),
        ("interface Sail { area: number; hoist(): void }", "hoist", "ts", ["def"]),
        ("type Level = 'low' | 'high'; class Boat extends Hull { }", "Hull", "ts", ["ref"]),
        ("const tie = async <T>(x: T): Promise<T> => x;", "tie", "ts", ["def"]),
        ("const r = /tie(\\/)[/]/g, t = `tie()`; a?.tie(1); b.c.tie?.(2);", "tie", "ts", ["call", "call"]),
        ("const o = { tie(x) { pull(x); } };", "tie", "ts", ["def"]),
        ("namespace N { class Boat { void Sail() { Log.Write(\"x\"); } } }", "Write", "csharp", ["call"]),
        ("class Boat { public int Depth { get; set; } }", "Depth", "csharp", ["def"]),
        ("record Boat(string Name);\nclass A { void F() { var b = new Boat(@\"C:\\\"); F(); } }", "Boat", "csharp", ["def", "ref"]),
    ],
)
def test_roles(text, name, lang, want):
    assert roles(text, name, lang) == want


def test_cpp():
    text = """
namespace sea::tide {
/// How deep it is.
/// In metres.
template <class T> struct Gauge : Base<T> {
  Gauge(int n) : n_(n), v_{make(n)} { init(); }
  ~Gauge() { done(); }
  T get() const noexcept { return at<T>(n_); }
  bool operator==(const Gauge& o) const { return same(o); }
  static int count;
  int n_;
};
enum class Level : int { Low, High = calc(1) };
static int helper();
template <class T> T Gauge<T>::late() { if (ok(1)) for (auto& x : all()) { sort(x.begin(), [](int a) { return key(a); }); } return T(); }
}
extern "C" { void plain(int); }
REGISTER(Thing);
"""
    assert names(text) == [("sea::tide::Gauge", "Record"), ("sea::tide::Gauge::Gauge", "Function"), ("sea::tide::Gauge::~Gauge", "Function"), ("sea::tide::Gauge::get", "Function"), ("sea::tide::Gauge::operator==", "Function"), ("sea::tide::Level", "Record"), ("Gauge::late", "Function")]
    g = "sea::tide::Gauge::"
    late = [("Gauge::late", x) for x in ("ok", "all", "sort", "begin", "key", "T")]
    assert calls(text) == [(g + "Gauge", "make"), (g + "Gauge", "init"), (g + "~Gauge", "done"), (g + "get", "at"), (g + "operator==", "same"), *late]
    gauge = trees.rows(text, "cpp")[0][0]
    assert (gauge["doc"], gauge["line"], gauge["end_line"], gauge["signature"]) == ("How deep it is.\nIn metres.", 5, 12, "template <class T> struct Gauge : Base<T>")
    assert roles(text, "helper") == ["def"] and roles(text, "REGISTER") == ["call"] and roles(text, "plain") == ["def"]


def test_rust():
    text = """
/// A knot.
#[derive(Debug)]
// of rope
pub struct Knot<'a> { pub name: &'a str }
mod ropes {
    impl<T: Pull> super::Tie for Rope<T> where T: Clone {
        pub fn pull(&self) -> u8 {
            fn inner() { deep(); }
            inner();
            self.end.slack(|x| x.cut());
            Self::knot(1)
        }
    }
}
"""
    assert names(text, "rust") == [("Knot", "Record"), ("ropes::Rope::pull", "Function"), ("ropes::Rope::pull::inner", "Function")]
    assert calls(text, "rust") == [("ropes::Rope::pull::inner", "deep"), ("ropes::Rope::pull", "inner"), ("ropes::Rope::pull", "slack"), ("ropes::Rope::pull", "cut"), ("ropes::Rope::pull", "knot")]
    knot = trees.rows(text, "rust")[0][0]
    assert knot["doc"] == "A knot.\nof rope" and knot["exported"]


def test_typescript():
    text = """
export class Boat<T> extends Hull {
  private depth = 1;
  sail = (a: number): void => { this.go(a); };
  /** Moves. */
  async *steps<U>(x: U): AsyncGenerator<U> { yield f(x); }
  get name(): string { return g(); }
  constructor(private q: Q) { super(q); h(); }
}
export const z = async x => w(x);
const old = function () { return v(); };
export default function main() { const k = () => u(); k(); new Boat(); if (k()) { t(); } }
"""
    assert names(text, "ts") == [("Boat", "Record"), *[(f"Boat::{x}", "Function") for x in ("sail", "steps", "name", "constructor")], ("z", "Function"), ("old", "Function"), ("main", "Function"), ("main::k", "Function")]
    assert calls(text, "ts") == [("Boat::sail", "go"), ("Boat::steps", "f"), ("Boat::name", "g"), ("Boat::constructor", "h"), ("z", "w"), ("old", "v"), ("main::k", "u"), ("main", "k"), ("main", "k"), ("main", "t")]
    assert {d["name"]: d["doc"] for d in trees.rows(text, "ts")[0]}["Boat::steps"] == "Moves."


def test_csharp():
    text = """
namespace Sea.Tide;
[Serializable]
public class Boat : Hull, IMoor<int> {
  public Boat(int a) : base(Make(a)) { Init(); }
  string Name => Find();
  void Run() {
    var p = new Plugin(); p.Awake();
    int Local(int x) { return Deep(x); }
    list.Select(x => Map(x)).ToList<int>();
  }
  [Test] public static async Task<int> Go<T>(T t) where T : class => await Do(t);
  delegate void Moved(int by);
}
"""
    assert names(text, "csharp") == [("Boat", "Record"), ("Boat::Boat", "Function"), ("Boat::Name", "Property"), ("Boat::Run", "Function"), ("Boat::Run::Local", "Function"), ("Boat::Go", "Function"), ("Boat::Moved", "Function")]
    assert calls(text, "csharp") == [("Boat::Boat", "Make"), ("Boat::Boat", "Init"), ("Boat::Name", "Find"), ("Boat::Run", "Awake"), ("Boat::Run::Local", "Deep"), ("Boat::Run", "Select"), ("Boat::Run", "Map"), ("Boat::Run", "ToList"), ("Boat::Go", "Do")]


@pytest.mark.parametrize("lang", ["cpp", "rust", "ts", "csharp"])
@pytest.mark.parametrize("text", ["", "}", "((((", "{{{" * 2000, "a<b<c<", "fn", "class", "struct {", "const x", "'", '"', "f(", "operator", "@", "#[", "template <", "impl", "x = function", "get", "/*", "R\"(", "~", "namespace", "a::", "new", "=>"])
def test_broken_sources(text, lang):
    assert all(isinstance(x, list) for x in trees.rows(text, lang))


def test_relations(spark):
    rows = [("a.cpp", "struct A {};\nvoid f() { g(); }"), ("b.das", "def public go(x)\n"), ("c.py", 'def h():\n    "Says h."\n    k()\n'), ("d.txt", "void f() {}"), ("e.rs", None)]
    df = spark.createDataFrame(rows, "rel string, content string")
    assert sorted((r.rel, r.name, r.doc) for r in files.definitions(df).collect()) == [("a.cpp", "A", None), ("a.cpp", "f", None), ("b.das", "go", None), ("c.py", "h", "Says h.")]
    assert sorted((r.caller, r.callee) for r in files.call_edges(df).collect()) == [("f", "g"), ("h", "k")]
    assert extract.language("x.d/y") is None
