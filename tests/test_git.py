"""Repositories read as relations, against what the git command says of them."""

import random
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxspark.operators import linediff
from ctxspark.sources import git


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_shortest_script(a, b):
    pairs = linediff.kept(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) == lcs(a, b)
    new = list(a)
    for s, n, t, m in reversed(list(linediff.hunks_of(a, b))):  # the hunks make the new side
        at = s - 1 if n else s
        new[at : at + n] = b[t - 1 if m else t :][:m]
    assert new == b


def test_long_texts():
    rng = random.Random(1)
    a = [str(rng.randrange(10**9)) for _ in range(20_000)]
    b = [x for x in a if rng.random() > 0.02]
    assert len(linediff.kept(a, b)) == len(b)
    assert list(linediff.hunks_of([], ["x\n"])) == [(0, 0, 1, 1)] and list(linediff.hunks_of(["x\n"], ["x"])) == [(1, 1, 1, 1)]


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def run(*args, check=True):
        env = {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "HOME": str(root), "PATH": "/usr/bin:/bin"}
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=Ana B", "-c", "user.email=a@b.c", *args], check=check, capture_output=True, text=True, env=env).stdout

    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)

    rng = random.Random(2)
    lines = [f"int f{i}(int a) {{ return a + {i}; }}\n" for i in range(300)]
    run("init", "-q", "-b", "main")
    put("src/deep/a.cpp", "".join(lines))
    put("src/b.py", "def one():\n    return 1\n\ndef two():\n    return 2\n")
    put("été.txt", "x\n")
    put(".gitignore", "*.log\nout/\n!keep.log\n/only.txt\n")
    (root / "bin.dat").write_bytes(bytes(range(256)) * 4)
    for name in ("one", "two", "three"):
        put(f"gone/{name}.txt", name * 20)
    run("add", "-A")
    run("commit", "-qm", "First\n\nwith a body")
    for k in range(6):  # versions that a pack keeps as deltas
        lines[rng.randrange(300)] = f"int g{k}() {{ return {k}; }}\n"
        put("src/deep/a.cpp", "".join(lines))
        run("commit", "-qam", f"Change {k}")
    run("tag", "-a", "v1", "-m", "tagged")
    run("gc", "-q", "--aggressive")
    put("src/new.py", "def three():\n    return 3\n")
    run("add", "-A")
    run("commit", "-qm", "After packing")
    # Staged, changed, deleted, moved, untracked and ignored.
    put("src/b.py", "def one():\n    return 10\n\ndef two(x):\n    return 2\n\ndef four():\n    pass\n")
    put("src/staged.py", "x = 1\n")
    run("add", "src/staged.py")
    put("src/staged.py", "x = 2\n")
    run("mv", "gone/one.txt", "gone/first.txt")
    run("rm", "-q", "gone/two.txt")
    (root / "gone/three.txt").unlink()
    for p in ("a.log", "keep.log", "out/x", "only.txt", "sub/only.txt", "fresh/deep/y", "fresh/z", "src/deep/loose"):
        put(p, p)
    (root / "src/new.py").chmod(0o755)
    return root, run


def test_objects(spark, repo):
    root, run = repo
    want = {tuple(x.split()) for x in run("cat-file", "--batch-check", "--batch-all-objects").splitlines()}
    got = git.load(spark, str(root)).select("oid", "kind", "size", F.sha1(F.concat(F.encode(F.concat("kind", F.lit(" "), "size", F.lit("\0")), "UTF-8"), "data")).alias("h")).collect()
    assert {(r.oid, r.kind, str(r.size)) for r in got} == want
    assert all(r.h == r.oid for r in got)
    assert any(n.endswith(".pack") for n in [p.name for p in (root / ".git/objects/pack").iterdir()])


def test_commits(spark, repo):
    root, run = repo
    want = {tuple(x.split("|")) for x in run("log", "--format=%H|%T|%P|%an|%ae|%ct|%s").splitlines()}
    rows = git.commits(git.load(spark, str(root))).collect()
    assert {(r.oid, r.tree, " ".join(r.parents), r.author, r.email, str(r["at"]), r.message.split("\n")[0]) for r in rows} == want
    assert any(r.message == "First\n\nwith a body\n" for r in rows)


@pytest.mark.parametrize("rev", ["HEAD", "main", "v1", "HEAD~3", "HEAD^", "v1~2^1"])
def test_revisions(spark, repo, rev):
    root, run = repo
    assert git.resolve(str(root), rev) == run("rev-parse", f"{rev}^{{commit}}").strip()
    if rev in ("HEAD", "v1"):
        want = {(x.split("\t")[1], x.split()[0], x.split()[2]) for x in run("-c", "core.quotePath=false", "ls-tree", "-r", rev).splitlines()}
        assert {tuple(r) for r in git.files_at(spark, str(root), rev).collect()} == want


def test_unknown_revisions(repo):
    root, run = repo
    full = run("rev-parse", "HEAD").strip()
    assert git.resolve(str(root), full) == git.resolve(str(root), full[:10]) == full
    for rev in ("nothing", "HEAD~99", "--all", "HEAD^3"):
        with pytest.raises(ValueError):
            git.resolve(str(root), rev)


def test_status(spark, repo):
    root, run = repo
    lines = run("-c", "core.quotePath=false", "status", "--porcelain", "-unormal").splitlines()
    want = {(x[:2], x[3:].split(" -> ")[-1]) for x in lines}
    got = git.status(spark, str(root)).collect()
    assert {(r.status, r.path) for r in got} == want
    assert {s for s, _ in want} == {" M", "AM", "R ", "D ", " D", "??"}
    assert {r.path: r.size for r in got}["src/deep/loose"] == len("src/deep/loose")


@pytest.mark.parametrize(("old", "new"), [("v1~5", "v1"), ("HEAD~1", "HEAD"), ("HEAD", None)])
def test_diff(spark, repo, old, new):
    root, run = repo
    text = run("-c", "core.quotePath=false", "diff", "-U0", "--no-renames", "--minimal", "--no-indent-heuristic", old, *([new] if new else []))
    want, path = {}, ""
    for line in text.splitlines():
        if line.startswith(("--- a/", "+++ b/")):
            path = line[6:]
        elif line.startswith("@@"):
            side = [tuple(map(int, (x[1:] + ",1").split(",")[:2])) for x in line.split()[1:3]]
            added, gone = want.get(path, (0, 0))
            want[path] = (added + side[1][1], gone + side[0][1])
    got = git.diff(spark, str(root), old, new).groupBy("path").agg(F.sum("new_count").alias("a"), F.sum("old_count").alias("g")).collect()
    assert {r.path: (r.a, r.g) for r in got} == want and want


def test_diff_map_and_scopes(spark, repo):
    root, run = repo
    assert {(r.rel, r.name, r.change) for r in git.diff_map(spark, str(root)).collect()} == {("src/b.py", "one", "body"), ("src/b.py", "two", "signature"), ("src/b.py", "four", "new")}
    cpp = {(r.rel, r.name, r.change) for r in git.diff_map(spark, str(root), "v1~1", "v1").collect()}
    assert cpp == {("src/deep/a.cpp", "g5", "new")}
    inside, outside, warned = git.commit_scopes(spark, str(root), spark.createDataFrame([("code", "src/")], "name string, prefix string"))
    assert {r.path for r in inside.collect()} == {"src/b.py", "src/staged.py", "src/deep/loose", "src/new.py"}
    assert "gone/first.txt" in {r.path for r in outside.collect()} and warned.collect() is not None


def test_no_commit_yet(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "x").write_text("1")
    assert [(r.status, r.path) for r in git.status(spark, str(tmp_path)).collect()] == [("??", "x")]
