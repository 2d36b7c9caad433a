"""Git repositories as relations: objects of packs and loose files, commits, trees, the index, the working tree, its status and
differences between revisions.

The data source `git` reads the files of a repository in a folder that all executors see. Objects come in partitions of a pack's
entries (each task follows delta chains within the pack) and of loose folders; trees, status and differences are joins.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import folders_above
from ..operators import change, linediff
from ..storage import stored
from . import files

#: Object kinds by number, and of these the two whose data is a delta.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_OID = 6, 7
#: Bytes of objects that a task remembers as bases of deltas.
REMEMBER = 64 << 20
SCHEMAS = {"objects": "oid string, kind string, size long, data binary", "index": "path string, mode string, oid string, stage int", "worktree": "path string, mode string, oid string, size long, data binary"}


class Pack:
    """One pack with its index."""

    def __init__(self, path: str):
        with open(f"{path}.idx", "rb") as f:
            raw = f.read()
        if raw[:8] != b"\xfftOc\0\0\0\x02":
            raise ValueError(f"{path}.idx: only index version 2 is read")
        self.n = n = struct.unpack(">I", raw[1028:1032])[0]
        names = raw[1032 : 1032 + 20 * n]
        self.oids = [names[20 * i : 20 * i + 20] for i in range(n)]
        at = 1032 + 24 * n
        small = struct.unpack(f">{n}I", raw[at : at + 4 * n])
        large = raw[at + 4 * n :]
        self.offsets = [x if not x >> 31 else struct.unpack(">Q", large[8 * (x & 0x7FFFFFFF) : 8 * (x & 0x7FFFFFFF) + 8])[0] for x in small]
        with open(f"{path}.pack", "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.known: dict[int, tuple[int, bytes]] = {}
        self.held = 0

    def offset(self, oid: bytes) -> int | None:
        i = bisect_left(self.oids, oid)
        return self.offsets[i] if i < self.n and self.oids[i] == oid else None

    def read(self, offset: int) -> tuple[int, bytes]:
        """Kind and data of the object at an offset; deltas are followed down to a whole object and then applied."""
        chain = []
        while offset not in self.known:
            at, byte = offset + 1, self.data[offset]
            kind = byte >> 4 & 7
            while byte & 0x80:
                byte, at = self.data[at], at + 1
            base = None
            if kind == BY_OFFSET:
                byte, at = self.data[at], at + 1
                back = byte & 0x7F
                while byte & 0x80:
                    byte, at = self.data[at], at + 1
                    back = ((back + 1) << 7) | (byte & 0x7F)
                base = offset - back
            elif kind == BY_OID:
                base, at = self.offset(self.data[at : at + 20]), at + 20
                if base is None:
                    raise ValueError("a delta's base isn't in its pack")
            body = self._inflated(at)
            if base is None:
                self._remember(offset, (kind, body))
                break
            chain.append((offset, body))
            offset = base
        kind, body = self.known[offset]
        for at, delta in reversed(chain):
            body = patched(body, delta)
            self._remember(at, (kind, body))
        return kind, body

    def _inflated(self, at: int, step: int = 1 << 16) -> bytes:
        """What is deflated from a place on; only as much of the pack is read as that takes."""
        inflate, parts = zlib.decompressobj(), []
        while not inflate.eof and at < len(self.data):
            parts.append(inflate.decompress(self.data[at : at + step]))
            at += step
        return b"".join(parts)

    def _remember(self, offset: int, found: tuple[int, bytes]) -> None:
        if self.held > REMEMBER:
            self.known.clear()
            self.held = 0
        self.known[offset] = found
        self.held += len(found[1])


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: copies of the base's parts and new bytes."""
    at, sizes = 0, []
    for _ in range(2):
        value = shift = 0
        while True:
            byte, at = delta[at], at + 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                break
        sizes.append(value)
    out = []
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 0x80:
            start = size = 0
            for k in range(7):
                if op >> k & 1:
                    start, size = (start | delta[at] << 8 * k, size) if k < 4 else (start, size | delta[at] << 8 * (k - 4))
                    at += 1
            out.append(base[start : start + (size or 0x10000)])
        else:
            out.append(delta[at : at + op])
            at += op
    result = b"".join(out)
    if len(base) != sizes[0] or len(result) != sizes[1]:
        raise ValueError("a delta doesn't fit its base")
    return result


def _loose(path: str) -> tuple[str, bytes]:
    with open(path, "rb") as f:
        head, _, body = zlib.decompress(f.read()).partition(b"\0")
    return head.split()[0].decode(), body


def _packs(git: str) -> list[str]:
    folder = f"{git}/objects/pack"
    return sorted(f"{folder}/{n[:-4]}" for n in os.listdir(folder) if n.endswith(".idx")) if os.path.isdir(folder) else []


def read_object(git: str, oid: str) -> tuple[str, bytes]:
    """One object, for what is looked up on the driver: tags and the commits that a revision names."""
    path = f"{git}/objects/{oid[:2]}/{oid[2:]}"
    if os.path.exists(path):
        return _loose(path)
    for p in _packs(git):
        pack = Pack(p)
        if (at := pack.offset(bytes.fromhex(oid))) is not None:
            kind, body = pack.read(at)
            return KINDS[kind], body
    raise ValueError(f"no object {oid}")


def git_dir(root: str) -> str:
    path = f"{root.rstrip('/')}/.git"
    if os.path.isfile(path):  # a linked working tree
        with open(path, encoding="utf-8") as f:
            path = os.path.join(root, f.read().split(":", 1)[1].strip())
    return path if os.path.isdir(path) else root.rstrip("/")


def resolve(root: str, rev: str = "HEAD") -> str:
    """The commit that a revision names: a branch, tag, HEAD, an object's (beginning of) name, with ~n and ^n behind."""
    git = git_dir(root)
    m = re.match(r"([^~^]+)((?:[~^]\d*)*)$", rev)
    if not m or rev.startswith("-"):
        raise ValueError(f"not a revision: {rev}")
    oid = _named(git, m[1])
    for sign, number in re.findall(r"([~^])(\d*)", m[2]):
        for step in range(int(number or 1) if sign == "~" else 1):
            parents = re.findall(rb"^parent ([0-9a-f]{40})$", read_object(git, oid)[1].split(b"\n\n")[0], re.M)
            k = int(number or 1) - 1 if sign == "^" else 0
            if k >= len(parents):
                raise ValueError(f"{rev}: there is no such parent")
            oid = parents[k].decode()
    return oid


def _named(git: str, name: str) -> str:
    common = git
    if os.path.exists(f"{git}/commondir"):
        with open(f"{git}/commondir", encoding="utf-8") as f:
            common = os.path.join(git, f.read().strip())
    packed = {}
    if os.path.exists(f"{common}/packed-refs"):
        with open(f"{common}/packed-refs", encoding="utf-8") as f:
            packed = {ref: oid for oid, ref in (x.split() for x in f if x.strip() and x[0] not in "#^")}
    oid = None
    for ref in (name, f"refs/{name}", f"refs/tags/{name}", f"refs/heads/{name}", f"refs/remotes/{name}"):
        for folder in dict.fromkeys((git, common)):
            if ".." not in ref and os.path.isfile(f"{folder}/{ref}"):
                with open(f"{folder}/{ref}", encoding="utf-8") as f:
                    oid = f.read().strip()
                if oid.startswith("ref: "):
                    return _named(git, oid[5:])
                break
        oid = oid if oid and re.fullmatch("[0-9a-f]{40}", oid) else packed.get(ref)
        if oid:
            break
    if not oid and re.fullmatch("[0-9a-f]{4,40}", name):
        there = {p for p in ([name[:2] + x for x in os.listdir(f"{git}/objects/{name[:2]}")] if os.path.isdir(f"{git}/objects/{name[:2]}") else []) if p.startswith(name)}
        there |= {x.hex() for p in _packs(git) for x in Pack(p).oids if x.hex().startswith(name)}
        oid = there.pop() if len(there) == 1 else None
    if not oid:
        raise ValueError(f"unknown revision {name}")
    kind, body = read_object(git, oid)
    return body.split(b"\n")[0].split()[1].decode() if kind == "tag" else oid


def index_entries(git: str) -> list[tuple[str, str, str, int]]:
    """path, mode, oid, stage of the index (versions 2 and 3)."""
    if not os.path.exists(f"{git}/index"):
        return []
    with open(f"{git}/index", "rb") as f:
        raw = f.read()
    sign, version, n = struct.unpack(">4sII", raw[:12])
    if sign != b"DIRC" or version not in (2, 3):
        raise ValueError("only index versions 2 and 3 are read")
    out, at = [], 12
    for _ in range(n):
        mode, flags = struct.unpack(">I", raw[at + 24 : at + 28])[0], struct.unpack(">H", raw[at + 60 : at + 62])[0]
        start = at + 62 + 2 * bool(flags & 0x4000)
        end = raw.index(b"\0", start)
        out.append((raw[start:end].decode("utf-8", "replace"), f"{mode:06o}", raw[at + 40 : at + 60].hex(), flags >> 12 & 3))
        at += (end - at + 8) // 8 * 8
    return out


class Ignored:
    """The patterns of a tree's .gitignore files and info/exclude; the last one that fits decides."""

    def __init__(self, root: str, git: str):
        self.root, self.rules = root, []
        self.read(f"{git}/info/exclude", "")

    def read(self, path: str, base: str) -> None:
        if not os.path.isfile(path):
            return
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                rule = line.rstrip("\n").rstrip()
                if not rule or rule.startswith("#"):
                    continue
                out, rule = rule.startswith("!"), rule.removeprefix("!")
                folder, rule = rule.endswith("/"), rule.rstrip("/")
                fixed = "/" in rule
                parts = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
                body = re.sub(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]*\]|\\.|[^*?\[\\]", lambda m: parts.get(m[0]) or (m[0].replace("[!", "[^") if m[0][0] == "[" and len(m[0]) > 1 else re.escape(m[0][-1])), rule.lstrip("/"))
                self.rules.append((re.compile(re.escape(base) + ("" if fixed else "(?:.*/)?") + body + "$"), out, folder))

    def __call__(self, rel: str, is_folder: bool) -> bool:
        for rule, out, folder in reversed(self.rules):
            if (is_folder or not folder) and rule.match(rel):
                return not out
        return False


class _Part(InputPartition):
    def __init__(self, what: str, path: str, items: list):
        self.what, self.path, self.items = what, path, items


class _Reader(DataSourceReader):
    def __init__(self, root: str, what: str, per: int, content: bool):
        self.root, self.git, self.what, self.per, self.content = root, git_dir(root), what, per, content

    def partitions(self) -> list[_Part]:
        if self.what == "index":
            return [_Part("index", self.git, [])]
        if self.what == "worktree":
            found = self._walk()
            return [_Part("file", self.root, found[i : i + self.per]) for i in range(0, len(found), self.per)] or [_Part("file", self.root, [])]
        parts = []
        for p in _packs(self.git):
            n = Pack(p).n
            parts += [_Part("pack", p, [i, min(i + self.per, n)]) for i in range(0, n, self.per)]
        folders = [f"{i:02x}" for i in range(256) if os.path.isdir(f"{self.git}/objects/{i:02x}")]
        return parts + [_Part("loose", f"{self.git}/objects", folders[i : i + 16]) for i in range(0, len(folders), 16)] or [_Part("loose", self.git, [])]

    def _walk(self) -> list[str]:
        """Files that aren't ignored, and those of the index."""
        ignored, found = Ignored(self.root, self.git), set()
        for top, folders, names in os.walk(self.root):
            base = os.path.relpath(top, self.root).replace(os.sep, "/") + "/"
            base = "" if base == "./" else base
            ignored.read(os.path.join(top, ".gitignore"), base)
            folders[:] = sorted(d for d in folders if d != ".git" and not ignored(base + d, True))
            found.update(base + n for n in names if n != ".git" and not ignored(base + n, False))
        found.update(p for p, _, _, _ in index_entries(self.git) if os.path.lexists(os.path.join(self.root, p)))
        return sorted(p for p in found if not os.path.isdir(os.path.join(self.root, p)) or os.path.islink(os.path.join(self.root, p)))

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.what == "index":
            yield from index_entries(part.path)
        elif part.what == "pack":
            pack = Pack(part.path)
            # In the order of the file, where bases are near their deltas.
            order = sorted(range(pack.n), key=pack.offsets.__getitem__)[slice(*part.items)]
            for i in order:
                kind, body = pack.read(pack.offsets[i])
                yield pack.oids[i].hex(), KINDS[kind], len(body), body
        elif part.what == "loose":
            for folder in part.items:
                for name in sorted(os.listdir(f"{part.path}/{folder}")):
                    if re.fullmatch("[0-9a-f]{38}", name):
                        kind, body = _loose(f"{part.path}/{folder}/{name}")
                        yield folder + name, kind, len(body), body
        else:
            for rel in part.items:
                path = os.path.join(part.path, rel)
                try:
                    link = os.path.islink(path)
                    body = os.readlink(path).encode() if link else open(path, "rb").read()
                    mode = "120000" if link else "100755" if os.stat(path).st_mode & 0o100 else "100644"
                except OSError:
                    continue
                oid = hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()
                yield rel, mode, oid, len(body), body if self.content else None


class GitDataSource(DataSource):
    """spark.dataSource.register(GitDataSource); spark.read.format("git").option("read", "objects" or "index" or "worktree").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("read", "objects")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("read", "objects"), int(self.options.get("pertask", "2000")), self.options.get("content", "false") == "true")


def load(spark: SparkSession, root: str, what: str = "objects", content: bool = False) -> DataFrame:
    spark.dataSource.register(GitDataSource)
    return spark.read.format("git").option("read", what).option("content", str(content).lower()).load(root)


COMMIT = "oid string, tree string, parents array<string>, author string, email string, at long, message string"


def commits(objects: DataFrame) -> DataFrame:
    """oid, tree, parents, author, email, at (of the commit, in seconds) and message."""
    text = F.decode("data", "UTF-8")
    head, line = F.substring_index(text, "\n\n", 1), lambda p, g=1: F.regexp_extract(F.col("head"), p, g)
    c = objects.where("kind = 'commit'").select("oid", head.alias("head"), F.substring(text, F.length(head) + 3, F.length(text)).alias("message"))
    who = r"(?m)^author (.*?) ?<([^>]*)>"
    return c.select("oid", line(r"(?m)^tree ([0-9a-f]{40})$").alias("tree"), F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"), line(who).alias("author"), line(who, 2).alias("email"), line(r"(?m)^committer .*> (-?\d+) [+-]\d+$").cast("long").alias("at"), "message")


def tree_entries(objects: DataFrame) -> DataFrame:
    """tree, name, mode, oid of what is in each tree."""

    def work(batches):
        for pdf in batches:
            rows = []
            for tree, data in zip(pdf["oid"], pdf["data"]):
                at = 0
                while at < len(data):
                    space, zero = data.index(b" ", at), data.index(b"\0", at)
                    rows.append((tree, data[space + 1 : zero].decode("utf-8", "replace"), data[at:space].decode().zfill(6), data[zero + 1 : zero + 21].hex()))
                    at = zero + 21
            yield pd.DataFrame(rows, columns=["tree", "name", "mode", "oid"])

    return objects.where("kind = 'tree'").select("oid", "data").mapInPandas(work, "tree string, name string, mode string, oid string")


def files_at(spark: SparkSession, root: str, rev: str = "HEAD") -> DataFrame:
    """path, mode, oid of a revision's files: the tree's folders are opened level by level, all of a level in one join."""
    git = git_dir(root)
    tree = read_object(git, resolve(root, rev))[1].split(b"\n")[0].split()[1].decode()
    entries = stored(tree_entries(load(spark, root)), "tree-entries")
    level = entries.where(F.col("tree") == tree).select(F.col("name").alias("path"), "mode", "oid")
    out = None
    while True:
        level = stored(level, "tree-level")
        leaves = level.where("mode != '040000'")
        out = leaves if out is None else out.unionByName(leaves)
        folders = level.where("mode = '040000'").select("path", F.col("oid").alias("tree"))
        if folders.isEmpty():
            return out
        level = folders.join(entries, "tree").select(F.concat("path", F.lit("/"), "name").alias("path"), "mode", "oid")


def status(spark: SparkSession, root: str) -> DataFrame:
    """status (two letters, as a short status has them), path and size: index against HEAD, working tree against index, renames
    of unchanged files, and what is untracked, folders without a tracked file as one."""
    try:
        head = files_at(spark, root)
    except ValueError:  # no commit yet
        head = spark.createDataFrame([], "path string, mode string, oid string")
    index = stored(load(spark, root, "index"), "git-index")
    work = stored(load(spark, root, "worktree").drop("data"), "git-worktree")
    side = lambda df, n: df.select("path", F.concat_ws(" ", "mode", "oid").alias(n))
    i, w, h = F.col("i"), F.col("w"), F.col("h")
    # A submodule is a commit in the index and a folder in the tree.
    files_ = side(index.where("stage = 0 AND mode != '160000'"), "i")
    all_ = side(head.where("mode != '160000'"), "h").join(files_, "path", "full").join(work.select("path", F.concat_ws(" ", "mode", "oid").alias("w"), "size"), "path", "full")
    x = F.when(h.isNull() & i.isNotNull(), "A").when(h.isNotNull() & i.isNull(), "D").when(h != i, "M").otherwise(" ")
    y = F.when(i.isNull(), " ").when(w.isNull(), "D").when(w != i, "M").otherwise(" ")
    all_ = stored(all_.withColumns({"x": x, "y": y}), "git-status")
    nth = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("path"))
    added = all_.where("x = 'A'").select(F.col("i").alias("same"), "path").withColumn("n", nth("same"))
    gone = all_.where("x = 'D'").select(F.col("h").alias("same"), F.col("path").alias("old")).withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("old")))
    moved = added.join(gone, ["same", "n"]).select("path", "old")
    known = all_.join(moved.select("path", F.lit(True).alias("moved")), "path", "left").join(moved.select(F.col("old").alias("path"), F.lit(True).alias("left")), "path", "left").where("left IS NULL")
    changed = known.where("x != ' ' OR y != ' '").select(F.concat(F.when(F.col("moved"), "R").otherwise(F.col("x")), "y").alias("status"), "path", "size")
    conflicts = index.where("stage > 0").select(F.lit("UU").alias("status"), "path").distinct().join(work.select("path", "size"), "path", "left").select("status", "path", "size")
    fresh = all_.where("i IS NULL AND w IS NOT NULL").join(index.where("stage > 0").select("path"), "path", "left_anti").select("path", "size")
    tracked = index.select(F.explode(folders_above(F.col("path"))).alias("folder")).distinct()
    above = fresh.select("path", F.explode(folders_above(F.col("path"))).alias("folder")).where("folder != path").join(tracked, "folder", "left_anti")
    top = above.groupBy("path").agg(F.min_by("folder", F.length("folder")).alias("folder"))
    untracked = fresh.join(top, "path", "left").select(F.lit("??").alias("status"), F.coalesce(F.concat("folder", F.lit("/")), "path").alias("path"), F.when(F.col("folder").isNull(), F.col("size")).alias("size")).distinct()
    return changed.unionByName(conflicts).unionByName(untracked)


def differences(spark: SparkSession, root: str, old: str = "HEAD", new: str | None = None) -> DataFrame:
    """path, old, new: both texts of the files that differ between two revisions, or a revision and the tracked files of the working
    tree; null where there is none. Files with a zero byte are left out."""
    a = files_at(spark, root, old).select("path", F.col("oid").alias("a"))
    objects = load(spark, root)
    if new is None:
        tracked = load(spark, root, "index").select("path").distinct()
        now = load(spark, root, "worktree").select("path", F.col("oid").alias("b")).join(tracked, "path", "left_semi")
    else:
        now = files_at(spark, root, new).select("path", F.col("oid").alias("b"))
    pairs = stored(a.join(now, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))), "git-pairs")
    text = lambda c: F.decode(c, "UTF-8")
    blobs = objects.where("kind = 'blob'").select("oid", "data")
    out = pairs.join(blobs.select(F.col("oid").alias("a"), F.col("data").alias("x")), "a", "left")
    if new is None:
        there = load(spark, root, "worktree", content=True).select("path", F.col("oid").alias("b"), F.col("data").alias("y"))
        out = out.join(there, ["path", "b"], "left")
    else:
        out = out.join(blobs.select(F.col("oid").alias("b"), F.col("data").alias("y")), "b", "left")
    binary = lambda c: F.coalesce(F.contains(F.hex(F.substring(c, 1, 8000)), F.lit("00")) & (F.locate("\0", F.decode(c, "ISO-8859-1")) > 0), F.lit(False))
    return out.where(~binary("x") & ~binary("y")).select("path", text("x").alias("old"), text("y").alias("new"))


def diff(spark: SparkSession, root: str, old: str = "HEAD", new: str | None = None) -> DataFrame:
    """path and the hunks between two revisions, or a revision and the working tree, with the lines they touch."""
    return linediff.touched(linediff.line_hunks(differences(spark, root, old, new)))


def diff_map(spark: SparkSession, root: str, old: str = "HEAD", new: str | None = None) -> DataFrame:
    """Definitions of the new side that a difference touches, and whether they are new or changed in body or signature."""
    both = stored(differences(spark, root, old, new), "git-differences")
    spans = lambda side: files.definitions(both.where(F.col(side).isNotNull()).select(F.col("path").alias("rel"), F.col(side).alias("content"))).where("kind = 'Function'")
    ranges = linediff.touched(linediff.line_hunks(both.where("new IS NOT NULL"))).select(F.col("path").alias("rel"), "first", "last")
    return change.classify(change.overlapping(spans("new").withColumns({"start": F.col("line"), "end": F.col("end_line")}), ranges), spans("old"))


def commit_scopes(spark: SparkSession, root: str, scope: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is dirty in each scope (name, prefix), what in none, and the warnings about it."""
    dirty = stored(status(spark, root), "git-dirty")
    inside, outside = change.scopes(dirty, scope)
    return inside, outside, change.warnings(dirty)
