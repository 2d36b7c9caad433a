"""Relations over files: trees of sources and notes, Markdown, code, CSV traces, JSON lines, maps, diffs and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import extract

SECTION = "path string, heading string, heading_level int, heading_path array<string>, anchor string, ordinal int, start_line int, end_line int, body string, tags array<string>"
LINK = "source string, raw string, target string, is_external boolean"
DEF = "rel string, name string, kind string, line int, end_line int, signature string, has_doc boolean, exported boolean, doc string"
OCCURRENCE = "rel string, name string, role string, line int"
EDGE = "rel string, caller string, callee string, line int, text string"
FIELD = "rel string, type string, name string, ty string, ord int, non_pod_reason string"


def tree(spark: SparkSession, root: str, pruned: list[str] | None = None, pattern: str = "*") -> DataFrame:
    """rel, lang, bytes, mtime, content of the files under a folder of any file system, without those in pruned folders."""
    skip = pruned if pruned is not None else extract.PRUNED
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z]+:/*", "/"), r"^\Q" + _bare(root) + r"\E/*", "")
    ext = F.when(F.regexp_extract(rel, r"([^/]*)$", 1).contains("."), F.lower(F.substring_index(rel, ".", -1)))
    lang = F.create_map(*[F.lit(x) for pair in extract.BY_EXTENSION.items() for x in pair])[ext]
    folders = F.slice(F.split(rel, "/"), F.lit(1), F.size(F.split(rel, "/")) - 1)
    out = raw.select(rel.alias("rel"), lang.alias("lang"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), folders.alias("_f"), "content")
    return out.where(~F.arrays_overlap("_f", F.lit(skip)) if skip else F.lit(True)).drop("_f").withColumn("content", F.decode("content", "UTF-8"))


def _bare(root: str) -> str:
    import re

    return re.sub(r"^[a-zA-Z]+:/*", "/", root).rstrip("/")


def _rows(files: DataFrame, parse: Callable[[str, str], Iterator[dict]], schema: str, key: str) -> DataFrame:
    """parse(path, text) of every file as rows; runs on Arrow batches of files."""
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def work(batches):
        for pdf in batches:
            out = [{key: p} | r for p, t in zip(pdf["path"], pdf["text"]) for r in parse(p, t or "")]
            yield pd.DataFrame(out, columns=names)

    return files.select(F.col("rel").alias("path"), F.col("content").alias("text")).mapInPandas(work, schema)


def sections(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t: extract.sections(t), SECTION, "path")


def chunks(sections_: DataFrame) -> DataFrame:
    """Sections with text, as search takes them: the heading counts as text."""
    body = F.concat_ws("\n", F.nullif("heading", F.lit("")), "body")
    return sections_.where(F.trim("body") != "").select(F.concat_ws("#", "path", "anchor").alias("chunk_id"), body.alias("body"), "path", "heading")


def links(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t: extract.links(t), LINK, "source")


def definitions(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t: iter(extract.code_rows(p, t)[0]), DEF, "rel")


def occurrences(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t: iter(extract.code_rows(p, t)[1]), OCCURRENCE, "rel")


def call_edges(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t: iter(extract.code_rows(p, t)[2]), EDGE, "rel")


def fields(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, t: extract.record_fields(t), FIELD, "rel")


def lines(files: DataFrame) -> DataFrame:
    """rel, line (from 1), text."""
    return files.select("rel", F.posexplode(F.split("content", "\n")).alias("n", "text")).select("rel", (F.col("n") + 1).alias("line"), "text")


def includes(files: DataFrame) -> DataFrame:
    """rel, target, angle, ord of every #include; built-in expressions only."""
    m = lambda g: F.regexp_extract("text", r"^\s*#\s*include\s*([<\"])([^>\"]+)[>\"]", g)
    return lines(files).where(m(2) != "").select("rel", m(2).alias("target"), (m(1) == "<").alias("angle"), F.col("line").alias("ord"))


def symbol_map(files: DataFrame, cap: int = 40) -> DataFrame:
    """rel and its first `cap` signatures, in order, and how many there are."""
    d = definitions(files)
    first = F.slice(F.array_sort(F.collect_list(F.struct("line", "signature"))), 1, cap)
    return d.groupBy("rel").agg(F.transform(first, lambda x: x["signature"]).alias("symbols"), F.count("*").alias("n"))


#: Names that a trace's columns may have.
TRACE_NAMES = {
    "name": ["name", "zone", "zone_name"], "src_file": ["src_file", "file", "source"], "src_line": ["src_line", "line"], "total_ns": ["total_ns", "time", "total", "total_time"],
    "counts": ["counts", "count", "calls"], "mean_ns": ["mean_ns", "mean", "avg"], "max_ns": ["max_ns", "max"],
}


def trace_csv(spark: SparkSession, path: str) -> DataFrame:
    """Profile rows of CSV files with a header: columns by any of their names in any case, unreadable numbers 0, rows without a
    name left out."""
    raw = spark.read.option("header", "true").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    pick = lambda k: next((F.col(f"`{have[n]}`") for n in TRACE_NAMES[k] if n in have), F.lit(None).cast("string"))
    num = lambda k, t: F.coalesce(F.trim(pick(k)).try_cast(t), F.lit(0).cast(t)).alias(k)
    out = raw.select(F.trim(pick("name")).alias("name"), pick("src_file").alias("src_file"), pick("src_line").alias("src_line"), num("total_ns", "double"), num("counts", "long"), num("mean_ns", "double"), num("max_ns", "double"))
    return out.where("name != ''")


def newest(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str | None:
    """The path of the newest file in a folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = f.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row.p


def json_lines(spark: SparkSession, path: str, schema: str, malformed: str = "malformed") -> DataFrame:
    """Rows of JSON lines; a line that can't be read has only `malformed`."""
    return spark.read.schema(f"{schema}, {malformed} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", malformed).json(path)


def tail(events: DataFrame, order: str, n: int) -> DataFrame:
    return events.orderBy(F.desc(order)).limit(n)


def _hex(c: Column) -> Column:
    """Unsigned 64-bit hexadecimal digits as a decimal."""
    h = F.lpad(c, 16, "0")
    half = lambda s: F.conv(s, 16, 10).cast("decimal(20,0)")
    return (half(F.substring(h, 1, 8)) * F.lit(4294967296).cast("decimal(11,0)") + half(F.substring(h, 9, 8))).cast("decimal(20,0)")


def memory_maps(text: DataFrame, line: str = "value") -> DataFrame:
    """start, end, perm, path, kind of the lines of a process's memory map."""
    m = lambda g: F.regexp_extract(line, r"^([0-9a-f]+)-([0-9a-f]+)\s+(\S{4})\s+\S+\s+\S+\s+\d+\s*(.*)$", g)
    path, perm = F.trim(m(4)), m(3)
    kind = (
        F.when(path == "[heap]", "heap")
        .when(path.startswith("[stack"), "stack")
        .when(path.rlike(r"^\[(vdso|vvar|vsyscall)"), "vdso")
        .when(path.endswith(".so") | path.contains(".so."), "image")
        .when(path.startswith("/") & (perm.contains("x") | path.contains("/bin/") | path.endswith(".exe")), "image")
        .when((path == "") | path.startswith("/dev/") | path.startswith("/anon"), F.when(perm.contains("x"), "anon_exec").otherwise("anon"))
        .when(path.startswith("["), "kernel_helper")
        .otherwise("file")
    )
    return text.where(m(1) != "").select(_hex(m(1)).alias("start"), _hex(m(2)).alias("end"), perm.alias("perm"), path.alias("path"), kind.alias("kind"))


def status_kb(text: DataFrame, line: str = "value") -> DataFrame:
    """metric, bytes of lines like `VmRSS:  123 kB`."""
    m = lambda g: F.regexp_extract(line, r"^(\w+):\s+(\d+)\s+kB", g)
    return text.where(m(1) != "").select(m(1).alias("metric"), (m(2).cast("long") * 1024).alias("bytes"))


def perf_samples(text: DataFrame, line: str = "value") -> DataFrame:
    """address, weight, source of sample lines `... addr: 0x... weight: n source`."""
    addr = F.regexp_extract(line, r"(?:addr:?\s*)?(?:0x)?([0-9a-f]{6,16})\b", 1)
    weight = F.coalesce(F.nullif(F.regexp_extract(line, r"weight:?\s*(\d+)", 1), F.lit("")).try_cast("long"), F.lit(1))
    return text.where(addr != "").select(_hex(addr).cast("long").alias("address"), weight.alias("weight"), F.regexp_extract(line, r"(\S+)\s*$", 1).alias("source"))


def allocation_lines(text: DataFrame, line: str = "value") -> DataFrame:
    """kind, ptr, new_ptr, size of lines `A ptr size`, `F ptr 0`, `R old new size`; others are left out."""
    p = F.split(F.trim(line), r"\s+")
    kind = p[0]
    hexa = lambda c: _hex(F.regexp_replace(c, "^0x", "")).cast("long")
    ok = (kind.isin("A", "F") & (F.size(p) == 3)) | ((kind == "R") & (F.size(p) == 4))
    return text.where(ok).select(kind.alias("kind"), hexa(p[1]).alias("ptr"), F.when(kind == "R", hexa(F.get(p, F.lit(2)))).alias("new_ptr"), F.when(kind == "R", F.get(p, F.lit(3))).when(kind == "A", p[2]).otherwise("0").try_cast("long").alias("size"))


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, bytes, mtime, width and height (PNG), json_keys (of small JSON files) of the files under a folder."""
    from ..functions.text import artifact_kind

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    text = F.when((F.lower("path").endswith(".json")) & (F.col("length") <= 262_144), F.decode("content", "UTF-8"))
    return raw.select("path", artifact_kind(F.col("path")).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"), F.slice(F.json_object_keys(text), 1, 32).alias("json_keys"))
