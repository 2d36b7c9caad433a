"""Digests of what commands print. Lines come as rows (by: the run, ord, text); digests are rows too, so no output is too long.

Windows run within one command's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: labels of the long form of a status.
STATUS_LABELS = {"modified:": "modified", "new file:": "added", "deleted:": "deleted", "renamed:": "renamed"}


def _bare(text: str) -> Column:
    return F.trim(F.col(text), F.lit(" \t\r"))


def _so_far(by: str, ord: str, *more: str):
    return Window.partitionBy(by, *more).orderBy(ord).rowsBetween(Window.unboundedPreceding, 0)


def status_lines(lines: DataFrame, by: str = "run", ord: str = "ord", text: str = "text") -> DataFrame:
    """by, ord, kind, path of a status in its short or long form; kind is modified, added, deleted, renamed, untracked or
    other. Branch lines and all else give no row; the new name counts where a file was renamed."""
    line, bare = F.col(text), _bare(text)
    code = F.trim(F.substring(line, 1, 2))
    short = line.rlike(r"^[^\t#].. *\S") & (F.substring(line, 3, 1) == " ") & ~line.startswith("On branch ")
    has = lambda x: F.contains(code, F.lit(x))
    kind = F.when(code == "??", "untracked").when(has("M") & (code != "AM") & (code != "RM"), "modified").when(has("A"), "added").when(has("D"), "deleted").when(code.isin("R", "RM"), "renamed").otherwise("other")
    long_kind, long_path = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, name in STATUS_LABELS.items():
        long_kind = F.when(bare.startswith(label), name).otherwise(long_kind)
        long_path = F.when(bare.startswith(label), F.trim(F.substring(bare, len(label) + 1, 1 << 30))).otherwise(long_path)
    path = F.when(short, F.trim(F.substring(line, 4, 1 << 30))).otherwise(long_path)
    path = F.when(F.contains(path, F.lit(" -> ")), F.trim(F.substring_index(path, " -> ", -1))).otherwise(path)
    return lines.select(by, ord, F.when(short, kind).otherwise(long_kind).alias("kind"), path.alias("path")).where("kind IS NOT NULL AND path != ''")


def status(lines: DataFrame, by: str = "run", ord: str = "ord", text: str = "text", cap: int = 40) -> DataFrame:
    """by, kind, n, paths (the first `cap` in order), more (how many others). Untracked files count by folder: kind is
    `untracked FOLDER` and paths is empty."""
    found = status_lines(lines, by, ord, text)
    folder = F.when(F.col("path").endswith("/"), F.regexp_replace("path", "/+$", "")).otherwise(F.coalesce(F.nullif(F.regexp_extract("path", "^(.+)/[^/]*$", 1), F.lit("")), F.lit(".")))
    new = F.col("kind") == "untracked"
    found = found.withColumns({"kind": F.when(new, F.concat(F.lit("untracked "), folder)).otherwise(F.col("kind")), "path": F.when(~new, F.col("path"))})
    totals = found.groupBy(by, "kind").agg(F.count("*").alias("n"), F.count("path").alias("named"))
    first = found.where("path IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(by, "kind").orderBy(ord))).where(F.col("_n") <= cap)
    first = first.groupBy(by, "kind").agg(F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("_p"))
    out = totals.join(first, [by, "kind"], "left")
    return out.select(by, "kind", "n", F.coalesce(F.transform("_p", lambda x: x["path"]), F.array().cast("array<string>")).alias("paths"), F.greatest(F.col("named") - cap, F.lit(0)).alias("more"))


def log(lines: DataFrame, by: str = "run", ord: str = "ord", text: str = "text") -> DataFrame:
    """by, ord, hash (7 digits), subject of each commit of a log; a one-line log's lines as they are. A commit without a
    subject gives no row."""
    line, bare = F.col(text), _bare(text)
    starts = line.rlike("^commit [0-9a-fA-F]{7}")
    header = line.startswith("commit ") | line.startswith("Author:") | line.startswith("Date:") | line.startswith("Merge:")
    short = line.rlike("^[0-9a-fA-F]{7} .")
    # Without headers and blank lines, a commit's subject is the line right after its first one: one window, and no line but these in it.
    told = lines.where(starts | (~header & (bare != ""))).select(by, ord, text)
    told = told.withColumn("_of", F.lag(F.when(starts, F.substring(line, 8, 7))).over(Window.partitionBy(by).orderBy(ord, text)))
    named = F.col("_of").isNotNull()
    found = told.where(~starts & (named | short))
    return found.select(by, F.col(ord).alias("ord"), F.coalesce("_of", F.substring(line, 1, 7)).alias("hash"), F.when(named, bare).otherwise(F.substring(line, 9, 1 << 30)).alias("subject"))


def diff(lines: DataFrame, by: str = "run", ord: str = "ord", text: str = "text", cap: int = 12) -> DataFrame:
    """by, ord, text: headers, hunk marks and the first `cap` changed lines of each file; the next one is `…`, the rest goes."""
    line = F.col(text)
    file = line.startswith("diff --git ") | line.startswith("diff --cc ")
    head = file | line.startswith("@@") | line.startswith("+++") | line.startswith("---") | line.startswith("index ")
    changed = ~head & (line.startswith("+") | line.startswith("-"))
    numbered = lines.withColumn("_f", F.count_if(file).over(_so_far(by, ord)))
    counted = numbered.withColumn("_n", F.count_if(changed).over(_so_far(by, ord, "_f")))
    return counted.where(head | (changed & (F.col("_n") <= cap + 1))).select(by, ord, F.when(changed & (F.col("_n") > cap), F.lit("…")).otherwise(line).alias(text))


def _counted(lines: DataFrame, by: str, text: str, passed: Column, failed: Column, kept: Column) -> tuple[DataFrame, DataFrame]:
    marked = lines.withColumns({"_p": passed, "_f": failed, "_k": kept})
    counts = marked.groupBy(by).agg(F.count_if("_p").alias("passed"), F.count_if("_f").alias("failed"), F.count_if("_k").alias("kept"))
    return counts, marked.where("_k").drop("_p", "_f", "_k")


def ctest(lines: DataFrame, by: str = "run", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(by, passed, failed, kept) and the lines kept: failures, timeouts, tests not run, and the summary."""
    line = F.col(text)
    failed = F.contains(line, F.lit("***Failed")) | F.contains(line, F.lit("***Timeout")) | F.contains(line, F.lit("***Not Run"))
    passed = ~failed & F.contains(line, F.lit("Passed"))
    return _counted(lines, by, text, passed, failed, failed | (~passed & F.contains(line, F.lit("tests passed"))))


def cargo_test(lines: DataFrame, by: str = "run", ord: str = "ord", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(by, passed, failed, kept) and the lines kept: failures with the indented lines that follow them, errors and results."""
    line = F.col(text)
    failed = F.contains(line, F.lit("FAILED")) | line.startswith("failures:") | line.startswith("---- ")
    said = ~failed & (line.startswith("test result:") | line.startswith("error:"))
    indented = ~failed & (line.startswith("    ") | line.startswith("\t"))
    after = F.coalesce(F.last(F.when(~indented, failed), ignorenulls=True).over(_so_far(by, ord)), F.lit(False))
    marked = lines.withColumn("_after", after)
    kept = failed | said | (indented & F.col("_after"))
    counts, rest = _counted(marked, by, text, ~kept & F.contains(line, F.lit(" ... ok")), failed, kept)
    return counts, rest.drop("_after")


def build(lines: DataFrame, text: str = "text") -> DataFrame:
    """Errors, warnings and the last word of a build."""
    line = F.col(text)
    return lines.where(F.contains(F.lower(line), F.lit("error")) | F.contains(line, F.lit("warning:")) | line.startswith("Finished") | F.contains(line, F.lit("could not compile")))


def shorter(digest: Column, text: Column) -> Column:
    """The digest if there is one and it is shorter than the text, or the text."""
    return F.when((digest != "") & (F.octet_length(digest) < F.octet_length(text)), digest).otherwise(text)
