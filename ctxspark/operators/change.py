"""Analysis of changes: unified diffs, changed functions, what they are, which tests they touch, and commit scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_binary, looks_generated, looks_secret, segment


def hunks(lines: DataFrame, by: str = "diff", ord: str = "ord", text: str = "text") -> DataFrame:
    """rel, start, count, first, last (new side) of every hunk of unified diffs, one row per line in.

    A hunk of no new lines touches one line, at least line 1. A deleted file (/dev/null) has none.
    """
    line = F.col(text)
    w = Window.partitionBy(by).orderBy(ord).rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(line.startswith("+++ "), F.regexp_replace(F.regexp_extract(line, r"^\+\+\+ (\S+)", 1), "^b/", ""))
    at = lines.withColumn("rel", F.last(name, ignorenulls=True).over(w)).where(line.startswith("@@ ")).where("rel IS NOT NULL AND rel != '/dev/null'")
    start = F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))
    out = at.select(by, "rel", start.alias("start"), count.alias("count")).where("start IS NOT NULL")
    first = F.when(F.col("count") == 0, F.greatest("start", F.lit(1))).otherwise(F.col("start"))
    return out.withColumn("first", first).withColumn("last", F.col("first") + F.greatest("count", F.lit(1)) - 1)


def changed_lines(hunks_: DataFrame) -> DataFrame:
    return hunks_.select("rel", F.explode(F.sequence("first", "last")).alias("line")).distinct()


def overlapping(spans: DataFrame, ranges: DataFrame, by: str = "rel", width: int = 64) -> DataFrame:
    """Spans (start, end) of a file that some range (first, last) touches.

    An interval join as an equi-join: both are cut into cells of `width` lines, so a file with many spans and ranges isn't
    compared pair by pair.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    s = spans.withColumn("_cell", cells("start", "end"))
    r = ranges.select(by, F.col("first").alias("_first"), F.col("last").alias("_last"), cells("first", "last").alias("_cell"))
    return s.join(r, (s[by] == r[by]) & (s["_cell"] == r["_cell"]) & (F.col("start") <= F.col("_last")) & (F.col("end") >= F.col("_first")), "left_semi").drop("_cell").distinct()


def classify(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Changed spans (rel, name, signature) with change: new, body (signature as before) or signature; unknown without the old side.

    Signatures compare with all white space squeezed; names by last segment within a file.
    """
    if old is None:
        return new.withColumn("change", F.lit("unknown"))
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    o = old.groupBy(F.col("rel").alias("_rel"), segment(F.col("name")).alias("_seg")).agg(F.collect_set(plain(F.col("signature"))).alias("_sigs"))
    out = new.join(o, (new["rel"] == o["_rel"]) & (segment(new["name"]) == o["_seg"]), "left")
    change = F.when(F.col("_sigs").isNull(), "new").when(F.array_contains("_sigs", plain(F.col("signature"))), "body").otherwise("signature")
    return out.withColumn("change", change).drop("_rel", "_seg", "_sigs")


def impact(changed: DataFrame, tests: DataFrame, n: int | None = 40) -> DataFrame:
    """Test files (rel, name of what they mention) by how many different changed symbols they mention."""
    out = tests.join(changed.select("name").distinct(), "name").groupBy("rel").agg(F.countDistinct("name").alias("symbols"), F.count("*").alias("mentions")).orderBy(F.desc("symbols"), F.desc("mentions"), "rel")
    return out.limit(n) if n else out


def scopes(dirty: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dirty paths in the scopes whose prefix they have (a path may be in several), and those in none. Scopes are few by
    nature, but checked before they are broadcast."""
    small = F.broadcast(scope) if scope.limit(10_001).count() <= 10_000 else scope
    hit = dirty.join(small, F.expr("startswith(path, prefix)"))
    return hit, dirty.join(hit.select("path").distinct(), "path", "left_anti")


def warnings(dirty: DataFrame, large: int = 1_000_000) -> DataFrame:
    """path, warning: secret, generated, binary, large; each once."""
    path = F.col("path")
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (("secret", looks_secret(path)), ("generated", looks_generated(path)), ("binary", looks_binary(path)), ("large", F.col("size") > large))]))
    return dirty.select("path", F.explode(kinds).alias("warning")).distinct()


def untracked_buckets(dirty: DataFrame) -> DataFrame:
    return dirty.where("status = '??'").groupBy(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))


def has_all_tags(text: Column, tags: list[str]) -> Column:
    """Whether every tag is in the text as [tag]."""
    have = F.regexp_extract_all(text, F.lit(r"\[([^\[\]\s]+)\]"), F.lit(1))
    return F.size(F.array_except(F.lit(tags), have)) == 0 if tags else F.lit(True)
