"""Cards from the JSON documents of providers: specifications are rows, so that one plan serves any document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of cards, and what stands for a value that isn't there.
KINDS = ("metric", "sparkline", "donut", "bar", "activity")
NOTHING = "—"
NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|DOUBLE|FLOAT|DECIMAL)"
POINT = "array<struct<ts:long,label:string,value:double,ago:string>>"


def path_of(pointer: Column) -> Column:
    """A JSON pointer as the path of a variant; parts that are numbers are places in arrays."""
    parts = F.filter(F.split(F.coalesce(pointer, F.lit("")), "/"), lambda p: p != "")
    return F.concat(F.lit("$"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("['"), p, F.lit("']")))), ""))


def _number(x: Column, path: str = "$") -> Column:
    there = F.try_variant_get(x, path, "variant")
    return F.when(F.schema_of_variant(there).rlike(NUMBERS), F.try_variant_get(x, path, "double"))


def _text(x: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))


def ago(now: Column, ts: Column) -> Column:
    """How long ago, in the largest unit that is reached."""
    s = F.greatest(now - ts, F.lit(0)).cast("long")
    unit = lambda n, name: F.concat(F.floor(s / n), F.lit(name))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


def cards(specs: DataFrame, documents: DataFrame, now: int) -> DataFrame:
    """provider, available, reason, age_secs and, of each card, ord, kind, title, value, detail and series.

    specs: provider, sidecar, stale_secs, ord, kind, title, value, detail, series (pointers). documents: sidecar, content (JSON), mtime
    (seconds). A document's age is from its `ts`, or else its mtime. A provider whose document is missing or can't be read has
    no cards but one row that says so; one that is too old has its cards and isn't available. What a pointer doesn't find is
    a dash, or an empty series. Points of a sparkline may be bare numbers, which get their place as ts; rows of an activity keep
    their JSON as label.
    """
    unknown = ~F.col("kind").isin(*KINDS) | ((F.col("kind") == "metric") & F.col("value").isNull()) | ((F.col("kind") != "metric") & F.col("series").isNull())
    d = documents.select(F.col("sidecar"), F.try_parse_json("content").alias("doc"), "mtime", F.lit(True).alias("there"))
    j = specs.where(~unknown).join(d, "sidecar", "left")
    doc, now_ = F.col("doc"), F.lit(now).cast("double")
    age = F.greatest(now_ - F.coalesce(F.floor(_number(doc, "$.ts")), F.col("mtime")), F.lit(0)).cast("long")
    reason = F.when(F.col("there").isNull(), "unavailable").when(doc.isNull(), "parse error").when(age > F.col("stale_secs"), "stale")
    at = lambda c: F.try_variant_get(doc, path_of(F.col(c)), "string")

    def point(x: Column, i: Column) -> Column:
        spark, labelled = F.col("kind") == "sparkline", F.col("kind").isin("donut", "bar")
        ts = F.floor(_number(x, "$.ts")).cast("long")
        either = lambda f, a, b: F.when(F.try_variant_get(x, a, "variant").isNotNull(), f(x, a)).otherwise(f(x, b))
        bare = _number(x)
        value = F.when(spark, F.coalesce(bare, _number(x, "$.value"), _number(x, "$.rtt_ms"), F.lit(0.0))).when(labelled, F.coalesce(either(_number, "$.value", "$.count"), F.lit(0.0)))
        label = F.when(spark, _text(x, "$.label")).when(labelled, F.coalesce(either(_text, "$.label", "$.name"), F.lit("?"))).otherwise(F.to_json(x))
        when = F.when(spark, F.when(bare.isNotNull(), i).otherwise(F.coalesce(ts, i))).when(~labelled & ts.isNotNull(), F.greatest(ts, F.lit(0)))
        return F.struct(when.cast("long").alias("ts"), label.alias("label"), value.alias("value"), F.when(~spark & ~labelled & ts.isNotNull(), ago(now_, F.greatest(ts, F.lit(0)))).alias("ago"))

    rows = F.try_variant_get(doc, path_of(F.col("series")), "array<variant>")
    series = F.when(F.col("kind") != "metric", F.coalesce(F.transform(rows, point), F.array()).cast(POINT))
    detail = F.when((F.col("kind") == "metric") & F.col("detail").isNotNull(), at("detail"))
    value = F.when(F.col("kind") == "metric", F.coalesce(at("value"), F.lit(NOTHING)))
    found = j.select("provider", "ord", "kind", "title", value.alias("value"), detail.alias("detail"), series.alias("series"), reason.alias("reason"), F.when(doc.isNotNull(), age).alias("age_secs"), F.coalesce(reason.isin("unavailable", "parse error"), F.lit(False)).alias("none"))
    shown = found.where("NOT none").select("provider", F.col("reason").isNull().alias("available"), "reason", "age_secs", "ord", "kind", "title", "value", "detail", "series")
    empty = [F.lit(None).cast(shown.schema[c].dataType).alias(c) for c in shown.columns[3:]]
    return shown.unionByName(found.where("none").select("provider", F.lit(False).alias("available"), "reason", *empty).distinct())
