"""Memory and runtime captures: comparison, budgets, regions, address segments, hot pages and allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Regions that a task sorts, where their number is known.
PART_ROWS = 400_000


def latest(captures: DataFrame, by: str = "capture", order: str = "seq") -> DataFrame:
    """The last record of each capture."""
    return captures.groupBy(by).agg(F.max_by(F.struct(*captures.columns), order).alias("r")).select("r.*")


def diff_named(base: DataFrame, current: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Values of either capture by name; what is missing on one side is 0."""
    b, c = (df.select(F.col(name).alias("name"), F.col(value).alias(side)) for df, side in ((base, "base"), (current, "current")))
    out = b.join(c, "name", "full_outer").select("name", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("current", F.lit(0)).alias("current"))
    return out.withColumn("delta", F.col("current") - F.col("base"))


def budget(limits: DataFrame, metrics: DataFrame) -> DataFrame:
    """Limits (metric, limit) with the value and status: ok, over, or unavailable if the capture lacks the metric."""
    status = F.when(F.col("value").isNull(), "unavailable").when(F.col("value") > F.col("limit"), "over").otherwise("ok")
    return limits.join(metrics, "metric", "left").select("metric", "limit", "value", status.alias("status"), F.greatest(F.col("value") - F.col("limit"), F.lit(0)).alias("excess"))


def top_other(regions: DataFrame, name: str, size: str, n: int) -> DataFrame:
    """The n largest names and one row `other` for the rest."""
    sums = regions.groupBy(F.col(name).alias("name")).agg(F.sum(size).alias("bytes"), F.count("*").alias("regions"))
    top = sums.orderBy(F.desc("bytes"), "name").limit(n)
    total = sums.agg(F.sum("bytes").alias("bytes"), F.sum("regions").alias("regions"))
    kept = top.agg(F.sum("bytes").alias("kb"), F.sum("regions").alias("kr"))
    rest = total.crossJoin(F.broadcast(kept)).select(F.lit("other").alias("name"), (F.col("bytes") - F.coalesce("kb", F.lit(0))).alias("bytes"), (F.col("regions") - F.coalesce("kr", F.lit(0))).alias("regions"))
    return top.unionByName(rest.where("regions > 0"))


def gaps(regions: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Regions with the gap to the one before in address order (0 for touching or overlapping ones, null for the first)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.lag(end).over(w)
    return regions.withColumn("gap", F.when(before.isNotNull(), F.greatest(F.col(start) - before, F.lit(0))))


def buckets(regions: DataFrame, by: list[str], n: int, kind: str = "kind", start: str = "start", end: str = "end", rows: int | None = None) -> DataFrame:
    """Consecutive regions in at most n buckets: bounds, bytes, regions, and their kind or `mixed`. rows: how many regions there
    are, if it is known; then a task gets PART_ROWS of them, however many there are (but all of a group)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    # Rank and number over one order: a task sorts its regions once for both.
    per = F.ceil(F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / n)
    regions = regions.select(*by, start, end, kind)
    if rows is not None:
        regions = regions.repartition(1 + rows // PART_ROWS, *by)
    placed = regions.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / per).cast("long"))
    one = F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("mixed")
    return placed.groupBy(*by, "bucket").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.sum(F.col(end) - F.col(start)).alias("bytes"), F.count("*").alias("regions"), one.alias("kind"))


def hot_pages(samples: DataFrame, address: str = "address", weight: str = "weight", page: int = 4096) -> DataFrame:
    """Samples and weight per page of memory."""
    return samples.groupBy((F.floor(F.col(address) / page) * page).cast("long").alias("page")).agg(F.count("*").alias("samples"), F.sum(weight).alias("weight"))


def hotspots(pages: DataFrame, least: int, n: int) -> DataFrame:
    return pages.where(F.col("samples") >= least).orderBy(F.desc("samples"), "page").limit(n)


def running_peak(events: DataFrame, by: list[str], order: list, delta: Column) -> DataFrame:
    """Live bytes after each event and the peak so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("live", F.sum(delta).over(w)).withColumn("peak", F.max("live").over(w))


def allocation_deltas(events: DataFrame) -> DataFrame:
    """Events (ord, kind A/F/R, ptr, new_ptr, size) with delta: a free takes what its pointer last held, a move both."""
    moves = events.where("kind = 'R'").select("ord", F.lit("A").alias("kind"), F.col("new_ptr").alias("ptr"), "size", F.lit(1).alias("part"))
    frees = events.where("kind IN ('F', 'R')").select("ord", F.lit("F").alias("kind"), "ptr", F.lit(0).cast("long").alias("size"), F.lit(0).alias("part"))
    all_ = events.where("kind = 'A'").select("ord", "kind", "ptr", "size", F.lit(1).alias("part")).unionByName(moves).unionByName(frees)
    w = Window.partitionBy("ptr").orderBy("ord", "part")
    held = F.lag(F.when(F.col("kind") == "A", F.col("size")).otherwise(0)).over(w)
    return all_.withColumn("delta", F.when(F.col("kind") == "A", F.col("size")).otherwise(-F.coalesce(held, F.lit(0))))


def type_size(ty: Column) -> Column:
    """An estimate of a field's bytes from its type's name."""
    t = F.lower(F.trim(ty))
    return (
        F.when(t.rlike(r"[*&]\s*$"), 8)
        .when(t.rlike(r"^(bool|char|u?int8(_t)?|[iu]8|byte)$"), 1)
        .when(t.rlike(r"^(short|u?int16(_t)?|[iu]16)$"), 2)
        .when(t.rlike(r"^(int|unsigned|float|u?int32(_t)?|[iuf]32)$"), 4)
        .when(t.rlike(r"vec2$"), 8).when(t.rlike(r"vec3$"), 12).when(t.rlike(r"(vec4|quat)$"), 16).when(t.rlike(r"mat4$"), 64)
        .when(t.rlike(r"string|vector|vec<"), 24)
        .otherwise(8)
    )


def reordered(fields: DataFrame, by: str = "type") -> DataFrame:
    """Fields of a type from large to small, with their offset when laid out so."""
    w = Window.partitionBy(by).orderBy(F.desc("bytes"), "ord")
    sized = fields.withColumn("bytes", type_size(F.col("ty")))
    return sized.withColumns({"place": F.row_number().over(w), "offset": F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")})


def metric(snapshot: Column, key: str) -> Column:
    """A number of a JSON snapshot, as a long: `pools.NAME` (its in_use) or `pools.NAME.FIELD` by the pool's name, or a JSON
    pointer, with or without its first slash. Null if there is no number."""
    if key.startswith("pools."):
        name, _, field = key[len("pools.") :].partition(".")
        pools = F.from_json(F.get_json_object(snapshot, "$.pools"), "array<map<string,string>>")
        found = F.get(F.filter(pools, lambda p: p["name"] == name), F.lit(0))[field or "in_use"]
    else:
        steps = [s.replace("~1", "/").replace("~0", "~") for s in key.strip("/").split("/")]
        found = F.get_json_object(snapshot, "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps))
    return F.floor(found.try_cast("double")).cast("long")
