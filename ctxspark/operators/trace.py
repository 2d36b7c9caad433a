"""Profiles: zones with totals, and the comparison of two captures. Rows have name, total_ns, counts, mean_ns, max_ns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zones(rows: DataFrame) -> DataFrame:
    """One row per zone: sums of total_ns and counts, the mean of the sums in microseconds, the largest max_ns."""
    mean = F.when(F.col("counts") > 0, F.col("total_ns") / F.col("counts") / 1000).otherwise(F.lit(0.0))
    return rows.groupBy("name").agg(F.sum("total_ns").alias("total_ns"), F.sum("counts").alias("counts"), F.max("max_ns").alias("max_ns")).withColumn("mean_us", mean)


def top_zones(zones_: DataFrame, sort_by: str = "total", n: int = 15) -> DataFrame:
    """The n largest zones by total, mean, max or count (ties by name) with their share of the grand total in percent."""
    key = {"total": "total_ns", "mean": "mean_us", "max": "max_ns", "count": "counts"}[sort_by]
    grand = zones_.agg(F.sum("total_ns").alias("_all"))
    share = F.when(F.col("_all") > 0, F.col("total_ns") / F.col("_all") * 100).otherwise(F.lit(0.0))
    out = zones_.crossJoin(F.broadcast(grand)).withColumn("share_pct", share).drop("_all").orderBy(F.desc(key), "name").limit(n)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(key), "name")))


def diff_zones(base: DataFrame, current: DataFrame, n: int | None = None) -> DataFrame:
    """Zones of either capture: both totals, delta, change in percent and tag (new, gone, changed, same), largest delta first."""
    b = base.select("name", F.col("total_ns").alias("base_ns"))
    c = current.select("name", F.col("total_ns").alias("current_ns"))
    out = b.join(c, "name", "full_outer")
    tag = F.when(F.col("base_ns").isNull(), "new").when(F.col("current_ns").isNull(), "gone").when(F.col("base_ns") == F.col("current_ns"), "same").otherwise("changed")
    out = out.withColumn("tag", tag).fillna(0.0, ["base_ns", "current_ns"]).withColumn("delta_ns", F.col("current_ns") - F.col("base_ns"))
    out = out.withColumn("change_pct", F.when(F.col("base_ns") > 0, F.col("delta_ns") / F.col("base_ns") * 100))
    return out.orderBy(F.desc("delta_ns"), "name").limit(n) if n else out


def net(diff: DataFrame) -> DataFrame:
    return diff.agg(F.sum("base_ns").alias("base_ns"), F.sum("current_ns").alias("current_ns"), F.sum("delta_ns").alias("delta_ns"))


def clean_zone(name: Column) -> Column:
    """The symbol in a zone's label: what stands before arguments, brackets and decorations."""
    return F.trim(F.regexp_extract(F.trim(name), r"^(?:[\w<>]+\s+)?([A-Za-z_][\w:]*)", 1))
