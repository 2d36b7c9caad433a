"""Rollups of an event log: totals per tool, percentiles, signals, rings, attribution and pressure.

Events have tool, ts (seconds), elapsed_us, baseline, returned, outcome and workspace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ["ok", "error", "invalid", "not_found", "truncated", "empty", "low_yield"]


def since(events: DataFrame, cutoff: int, workspace: str = "", inclusive: bool = True) -> DataFrame:
    """Events from the cutoff on (after it, if not inclusive) of one workspace, or of all for a blank one."""
    ts = F.col("ts")
    out = events.where(ts >= cutoff if inclusive else ts > cutoff)
    return out.where(F.col("workspace") == workspace) if workspace else out


def _measures() -> list[Column]:
    total = F.sum("elapsed_us")
    return [
        F.count("*").alias("calls"),
        F.sum("baseline").alias("baseline_tokens"),
        F.sum("returned").alias("returned_tokens"),
        total.alias("total_us"),
        F.max("elapsed_us").alias("peak_us"),
        F.floor(F.floor(total / 1000) / F.count("*")).cast("long").alias("avg_ms"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in OUTCOMES],
    ]


def rollup(events: DataFrame, by: str = "tool") -> DataFrame:
    """A row per tool."""
    return events.groupBy(by).agg(*_measures())


def rollup_total(events: DataFrame, by: str = "tool") -> DataFrame:
    """A row per tool and one for all (`TOTAL`), with the saved share in percent."""
    out = events.rollup(by).agg(*_measures(), F.grouping(by).alias("_all"))
    saved = F.greatest(F.col("baseline_tokens") - F.col("returned_tokens"), F.lit(0))
    pct = F.when(F.col("baseline_tokens") == 0, F.lit(0)).otherwise(F.round(saved / F.col("baseline_tokens") * 100)).cast("long")
    return out.withColumn(by, F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(by))).drop("_all").withColumn("saved_pct", pct)


def percentiles(events: DataFrame, value: str = "elapsed_us", by: str = "tool", at: tuple = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles. Values are counted first and ranks are sums of counts, so a hot tool is as many rows as it has
    different values, and nothing is collected."""
    counts = events.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(value)
    run = counts.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(by))})
    want = lambda p: F.round(F.lit(p / 100.0) * (F.col("all") - 1)) + 1
    return run.groupBy(by).agg(*[F.min(F.when(F.col("upto") >= want(p), F.col(value))).alias(f"p{p}") for p in at])


def signals(tools: DataFrame, slow_ms: int = 50, truncated_pct: int = 15, error_pct: int = 10, error_calls: int = 5, low_pct: int = 25, low_calls: int = 10) -> DataFrame:
    """signal, tool, value: what a rollup gives reason to look at."""
    t = tools.where("calls > 0")
    rate = lambda c: F.floor(F.col(c) * 100 / F.col("calls")).cast("long")
    pick = lambda name, where, value: t.where(where).select(F.lit(name).alias("signal"), "tool", value.cast("long").alias("value"))
    enough = F.col("calls") >= error_calls
    parts = [
        pick("slow", F.col("avg_ms") >= slow_ms, F.col("avg_ms")),
        pick("truncation", (F.col("truncated_count") > 0) & (rate("truncated_count") >= truncated_pct), rate("truncated_count")),
        *[pick(f"{o}_prone", enough & (rate(f"{o}_count") >= error_pct), rate(f"{o}_count")) for o in ("error", "invalid", "not_found")],
        pick("low_yield", (F.col("calls") >= low_calls) & (rate("low_yield_count") >= low_pct), rate("low_yield_count")),
        pick("net_negative", (F.col("baseline_tokens") >= 500) & (F.col("returned_tokens") >= F.col("baseline_tokens")), F.col("returned_tokens") - F.col("baseline_tokens")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def never_called(registry: DataFrame, events: DataFrame, by: str = "tool") -> DataFrame:
    return registry.join(events.select(by).distinct(), by, "left_anti")


def histogram(events: DataFrame, value: Column, none: str = "none") -> DataFrame:
    """bucket, n: nulls are the bucket `none`."""
    return events.groupBy(F.coalesce(value, F.lit(none)).alias("bucket")).agg(F.count("*").alias("n"))


def ring(events: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The newest n rows of each group."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def attribute_clicks(events: DataFrame, is_search: Column, is_click: Column, by: str, order: list, key: str) -> DataFrame:
    """Each click with the key of the newest search before it by the same user (null if there is none)."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("search", F.last(F.when(is_search, F.col(key)), ignorenulls=True).over(w)).where(is_click)


def since_marker(events: DataFrame, is_marker: Column, by: str, ts: str) -> DataFrame:
    """Events after their group's last marker; all of a group without one."""
    last = events.where(is_marker).groupBy(by).agg(F.max(ts).alias("_last"))
    return events.join(last, by, "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")


def kpis(searches: DataFrame) -> DataFrame:
    """Searches (results, latency_ms, click_rank) in one row: rates and means with one decimal."""
    tenth = lambda c: F.round(c, 1)
    return searches.agg(
        F.count("*").alias("searches"),
        tenth(F.count_if(F.col("results") == 0) * 100 / F.count("*")).alias("no_result_pct"),
        tenth(F.avg("latency_ms")).alias("avg_latency_ms"),
        tenth(F.avg("click_rank")).alias("avg_click_rank"),
    )


def pressure(events: DataFrame, unresolved: int = 0, eyeball: int = 0, failed_runs: int = 0, open_questions: int = 0, rounds_left: int | None = None, by: list[str] | None = None) -> DataFrame:
    """events, error and truncation rates, score and level of a session (or of each group)."""
    rate = lambda o: F.coalesce(F.floor(F.count_if(F.col("outcome") == o) * 100 / F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("long")
    measures = [F.count("*").alias("events"), rate("error").alias("error_pct"), rate("truncated").alias("truncated_pct")]
    base = events.groupBy(*by).agg(*measures) if by else events.agg(*measures)
    fixed = (3 if eyeball else 1 if unresolved else 0) + (2 if failed_runs >= 3 else 1 if failed_runs else 0) + (2 if open_questions > 5 else 1 if open_questions else 0) + {0: 2, 1: 1}.get(rounds_left, 0)
    e, r, t = F.col("events"), F.col("error_pct"), F.col("truncated_pct")
    score = F.when(e >= 80, 3).when(e >= 40, 2).when(e >= 20, 1).otherwise(0) + F.when(r >= 20, 2).when(r >= 10, 1).otherwise(0) + F.when(t >= 20, 1).otherwise(0) + fixed
    s = F.col("score")
    return base.withColumn("score", score).withColumn("level", F.when(s <= 2, "low").when(s <= 5, "medium").when(s <= 8, "high").otherwise("critical"))


def averages(calls: DataFrame, *by: str) -> DataFrame:
    """calls, board_calls (from the blackboard), fallback_calls (that took the plain path), the mean ratio, and the mean of the
    precisions that are numbers, of calls (used, ratio, precision, from_board)."""
    measured = F.when(~F.isnan("precision"), F.col("precision"))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("from_board").alias("board_calls"), F.count_if(~F.col("used")).alias("fallback_calls"), F.avg("ratio").alias("ratio"), F.avg(measured).alias("precision"), F.count(measured).alias("measured"))
