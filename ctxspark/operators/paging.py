"""Token budgets and continuation tokens over ordered rows."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def budget_page(rows: DataFrame, size: Column, order: list, budget: int, offset: int = 0, page: int = 10_000) -> DataFrame:
    """From the offset on, the rows that fit in the budget: they stop at the first that doesn't, but one is always given.
    Adds rank (from 1) and used. The `page` first rows are sorted in one place; only if all of these fit and there may be more, ranks
    and totals are taken over ranges of all rows, so that no task has them all, however small they are."""
    w = Window.orderBy(*order)
    top = rows.orderBy(*order).limit(offset + page).withColumn("_size", size)
    sized = top.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") > offset)
    sized = sized.withColumn("used", F.sum("_size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    n, used, over = sized.agg(F.count("*"), F.max("used"), F.min(F.when(F.col("used") > budget, F.col("rank")))).first()
    if n == page and over is None:
        sized = ranked(rows.withColumn("_size", size), order, F.col("_size"))
        had = sized.where(F.col("rank") == offset).agg(F.max("used")).first()[0] or 0
        sized = sized.where(F.col("rank") > offset).withColumn("used", F.col("used") - had)
        over = sized.agg(F.min(F.when(F.col("used") > budget, F.col("rank")))).first()[0]
    if over is not None:
        sized = sized.where((F.col("rank") < over) | (F.col("rank") == offset + 1))
    return sized.drop("_size")


def fingerprint(args: dict) -> str:
    """Of a call's arguments, whatever their order; the paging arguments don't count."""
    kept = {k: v for k, v in args.items() if k not in ("continuation", "token_budget")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def encode(tool: str, args: dict, offset: int, kind: str = "rows") -> str:
    body = json.dumps({"v": 1, "tool": tool, "args_fp": fingerprint(args), "offset": offset, "kind": kind})
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def resume(token: str | None, tool: str, args: dict) -> int:
    """The offset of a continuation token; ValueError if it belongs to another tool or other arguments."""
    if not token:
        return 0
    try:
        body = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError as e:
        raise ValueError("not a continuation token") from e
    if body.get("v") != 1 or body.get("tool") != tool or body.get("args_fp") != fingerprint(args):
        raise ValueError("the continuation belongs to another call")
    return int(body["offset"])
