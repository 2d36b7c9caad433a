"""Shortest edit scripts between two versions of texts, by line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "old_start long, old_count long, new_start long, new_count long"


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A stretch (x, y) to (u, v) of equal lines in the middle of a shortest script; forward and backward searches meet in it."""
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and abs(delta - k) <= d - 1 and x + back.get(delta - k, -1) >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and abs(delta - k) <= d and x + ahead.get(delta - k, -1) >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("two searches of all lines meet")


def kept(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal lines that a shortest script keeps: a longest common subsequence, in memory linear in the lines."""
    ids: dict = {}
    a, b = ([ids.setdefault(x, len(ids)) for x in side] for side in (a, b))
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        x, y, u, v = _middle(a[alo:ahi], b[blo:bhi])
        out += [(alo + x + i, blo + y + i) for i in range(u - x)]
        todo += [(alo, alo + x, blo, blo + y), (alo + u, ahi, blo + v, bhi)]
    return sorted(out)


def hunks_of(old: list, new: list) -> Iterator[tuple[int, int, int, int]]:
    """old_start, old_count, new_start, new_count of each change, as in a unified diff without context: lines count from 1, and a side
    without lines names the line before."""
    i = j = 0
    for x, y in [*kept(old, new), (len(old), len(new))]:
        if x > i or y > j:
            yield i + (x > i), x - i, j + (y > j), y - j
        i, j = x + 1, y + 1


def lines_of(text: str | None) -> list[str]:
    """Lines with their ends, so that a missing one at the end of a file counts."""
    return [x for x in (text or "").replace("\n", "\n\0").split("\0") if x]


def line_hunks(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """The other columns of pairs with the hunks between two texts of a row, a row for each. A null text is an empty one."""
    keep = [c for c in pairs.columns if c not in (old, new)]
    schema = ", ".join([*[f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep], HUNK])
    names = [*keep, *[c.split()[0] for c in HUNK.split(", ")]]

    def work(batches):
        for pdf in batches:
            rows = [(*key, *h) for *key, x, y in pdf[[*keep, "_old", "_new"]].itertuples(index=False) if x != y for h in hunks_of(lines_of(x), lines_of(y))]
            yield pd.DataFrame(rows, columns=names)

    return pairs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{old}`").cast("string"), F.lit("")).alias("_old"), F.coalesce(F.col(f"`{new}`").cast("string"), F.lit("")).alias("_new")).mapInPandas(work, schema)


def touched(hunks: DataFrame) -> DataFrame:
    """hunks with first and last, the lines of the new side that they touch; one that only takes lines away touches one."""
    first = F.greatest("new_start", F.lit(1))
    return hunks.withColumns({"first": first.cast("int"), "last": (first + F.greatest("new_count", F.lit(1)) - 1).cast("int")})
