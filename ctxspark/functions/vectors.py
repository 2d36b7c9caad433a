"""Arithmetic over arrays and groups: cosine, softmax, margins, conformal sets, dates."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length; the longer one is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    both = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def softmax(score: str, *by: str) -> Column:
    """Of a score column within groups, shifted by the group's maximum; the sum is at least 1e-12."""
    w = Window.partitionBy(*by)
    top = F.max(score).over(w)
    total = F.sum(F.exp(score)).over(w) / F.exp(top)  # the shift cancels out
    return F.exp(F.col(score) - top) / F.greatest(total, F.lit(1e-12))


def softmax_array(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.greatest(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), F.lit(1e-12)))


def top_margin(probs: Column) -> Column:
    """The largest less the second largest; the largest if there is one only, 0 if there is none."""
    s = F.sort_array(probs, asc=False)
    return F.coalesce(F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)), F.lit(0.0))


def conformal_size(probs: Column, qhat: float) -> Column:
    """How many options have 1 - p at most qhat; a choice is committed if it is one."""
    return F.size(F.filter(probs, lambda p: 1 - p <= qhat))


def freshness(touched: Column, status: Column, today: Column, fresh: int = 14, stale: int = 30, dormant: int = 90) -> tuple[Column, Column]:
    """Age in days (0 for the future and for what can't be read) and band of something touched on a day."""
    age = F.greatest(F.coalesce(F.datediff(today, touched.try_cast("date")), F.lit(0)), F.lit(0))
    band = F.when(age < fresh, "fresh").when(age < stale, "due").when((age >= dormant) & status.isin("seed", "sprouted"), "dormant").otherwise("stale")
    return age, band


def compression_mode(ratio_of: dict[int, Column], most: float) -> Column:
    """The smallest token size whose compression ratio is within the cap; null if none is."""
    out = F.lit(None).cast("int")
    for size in sorted(ratio_of, reverse=True):
        out = F.when(ratio_of[size] <= most, F.lit(size)).otherwise(out)
    return out


def char_precision(a: Column, b: Column) -> Column:
    """The share of positions at which two texts agree, over the longer one."""
    long = F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda z: z))
    return F.when(long == 0, F.lit(1.0)).otherwise(same / long)
