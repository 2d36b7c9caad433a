"""Language identification with an interpolated Kneser-Ney character model per language.

The language of a text is the one whose model needs the fewest nats per character. A text whose best cross-entropy is above
what its language's own training texts need (the REJECT quantile) is rejected; the prediction stays, with `rejected` true. The
score is the posterior under the best temperature. Both are measured on all training texts, by sums and counts that Spark takes;
the quantile is exact. The models use all training texts, and their order is fixed.

Edge cases: a text that is null or has no letter is `und` with score 0; letters that no model knows cost the same in each and
fall to the first language; without training rows everything is `und`; repeated rows count each; ties go to the first name;
texts of any length are read whole; other columns are carried in a struct, so that no name clashes; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .kneserney import MAX_CELLS, fit, gram_counts, scored

ORDER = 5
#: The quantile of its training texts that a language accepts, the temperatures to choose from, and the bins of one count.
REJECT, HEATS, BINS = 0.995, (5.0, 10.0, 20.0, 40.0, 80.0), 1000


def has_letter(words: list[str], text: str) -> bool:
    return any(map(str.isalpha, words)) or any(map(str.isalpha, text))


def _entropies(docs: DataFrame, keep: list[str], models: list) -> DataFrame:
    def finish(logs, chars, split, texts):
        per = -logs / np.maximum(chars, 1)[:, None]
        return [pa.array(list(per), pa.list_(pa.float64())), pa.array([has_letter(w, t) for w, t in zip(split, texts)], pa.bool_())]

    return scored(docs, keep, models, finish, "h array<double>, letters boolean")


def detect(docs: DataFrame, train: DataFrame | None = None, text: str = "text", order: int = ORDER, max_cells: int = MAX_CELLS, lang: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as the struct `row` (of its columns `keep`, or all), with lang_pred, score and rejected.

    train: text and lang; null langs don't count. Instead, `lang` may name the column of docs that has the language of those
    rows that are learned from, and null in the others; then each text is scored once, for calibration and prediction."""
    own = F.col(f"`{lang}`") if lang else F.lit(None)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), own.cast("string").alias("lang"))
    train = (rows if lang else train).where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), "lang")
    langs = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    if not langs:
        return rows.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    cls = (F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1).alias("cls")
    train, rows = train.select("text", cls), rows.select("row", "text", cls)
    models = fit(gram_counts(train, len(langs), order), [f"n{c}" for c in range(len(langs))], max_cells)

    known = written(_entropies(rows, ["row", "cls"], models) if lang else _entropies(train, ["cls"], models), "entropies")
    heat, limit = _calibrated(known.where("letters AND cls IS NOT NULL").select("cls", "h"), len(langs))

    best = F.array_min("h")
    at = F.array_position("h", best).cast("int")
    score = 1 / F.aggregate(F.transform("h", lambda x: F.exp((best - x) * heat)), F.lit(0.0), lambda a, x: a + x)
    letters = F.col("letters")
    return (known if lang else _entropies(rows, ["row"], models)).select(
        "row",
        F.when(letters, F.element_at(F.lit(langs), at)).otherwise("und").alias("lang_pred"),
        F.when(letters, score).otherwise(F.lit(0.0)).alias("score"),
        (~letters | (best > F.element_at(_doubles(limit), at))).alias("rejected"),
    )


def _doubles(xs: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def _calibrated(known: DataFrame, classes: int) -> tuple[float, list[float]]:
    """The temperature under which the training texts (cls, h) are likeliest, and for each language the least value that the
    REJECT share of its texts' own entropies doesn't exceed (infinite without texts). A row a language or bin comes to the driver."""
    mine, best = F.element_at("h", F.col("cls") + 1), F.array_min("h")
    spread = lambda heat: F.aggregate(F.transform("h", lambda x: F.exp((best - x) * heat)), F.lit(0.0), lambda a, x: a + x)
    # Decimals add to the same in any order.
    likely = [F.sum(((best - mine) * heat - F.log(spread(heat))).cast("decimal(28,12)")).alias(f"p{i}") for i, heat in enumerate(HEATS)]
    found = known.groupBy("cls").agg(F.count("*").alias("n"), F.min(mine).alias("lo"), F.max(mine).alias("hi"), *likely).collect()
    heat = HEATS[max(range(len(HEATS)), key=lambda i: sum(r[f"p{i}"] for r in found))]

    # (lo, hi, which one between them from the least), narrowed to the values of one bin until one value is left.
    left = {r.cls: (r.lo, r.hi, max(1, math.ceil(REJECT * r.n))) for r in found}
    while any(lo < hi for lo, hi, _ in left.values()):
        open_ = {c: x for c, x in left.items() if x[0] < x[1]}
        low, high = (F.element_at(_doubles([open_.get(c, (np.inf, -np.inf))[k] for c in range(classes)]), F.col("cls") + 1) for k in (0, 1))
        bins = known.select("cls", mine.alias("x"), low.alias("lo"), high.alias("hi")).where("x BETWEEN lo AND hi").groupBy("cls", F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).alias("bin"))
        for r in sorted(bins.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()):
            if r.cls in open_:
                k = open_[r.cls][2]
                open_[r.cls] = (*open_[r.cls][:2], k - r.n)
                if k <= r.n:
                    left[r.cls] = (r.lo, r.hi, k)
                    del open_[r.cls]
    return heat, [left[c][0] if c in left else np.inf for c in range(classes)]


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False))).withColumn("learned", F.when(~F.col("held_out"), F.col("lang")))
    return detect(docs, lang="learned", keep=["doc_id", "held_out"]).select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")
