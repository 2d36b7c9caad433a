"""Decisions among options: word-overlap scores, softmax, debiasing, conformal sets and blending with a ranking.

Requests have id, state, question and options (array of id and description). A scorer is a function from requests to
(id, option, ord, raw_score) rows; the one here counts words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import option_tokens
from ..functions.vectors import softmax

Scorer = Callable[[DataFrame], DataFrame]


def word_scores(requests: DataFrame) -> DataFrame:
    """0.5, plus 1 + ln(1 + f) for every word of an option that the context has f times, plus the share of such words.

    A request is scored where it lies: its context is split once, and only the options' scores are exploded. Options' words are
    tokens already, so the context's short and stop words needn't be taken out: none of them equals one.
    """
    context = F.split(F.lower(F.concat_ws(" ", "state", "question")), "[^a-z0-9]+")

    def score(ctx: Column, o: Column) -> Column:
        words = option_tokens(F.concat_ws(" ", o["id"], o["description"]))
        found = F.filter(F.transform(words, lambda w: F.size(ctx) - F.size(F.array_remove(ctx, w))), lambda f: f > 0)
        start = F.struct(F.lit(0.5).alias("sum"), F.lit(0).alias("n"))
        add = lambda a, f: F.struct((a["sum"] + 1 + F.log(f.cast("double") + 1)).alias("sum"), (a["n"] + 1).alias("n"))
        return F.aggregate(found, start, add, lambda a: a["sum"] + a["n"] / F.greatest(F.size(words), F.lit(1)))

    scored = F.transform(F.array(context), lambda ctx: F.transform("options", lambda o: F.struct(o["id"].alias("option"), score(ctx, o).alias("raw_score"))))
    return requests.select("id", F.posexplode(scored[0]).alias("ord", "o")).select("id", "o.option", "ord", "o.raw_score")


def probabilities(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    t = min(10.0, max(0.05, temperature))
    return scores.withColumn("_s", F.col("raw_score") / t).withColumn("probability", softmax("_s", "id")).drop("_s")


def decide(requests: DataFrame, scorer: Scorer = word_scores, temperature: float = 1.0) -> DataFrame:
    """id, chosen, probability, margin, options: the likeliest option, of equal ones the last."""
    p = probabilities(scorer(requests), temperature)
    probs = F.sort_array(F.collect_list("probability"), asc=False)
    out = p.groupBy("id").agg(F.max_by("option", F.struct("probability", "ord")).alias("chosen"), F.max("probability").alias("probability"), probs.alias("_p"), F.count("*").alias("options"))
    return out.withColumn("margin", F.col("_p")[0] - F.coalesce(F.get("_p", F.lit(1)), F.lit(0.0))).drop("_p")


def conformal(probs: DataFrame, qhat: float) -> DataFrame:
    """id, set_size, commit: how many options have 1 - p at most qhat; one commits."""
    return probs.groupBy("id").agg(F.count_if(1 - F.col("probability") <= qhat).alias("set_size")).withColumn("commit", F.col("set_size") == 1)


def debiased(requests: DataFrame, scorer: Scorer = word_scores) -> DataFrame:
    """Option scores averaged over all cyclic orders of the options."""
    n = F.size("options")
    turned = requests.withColumn("_r", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("options", F.concat(F.slice(F.col("options"), F.col("_r") + 1, n), F.slice(F.col("options"), F.lit(1), F.col("_r"))))
    out = scorer(turned.withColumn("_id", F.col("id")).withColumn("id", F.concat_ws("\x1f", "id", "_r")).select("id", "state", "question", "options"))
    plain = out.withColumn("id", F.substring_index("id", "\x1f", 1))
    return plain.groupBy("id", "option").agg(F.avg("raw_score").alias("raw_score"))


def blend(hits: DataFrame, probs: DataFrame, id: str, head: int = 5, weight: float = 0.55) -> DataFrame:
    """The best `head` hits reordered by weight * p + (1 - weight) * score / best; the others behind them as they were."""
    top = hits.orderBy(F.desc("score"), id).limit(head)
    best = top.agg(F.max("score").alias("_best"))
    mixed = top.join(probs.select(F.col("option").alias(id), "probability"), id, "left").crossJoin(F.broadcast(best)).select(id, (weight * F.coalesce("probability", F.lit(0.0)) + (1 - weight) * F.col("score") / F.col("_best")).alias("_mix"))
    out = hits.join(F.broadcast(mixed), id, "left")
    return out.withColumns({"head": F.col("_mix").isNotNull(), "score": F.coalesce("_mix", "score")}).drop("_mix")


def rank_hits(hits: DataFrame, id: str) -> DataFrame:
    """rank: the head first, each part by score and id. Meant for a top list, which is small."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("head"), F.desc("score"), id)))
