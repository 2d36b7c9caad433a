"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model predict each word of a text from the word before it. An expression's count in a class, of one
word or of two, is the number of different training texts of the class that hold it (n copies of a text count as one). Both
models are interpolated as Kneser and Ney do it: a class keeps of a count what a discount leaves, and the discounted mass goes
to a lower model whose shares are the discounts themselves, so that the classes together keep every expression's frequency.

- Words: p(w | class) = own(w) / T + gamma p_shared(w), where T counts the class's words, gamma is the discounted share of T,
  and p_shared(w) is the share of w in the discounts of both classes: the backoff that the classes share.
- Pairs: p(w | v, class) = own(v, w) / F(v) + gamma(v) p(w | class), where F(v) counts what follows v in the class.

The discount is what the shared counts explain: the expected count e (for a pair, by how likely the class is to say w), three
of its deviations, and three more: own = n - min(n, e + 3 sqrt(e) + 3). The usual constant discount (below one) leaves a class
so much chance in tens of thousands of rare words that it drowns what tells the classes apart. Rare expressions are thus left to the
shared counts, where they are as likely in either class, whatever the number of labels.

A text's evidence is the difference of its two log-likelihoods over all its words, less what the same number of shared words
has. Normalised by the words it is turned into a score by a logistic function, which is fitted on at most SAMPLE different
labelled texts of one fold, taken by hash and scored by models of the other folds. Where most labels are toxic their weight there is
cut to a half: how labels were picked says nothing about a text.

All words and pairs of all labelled texts are counted. A pair can keep a count of its own only if both its words occur in more
than three texts of a class, so others aren't passed on. Evidence is a sum of weights of words, pairs and first words of pairs that
kept something. Up to BROADCAST_ROWS weights, labels or repeated texts are broadcast (counted first); beyond that they are joined.

Edge cases: empty and null texts have no evidence; rows without a label aren't learned from; with labels of one class only (or
none) every score is that class (or 0); repeated rows and ties change nothing; texts of any length are read whole; other
columns are carried in a struct, so that no name clashes; no rows to score give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, hash128, packed, table, text_or_empty, texts, written

#: Deviations (and texts) by which a count must exceed what the shared counts explain.
SURE = 3.0
#: Labelled texts at most on which the score is calibrated, and the part of the training texts they are taken from.
SAMPLE, FOLDS = 20_000, 4
#: Expressions that a task counts before it passes them on, and words whose hashes it remembers.
FLUSH, REMEMBER = 400_000, 100_000
BROADCAST_ROWS = 2_000_000
#: Score from which a text is rejected.
REJECT = 0.7
WORD = re.compile(r"[^\W\d_]+").findall
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Words:
    """Hashes of a text's words in order."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = WORD((text or "").lower()), self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            known.update((w, xxhash.xxh64_intdigest(w)) for w in words if w not in known)
            return np.array([known[w] for w in words], np.uint64)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (v * P1 + w) * P2
    return h ^ (h >> np.uint64(29))


def first_keys(v: np.ndarray) -> np.ndarray:
    h = v * P3 + P1
    return h ^ (h >> np.uint64(31))


def _counted(train: DataFrame, each, names: list[str], values: list[str]) -> DataFrame:
    """Sums of what each(words of a text) gives, (keys.., values..), by keys, class and weight: a column per value and class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                for text, cls, weight in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    got = each(words(text.as_py()))
                    held.append((cls, weight, got))
                    size += len(got[0])
            if held and (batch is None or size > FLUSH):
                keys = [np.concatenate([g[i] for _, _, g in held]).view(np.int64) for i in range(len(names))]
                cls = np.repeat([c for c, _, _ in held], [len(g[0]) for _, _, g in held]).astype(np.int32)
                order = np.lexsort((cls, *keys))
                new = np.ones(len(order), bool)
                new[1:] = False
                for k in (cls, *keys):
                    new[1:] |= k[order][1:] != k[order][:-1]
                at = np.flatnonzero(new)
                sums = []
                for i in range(len(values)):
                    x = np.concatenate([g[len(names) + i] * w for _, w, g in held])[order]
                    sums.append(pa.array(np.add.reduceat(x, at) if len(at) else x))
                yield pa.RecordBatch.from_arrays([*[pa.array(k[order][at]) for k in keys], pa.array(cls[order][at]), *sums], names=[*names, "cls", *values])
                held, size = [], 0

    schema = ", ".join([*[f"{n} long" for n in names], "cls int", *[f"{v} double" for v in values]])
    sums = [F.round(F.sum(F.when(F.col("cls") == c, F.col(v)).otherwise(0.0))).cast("long").alias(f"{v}{c}") for v in values for c in range(4)]
    return train.select("text", "cls", "weight").mapInArrow(work, schema).groupBy(*names).agg(*sums)


def _words_of(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different words, one each, and how many different words follow them."""
    words = np.unique(h)
    pairs = np.unique(pair_keys(h[:-1], h[1:]), return_index=True)[1] if len(h) > 1 else np.zeros(0, np.int64)
    follow = np.bincount(np.searchsorted(words, h[pairs]), minlength=len(words)).astype(float)
    return words, np.ones(len(words)), follow


def expressions(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts (w, n0.., f0..: texts that hold it, words that follow it) and pair counts (v, w, n0..) by class, all exact for
    words and for pairs that can keep a count. train: text, cls, weight."""
    words = written(_counted(train, _words_of, ["w"], ["n", "f"]), "word-counts")
    often = words.where((F.col("n0") + F.col("n2") > SURE) | (F.col("n1") + F.col("n3") > SURE)).select("w")
    few = often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = train.sparkSession.sparkContext.broadcast(np.sort(often.toArrow().column("w").to_numpy().view(np.uint64)) if few else None)

    def pairs_of(h: np.ndarray) -> tuple[np.ndarray, ...]:
        v, w = h[:-1], h[1:]
        if known.value is not None and len(h) > 1:
            keep = known.value
            there = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h if len(keep) else np.zeros(len(h), bool)
            v, w = v[there[:-1] & there[1:]], w[there[:-1] & there[1:]]
        first = np.unique(pair_keys(v, w), return_index=True)[1]
        return v[first], w[first], np.ones(len(first))

    pairs = _counted(train, pairs_of, ["v", "w"], ["n"])
    return words, written(pairs.where((F.col("n0") + F.col("n2") > SURE) | (F.col("n1") + F.col("n3") > SURE)), "pair-counts")


def _own(n: Column, expected: Column) -> Column:
    return n - F.least(n, expected + SURE * F.sqrt(expected) + SURE)


def weights(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, part, all: what a word, a pair and a pair's first word add to the evidence, by a model of the texts outside the
    calibration fold and by one of all texts (0 where a model has nothing to say)."""
    spark, models, classes = words.sparkSession, ("part", "all"), (0, 1)
    count = lambda x, m, c: F.col(f"{x}{c}").cast("double") if m == "part" else (F.col(f"{x}{c}") + F.col(f"{x}{c + 2}")).cast("double")
    each = [(m, c) for m in models for c in classes]
    w = words.select("w", *[count(x, m, c).alias(f"{x}_{m}{c}") for x in "nf" for m, c in each])
    t = w.agg(*[F.sum(f"n_{m}{c}").alias(f"{m}{c}") for m, c in each]).first()
    models = [m for m in models if t[f"{m}0"] and t[f"{m}1"]]
    if not models:
        return spark.createDataFrame([], "key long, part double, all double")
    each = [(m, c) for m in models for c in classes]
    n = lambda m: F.col(f"n_{m}0") + F.col(f"n_{m}1")
    own = lambda m: F.col(f"o_{m}0") + F.col(f"o_{m}1")
    w = w.withColumns({f"o_{m}{c}": _own(F.col(f"n_{m}{c}"), n(m) * (t[f"{m}{c}"] / (t[f"{m}0"] + t[f"{m}1"]))) for m, c in each})
    d = w.agg(*[F.sum(F.col(f"n_{m}{c}") - F.col(f"o_{m}{c}")).alias(f"{m}{c}") for m, c in each]).first()
    gamma = {(m, c): d[f"{m}{c}"] / t[f"{m}{c}"] for m, c in each}
    p = lambda m, c: F.col(f"o_{m}{c}") / t[f"{m}{c}"] + gamma[m, c] * (n(m) - own(m)) / (d[f"{m}0"] + d[f"{m}1"])
    w = w.withColumns({f"p_{m}{c}": p(m, c) for m, c in each})
    ratio = lambda x, m: F.log(F.col(f"{x}_{m}1")) - F.log(F.col(f"{x}_{m}0"))
    none = [F.lit(0.0).alias(m) for m in ("part", "all") if m not in models]
    said = lambda of: [*[F.coalesce(F.when(own(m) > 0, of(m)), F.lit(0.0)).alias(m) for m in models], *none]
    some = sum((own(m) for m in models), F.lit(0.0)) > 0
    single = w.where(some).select(F.col("w").alias("key"), *said(lambda m: ratio("p", m) - float(np.log(gamma[m, 1] / gamma[m, 0]))))

    two = pairs.select("v", "w", *[count("n", m, c).alias(f"n_{m}{c}") for m, c in each]).join(w.select("w", *[f"p_{m}{c}" for m, c in each]), "w")
    every = lambda m: F.col(f"p_{m}0") * t[f"{m}0"] + F.col(f"p_{m}1") * t[f"{m}1"]
    says = lambda m, c: F.coalesce(F.try_divide(n(m) * F.col(f"p_{m}{c}") * t[f"{m}{c}"], every(m)), F.lit(0.0))  # noqa: E731  (a word may be the fold's alone)
    two = two.withColumns({f"o_{m}{c}": _own(F.col(f"n_{m}{c}"), says(m, c)) for m, c in each}).where(some)
    heads = two.groupBy("v").agg(*[F.sum(f"o_{m}{c}").alias(f"o_{m}{c}") for m, c in each]).join(w.select(F.col("w").alias("v"), *[f"f_{m}{c}" for m, c in each]), "v")
    heads = heads.withColumns({f"g_{m}{c}": F.when(F.col(f"f_{m}{c}") > 0, 1 - F.col(f"o_{m}{c}") / F.col(f"f_{m}{c}")).otherwise(F.lit(1.0)) for m, c in each})
    firsts = heads.select("v", F.lit(None).cast("long").alias("w"), *said(lambda m: ratio("g", m)))
    two = two.join(heads.select("v", *[f"{x}_{m}{c}" for x in "fg" for m, c in each]), "v")
    q = lambda m, c: F.when(F.col(f"f_{m}{c}") > 0, F.col(f"o_{m}{c}") / F.col(f"f_{m}{c}")).otherwise(F.lit(0.0)) + F.col(f"g_{m}{c}") * F.col(f"p_{m}{c}")
    both = two.select("v", "w", *said(lambda m: F.log(q(m, 1)) - F.log(q(m, 0)) - ratio("p", m) - ratio("g", m)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, second = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
            single_ = np.array(second.is_null())
            w_ = second.fill_null(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(single_, first_keys(v), pair_keys(v, w_)).view(np.int64)), *batch.columns[2:]], names=["key", "part", "all"])

    hashed = both.select("v", "w", "part", "all").unionByName(firsts).mapInArrow(keyed, "key long, part double, all double")
    return written(single.select("key", "part", "all").unionByName(hashed), "toxic-weights")


def _keys(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, pair_keys(h[:-1], h[1:]), first_keys(h[:-1])]).view(np.int64) if len(h) else np.zeros(0, np.int64)


def evidence(docs: DataFrame, keep: list[str], model: DataFrame, bound: int = BROADCAST_ROWS, inside: int | None = None) -> DataFrame:
    """The `keep` columns of docs (which has text) with evidence and words, by a table of key and weight. inside: the number of the
    field of the first kept column, a struct, that is the text too, so that it needn't be passed to Python twice."""
    sc = docs.sparkSession.sparkContext
    few = model.limit(bound + 1).count() <= bound
    got = model.toArrow().sort_by("key") if few else None
    values = sc.broadcast((got.column("key").to_numpy(), got.column("weight").to_numpy()) if few else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sums, size = [], []
            for text in batch.column(len(keep)) if inside is None or not few else batch.column(0).field(inside):
                h = words(text.as_py())
                size.append(len(h))
                if few and len(values.value[0]):
                    keys, weight = values.value
                    k = _keys(h)
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    sums.append(float(weight[at[keys[at] == k]].sum()))
                else:
                    sums.append(0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sums, pa.float64()), pa.array(size, pa.int64())], names=names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                k, n = np.unique(_keys(words(text.as_py())), return_counts=True)
                at = pa.array([i] * len(k), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(k), pa.array(n)], names=["h1", "h2", "key", "n"])

    if few:
        names = [*keep, "evidence", "words"]
        return docs.select(*keep, *(["text"] if inside is None else [])).mapInArrow(work, arrow_schema(docs, keep, "evidence double, words long"))
    h1, h2 = hash128(F.col("text"))
    names = [*keep, "_h1", "_h2", "_none", "words"]
    rows = docs.select(*keep, h1.alias("_h1"), h2.alias("_h2"), "text")
    keep = [*keep, "_h1", "_h2"]
    sized = rows.mapInArrow(work, arrow_schema(rows, keep, "_none double, words long"))
    each = docs.select(h1.alias("h1"), h2.alias("h2"), "text").dropDuplicates(["h1", "h2"]).mapInArrow(spread, "h1 long, h2 long, key long, n long")
    sums = each.join(model, "key").groupBy("h1", "h2").agg(F.sum(F.col("n") * F.col("weight")).alias("evidence"))
    joined = sized.join(sums, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left")
    return joined.select(*keep[:-2], F.coalesce("evidence", F.lit(0.0)).alias("evidence"), "words")


def _features(total: Column, words: Column) -> list[Column]:
    """Evidence per word, per root of the words, and in all (damped). Without evidence only the constant is left, so a text's
    length alone never makes it toxic."""
    n = F.greatest(words, F.lit(1)).cast("double")
    return [20 * total / n, total / F.sqrt(n), F.signum(total) * F.sqrt(F.abs(total)), F.lit(1.0)]


def _logistic(x: np.ndarray, y: np.ndarray, often: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for the weights of a logistic function; often: how much each row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (often * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (often * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def score(docs: DataFrame, train: DataFrame, text: str = "text", sample: int = SAMPLE, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of docs as the struct `row`, with score and predicted. train: text and toxic (0 or 1)."""
    whole = text_or_empty(F.col("text"))
    h1, h2 = hash128(whole)
    train = train.where("toxic IN (0, 1)").select(whole.alias("text"), F.col("toxic").cast("int").alias("toxic"), h1.alias("h1"), h2.alias("h2"))
    copies = written(train.groupBy("h1", "h2", "toxic").agg(F.count("*").alias("n")), "labelled")
    numbers = {r.toxic: r.n for r in copies.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = packed(docs, text=text_or_empty(F.col(f"`{text}`")))
    if len(numbers) < 2:
        flat = float(max(numbers, default=0))
        return rows.select("row", F.lit(flat).alias("score"), F.lit(int(flat >= REJECT)).alias("predicted"))
    fold = F.pmod("h2", F.lit(FOLDS)) == 0
    train = train.join(_small(copies.where("n > 1")), ["h1", "h2", "toxic"], "left").withColumns({"weight": 1 / F.coalesce("n", F.lit(1)), "cls": (F.col("toxic") + F.when(fold, 2).otherwise(0)).cast("int")})
    model = weights(*expressions(train))
    by = lambda m: model.where(F.col(m) != 0).select("key", F.col(m).alias("weight"))
    last = copies.where(fold).select("h1").orderBy("h1").limit(sample).agg(F.max("h1")).first()[0]
    part = train.where(F.col("cls") >= 2).where(F.col("h1") <= F.lit(last).cast("long"))
    seen = evidence(part, ["toxic", "weight"], by("part"), bound).groupBy("toxic", "evidence", "words").agg(F.sum("weight").alias("n"))
    got = sorted(tuple(r) for r in seen.select("toxic", "n", *_features(F.col("evidence"), F.col("words"))).collect())
    got = np.array(got, float).reshape(-1, 6)
    y, often, x = got[:, 0], got[:, 1], got[:, 2:]
    often = often * np.where(y > 0, min(1.0, float((often * (1 - y)).sum()) / max(float((often * y).sum()), 1e-9)), 1.0)
    fitted = _logistic(x, y, often)
    z = sum((f * float(k) for f, k in zip(_features(F.col("evidence"), F.col("words")), fitted)), F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    inside = docs.columns.index(text) if docs.columns.count(text) == 1 and docs.schema[text].dataType.typeName() == "string" else None
    out = evidence(rows, ["row"], by("all"), bound, inside).select("row", p.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the documents with a label that may be learned from."""
    marks = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    return docs.select("doc_id", "text").where(~held_out()).join(_small(marks), "doc_id").select("text", "toxic")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below REJECT, by a model of the labelled ones. Null and empty texts stay, and so does
    every row if there are no labels; the columns are those of docs, whatever their names; no rows give no rows."""
    return score(docs, labelled(docs, labels)).where("predicted = 0").select("row.*")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs.withColumn("held_out", held_out()), labelled(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", "row.held_out", "score", "predicted")
