"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text is reduced to the statistics of FEATURES (kinds of characters, lengths of words and lines, repetition), each of the whole
text. Trees are grown level by level on the logistic loss: every feature has at most BINS bins between quantiles of the
training rows, a level needs one histogram of gradients and Hessians by node, feature and bin, and every node is split where
the gain is largest. Trees are complete, so that they are flattened into arrays of features, thresholds and leaves, and
numpy takes a block of rows through all trees at once, a level at a time.

Counting statistics and scoring are the work on all data, done in Arrow batches where the rows lie; no text is shuffled. The
trees are fitted on at most SAMPLE labelled rows (those of the least hashes of text and label), so what comes to the driver is
SAMPLE rows of some thirty numbers, whatever the size of the input.

Edge cases: a null text is an empty one; both have statistics (zeros) and a score; a text of any length is read whole; equal
texts have equal scores; a document with several labels teaches each of them, repeated rows count each; without labelled rows
every score is 0.5, with labels of one kind all scores are that kind's share; null ids are not held out and have no label;
other columns are carried in a struct, so that no name clashes; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, packed, table, texts, written

#: Labelled rows at most that the trees are fitted on.
SAMPLE = 40_000
#: Trees, their depth, bins of a feature, learning rate, and what regularises a leaf and a split.
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 80, 4, 64, 0.15, 2.0, 4.0
#: From this score on a document is predicted to be good.
ACCEPT = 0.7
#: Rows that are scored together, and labels up to which their ids are broadcast (counted first).
BLOCK, BROADCAST_ROWS = 4096, 500_000

#: Kinds of bytes, which are counted as shares of the text.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "symbol": b"#$%&*@^~=+<>`",
    "bar": b"|{}[]\\/_",
}
FEATURES = [
    "log_bytes", *KINDS, "other_bytes", "byte_entropy", "log_words", "mean_word", "sd_word", "distinct_words", "top_word", "repeated_word", "longest_repeat",
    "capital_words", "shouted_words", "plain_ends", "log_lines", "mean_line", "short_lines", "repeated_lines", "ended_lines", "barred_lines", "distinct_pairs",
]
_KIND_OF = np.full(256, len(KINDS), np.int64)
for _k, _chars in enumerate(KINDS.values()):
    _KIND_OF[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    """The values of FEATURES of a UTF-8 text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = count[count > 0] / n
    kinds = np.bincount(_KIND_OF, count, minlength=len(KINDS) + 1) / n
    words = text.split()
    m = max(len(words), 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    often = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    same, longest, now = 0, 0, 0
    if len(often) < len(words):
        for a, b in zip(words, words[1:]):
            now = now + 1 if a == b else 0
            if now:
                same += 1
                longest = max(longest, now)
    # By different words, weighed by how often they occur.
    capital = sum(c for w, c in often.items() if w[:1].isupper())
    shouted = sum(c for w, c in often.items() if len(w) > 1 and w.isupper())
    ends = sum(c for w, c in often.items() if w[-1:].isalnum() or w[-1] >= 0x80)
    lines = text.split(b"\n")
    k = len(lines)
    length = np.fromiter(map(len, lines), np.int64, k)
    return [
        np.log1p(n), *kinds.tolist(), -float((share * np.log(share)).sum()), np.log1p(len(words)), float(size.mean()), float(size.std()),
        len(often) / m**0.75, max(often.values(), default=0) / m, same / m, np.log1p(longest),
        capital / m, shouted / m, ends / m, np.log1p(k), float(np.log1p(length).mean()), float((length < 20).mean()),
        1 - len(set(lines)) / k, sum(x.endswith((b".", b"!", b"?")) for x in lines) / k, sum(b" | " in x for x in lines) / k, pairs / m,
    ]


class Trees:
    """Boosted complete trees in flat arrays: feature and threshold by tree and inner node, leaf by tree and leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf
        self.depth = int(np.log2(leaf.shape[1])) if leaf.size else 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row: all trees at once, a level at a time."""
        trees = np.arange(len(self.feature))
        out = np.full(len(x), self.base)
        for lo in range(0, len(x) if len(trees) else 0, BLOCK):
            part = x[lo : lo + BLOCK]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[lo : lo + BLOCK] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def cuts_of(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Between-bin thresholds: a value is in the bin of the cuts below it, and no cut is a largest value."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
    return values[values < column.max()] if len(values) else values


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Trees for rows x (float) and labels y (0 or 1)."""
    if not len(y):
        return Trees(0.0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    if ones in (0, len(y)):
        return Trees(base, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    cuts = [cuts_of(c, bins) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    f = len(cuts)
    last = np.array([len(c) for c in cuts])
    feature, threshold, leaf = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            n, first = 2**level, 2**level - 1
            key = node * bins
            hist = np.stack([[np.bincount(key + b, w, minlength=n * bins).reshape(n, bins) for b in binned] for w in (g, h)])  # what, feature, node, bin
            below = hist.cumsum(3)
            total = below[..., -1:]
            gl, hl = below
            gr, hr = total - below
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
            allowed = (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN) & (np.arange(bins)[None, None, :] < last[:, None, None])
            gain = np.where(allowed, gain, -np.inf).transpose(1, 0, 2).reshape(n, f * bins)
            best = gain.argmax(1)
            split = gain[np.arange(n), best] > 1e-9
            of, at = best // bins, best % bins
            for k in np.flatnonzero(split):
                feature[t, first + k], threshold[t, first + k] = of[k], cuts[of[k]][at[k]]
            # A node without a split sends all rows to the left.
            right = split[node] & (binned[of[node], np.arange(len(y))] > at[node])
            node = 2 * node + right
        size = 2**depth
        leaf[t] = -rate * np.bincount(node, g, minlength=size) / (np.bincount(node, h, minlength=size) + RIDGE)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def _rows_of(texts_: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py() or b"") for t in texts_.cast(pa.string()).cast(pa.binary())]
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of docs as the struct `row`, with x, the array of its statistics."""
    part, at = packed(docs), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch.column(0).field(at))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "x"])

    return part.mapInArrow(work, arrow_schema(part, ["row"], "x array<double>"))


def learned(train: DataFrame, sample: int = SAMPLE, **options) -> Trees:
    """Trees from train (text, label). The sample is the rows with the least hashes of text and label."""
    marked = with_statistics(train.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("text", "label").alias("at")).where("label IS NOT NULL"))
    rows = marked.select("row.at", "row.label", "x").orderBy("at", "label").limit(sample).collect()  # at most `sample` rows
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in rows], np.float64), **options)


def score(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """Every row of docs as the struct `row`, with score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # some thousand numbers
    part, at = packed(docs), docs.columns.index(text)  # the text goes to Python once, within its row

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(_rows_of(batch.column(0).field(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["row", "score", "predicted"])

    return part.mapInArrow(work, arrow_schema(part, ["row"], "score double, predicted int"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and label of the documents with a label that may be learned from; of more labels than `sample`, those with the least
    hashes of their ids."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id").alias("at"))
    marks = F.broadcast(written(marks.orderBy("at", "label").limit(sample).drop("at"), "quality-labels"))  # at most `sample` rows of two numbers
    return docs.select("doc_id", "text").join(marks, "doc_id").select("text", "label")


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    trees = learned(labelled(docs, table(spark, sf_dir, "labels")))
    out = score(docs.withColumn("held_out", held_out()), trees)
    return out.select("row.doc_id", "row.held_out", "score", "predicted")
