"""Interpolated Kneser-Ney character models of several classes at once, kept in sorted hash arrays.

A word is read as ``^word$``; its characters are predicted in turn from at most order - 1 characters before them, never from
another word. So a word's log-likelihood is a property of the word, and texts are scored by looking their words up.

Counting is distributed: tasks count words per class, expand them to n-grams, and Spark sums the n-grams of all documents. The
order never changes. A model of up to MAX_CELLS numbers (n-grams times classes, counted first) is fitted on the driver and
broadcast. A larger one is fitted and broadcast in blocks: everything that the prediction of a character needs shares the two
characters before it, so the n-grams are dealt by those. Only what is shorter, and the discounts, all blocks share. A text's
log-likelihood is the sum over the blocks, which each see all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, hash128, new_folder, written

#: N-grams times classes that are fitted and broadcast at once.
MAX_CELLS = 12_000_000
#: Words that a worker counts or remembers before it starts anew.
MAX_WORDS = 400_000
#: Words of texts that are looked up together.
CHUNK = 200_000
P = np.uint64(0x100000001B3)
WORD = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return WORD(text.lower())


def _grams(words: dict[tuple[int, str], int], order: int) -> Counter:
    found: Counter = Counter()
    for (cls, w), n in words.items():
        s = f"^{w}$"
        for o in range(1, len(s)):
            found[cls, s[max(0, o + 1 - order) : o + 1]] += n
    return found


def gram_counts(docs: DataFrame, classes: int, order: int) -> DataFrame:
    """gram and n0, n1, ... per class, over all rows of docs (text string, cls int)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[int, str], int] = {}
        for batch in chain(batches, [None]):
            if batch is not None:
                for text, cls in zip(batch.column(0), batch.column(1).to_pylist()):
                    for w, n in Counter(words_of(text.as_py() or "")).items():
                        words[cls, w] = words.get((cls, w), 0) + n
            if words and (batch is None or len(words) > MAX_WORDS):
                grams = _grams(words, order)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.int32()), pa.array([k[1] for k in grams]), pa.array(grams.values(), pa.int64())], names=["cls", "gram", "n"])
                words = {}

    each = [F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(classes)]
    return written(docs.select("text", "cls").mapInArrow(work, "cls int, gram string, n long").groupBy("gram").agg(*each), "grams")


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = h * P + codes[:, j].astype(np.uint64) + np.uint64(1)
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and which of wanted are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _block(before: np.ndarray, last: np.ndarray, blocks: int) -> np.ndarray:
    """The block of what follows two characters."""
    h = (before.astype(np.uint64) * P + last.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _codes(grams: list[str], k: int) -> np.ndarray:
    return np.array(grams, f"U{k}").view(np.uint32).reshape(-1, k) if grams else np.zeros((0, k), np.uint32)


def _discount(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    return np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)


class Model:
    """order; for each k: sorted hashes of k-grams with log-probabilities, sorted hashes of contexts with log backoff weights."""

    def __init__(self, grams: list[str], counts: np.ndarray, block: int = 0, blocks: int = 1, low: dict | None = None, discounts: dict | None = None):
        """counts: a row per n-gram, a column per class. Of a model in blocks: the n-grams of one block, the types (codes,
        counts) of one and two characters of all blocks, and the discounts by order."""
        classes = counts.shape[1]
        self.block, self.blocks = block, blocks
        length = np.array([len(g) for g in grams], np.int64)
        self.order, self.classes = max(discounts) if discounts else int(length.max(initial=1)), classes
        given = {}
        for k in range(2, self.order + 1):
            at = np.flatnonzero(length == k)
            given[k] = (_codes([grams[i] for i in at], k), counts[at].astype(float))
        types: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        above: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(self.order, 0, -1):
            if low and k in low:
                types[k] = low[k]
                continue
            codes, own = given.get(k, (np.zeros((0, k), np.uint32), np.zeros((0, classes))))
            if above is not None:
                codes = np.concatenate([codes, above[0][:, 1:]])
                own = np.concatenate([own, (above[1] > 0).astype(float)])
            h = _hash(codes)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            summed = np.stack([np.bincount(back, own[:, c], len(first)) for c in range(classes)], 1) if len(first) else np.zeros((0, classes))
            types[k] = above = (codes[first], summed)
        self.vocabulary = len(types[1][0]) + 1
        self.keys, self.logs, self.contexts, self.backs = {}, {}, {}, {}
        lower = None
        for k in range(1, self.order + 1):
            codes, c = types[k]
            d = discounts[k] if discounts else _discount((c == 1).sum(0), (c == 2).sum(0))
            context = _hash(codes[:, :-1])
            ctx, back = np.unique(context, return_inverse=True)
            total = lambda x: np.stack([np.bincount(back, x[:, j], len(ctx)) for j in range(classes)], 1)  # noqa: E731, B023
            tot, taken = total(c), total(np.minimum(c, d))
            gamma = np.where(tot > 0, taken / np.maximum(tot, 1e-300), 1.0)
            below = np.full(c.shape, 1 / self.vocabulary)
            if lower is not None:
                at, there = _find(lower[0], _hash(codes[:, 1:]))
                below[there] = lower[1][at[there]]
            prob = np.where(tot[back] > 0, np.maximum(c - d, 0) / np.maximum(tot[back], 1e-300), 0) + gamma[back] * below
            keys = _hash(codes)
            order = np.argsort(keys)
            lower = (keys[order], prob[order])
            self.keys[k], self.logs[k] = lower[0], np.log(lower[1]).astype(np.float32)
            self.contexts[k], self.backs[k] = ctx, np.log(np.maximum(gamma, 1e-12)).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood of each word (a row) under each class (a column), its end included. A block's model sums the
        characters that are its own; a word's first character is the first block's."""
        if not words:
            return np.zeros((0, self.classes), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.cumsum(size) - size
        place = np.arange(len(codes)) - np.repeat(start, size)
        # pos: the characters to predict; hashes of the k characters up to each one and up to the one before
        pos = np.flatnonzero(place > 0)
        place = place[pos]
        out, back = np.zeros((len(pos), self.classes), np.float32), np.zeros((len(pos), self.classes), np.float32)
        ends = [np.zeros(len(codes), np.uint64)]
        for k in range(1, self.order + 1):
            h = ends[-1].copy()
            h[k - 1 :] += np.uint64(pow(int(P), k - 1, 1 << 64)) * (codes[: max(0, len(codes) - k + 1)].astype(np.uint64) + np.uint64(1))
            ends.append(h)
        mine = np.where(place > 1, _block(codes[pos - 2], codes[pos - 1], self.blocks), 0) == self.block if self.blocks > 1 else np.ones(len(pos), bool)
        left = np.flatnonzero(mine)
        for k in range(self.order, 0, -1):
            now = left[place[left] >= k - 1]
            at, there = _find(self.keys[k], ends[k][pos[now]])
            hit = now[there]
            out[hit] = self.logs[k][at[there]] + back[hit]
            miss = now[~there]
            at, there = _find(self.contexts[k], ends[k - 1][pos[miss] - 1])
            back[miss[there]] += self.backs[k][at[there]]
            done = np.zeros(len(pos), bool)
            done[hit] = True
            left = left[~done[left]]
        out[left] = back[left] - np.float32(np.log(self.vocabulary))
        starts = np.cumsum(size - 1) - (size - 1)
        return np.add.reduceat(out, starts, axis=0)


class Scorer:
    """Sums of log-likelihoods and numbers of characters of texts; remembers words."""

    def __init__(self, model: Model):
        self.model, self.known, self.logs = model, {}, np.zeros((0, model.classes), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.int64)
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in known]
            if len(known) + len(new) > MAX_WORDS:
                known.clear()
                self.logs = self.logs[:0]
                new = list(dict.fromkeys(words))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.logs = np.concatenate([self.logs, self.model.words(new)])
            return np.array([known[w] for w in words], np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """For a few texts at once: log-likelihoods (a row per text), predicted characters, and the words."""
        split = [words_of(t) for t in texts]
        n = np.array([len(w) for w in split])
        flat = list(chain.from_iterable(split))
        ids = self._ids(flat)
        ends = np.cumsum(n)
        logs = np.zeros((len(texts), self.model.classes))
        some = np.flatnonzero(n)
        if len(flat):
            logs[some] = np.add.reduceat(self.logs[ids].astype(np.float64), (ends - n)[some], axis=0)
        chars = np.array([sum(map(len, w)) + len(w) for w in split])
        return logs, chars, split


def _in_parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with some texts each."""
    texts, at = batch.column(column), 0
    while at < len(texts):
        some, size = [], 0
        while at + len(some) < len(texts) and size < CHUNK * 6:
            some.append(texts[at + len(some)].as_py() or "")
            size += len(some[-1])
        yield batch.slice(at, len(some)), some
        at += len(some)


def scored(docs: DataFrame, keep: list[str], models: list, finish: Callable, schema: str) -> DataFrame:
    """The `keep` columns of docs (which has text) and what finish(logs, chars, words, texts) gives for some texts at a time (a
    list of arrays). models: the broadcast Model, or one for each block."""
    names = [*keep, *(x.split()[0] for x in schema.split(","))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models[0].value)
        for batch in batches:
            for rows, some in _in_parts(batch, len(keep)):
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *finish(*scorer(some), some)], names=names)

    if len(models) == 1:
        return docs.select(*keep, "text").mapInArrow(work, arrow_schema(docs, keep, schema))

    # Each block scores the different texts; sums go back to the rows by the texts' hashes.
    h1, h2 = (h.alias(n) for h, n in zip(hash128(F.coalesce("text", F.lit(""))), ("h1", "h2")))
    rows = docs.select(F.struct(*keep).alias("row"), "text", h1, h2)
    different = rows.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    logs = [f"l{c}" for c in range(models[0].value.classes)]

    def partly(model):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model.value)
            for batch in batches:
                for part, some in _in_parts(batch, 2):
                    got = scorer(some)[0]
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], *[pa.array(got[:, c]) for c in range(len(logs))]], names=["h1", "h2", *logs])

        return written(different.mapInArrow(work, f"h1 long, h2 long, {', '.join(f'{x} double' for x in logs)}"), "block-scores")

    parts = [partly(m) for m in models]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = every.groupBy("h1", "h2").agg(*[F.sum(x).alias(x) for x in logs])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in _in_parts(batch, 1):
                split = [words_of(t) for t in some]
                got = np.stack([c.to_numpy() for c in part.columns[2:]], 1)
                out = finish(got, np.array([sum(map(len, w)) + len(w) for w in split]), split, some)
                yield pa.RecordBatch.from_arrays([*part.column(0).flatten(), *out], names=names)

    return rows.join(sums, ["h1", "h2"]).select("row", "text", *logs).mapInArrow(whole, arrow_schema(docs, keep, schema))


def fit(table: DataFrame, columns: list[str], max_cells: int = MAX_CELLS) -> list:
    """The model of a table of gram_counts, broadcast, or those of its blocks; columns: its count columns, one for each class."""
    sc = table.sparkSession.sparkContext
    table = table.where(" OR ".join(f"{c} > 0" for c in columns)).select("gram", *columns)
    blocks = max(1, -(-table.count() * len(columns) // max_cells))

    def load(part: DataFrame) -> tuple[list[str], np.ndarray]:
        got = part.toArrow()
        return got.column("gram").to_pylist(), np.stack([got.column(c).to_numpy() for c in columns], 1).reshape(-1, len(columns))

    if blocks == 1:
        return [sc.broadcast(Model(*load(table)))]
    order = table.agg(F.max(F.char_length("gram"))).first()[0]
    size, end = F.char_length("gram"), lambda k: F.substring(F.col("gram"), -k, k)
    low, discounts = {}, {}
    for k in range(order, 0, -1):  # the types of k characters: given ones, and different ones with one more before them
        longer = table.where(size > k).groupBy(end(k + 1).alias("gram")).agg(*[F.max((F.col(c) > 0).cast("long")).alias(c) for c in columns])
        types = table.where(size == k).unionByName(longer.select(end(k).alias("gram"), *columns)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in columns])
        ones = types.agg(*[F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in columns for n in (1, 2)]).first()
        discounts[k] = _discount(*[np.array([ones[f"{c}_{n}"] for c in columns]) for n in (1, 2)])
        if k < 3:
            grams, counts = load(types)
            low[k] = (_codes(grams, k), counts.astype(float))
    path = new_folder(table.sparkSession, "gram-blocks")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context = _codes([g[-3:-1] for g in batch.column(0).to_pylist()], 2)
            yield pa.RecordBatch.from_arrays([pa.array(_block(context[:, 0], context[:, 1], blocks).astype(np.int32)), *batch.columns], names=["block", "gram", *columns])

    longer = table.where(size > 2)
    longer.mapInArrow(dealt, f"block int, gram string, {', '.join(f'{c} long' for c in columns)}").write.partitionBy("block").parquet(path)
    every = table.sparkSession.read.schema(f"gram string, {', '.join(f'{c} long' for c in columns)}, block int").parquet(path)
    return [sc.broadcast(Model(*load(every.where(F.col("block") == b)), b, blocks, low, discounts)) for b in range(blocks)]
