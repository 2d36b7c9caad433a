"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Only the lengths decide a packing, and there are at most `capacity` of them, so the driver packs the histogram of lengths:
a bounded instance whatever the number of documents. Sets of one to three pieces that dominate every other set with the same
longest piece are fixed for good, as often as the counts allow; best-fit decreasing packs the remainder. The result is a list
of runs: so many sequences with the same pieces in the same places. Each piece has a rank among those of its length, counted
in salted parts so that a hot length is never in one task, and the run that holds the rank gives its sequence and offset.

Tokenizing is by document in Arrow batches, by an encoder built from the tokenizer's file, which gives the same ids.

Edge cases: a null or empty text is the single id 0; a text longer than a sequence is cut into full sequences after a shorter
first piece; repeated rows are packed each; without rows there are no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

CAPACITY = 2048
#: Ranks of one length are counted in parts of at most about so many rows, and of that share of all rows.
PART_ROWS, PARTS = 100_000, 400


@lru_cache(1)
def _encoding(path: str, pattern: str):
    """The tokenizer file's vocabulary in an encoder that is several times as fast; None if ids aren't in the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    return tok


def encoder(path: str, pattern: str):
    """A function from a text to its ids."""
    fast = _encoding(path, pattern)
    if fast is not None:
        return fast.encode_ordinary
    tok = _tokenizer(path)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = array("I", encode(t or ""))
                ids.append(0)
                n, raw = len(ids), memoryview(ids).cast("B")
                at, end = 0, (n - 1) % capacity + 1
                for k in range((n + capacity - 1) // capacity):
                    row.append(i), piece.append(k), start.append(at), length.append(end - at), crc.append(zlib.crc32(raw[4 * at : 4 * end]))
                    at, end = end, end + capacity
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    part = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return part.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _reduce(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of the histogram, longest piece first, until nothing changes. Returns (lengths, times).

    A set with piece a dominates if its other pieces can be matched, each at least as large, with groups of the other pieces
    of any feasible set that holds a. That is so when nothing fits beside a; when one piece fills the rest exactly; when no
    two pieces fit beside a, for the largest that does; and, when no three do, for it if no pair is larger, or else for
    a pair whose larger piece is that largest piece and whose sum fills the rest.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for a in range(capacity, 0, -1):
            while count[a]:
                rest = capacity - a
                count[a] -= 1  # the other pieces are those left beside one a
                there = np.flatnonzero(count[: rest + 1])
                count[a] += 1
                small = [int(x) for x in there[:3] for _ in range(min(3, int(count[x] - (x == a))))][:3]
                times, chosen = 0, ()
                if not len(there):
                    # Left over only for want of partners that other sets have taken: nothing that remains fits.
                    times, chosen = int(count[a]), (a,)
                    if 2 * a <= capacity:
                        times = 1
                else:
                    b = int(there[-1])
                    pair = (small[0] + small[1]) if len(small) > 1 else rest + 1
                    triple = sum(small) if len(small) > 2 else rest + 1
                    most = int(count[a]) // 2 if a == b else min(int(count[a]), int(count[b]))
                    if b == rest or pair > rest:
                        times, chosen = most, (a, b)
                    elif triple > rest:
                        own = count[: rest + 1].copy()
                        if a <= rest:
                            own[a] -= 1
                        best = _best_pair(own, there, rest)
                        if b >= sum(best):
                            times, chosen = 1, (a, b)
                        elif sum(best) == rest and best[0] == b:
                            times, chosen = 1, (a, *best)
                if not times:
                    break
                fixed.append((chosen, times))
                changed = True
                for x in chosen:
                    count[x] -= times
    return fixed


def _best_pair(count: np.ndarray, there: np.ndarray, rest: int) -> tuple[int, int]:
    """The two pieces with the largest sum that is at most rest, the larger first; the first of ties has the largest piece."""
    best, i, j = (0, 0), len(there) - 1, 0
    while i >= j:
        x, y = int(there[i]), int(there[j])
        if x + y > rest or (i == j and count[x] < 2):
            i -= 1
            continue
        while j < i and (int(there[j + 1]) + x <= rest) and (j + 1 < i or count[x] > 1):
            j += 1
        y = int(there[j])
        if x + y > sum(best):
            best = (x, y)
        i -= 1
    return best


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: all pieces of a length go at once into groups of like sequences."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by what is left in them
    for a in range(capacity, 0, -1):
        left = int(count[a])
        for room in sorted(r for r in groups if r >= a):
            todo = groups.pop(room) if left else []
            while todo and left:
                held, n = todo.pop()
                each = room // a
                full = min(n, left // each)
                if full:
                    groups[room - each * a].append((held + (a,) * each, full))
                    left, n = left - full * each, n - full
                if n and left:
                    groups[room - left * a].append((held + (a,) * left, 1))
                    left, n = 0, n - 1
                if n:
                    todo.append((held, n))
            if todo:
                groups[room].extend(todo)
            if not left:
                break
        each = capacity // a
        if left >= each:
            groups[capacity - each * a].append(((a,) * each, left // each))
        if left % each:
            groups[capacity - left % each * a].append(((a,) * (left % each), 1))
    return [g for at in groups.values() for g in at]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences), which hold exactly the counted pieces."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    fixed = _reduce(count, capacity)
    return fixed + _best_fit(count, capacity)


def _runs(packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) of runs, with their first sequence and offset."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, n in packed:
        offset = 0
        for x in lengths:
            out.append((x << 44 | rank[x], sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    out.sort()
    return tuple(np.array([r[i] for r in out], np.int64) for i in range(3))


def pack(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, pattern, text, doc_id, capacity), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    most = max(1, min(PART_ROWS, sum(counts.values()) // PARTS))
    parts = max(1, -(-max(counts.values(), default=0) // most))
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    by_part = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    runs = spark.sparkContext.broadcast(_runs(pack_histogram(counts, capacity)))  # some thousand rows, bounded by the capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, offset = runs.value
        for batch in batches:
            key = (batch.column(3).to_numpy() << 44) | batch.column(5).to_numpy()
            at = np.searchsorted(first, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + key - first[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(texts(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
