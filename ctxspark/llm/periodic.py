"""Runs of periodic repetition in texts, on a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q and at least EXPONENT * q (and LEAST) words that can't be extended
with that period. For each period p the words at jp and (j+1)p are grid points; a run of period p holds at least EXPONENT of
them in a row, so its words at these agree. Where they do, the forward and the backward longest common extension (LCE) from
jp and (j+1)p give the maximal stretch of period p around them. A text of n words has n/1 + n/2 + ... grid points, n log n in all.

LCEs come from suffix arrays of the texts and of the reversed texts: by prefix doubling, over many texts at once (each text
ends with a mark of its own, so that nothing is compared across texts), with the neighbours' common prefixes and range minima
over them (within blocks by running minima, across them by a sparse table, which keeps them linear in memory). A stretch whose
smallest period is a divisor of p is found under both; the smallest period wins.

Edge cases: a null or empty text has no words, no runs and collapses to the empty string; words are what stands between ASCII
white space; texts of any length are read whole (a task holds some texts of together FLUSH words, or one longer text); equal
rows have equal results; other columns are carried in a struct, so that no name clashes; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, texts
from .merkle import crc32_sql

#: A run's least number of words, and of its periods.
LEAST, EXPONENT = 6, 4
#: Words that are worked on together, grid points that are looked at together, and positions in a block of the range minima.
FLUSH, GRID, BLOCK = 400_000, 2_000_000, 16
RUNS = "array<struct<start:long,length:long,period:long>>"


class Minima:
    """Minima of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = -(-max(len(values), 1) // BLOCK) * BLOCK
        padded = np.full(n, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.sparse = [blocks.min(1)]
        while 2 << (len(self.sparse) - 1) <= len(blocks):
            last, step = self.sparse[-1], 1 << (len(self.sparse) - 1)
            self.sparse.append(np.minimum(last[:-step], last[step:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo..hi], both included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.onward[lo], self.upto[hi])
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            first, count = a[wide] + 1, b[wide] - a[wide] - 1
            level = np.frexp(count)[1] - 1
            for k in np.unique(level):
                w = np.flatnonzero(level == k)
                f, row = first[w], self.sparse[k]
                out[wide[w]] = np.minimum(out[wide[w]], np.minimum(row[f], row[f + count[w] - (1 << k)]))
        same = np.flatnonzero(a == b)
        for at in range(0, len(same), 1 << 16):
            s = same[at : at + (1 << 16)]
            places = lo[s, None] + np.arange(BLOCK)
            inside = places <= hi[s, None]
            out[s] = np.where(inside, self.values[np.minimum(places, len(self.values) - 1)], np.iinfo(self.values.dtype).max).min(1)
        return out


class Extensions:
    """Longest common extensions to the right of two places, over texts that end with marks found nowhere else."""

    def __init__(self, tokens: np.ndarray, longest: int):
        n = len(tokens)
        rank = np.unique(tokens, return_inverse=True)[1].astype(np.int32)
        levels, length = [rank], 1
        while length <= longest and int(rank.max(initial=0)) + 1 < n:
            ahead = np.zeros(n, np.int64)
            ahead[: n - length] = rank[length:].astype(np.int64) + 1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1].astype(np.int32)
            levels.append(rank)
            length *= 2
        # The marks make all suffixes different, so the last ranks are places in the suffix array.
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        x, y = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 2, -1, -1):
            some = np.flatnonzero(levels[k][x] == levels[k][y])
            common[some] += 1 << k
            x[some] += 1 << k
            y[some] += 1 << k
        self.minima = Minima(common)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        return self.minima.of(np.minimum(a, b), np.maximum(a, b) - 1).astype(np.int64)


def _grid(ids: np.ndarray, at: np.ndarray, size: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, ...]:
    """text, period and place (in ids) of every grid point from which exponent grid points in a row agree."""
    most = np.where(size >= least, size // exponent, 0)
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (size[text] - 1) // period
    ends = np.cumsum(pairs)
    found, lo = [], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GRID, "right")))
        n = pairs[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        p = period[which]
        x = at[text[which]] + j * p
        agree = ids[x] == ids[x + p]
        run = agree
        for k in range(1, exponent - 1):
            run = run & np.concatenate([agree[k:], np.zeros(min(k, len(agree)), bool)]) & (j + k < pairs[which])
        hit = np.flatnonzero(run)
        found.append((text[which[hit]], p[hit], x[hit]))
        lo = hi
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def find_runs(ids: np.ndarray, size: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of all runs. ids: the texts' words as numbers, one text after another."""
    at = np.cumsum(size) - size
    text, period, x = _grid(ids, at, size, least, exponent)
    if not len(text):
        return np.zeros((0, 4), np.int64)
    # Texts without a grid point in agreement have no runs; the others get an end mark each.
    there = np.unique(text)
    n = size[there]
    new_at = np.cumsum(n + 1) - (n + 1)
    tokens = np.empty(int((n + 1).sum()), np.int64)
    mark = np.zeros(len(tokens), bool)
    mark[new_at + n] = True
    tokens[~mark] = np.concatenate([ids[at[t] : at[t] + size[t]] for t in there])
    tokens[mark] = int(ids.max()) + 1 + np.arange(len(there))
    # The same word in two texts isn't the same token: no suffix is compared beyond its text.
    owner = np.repeat(np.arange(len(there)), n + 1)
    tokens = owner * (int(tokens.max()) + 1) + tokens
    of = np.searchsorted(there, text)
    begin, left = new_at[of], x - at[text]
    longest = int(n.max())
    ahead = Extensions(tokens, longest).of(begin + left, begin + left + period)
    turned = np.arange(len(tokens))
    turned = tokens[(2 * new_at + n - 1)[owner] - turned] if len(turned) else turned
    turned[mark] = tokens[mark]
    back = np.zeros(len(x), np.int64)
    some = np.flatnonzero(left > 0)
    mirror = begin[some] + n[of[some]] - 1
    back[some] = Extensions(turned, longest).of(mirror - (left[some] - 1), mirror - (left[some] + period[some] - 1))
    start, length = left - back, period + ahead + back
    good = length >= np.maximum(least, exponent * period)
    rows = np.stack([text, start, length, period], axis=1)[good]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(words: list[bytes], size: list[int], runs: np.ndarray) -> list[bytes]:
    """The texts' words, joined by one space, without those that a run holds after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    begin = (np.cumsum(size) - size)[runs[:, 0]] + runs[:, 1]
    np.add.at(depth, begin + runs[:, 3], 1)
    np.add.at(depth, begin + runs[:, 2], -1)
    drop = np.cumsum(depth[:-1]) > 0
    hit, out, at = set(runs[:, 0].tolist()), [], 0
    for t, n in enumerate(size):
        some = words[at : at + n]
        out.append(b" ".join([w for w, d in zip(some, drop[at : at + n].tolist()) if not d] if t in hit else some))
        at += n
    return out


def _texts_in_parts(texts_: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Where some texts begin, and their words."""
    some, words, first = [], 0, 0
    for i in range(len(texts_)):
        some.append((texts_[i].as_py() or b"").split())
        words += len(some[-1])
        if words >= FLUSH:
            yield first, some
            some, words, first = [], 0, i + 1
    if some:
        yield first, some


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The other columns of docs as the struct `row`, with n_words, runs (by start, then period) and collapsed."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    part = docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = arrow_schema(part, ["row"], f"n_words long, runs {RUNS}, collapsed string")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, split in _texts_in_parts(batch.column(1).cast(pa.binary())):
                size = [len(w) for w in split]
                words = [w for ws in split for w in ws]
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                runs = find_runs(ids, np.array(size, np.int64), least, exponent)
                offsets = np.searchsorted(runs[:, 0], np.arange(len(size) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(kind))
                rest = _collapsed(words, size, runs)
                columns = [batch.column(0).slice(first, len(split)), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "runs", "collapsed"])

    return part.mapInArrow(work, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of the ids one whose words repeat from some place on."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def repeated(x: Column) -> Column:
        n, a, p = x["n"], x["a"], x["p"]
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x["words"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # Arguments of a lambda are computed once; an expression within one is computed for each element.
    once = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n")))
    once = F.transform(once, lambda x: F.struct(x["words"].alias("words"), x["n"].alias("n"), F.when(x["n"] > 0, g % x["n"]).alias("a")))
    once = F.transform(once, lambda x: F.struct(x["words"].alias("words"), x["n"].alias("n"), x["a"].alias("a"), (F.floor((x["n"] - x["a"]) / (3 + g % 8)) + 1).alias("p")))
    changed = F.transform(once, lambda x: F.when(x["n"] > 0, repeated(x)).otherwise(text))[0]
    return F.when(h % 10 == 0, changed).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Equal words at a distance of up to a quarter of the text, as islands of consecutive places.
OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {crc32_sql("doc_id::VARCHAR")} AS h,
    list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '') AS words FROM documents),
s AS (SELECT r, doc_id, coalesce(h % 10 = 0, false) AND len(words) > 0 AS planted, words, len(words) AS n, h // 10 AS g FROM d),
t AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM s),
i AS (SELECT r, doc_id, planted, words, n, a, p, unnest(range(n)) AS k FROM t),
w AS (SELECT r, k, n, words[1 + CASE WHEN planted AND k >= a THEN a + (k - a) % p ELSE k END] AS word FROM i),
e AS (SELECT x.r, x.k, y.k - x.k AS p FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.k > x.k AND 4 * (y.k - x.k) <= x.n),
g AS (SELECT r, p, k, k - row_number() OVER (PARTITION BY r, p ORDER BY k) AS island FROM e),
m AS (SELECT r, p, min(k) AS start, count(*) + p AS length FROM g GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT r, start, length, min(p) AS period FROM m GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS k FROM runs),
kept AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.k) AS rest FROM w ANTI JOIN gone USING (r, k) GROUP BY w.r),
sums AS (SELECT r, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
    first(period ORDER BY length DESC, start, period) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
