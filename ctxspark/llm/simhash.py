"""SimHash fingerprints and near-duplicates by meet-in-the-middle ball hashing.

Two values within distance r share a variant within r/2 of both. So every distinct value emits all its variants within r/2,
the variants are shuffled, and values that meet on one are verified. A variant is met by at most as many values as it has
variants itself, so no group can grow with the data, and with r = 2 any two of a group are linked. Exact copies are one
value and emit once.

Edge cases: a null or empty text has no words and fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle; texts of any length are read whole; repeated rows and ties share a component; a null doc_id isn't a
component's least (its component_id is null if it has no other); without rows there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, hash128, packed, text_or_empty, texts, written
from .components import connected_components

SEED = 42
#: Odd multipliers that turn one shingle hash into several.
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]

#: Bits of a set's parity.
PARITY = 512


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of a UTF-8 text (A-Z lower-cased, words between ASCII white space), repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], "<u8")
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return np.array([digest(joined[i:j], SEED) for i, j in zip((end - size)[: 1 - k].tolist(), end[k - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64-bit value whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def ends(hashes: np.ndarray) -> list[int]:
    """Two 64-bit values, each of two 32-bit fingerprints: of the text's first and of its last shingles, L of them each, L being
    the largest power of two and the largest odd power of its root that is at most half of them. Texts that differ by
    one block of up to a quarter have the same beginning or the same ending for one of the two."""
    n, out = len(hashes), []
    if not n:
        return [0, 0]
    half = math.log2(max(n / 2, 1))
    sizes = [int(2 ** math.floor(half)), max(int(2 ** (math.floor(half - 0.5) + 0.5)), 1)]
    for part in (lambda m: hashes[:m], lambda m: hashes[n - m :]):
        low, high = (majority(part(m)) for m in sizes)
        out.append((low & 0xFFFFFFFF) | ((high & 0xFFFFFFFF) << 32))
    return out


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", k: int = 3, count: int = 1, both_ends: bool = False) -> DataFrame:
    """The key columns and fp: array of `count` 64-bit fingerprints of the whole text, and with both_ends the two of `ends`."""
    count += 2 * both_ends

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(len(keys)).cast(pa.binary()).to_pylist():
                h = shingle_hashes(t or b"", k)
                rows.append([majority(h)] + [majority((x := h * np.uint64(m)) ^ (x >> np.uint64(29))) for m in MIX[: count - 1 - 2 * both_ends]] + (ends(h) if both_ends else []))
            flat = np.array(rows, np.uint64).reshape(-1).view(np.int64)
            column = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, count, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], column], names=[*keys, "fp"])

    part = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    return part.mapInArrow(work, arrow_schema(part, keys, "fp array<bigint>"))


def _variants(values: DataFrame, value: str, bits: int, radius: int) -> DataFrame:
    """variant and b: every value with all its variants within half the radius, in the low `bits` bits."""
    half = (radius + 1) // 2
    flips = [sum(1 << i for i in c) for n in range(half + 1) for c in combinations(range(bits), n)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    return values.select(F.col(value).alias("b"), F.explode(F.transform(F.lit(signed), lambda m: F.col(value).bitwiseXOR(m))).alias("variant"))


def ball_meetings(values: DataFrame, value: str, bits: int = 64, radius: int = 2) -> DataFrame:
    """variant, a, b: the distinct values b that share a variant with another one, a being the least of them. With radius 2
    any two values of a variant are within the radius, and any two within the radius share a variant."""
    meeting = Window.partitionBy("variant")
    met = _variants(values, value, bits, radius).withColumns({"a": F.min("b").over(meeting), "most": F.max("b").over(meeting)})
    return met.where("a != most").select("variant", "a", "b")


def ball_pairs(values: DataFrame, value: str, bits: int = 64, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct values that differ in at most `radius` of the low `bits` bits: for each group that meets on a
    variant, its least value with every other one. With radius 2 these connect all that is within the radius."""
    met = ball_meetings(values, value, bits, radius).where("a != b").select("a", "b").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    prints = written(fingerprints(docs, ["doc_id"]).select("doc_id", F.col("fp")[0].alias("fp")), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = connected_components(ball_pairs(distinct.select("fp"), "fp")).withColumnRenamed("node", "fp")
    rooted = distinct.join(groups, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def identified(rows: DataFrame) -> DataFrame:
    """node for each distinct (_h1, _h2): a number of its own. That is _h1 but for texts that have it in common with another
    one; these, of which 10**10 texts have about three, get another hash, and another one until no two numbers are equal."""
    known = rows.select("_h1", "_h2").distinct()
    clash = written(known.groupBy("_h1").agg(F.min("_h2").alias("lo"), F.max("_h2").alias("hi")).where("lo != hi").select("_h1"), "clashes")
    if clash.isEmpty():
        return known.withColumn("node", F.col("_h1"))
    alone = known.join(clash, "_h1", "left_anti").withColumn("node", F.col("_h1"))
    for seed in range(1, 100):
        again = alone.unionByName(known.join(clash, "_h1", "left_semi").withColumn("node", F.xxhash64(F.lit(seed), "_h1", "_h2")))
        if again.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return again
    raise ValueError("texts without a number of their own")


def near_groups(texts: DataFrame, k: int = 5, similarity: float = 0.8, features: int = 2, tables: int = 12) -> DataFrame:
    """node, root: texts (node, _whole; equal texts have equal nodes) that are near-duplicates of another, and their component's root.

    Candidates: `tables` 32-bit fingerprints over `features`-word shingles, four of them of the text's `ends` and the others
    halves of SimHashes of the whole text, with ball hashing (radius 2) in each. In a group of equal halves every text meets
    its centre, the least (in every second table the greatest) one, and each half's centre meets that of the least half within
    the radius that shares a variant's group with it: a text has two candidates a table, however large its group. Every
    candidate pair is verified by the exact Jaccard similarity of its sets of k-word shingles. Groups
    of a half or of a variant that this leaves in several components hold pairs that weren't compared: their texts are
    joined by rare_pairs, so that every pair within the radius is connected, verified or provably less similar.
    """
    wide = fingerprints(texts.select("node", "_whole"), ["node"], "_whole", features, tables // 2 - 2, True)
    halves = F.flatten(F.transform("fp", lambda x, i: F.array(F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(2 * i.cast("long"), 32)), x.bitwiseAND(0xFFFFFFFF).bitwiseOR(F.shiftleft(2 * i.cast("long") + 1, 32)))))
    rows = written(wide.select("node", F.explode(halves).alias("half")).groupBy("node", "half").count().select("node", "half"), "halves")
    even = F.shiftrightunsigned("half", 32).bitwiseAND(F.lit(1)) == 0
    centre = written(rows.groupBy("half").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).select("half", F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("centre"), "n"), "centres")
    same = rows.join(centre.where("n > 1"), "half").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    meetings = written(ball_meetings(centre.select("half"), "half", 32), "meetings")
    near = meetings.groupBy(F.col("b").alias("y")).agg(F.min("a").alias("x")).where("x != y")
    ends = lambda end, name: centre.select(F.col("half").alias(end), F.col("centre").alias(name))
    met = near.join(ends("x", "a"), "x").join(ends("y", "b"), "y").select("a", "b")
    pairs = written(same.unionByName(met).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # Copies become one before they are dealt out (an inner join isn't pushed below the aggregation).
    shown = texts.groupBy("node").agg(F.first("_whole").alias("_whole")).join(wanted, "node")
    sets = written(shingle_sets(shown, "node", "_whole", k), "shingle-sets")
    groups = written(connected_components(_alike(pairs, sets, similarity)), "near-groups")

    # The least and greatest component of a half's texts, then of a variant's. Two texts alone may have been compared themselves.
    rooted = rows.join(groups, "node", "left").select("node", "half", F.coalesce("root", "node").alias("root"))
    state = written(rooted.groupBy("half").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")), "half-states")
    known = meetings.join(state.withColumnRenamed("half", "b"), "b").join(near.select(F.col("y").alias("b"), "x"), "b", "left")
    spread = known.groupBy("variant").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), F.bool_or(F.col("a") == F.col("x")).alias("compared"))
    variant = spread.where("least != most AND NOT (n = 2 AND coalesce(compared, false))")
    open_ = state.where("n > 2 AND least != most").select("half").unionByName(meetings.join(variant, "variant", "left_semi").select(F.col("b").alias("half"))).distinct()
    left = written(rooted.join(open_, "half", "left_semi").select("node", "root").distinct(), "open-texts")
    more = written(_alike(rare_pairs(left.join(sets, "node"), similarity), sets, similarity), "rare-links")
    if more.isEmpty():
        return groups
    return connected_components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity."""
    a, b = (sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}")) for n in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = both >= similarity * (F.size("set_a") + F.size("set_b") - both)
    return pairs.join(a, "a").join(b, "b").where(alike).select("a", "b")


def rare_pairs(sets: DataFrame, similarity: float, salt: int = 2000) -> DataFrame:
    """Pairs (a, b) that hold all pairs of that Jaccard similarity between different roots. sets: node, root, set, parity.

    Prefix filtering: shingles are ordered by rareness. The first one that two similar sets share lies among the first
    n - similarity n + 1 of the larger, the first n - 2 similarity / (1 + similarity) n + 1 of the smaller one, and leaves both
    enough for the overlap. Shingles of one text only take places but no rows; a frequent one is dealt out to several tasks.
    A pair whose parities alone differ in more bits than its sets may in members isn't passed on.
    """
    each = sets.select("node", F.explode("set").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    first = lambda part: F.col("n") - F.ceil(F.lit(part) * F.col("n") - 1e-9) + 1
    ranked = each.join(shared, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    sized = ranked.join(sets.select("node", "root", "parity", F.size("set").alias("n")), "node").withColumn("alone", F.col("n") - F.size("ranked"))
    prefix = F.slice("ranked", F.lit(1), F.greatest(first(similarity) - F.col("alone"), F.lit(0)).cast("int"))
    keys = sized.select("node", "root", "parity", "n", "alone", F.posexplode(prefix).alias("at", "key")).select("node", "root", "parity", "n", (F.col("at") + F.col("alone")).alias("at"), "key.shingle", (F.col("key.df") / salt).cast("int").alias("salts"))
    keys = written(keys, "rare-shingles")
    fields = ("node", "root", "parity", "n", "at")
    a = keys.select("shingle", *[F.col(c).alias(f"{c}_a") for c in fields], F.pmod(F.xxhash64("node"), F.col("salts") + 1).cast("int").alias("salt"))
    b = keys.where(F.col("at") < first(2 * similarity / (1 + similarity))).select("shingle", *[F.col(c).alias(f"{c}_b") for c in fields], F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    ordered = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") > F.col("node_b")))
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY // 64)), F.lit(0))
    near = differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-9
    met = a.join(b, ["shingle", "salt"]).where(ordered & near & (F.col("root_a") != F.col("root_b")) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= needed))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def shingle_sets(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, set: the distinct 32-bit hashes of a text's k-word shingles, and parity: for each of 512 values of their low bits
    whether an odd number of them has it. Two parities differ in at most as many bits as their sets in members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((h ^ (h >> np.uint64(32))).astype(np.uint32)).view(np.int32) for h in (shingle_hashes(t or b"", k) for t in batch.column(1).cast(pa.binary()).to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            odd = [np.packbits(np.bincount(s & (PARITY - 1), minlength=PARITY) & 1).view(np.int64) for s in sets]
            parity = pa.ListArray.from_arrays(np.arange(0, len(sets) + 1, dtype=np.int32) * (PARITY // 64), pa.array(np.concatenate([*odd, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.int32)]))), parity], names=[key, "set", "parity"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` bigint, set array<int>, parity array<bigint>")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each group of exact or near copies: the one with the least doc_id (null last), then text hash.
    Null and empty texts are copies of each other; texts are known by 128-bit hashes; the columns are those of docs, whatever
    their names; no rows give no rows."""
    whole = text_or_empty(F.col(f"`{text}`"))
    h1, h2 = hash128(whole)
    rows = packed(docs, doc=F.col(f"`{doc_id}`"), _h1=h1, _h2=h2)
    copies = rows.groupBy("_h1", "_h2").agg(F.min("doc").alias("id")).select("_h1", "_h2", F.struct(F.col("id").isNull().alias("none"), "id").alias("first"))
    copies = written(copies, "copies")
    known = written(identified(copies), "text-nodes")
    texts = docs.select(h1.alias("_h1"), h2.alias("_h2"), whole.alias("_whole"))
    if known.where("node != _h1").isEmpty():
        texts = texts.select(F.col("_h1").alias("node"), "_whole")
    else:
        moved = known.where("node != _h1")
        texts = texts.join(F.broadcast(moved), ["_h1", "_h2"], "left").select(F.coalesce("node", "_h1").alias("node"), "_whole")
    groups = near_groups(texts, **options)
    rooted = copies.join(known, ["_h1", "_h2"]).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct("first", "_h1", "_h2")).alias("best"))
    stay = best.select(F.col("best._h1").alias("_h1"), F.col("best._h2").alias("_h2"), F.col("best.first.id").alias("_id"))
    on = (rows["_h1"] == stay["_h1"]) & (rows["_h2"] == stay["_h2"]) & rows["doc"].eqNullSafe(stay["_id"])
    # Equal texts under one id, or none, may be a third of all rows: each task leaves one of them before they are shuffled.
    return rows.join(stay, on, "left_semi").dropDuplicates(["_h1", "_h2", "doc"]).select("row.*")
