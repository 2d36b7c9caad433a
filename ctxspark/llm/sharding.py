"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

The things to pack are items of bounded number, whatever the input's size: groups of equal texts are dealt by hash into
bundles, some of them much smaller than the others, and a group larger than a bundle should be is an item of its own. It stays
whole as long as a shard can hold it; a group beyond that can't, and is cut into parts that are items. The items' vectors (at most some ten
thousand) come to the driver, which places them, largest first, each where the weighted dot product with the residual capacity is
highest; the small bundles come last and level what is left. Rows then learn their shard from their item. A large item's rows
are dealt by hash into parts, and a row's slot is its part's first slot and its place in the part, so neither a hot group nor a
whole shard is ever sorted in one task. No text is shuffled.

Edge cases: a null text has size 1 like an empty one; copies beyond a shard's capacity are spread, by their place in the table, so
also if their ids are null or equal; other copies stay together; repeated rows get slots of their own; of items that fit alike the
first shard takes one; a text larger than a shard's capacity has a shard nearly for itself; no column but doc_id and text is read,
so that no other name matters; an empty table gives no rows; the law is `bytes`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash128, text_or_empty, texts, written

#: Bundles, how many of them are split, and into how many small ones.
BUNDLES, SPLIT, SMALL = 4096, 256, 16
#: How much bytes (the law), tokens and rows count in the placement, where a large group makes them differ.
WEIGHTS = np.array([32.0, 1.0, 8.0])


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. Capacities are the total over the shards; vectors and residuals are measured in them."""
    scaled = vectors / np.maximum(vectors.sum(0), 1) * shards
    left, out = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -scaled.max(1))):
        out[i] = s = int(np.argmax(left @ (WEIGHTS * scaled[i])))
        left[s] -= scaled[i]
    return out


def shard(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    whole = text_or_empty(F.col(text))
    h1, h2 = hash128(whole)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.regexp_count(whole, F.lit(r"\S+")).cast("long").alias("tokens"), F.crc32(whole).alias("text_crc32"), h1.alias("h1"), h2.alias("h2"))
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    share = F.greatest(*[F.col(c) / F.lit(float(max(total[c] or 0, 1))) for c in ("size", "tokens", "n")]) * bundles
    # At most 3 * bundles groups can be larger than a bundle, so what is collected and broadcast is bounded.
    large = rows.groupBy("h1", "h2").agg(*sums).where(share > 1).select("h1", "h2", F.least(F.ceil(share), F.col("n")).cast("long").alias("parts"), (share * shards <= bundles).alias("fits")).orderBy("h1", "h2").collect()
    first, known, whole_item = bundles * SMALL, [], {}
    for r in large:
        known.append((r.h1, r.h2, r.parts, first))
        if r.fits:
            whole_item.update((first + p, first) for p in range(r.parts))
        first += r.parts
    known = F.broadcast(spark.createDataFrame(known, "h1 long, h2 long, parts long, first long"))
    bundle = F.pmod("h1", F.lit(bundles))
    fine = F.pmod(F.shiftrightunsigned("h2", 20), F.lit(SMALL))
    part = F.when(F.col("first").isNotNull(), F.col("first") + F.pmod(F.xxhash64("at"), F.col("parts"))).otherwise(bundle * SMALL + F.when(bundle < SPLIT, fine).otherwise(F.lit(0)))
    dealt = rows.join(known, ["h1", "h2"], "left").select("doc_id", "size", "tokens", "text_crc32", part.cast("long").alias("part"))

    parts = dealt.groupBy("part").agg(*sums).orderBy("part").collect()
    items, of = np.unique(np.array([whole_item.get(r.part, r.part) for r in parts], np.int64), return_inverse=True)
    vectors = np.zeros((len(items), 3))
    np.add.at(vectors, of, np.array([[r["size"], r.tokens, r.n] for r in parts], float).reshape(-1, 3))
    places = place(vectors, shards)[of]
    start, at = [0] * shards, []
    for r, s in zip(parts, places.tolist()):
        at.append((r.part, s, start[s]))
        start[s] += r.n
    at = F.broadcast(spark.createDataFrame(at, "part long, shard int, start long"))
    within = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size")
    return dealt.withColumn("rank", F.row_number().over(within)).join(at, "part").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
