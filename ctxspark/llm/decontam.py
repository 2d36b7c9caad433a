"""Benchmark decontamination by spaced-seed hashing.

A mask picks some of the tokens in a window and ignores the others, so a substituted token there doesn't matter. The hashes
of every window of the documents under every mask are joined with those of the benchmark. A hit says on which diagonal an
item may lie in a document; along it the tokens around the hit are compared one by one. A document holds an item if at least
`similarity` of the tokens agree in some window of `window` tokens of the item, or in all of a shorter item. An item of fewer
than `least` tokens must stand there whole and unchanged: its mask has no gaps and its own length.

With the default rule the masks leave no accepted pattern of substitutions unseen; the tests enumerate them all. The mask EXTRA is needed,
and used, only if the benchmark has items of 10 or 11 tokens.

Only hashes, ids and places are joined. The benchmark's windows are broadcast while they are fewer than BROADCAST_SEEDS (counted first);
more of them are shuffled and joined. A pair's diagonal is kept once however many hits it has, and only then are the tokens of
the documents and items with hits fetched and compared.

Edge cases: null or empty texts match nothing; a null id, of a document or an item, is an id of its own; items without tokens
are skipped; repeated rows and items are reported once per pair of ids; a hit at a document's start or end compares what is
there and counts the rest as different; texts and items of any length are read whole; of several best places the first is
reported; names of other columns don't matter; no rows, or no items, give no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash128, packed, table, text_or_empty, texts, written

#: Positions that each mask looks at; those of the last one only where items of EXTRA_SIZES tokens exist.
MASKS, EXTRA, EXTRA_SIZES = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 6)), (0, 1, 2, 4), (10, 11)
#: Windows of the benchmark, hits, or documents with hits up to which they are broadcast (some 30 bytes each).
BROADCAST_SEEDS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seeds(th: Column, masks: list[tuple[int, ...]]) -> Column:
    """Hash and place of every window under every mask; th: hashes of the tokens."""
    n, kind = F.size(th), "array<struct<seed:bigint,at:int>>"
    name = lambda mask: F.lit(sum(1 << o for o in mask))
    each = lambda mask: F.when(n > mask[-1], F.transform(F.sequence(F.lit(0), n - mask[-1] - 1), lambda i: F.struct(F.xxhash64(name(mask), *[F.get(th, i + o) if o else F.get(th, i) for o in mask]).alias("seed"), i.alias("at"))))
    return F.concat(*[F.coalesce(each(mask), F.array().cast(kind)) for mask in masks])


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_SEEDS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS else df


def _same_row(a: str, b: str) -> Column:
    """Whether the keys (doc_id, t1, t2) behind two prefixes are equal."""
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}t1") == F.col(f"{b}t1")) & (F.col(f"{a}t2") == F.col(f"{b}t2"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = 16, least: int = 8, similarity: float = 0.8) -> DataFrame:
    """doc_id, _t1, _t2 (of the text), item_id, doc_start, item_tokens, compared, matched, similarity of every pair found."""
    hashes = lambda t: F.transform(tokens(t), lambda w: F.xxhash64(w))
    items = benchmark.select(F.struct(F.col(f"`{item_id}`").alias("item_id")).alias("id"), hashes(text_or_empty(F.col(f"`{item_text}`"))).alias("ih")).where(F.size("ih") > 0)
    items = written(items.groupBy("ih").agg(F.collect_set("id").alias("ids")).select(F.xxhash64("ih").alias("item"), F.size("ih").alias("n"), "ih", "ids"), "items")
    sizes = {r.n for r in items.where((F.col("n") < least) | F.col("n").isin(*EXTRA_SIZES)).select("n").distinct().collect()}
    masks = [*MASKS, *([EXTRA] if sizes & set(EXTRA_SIZES) else [])]
    whole_masks = {n: tuple(range(n)) for n in sorted(sizes) if n < least}
    seeds = [items.where(F.col("n") >= least).select("item", F.explode(_seeds(F.col("ih"), masks)).alias("s"))]
    seeds += [items.where(F.col("n") == n).select("item", F.explode(_seeds(F.col("ih"), [mask])).alias("s")) for n, mask in whole_masks.items()]
    seeds = reduce(DataFrame.unionByName, seeds).select("item", "s.seed", F.col("s.at").alias("item_at"))

    whole = text_or_empty(F.col(f"`{text}`"))
    t1, t2 = hash128(whole)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), whole.alias("whole"))
    every = [*masks, *whole_masks.values()]
    windows = rows.select("doc_id", "t1", "t2", hashes(F.col("whole")).alias("th")).select("doc_id", "t1", "t2", F.explode(_seeds(F.col("th"), every)).alias("s")).select("doc_id", "t1", "t2", "s.seed", "s.at")
    hits = windows.join(_small(seeds), "seed").select("doc_id", "t1", "t2", "item", (F.col("at") - F.col("item_at")).alias("doc_start")).distinct()
    hits = written(hits.select(*[F.col(c).alias(f"hit_{c}") for c in ("doc_id", "t1", "t2")], "item", "doc_start"), "hits")

    # The tokens of the documents and items with hits, computed once for each.
    keys = hits.select(*[F.col(f"hit_{c}").alias(f"key_{c}") for c in ("doc_id", "t1", "t2")]).distinct()
    hit_rows = rows.join(_small(keys), _same_row("", "key_"), "left_semi").dropDuplicates(["doc_id", "t1", "t2"]).select("doc_id", "t1", "t2", hashes(F.col("whole")).alias("th"))
    hit_rows = hit_rows.join(_small(hits), _same_row("", "hit_"))
    found = hit_rows.join(_small(items), "item")
    # The diagonal's stretch of the document: as many tokens as the item has; null, and so different, where the document has none.
    place = F.col("doc_start")
    same = F.transform(F.col("ih"), lambda w, k: F.when((place + k >= 0) & (F.get("th", F.greatest(place + k, F.lit(0))) == w), 1).otherwise(0))
    wide = F.least(F.lit(window), F.size("ih"))
    most = lambda same: F.array_max(F.transform(F.sequence(F.lit(1), F.size(same) - wide + 1), lambda at: F.aggregate(F.slice(same, at, wide), F.lit(0), lambda x, y: x + y)))
    once = F.transform(F.array(same), most)[0]  # a lambda's argument is computed once, a column's expression wherever it is used
    found = found.select("doc_id", "t1", "t2", "ids", "doc_start", F.size("ih").alias("item_tokens"), wide.alias("compared"), once.alias("matched"))
    good = found.where(F.col("matched") >= F.when(F.col("item_tokens") < least, F.col("compared")).otherwise(similarity * F.col("compared")))
    good = good.select("doc_id", "t1", "t2", F.explode("ids").alias("id"), (F.col("matched") / F.col("compared")).alias("similarity"), (-F.col("doc_start")).alias("first"), "item_tokens", "compared", "matched")
    ranked = good.groupBy("doc_id", "t1", "t2", "id").agg(F.max(F.struct("similarity", "first", "item_tokens", "compared", "matched")).alias("m"))
    return ranked.select("doc_id", F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "id.item_id", (-F.col("m.first")).cast("int").alias("doc_start"), "m.item_tokens", "m.compared", "m.matched", "m.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no benchmark passage. Null and empty texts stay; repeated rows go or stay together; the columns
    are those of docs, whatever their names; without items all rows stay."""
    bad = leaks(docs, benchmark, text, doc_id, **options).select(F.col("doc_id").alias("bad_doc_id"), F.col("_t1").alias("bad_t1"), F.col("_t2").alias("bad_t2")).distinct()
    t1, t2 = hash128(text_or_empty(F.col(f"`{text}`")))
    rows = packed(docs, doc_id=F.col(f"`{doc_id}`"), t1=t1, t2=t2)
    return rows.join(_small(written(bad, "leaking")), _same_row("", "bad_"), "left_anti").select("row.*")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(texts(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("_t1", "_t2").groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "matched", "compared", "item_tokens", "doc_start")).alias("m")).select("doc_id", "item_id", "m.doc_start", "m.item_tokens", "m.compared", "m.matched", "m.similarity")
