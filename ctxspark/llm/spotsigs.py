"""Document fingerprints by SpotSigs.

A text's words (lower-cased runs of letters and digits) are anchors, if they are in a fixed list of very common words of
several languages, or content words. Where a content word follows an anchor, or begins the text, it and the next content
words (CHAIN of them, fewer at the end) form a signature, whatever anchors lie between. The fingerprint is the set of the
signatures' 32-bit hashes, sorted, in hexadecimal. Likeness is the Jaccard similarity of two sets.

``similar_pairs`` finds all pairs from a threshold on: sets are partitioned by length, so that only neighbouring partitions
can hold partners; within them sets meet on their rarest signatures (as many as a partner must share one of), pairs whose
lengths differ too much are pruned, and the rest is verified exactly. Equal fingerprints are one set.

Edge cases: a text of anchors only has one signature, of all its words; one without words, of the text itself; a null or empty
text has no signatures, and is like another such one (1.0) and nothing else (0.0). Repeated rows are rows of their own, next to
each other; null ids come first; a text of any length is read whole; other columns aren't read; a row alone follows itself;
no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

CHAIN = 2
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or she that the their there they this to was we were which will with you "
    "als am auch auf aus bei das dem den der des die ein eine einen einer es für hat ich im ist mit nach nicht noch sich sie sind so um und von war werden wie zu zum zur über "
    "au aux avec ce cette dans de du elle en est et il ils je la le les leur lui mais ne nous ont ou par pas plus pour que qui sa se ses son sont sur un une vous à été être "
    "al como con del el ella este esta ha las lo los más me muy o para pero por porque su sus también una uno y ya él"
).split()


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, the sorted array of a text's signature hashes. The text must not be null."""
    words, at = f"_{out}_words", f"_{out}_at"
    content = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).isin(*ANCHORS))
    gap = lambda x, j: x - F.when(j > 0, F.get(at, j - 1)).otherwise(F.lit(-1)) > 1
    chain = lambda j: F.hash(*[F.get(words, F.get(at, j + k)) for k in range(CHAIN)])
    found = F.filter(F.transform(at, lambda x, j: F.when((j == 0) | gap(x, j), chain(j))), lambda h: h.isNotNull())
    return (
        df.withColumn(words, F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
        .withColumn(at, F.when(F.size(words) > 0, content).otherwise(F.array().cast("array<int>")))
        .withColumn(out, F.when(F.size(at) > 0, F.array_sort(F.array_distinct(found))).when(F.size(words) > 0, F.array(F.hash(F.array_join(words, " ")))).when(F.col(text) != "", F.array(F.hash(text))).otherwise(F.array().cast("array<int>")))
        .drop(words, at)
    )


def fingerprint(sigs: str) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _ranges(rows: DataFrame, key: str, per: int) -> DataFrame:
    """rows with longer paths `bucket`: those of over 4 * per rows are split by `key` until they are smaller or hold one value of it.

    A path is an array of places that sorts as its rows do. A range is split at equal distances between its own least and
    greatest value, so outlying values cost a level more, not a large range; each level at least halves a range's width.
    What is broadcast is a row for each range that is split: at most a fourth of (number of rows / per).
    """
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    while True:
        cells = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        hot = written(cells.where((F.col("n") > 4 * per) & (F.col("lo") < F.col("hi"))), "ranges")
        if hot.isEmpty():
            return rows
        parts = F.greatest(F.lit(16), F.ceil(F.col("n") / per)).cast("double")
        place = F.floor((exact(key) - exact("lo")).cast("double") / (exact("hi") - exact("lo") + 1).cast("double") * parts)
        split = rows.join(F.broadcast(hot), "bucket", "left")
        rows = split.withColumn("bucket", F.when(F.col("n").isNull(), F.col("bucket")).otherwise(F.concat("bucket", F.array(place)))).drop("n", "lo", "hi")


def next_text(docs: DataFrame, rows_per_bucket: int = 20_000, least: int = 1000, most: int = 100_000) -> DataFrame:
    """doc_id, text, next_text: the text of the row that follows by doc_id (nulls first; ties by text hash; the first follows the last).

    doc_id is cut into ranges of at most about `rows_per_bucket` rows (fewer in small tables, so that there are about `least` ranges;
    more where there would be over `most`); an id, or null, with more rows is cut by text hash. Each range's first row is also
    put at the end of the range before it, so that every row finds its successor in its own range. The ranges' first ids are broadcast.
    """
    docs = docs.select("doc_id", "text")
    n = docs.count()
    per = max(1, min(rows_per_bucket, n // least), n // most)
    rows = docs.withColumns({"bucket": F.array(F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("long")), "tie": F.xxhash64("text")})
    rows = _ranges(_ranges(rows, "doc_id", per), "tie", per)
    firsts = written(rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id")), "first-ids")
    order = Window.orderBy("bucket")
    before = firsts.select("first_id", F.col("bucket").alias("of"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("into"))
    heads = rows.join(F.broadcast(before), (rows["bucket"] == F.col("of")) & rows["doc_id"].eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("into").agg(F.min_by(F.struct("doc_id", "text"), "tie").alias("head")).select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.col("into").alias("bucket"), F.lit(0).cast("long").alias("tie"), F.lit(True).alias("head"))
    all_rows = rows.withColumn("head", F.lit(False)).unionByName(heads)
    along = Window.partitionBy("bucket").orderBy("head", F.col("doc_id").asc_nulls_first(), "tie")
    return all_rows.withColumn("next_text", F.lead("text").over(along))


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    along = Window.partitionBy("bucket").orderBy("head", F.col("doc_id").asc_nulls_first(), "tie")
    rows = signatures(next_text(docs), "text", "sigs").withColumn("next_sigs", F.lead("sigs").over(along)).where("NOT head")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) AS int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 4) AS int))")))
    rows = signatures(rows.select("doc_id", "n_chars", "edited", "sigs", "next_sigs"), "edited", "edited_sigs")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"), jaccard("sigs", "edited_sigs").alias("near_edited"), jaccard("sigs", "next_sigs").alias("near_next"))


def similar_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, fingerprint, set_id) of all rows, and pairs (a, b, likeness) of set ids with likeness >= similarity."""
    base = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("_text"))
    rows = written(signatures(base, "_text", "sigs").select("doc_id", "sigs", F.xxhash64("sigs").alias("set_id")), "spotsigs")
    sets = rows.where(F.size("sigs") > 0).dropDuplicates(["set_id"]).select("set_id", "sigs", F.size("sigs").alias("n"))
    each = sets.select("set_id", "n", F.explode("sigs").alias("sig"))
    rare = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(rare, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("df", "sig")))
    keys = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1).select("set_id", "n", "sig", F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity)).cast("int").alias("part"))
    a = keys.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("part", F.col("part") + 1, F.col("part") - 1)).alias("part"))
    b = keys.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    pruned = a.join(b, ["part", "sig"]).where((F.col("a") < F.col("b")) & (F.col("na") >= similarity * F.col("nb")) & (F.col("nb") >= similarity * F.col("na")))
    found = pruned.select("a", "b").distinct()
    of = lambda name: sets.select(F.col("set_id").alias(name), F.col("sigs").alias(f"sigs_{name}"))
    pairs = found.join(of("a"), "a").join(of("b"), "b").select("a", "b", jaccard("sigs_a", "sigs_b").alias("likeness")).where(F.col("likeness") >= similarity)
    return rows.select("doc_id", fingerprint("sigs").alias("fingerprint"), "set_id"), pairs
