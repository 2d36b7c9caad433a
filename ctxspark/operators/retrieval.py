"""Ranked search over chunks of text: BM25, boosts, reranking, snippets, answers and similarity.

A search knows its terms when it is planned, so it doesn't build postings: one pass counts the corpus and the terms' document
frequencies in a single row, a second scores each chunk where it lies, and only the top k leave their partitions. Many queries
at once are joined through their terms, which are few beside the corpus's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP, clean, idea_tokens, overlap, sentence, snippet, tokens
from ..functions.vectors import bm25_weight, cosine, idf

#: Rows of query terms up to which they are broadcast (a term is some 40 bytes).
BROADCAST_TERMS = 1_000_000


def query_terms(query: str) -> list[str]:
    """The tokens of a query, repeats kept (they count twice)."""
    return [t for t in re.split(r"[\W_]+", query.lower()) if len(t.encode()) >= 2 and t not in STOP]


def corpus_stats(chunks: DataFrame, body: str = "body") -> DataFrame:
    """n and avgdl over the chunks that have tokens."""
    dl = F.size(tokens(F.col(body)))
    return chunks.select(dl.alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_df(chunks: DataFrame, body: str = "body") -> DataFrame:
    """term, df, cf: in how many chunks a term is, and how often in all. Both are sums over one explosion, so what is shuffled
    has been added up before."""
    toks = chunks.select(tokens(F.col(body)).alias("t"))
    mark = lambda xs, n: F.transform(xs, lambda x: F.struct(x.alias("term"), F.lit(n).alias("first")))
    each = toks.select(F.explode(F.concat(mark(F.col("t"), 0), mark(F.array_distinct("t"), 1))).alias("x")).select("x.*")
    return each.groupBy("term").agg(F.sum(F.col("first").cast("long")).alias("df"), F.count_if(F.col("first") == 0).alias("cf"))


def _once(value: Column, of) -> Column:
    """of(value) with the value computed once, wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def search(chunks: DataFrame, query: str, id: str | list = "chunk_id", body: str = "body", boost: Column | None = None, k: int | None = 5) -> DataFrame:
    """chunks with score, the best k by score and then id (all hits if k is None). boost multiplies the score of a chunk."""
    asked = query_terms(query)
    terms = sorted(set(asked))
    toks = tokens(F.coalesce(F.col(body), F.lit("")))
    has = _once(toks, lambda t: F.struct(F.size(t).alias("dl"), *[F.array_contains(t, w).alias(f"h{i}") for i, w in enumerate(terms)]))
    counted = chunks.select(has.alias("s")).where("s.dl > 0")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("s.dl").alias("_avgdl"), *[F.count_if(f"s.h{i}").alias(f"_df{i}") for i in range(len(terms))])

    def part(t: Column, i: int, w: str) -> Column:
        tf = F.size(F.filter(t, lambda x: x == w)).cast("double")
        return F.lit(asked.count(w)) * idf(F.col("_n"), F.col(f"_df{i}")) * bm25_weight(tf, F.size(t), F.col("_avgdl"))

    score = _once(toks, lambda t: sum((part(t, i, w) for i, w in enumerate(terms)), F.lit(0.0)))
    if boost is not None:
        score = score * boost
    found = chunks.crossJoin(F.broadcast(stats)).withColumn("score", F.coalesce(score, F.lit(0.0))).select(*chunks.columns, "score")
    # Above the limit, the filter isn't pushed into the scan, where it would compute the score again.
    return found.orderBy(F.desc("score"), *([id] if isinstance(id, str) else id)).limit(k).where("score > 0") if k is not None else found.where("score > 0")


def corpus(documents: DataFrame, defects: DataFrame | None = None) -> DataFrame:
    """What is searched: documents and unresolved defects in one relation, kind, chunk_id, path, heading, body, boost and text.

    documents: chunk_id, path, heading, body. defects as `records.defect_chunks` gives them; those without a boost are left out.
    All count in n, in document frequencies and in the average length. `text` is what is searched: heading and body.
    """
    text = F.concat_ws(" ", "heading", "body").alias("text")
    columns = lambda kind, id, boost: [F.lit(kind).alias("kind"), id.cast("string").alias("chunk_id"), "path", "heading", "body", boost.alias("boost"), text]
    out = documents.select(*columns("document", F.col("chunk_id"), F.lit(1.0)))
    if defects is None:
        return out
    return out.unionByName(defects.where("boost > 0").select(*columns("defect", F.concat(F.lit("defect "), F.col("id")), F.col("boost"))))


def search_corpus(chunks: DataFrame, query: str, k: int | None = 5) -> DataFrame:
    """`search` over a `corpus`; of equal scores documents come first, then ids count."""
    return search(chunks, query, id=[F.desc("kind"), "chunk_id"], body="text", boost=F.col("boost"), k=k)


def search_many(chunks: DataFrame, queries: DataFrame, id: str = "chunk_id", body: str = "body", query_id: str = "query_id", query: str = "query", k: int = 5) -> DataFrame:
    """query_id, chunk id, score and rank: the best k chunks for every query. Only the queries' terms are dealt out, once, by
    chunk; each task scores its chunks and passes on its best k of each query."""
    q = queries.select(F.col(query_id).alias("_q"), F.explode(tokens(F.col(query))).alias("term")).groupBy("_q", "term").agg(F.count("*").alias("qf"))
    terms = q.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda df: df)
    base = chunks.select(F.col(id).alias("_id"), tokens(F.col(body)).alias("_t")).select("_id", F.size("_t").alias("dl"), "_t")
    stats = base.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = base.select("_id", "dl", F.explode("_t").alias("term")).join(small(terms), "term", "left_semi").repartition("_id").groupBy("_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    part = tf.join(small(df) if few else df, "term").join(small(q) if few else q, "term").crossJoin(F.broadcast(stats))
    scored = part.groupBy("_q", "_id").agg(F.sum(F.col("qf") * idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf").cast("double"), F.col("dl"), F.col("avgdl"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc(F.round("score", 9)), "_id"))  # rounded: sums of floats in any order tie alike
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_q").alias(query_id), F.col("_id").alias(id), "score", "rank")


def with_snippets(hits: DataFrame, query: str, body: str = "body", chars: int = 280) -> DataFrame:
    return hits.withColumn("snippet", snippet(F.col(body), sorted(set(query_terms(query))), chars))


def answer(hits: DataFrame, query: str, id: str = "chunk_id", body: str = "body", citations: int = 5) -> DataFrame:
    """One row: the sentence-ended, cleaned snippets of the best hits joined by a space, and how many there are."""
    terms = sorted(set(query_terms(query)))
    part = clean(snippet(F.col(body), terms, 220))
    ranked = hits.orderBy(F.desc("score"), id).limit(citations).select("score", F.col(id).alias("id"), part.alias("part")).where("part != ''")
    said = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", sentence(F.col("part")).alias("part"))))
    return ranked.agg(F.array_join(F.transform(said, lambda x: x["part"]), " ").alias("answer"), F.count("*").alias("citations"))


def padded_answer(hits: DataFrame, query: str, id: str = "chunk_id", body: str = "body", citations: int = 5) -> DataFrame:
    """`answer`, with a second part where the best hits give only one or none: shorter snippets of the hits from the place on that
    follows as many as there are parts. That place may be that of the hit which gave the part. Columns answer, citations and
    padded, the number of parts put in; the answer says so if there is no hit, or none of use."""
    terms = sorted(set(query_terms(query)))
    best = hits.orderBy(F.desc("score"), id).limit(citations)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), id))  # of a few hits
    part = lambda chars: clean(snippet(F.col(body), terms, chars))
    each = best.select(rank.alias("rank"), part(220).alias("long"), part(160).alias("short"))
    rows = each.agg(F.array_sort(F.collect_list(F.struct("rank", "long", "short"))).alias("h"))
    said = F.transform(F.filter("h", lambda x: x["long"] != ""), lambda x: sentence(x["long"]))
    more = F.transform(F.filter(F.slice(F.col("h"), F.size("said") + 1, citations), lambda x: x["short"] != ""), lambda x: sentence(x["short"]))
    wanted = F.when((F.size("said") < 2) & (F.size("h") > F.size("said")), F.slice(more, F.lit(1), F.lit(2) - F.size("said"))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("said", said).withColumn("more", wanted)
    text = F.array_join(F.concat("said", "more"), " ")
    none = F.when(F.size("h") == 0, "(no matching documents)").otherwise("(no usable snippets)")
    return out.select(F.when(text == "", none).otherwise(text).alias("answer"), F.size("h").alias("citations"), F.size("more").alias("padded"))


def cited(hits: DataFrame, query: str, budget: int = 1200, used: int = 0, id: str = "chunk_id", body: str = "body", citations: int = 5) -> DataFrame:
    """rank, id, path, heading, score and snippet of the best hits as long as their lines fit in the token budget (four bytes a
    token), of which `used` bytes are taken before. The first is always given."""
    terms = sorted(set(query_terms(query)))
    w = Window.orderBy(F.desc("score"), id)  # of a few hits
    best = hits.orderBy(F.desc("score"), id).limit(citations).withColumn("rank", F.row_number().over(w)).withColumn("snippet", clean(snippet(F.col(body), terms, 200)))
    line = F.concat(F.lit("  ["), "rank", F.lit("] "), "path", F.lit(" - "), "heading", F.lit(" (score "), F.format_string("%.2f", "score"), F.lit(")\n      "), "snippet", F.lit("\n"))
    sized = best.withColumn("_size", F.octet_length(line))
    before = F.lit(used) + F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = (F.floor(before / 4) + F.floor(F.col("_size") / 4) > budget) & (F.col("rank") > 1)
    cut = sized.withColumn("_over", over.cast("int")).withColumn("_cut", F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.where("_cut = 0").select("rank", id, "path", "heading", "score", "snippet")


def rerank(hits: DataFrame, similarity: Column, id: str = "chunk_id", head: int = 24, weight: float = 0.5) -> DataFrame:
    """The best `head` hits by (1 - weight) * score / best + weight * similarity, the others after them in their old order and
    with their old scores. Adds rank."""
    first = hits.orderBy(F.desc("score"), id).limit(head).select(id, "score", similarity.alias("_s"))
    top = first.agg(F.max("score").alias("_m"))
    mixed = first.crossJoin(F.broadcast(top)).select(id, ((1 - weight) * F.when(F.col("_m") > 0, F.col("score") / F.col("_m")).otherwise(0.0) + weight * F.col("_s")).alias("mixed"))
    out = hits.join(F.broadcast(mixed), id, "left").withColumn("head", F.col("mixed").isNotNull())
    out = out.withColumn("score", F.coalesce("mixed", "score")).drop("mixed")
    return out


def cosine_similarity(vector: str, to: list[float]) -> Column:
    """(cosine + 1) / 2 with a fixed vector."""
    return (cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in to])) + 1) / 2


def similar(ideas: DataFrame, probe: str, id: str = "slug", text: str = "text", mode: str = "multiset", threshold: float = 0.25, k: int = 5) -> DataFrame:
    """The k ideas most like the probe text. The probe is one row, so this is a scan without a shuffle, which splits each text once."""
    words = [w for w in re.split("[^a-z0-9]+", probe.lower()) if len(w) > 2]
    asked = F.lit(words) if words else F.array().cast("array<string>")
    likeness = _once(idea_tokens(F.col(text)), lambda t: overlap(asked, t, mode))
    # Above the limit, the filter isn't pushed into the scan, where it would compute the likeness again.
    return ideas.select(F.col(id), likeness.alias("similarity")).orderBy(F.desc("similarity"), id).limit(k).where(F.col("similarity") >= threshold)


def design_links(designs: DataFrame, probe: str, path: str = "path", body: str = "content", k: int = 5) -> DataFrame:
    """Paths worth linking: 3 for each token of the probe in the file's stem, 1 for each of its first 12 in the text."""
    words = [w for w in re.split("[^a-z0-9]+", probe.lower()) if len(w) > 2]
    stem = F.lower(F.regexp_extract(F.col(path), r"([^/]*?)(?:\.[^./]*)?$", 1))
    has = lambda where, w: F.when(F.contains(where, F.lit(w)), 1).otherwise(0)
    score = sum((3 * has(stem, w) for w in words), F.lit(0)) + sum((has(F.lower(F.col(body)), w) for w in words[:12]), F.lit(0))
    return designs.select(path, score.alias("score")).where("score > 0").orderBy(F.desc("score"), path).limit(k)
