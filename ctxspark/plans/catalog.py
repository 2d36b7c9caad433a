"""The catalogue of queries over the driver tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import change, decide, digest, graph, linediff, paging, policy, presence, providers, records, retrieval, runtime, telemetry, trace, vectorcache
from ..sources import files
from ..storage import shared_folder, stored
from . import relations as rel
from .relations import read

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

QUERY = "inea thble erly than than"
STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP)
TOKENS_SQL = rf"list_filter(string_split_regex(lower({{}}), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda x: octet_length(encode(x)) >= 2 AND x NOT IN ({STOP_SQL}))"


def tokens_sql(expr: str) -> str:
    return TOKENS_SQL.replace("{{", "{").replace("}}", "}").replace("{}", expr)


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# Retrieval

TERMS = retrieval.query_terms(QUERY)
TERM_ROWS = ", ".join(f"('{t}', {TERMS.count(t)})" for t in sorted(set(TERMS)))
TOK_SQL = f"tok AS (SELECT doc_id, lang, source, unnest({tokens_sql('text')}) AS term FROM documents)"
SCORE_SQL = f"""
  dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  q(term, qf) AS (VALUES {TERM_ROWS}),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  sc AS (SELECT doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
         FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1)"""


@query(f"WITH {TOK_SQL}, {SCORE_SQL} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT 10")
def bm25_search(spark, sf):
    return retrieval.search(rel.chunks(spark, sf), QUERY, k=10).select("chunk_id", _r("score"))


@query(f"WITH tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents WHERE lang = 'en' AND source IN ('src5', 'src6', 'src7')), {SCORE_SQL} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT 10")
def bm25_facet_search(spark, sf):
    c = rel.chunks(spark, sf).where((F.col("lang") == "en") & F.col("source").isin("src5", "src6", "src7"))
    return retrieval.search(c, QUERY, k=10).select("chunk_id", _r("score"))


@query(f"""WITH {TOK_SQL}, {SCORE_SQL},
  b AS (SELECT doc_id, score * CASE WHEN toxic = 1 THEN 8 WHEN quality = 0 THEN 4 WHEN quality = 1 THEN 2 ELSE 1 END AS score FROM sc LEFT JOIN labels USING (doc_id))
  SELECT doc_id AS chunk_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10""")
def bm25_boosted(spark, sf):
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("toxic") == 1, "eyeball_fail").when(F.col("quality") == 0, "open").when(F.col("quality") == 1, "gated").alias("status"))
    c = rel.chunks(spark, sf).join(labels, "chunk_id", "left")
    boost = F.coalesce(records.defect_boost(F.col("status")), F.lit(1.0))
    return retrieval.search(c, QUERY, boost=boost, k=10).select("chunk_id", _r("score"))


@query(f"""WITH {TOK_SQL}, dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY 1, 2),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  sc AS (SELECT item_id, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1, 2)
  SELECT item_id, doc_id AS chunk_id, round(score, 4) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 3""")
def bm25_batch_benchmark(spark, sf):
    q = read(spark, sf, "benchmark").select("item_id", "text")
    out = retrieval.search_many(rel.chunks(spark, sf), q, query_id="item_id", query="text", k=3)
    return out.select("item_id", "chunk_id", _r("score", 4), "rank")


_LOW = "lower(body)"


def _pos(terms: list[str]) -> str:
    return "coalesce(list_min(list_filter([" + ", ".join(f"strpos({_LOW}, '{t}')" for t in sorted(set(terms))) + "], lambda x: x > 0)), 1)"


_POS = _pos(TERMS)
SNIPPET_SQL = f"""
  p AS (SELECT *, {_POS} AS pos FROM b), l AS (SELECT *, pos - length(list_last(string_split(substr(body, 1, pos - 1), chr(10)))) AS line FROM p),
  s AS (SELECT *, substr(body, line) AS rest FROM l),
  c AS (SELECT *, regexp_replace(replace(substr(rest, 1, $N), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS cut FROM s),
  sn AS (SELECT *, CASE WHEN length(rest) > $N THEN cut || ' …' ELSE cut END AS snippet FROM c)"""


@query(f"WITH {TOK_SQL}, {SCORE_SQL}, b AS (SELECT doc_id, text AS body, score FROM sc JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10), {SNIPPET_SQL.replace('$N', '280')} SELECT doc_id AS chunk_id, snippet FROM sn")
def search_snippet(spark, sf):
    hits = retrieval.search(rel.chunks(spark, sf), QUERY, k=10)
    return retrieval.with_snippets(hits, QUERY).select("chunk_id", "snippet")


@query(rf"""WITH {TOK_SQL}, {SCORE_SQL}, b AS (SELECT doc_id, text AS body, score FROM sc JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 5), {SNIPPET_SQL.replace('$N', '220')},
  cl AS (SELECT *, trim(regexp_replace(trim(regexp_replace(snippet, '\s+', ' ', 'g')), '^[`*#|]+|[`*#|]+$', '', 'g')) AS part FROM sn)
  SELECT string_agg(CASE WHEN regexp_matches(part, '[.!?]$') THEN part ELSE part || '.' END, ' ' ORDER BY score DESC, doc_id) AS answer, count(*) AS citations FROM cl WHERE part <> ''""")
def extractive_answer(spark, sf):
    return retrieval.answer(retrieval.search(rel.chunks(spark, sf), QUERY, k=5), QUERY)


CORPUS_QUERY = "inea thble urgent eyeball fail 4711"
CORPUS_ROWS = ", ".join(f"('{t}', {n})" for t, n in sorted({t: retrieval.query_terms(CORPUS_QUERY).count(t) for t in retrieval.query_terms(CORPUS_QUERY)}.items()))
CORPUS_SQL = f"""{rel.DEFECTS_SQL.replace("df AS (", "defects AS (", 1)},
  corpus AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS path, 'Document ' || doc_id AS heading, coalesce(text, '') AS body, 1.0 AS boost FROM documents
    UNION ALL SELECT 'defect', 'defect ' || id, '', 'DEFECT [' || status || '] ' || id, 'Defect ' || id || ' (' || status || ') in ' || subsystem || ': ' || summary || chr(10), CASE status WHEN 'eyeball_fail' THEN 8.0 WHEN 'open' THEN 4.0 ELSE 2.0 END FROM defects WHERE status <> 'done'),
  tok AS (SELECT doc_id, unnest({tokens_sql("heading || ' ' || body")}) AS term FROM corpus), {SCORE_SQL.replace(TERM_ROWS, CORPUS_ROWS)},
  hit AS (SELECT corpus.*, score * boost AS score FROM sc JOIN corpus USING (doc_id))"""


def _corpus(spark, sf):
    d = read(spark, sf, "documents")
    docs = d.select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("path"), F.concat(F.lit("Document "), "doc_id").alias("heading"), F.coalesce("text", F.lit("")).alias("body"))
    return retrieval.corpus(rel.spread(docs), records.defect_chunks(rel.defects(spark, sf)))


@query(f"WITH {CORPUS_SQL} SELECT kind, doc_id AS chunk_id, heading, round(score, 6) AS score FROM hit")
def corpus_search(spark, sf):
    """Documents and unresolved defects in one search: every hit with its score."""
    return retrieval.search_corpus(_corpus(spark, sf), CORPUS_QUERY, k=None).select("kind", "chunk_id", "heading", _r("score"))


@query(f"""WITH {CORPUS_SQL}, b AS (SELECT * FROM hit ORDER BY score DESC, kind DESC, doc_id LIMIT 5), {SNIPPET_SQL.replace('$N', '200').replace(_POS, _pos(retrieval.query_terms(CORPUS_QUERY)))}
  SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id AS chunk_id, path, heading, round(score, 6) AS score, trim(regexp_replace(trim(regexp_replace(snippet, '\\s+', ' ', 'g')), '^[`*#|]+|[`*#|]+$', '', 'g')) AS snippet FROM sn""")
def corpus_citations(spark, sf):
    """What an answer over documents and defects cites."""
    hits = retrieval.search_corpus(_corpus(spark, sf), CORPUS_QUERY, k=5)
    return retrieval.cited(hits, CORPUS_QUERY).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), b AS (SELECT vec_id, 10.0 / (1 + vec_id % 50) AS score, embedding FROM embeddings),
  h AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rn FROM b), m AS (SELECT max(score) AS m FROM h WHERE rn <= 24),
  x AS (SELECT vec_id, rn <= 24 AS head, CASE WHEN rn <= 24 THEN 0.5 * score / m + 0.5 * (list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) + 1) / 2 ELSE score END AS score FROM h, m, q)
  SELECT vec_id, head, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY head DESC, x.score DESC, vec_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 60""")
def rerank_cosine(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", (F.lit(10.0) / (1 + F.col("vec_id") % 50)).alias("score"), "embedding")
    probe = e.where("vec_id = 0").first().embedding
    out = retrieval.rerank(e, retrieval.cosine_similarity("embedding", probe), id="vec_id")
    top = out.orderBy(F.desc("head"), F.desc("score"), "vec_id").limit(60)
    return decide.rank_hits(top, "vec_id").select("vec_id", "head", _r("score"), "rank")


PROBE = "Then the thnttion of inea and hath ererered with oror and the thesator"
_IDEA = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: length(x) > 2)"


@query(f"""WITH d AS (SELECT doc_id AS slug, {_IDEA.format('text')} AS b, {_IDEA.format("'" + PROBE + "'")} AS a FROM documents),
  s AS (SELECT slug, CASE WHEN len(b) = 0 THEN 0 ELSE len(list_filter(a, lambda x: list_contains(b, x))) / (len(a) + len(b) - len(list_filter(a, lambda x: list_contains(b, x)))) END AS similarity FROM d)
  SELECT slug, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.02 ORDER BY s.similarity DESC, slug LIMIT 20""")
def similar_docs_multiset(spark, sf):
    d = rel.spread(read(spark, sf, "documents").select(F.col("doc_id").alias("slug"), "text"))
    return retrieval.similar(d, PROBE, threshold=0.02, k=20).select("slug", _r("similarity"))


@query(f"""WITH d AS (SELECT doc_id AS slug, list_distinct({_IDEA.format('text')}) AS b, list_distinct({_IDEA.format("'" + PROBE + "'")}) AS a FROM documents),
  s AS (SELECT slug, CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS similarity FROM d)
  SELECT slug, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.02 ORDER BY s.similarity DESC, slug LIMIT 20""")
def similar_docs_jaccard(spark, sf):
    d = rel.spread(read(spark, sf, "documents").select(F.col("doc_id").alias("slug"), "text"))
    return retrieval.similar(d, PROBE, mode="set", threshold=0.02, k=20).select("slug", _r("similarity"))


@query(f"""WITH {TOK_SQL}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1""")
def term_df_stats(spark, sf):
    return retrieval.term_df(rel.chunks(spark, sf)).select("term", "df", "cf")


@query(f"WITH {TOK_SQL}, dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM dl")
def corpus_stats(spark, sf):
    return retrieval.corpus_stats(rel.chunks(spark, sf)).select("n", _r("avgdl"))


@query(r"""WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part), x AS (SELECT name, 'red_widgt' AS q, lower(name) AS c, length(name) AS l FROM n),
  y AS (SELECT *, abs(l - 9) AS apart, l >= 4 AND greatest(l, 9) <= 2 * least(l, 9) AS near FROM x)
  SELECT name, score FROM (SELECT name, CAST(CASE WHEN name = q THEN 0 WHEN c = q THEN 1 WHEN near AND (ends_with(c, q) OR ends_with(q, c)) THEN 10 + apart WHEN near AND (contains(c, q) OR contains(q, c)) THEN 40 + apart
    WHEN l BETWEEN 4 AND 40 AND apart <= 2 AND (substr(c, 1, 3) = substr(q, 1, 3) OR len(list_intersect(list_distinct(string_split(c, '')), list_distinct(string_split(q, '')))) * 2 >= greatest(l, 9)) AND levenshtein(c, q) <= 2 THEN 20 + levenshtein(c, q) END AS INTEGER) AS score
  FROM y) WHERE score IS NOT NULL ORDER BY score, name LIMIT 8""")
def fuzzy_suggest(spark, sf):
    names = read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return graph.resolve_symbol(names, "red_widgt").select("name", "score")


# Telemetry

_MEASURES = "count(*) AS calls, CAST(sum(baseline) AS BIGINT) AS baseline_tokens, CAST(sum(returned) AS BIGINT) AS returned_tokens, CAST(sum(elapsed_us) AS BIGINT) AS total_us, max(elapsed_us) AS peak_us, CAST((sum(elapsed_us) // 1000) // count(*) AS BIGINT) AS avg_ms, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}_count" for o in telemetry.OUTCOMES)
ROLLUP_SQL = f"{rel.EVENTS_SQL}, roll AS (SELECT tool, {_MEASURES} FROM ev GROUP BY tool)"


@query(f"WITH {ROLLUP_SQL} SELECT * FROM roll")
def tool_rollup(spark, sf):
    return telemetry.rollup(rel.telemetry(spark, sf))


@query(f"""WITH {rel.EVENTS_SQL}, r AS (SELECT coalesce(tool, 'TOTAL') AS tool, {_MEASURES} FROM ev GROUP BY ROLLUP (tool))
  SELECT *, CAST(CASE WHEN baseline_tokens = 0 THEN 0 ELSE round(greatest(baseline_tokens - returned_tokens, 0) / baseline_tokens * 100) END AS BIGINT) AS saved_pct FROM r""")
def tool_rollup_total(spark, sf):
    return telemetry.rollup_total(rel.telemetry(spark, sf))


CUTOFF = 1704931200  # 2024-01-11


@query(f"WITH {rel.EVENTS_SQL} SELECT tool, {_MEASURES} FROM ev WHERE ts >= {CUTOFF} AND workspace = '7' GROUP BY tool")
def tool_rollup_30d(spark, sf):
    return telemetry.rollup(telemetry.since(rel.telemetry(spark, sf), CUTOFF, "7"))


@query(f"""WITH {rel.EVENTS_SQL}, k AS (SELECT tool, elapsed_us, row_number() OVER (PARTITION BY tool ORDER BY elapsed_us) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM ev)
  SELECT tool, """ + ", ".join(f"max(elapsed_us) FILTER (rn = CAST(round({p} / 100.0 * (n - 1)) AS BIGINT) + 1) AS p{p}" for p in (50, 95, 99)) + " FROM k GROUP BY tool")
def latency_percentiles(spark, sf):
    return telemetry.percentiles(rel.telemetry(spark, sf))


def _sig(name: str, where: str, value: str) -> str:
    return f"SELECT '{name}' AS signal, tool, CAST({value} AS BIGINT) AS value FROM roll WHERE {where}"


_RATE = "{0}_count * 100 // calls"


@query(f"WITH {ROLLUP_SQL} " + " UNION ALL ".join([
    _sig("slow", "avg_ms >= 50", "avg_ms"),
    _sig("truncation", f"truncated_count > 0 AND {_RATE.format('truncated')} >= 15", _RATE.format("truncated")),
    *[_sig(f"{o}_prone", f"calls >= 5 AND {_RATE.format(o)} >= 10", _RATE.format(o)) for o in ("error", "invalid", "not_found")],
    _sig("low_yield", f"calls >= 10 AND {_RATE.format('low_yield')} >= 25", _RATE.format("low_yield")),
    _sig("net_negative", "baseline_tokens >= 500 AND returned_tokens >= baseline_tokens", "returned_tokens - baseline_tokens"),
]))
def signals(spark, sf):
    return telemetry.signals(telemetry.rollup(rel.telemetry(spark, sf)))


REGISTRY = ["view", "click", "error", "purchase", "signup", "refund", "logout"]


@query("SELECT tool FROM (VALUES " + ", ".join(f"('{t}')" for t in REGISTRY) + ") AS r(tool) WHERE tool NOT IN (SELECT event_type FROM events)")
def never_called(spark, sf):
    reg = spark.range(1).select(F.explode(F.lit(REGISTRY)).alias("tool"))
    return telemetry.never_called(reg, rel.telemetry(spark, sf))


_LEVEL = "CASE WHEN score <= 2 THEN 'low' WHEN score <= 5 THEN 'medium' WHEN score <= 8 THEN 'high' ELSE 'critical' END"


@query(f"""WITH {rel.EVENTS_SQL}, c AS (SELECT workspace, count(*) AS events, CAST(count(*) FILTER (outcome = 'error') * 100 // count(*) AS BIGINT) AS error_pct, CAST(count(*) FILTER (outcome = 'truncated') * 100 // count(*) AS BIGINT) AS truncated_pct FROM ev WHERE ts >= {CUTOFF} GROUP BY 1),
  s AS (SELECT *, CASE WHEN events >= 80 THEN 3 WHEN events >= 40 THEN 2 WHEN events >= 20 THEN 1 ELSE 0 END + CASE WHEN error_pct >= 20 THEN 2 WHEN error_pct >= 10 THEN 1 ELSE 0 END + CASE WHEN truncated_pct >= 20 THEN 1 ELSE 0 END + 1 + 2 AS score FROM c)
  SELECT *, {_LEVEL} AS level FROM s""")
def pressure_score(spark, sf):
    return telemetry.pressure(telemetry.since(rel.telemetry(spark, sf), CUTOFF), unresolved=3, failed_runs=4, by=["workspace"])


@query("SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'none') AS bucket, count(*) AS n FROM events GROUP BY 1")
def cascade_histogram(spark, sf):
    return telemetry.histogram(rel.telemetry(spark, sf), F.when(F.col("tool") != "error", F.col("tool")))


@query(f"WITH {rel.EVENTS_SQL} SELECT event_id, tool, workspace FROM ev QUALIFY row_number() OVER (PARTITION BY tool ORDER BY ts DESC, event_id DESC) <= 40")
def recent_ring(spark, sf):
    return telemetry.ring(rel.telemetry(spark, sf), ["tool"], [F.desc("ts"), F.desc("event_id")], 40).select("event_id", "tool", "workspace")


@query(f"""WITH {rel.EVENTS_SQL}, a AS (SELECT *, last_value(CASE WHEN tool = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY workspace ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS search FROM ev)
  SELECT event_id, workspace, search FROM a WHERE tool = 'click'""")
def click_attribution(spark, sf):
    e = rel.telemetry(spark, sf)
    return telemetry.attribute_clicks(e, F.col("tool") == "view", F.col("tool") == "click", "workspace", ["ts", "event_id"], "event_id").select("event_id", "workspace", "search")


@query(f"WITH {rel.EVENTS_SQL}, m AS (SELECT workspace, max(ts) AS last FROM ev WHERE tool = 'purchase' GROUP BY 1) SELECT event_id, ev.workspace FROM ev LEFT JOIN m ON ev.workspace = m.workspace WHERE last IS NULL OR ts > last")
def session_since_marker(spark, sf):
    return telemetry.since_marker(rel.telemetry(spark, sf), F.col("tool") == "purchase", "workspace", "ts").select("event_id", "workspace")


@query(f"WITH {rel.EVENTS_SQL} SELECT count(*) AS searches, round(count(*) FILTER (returned // 100 = 0) * 100 / count(*), 1) AS no_result_pct, round(avg(elapsed_us // 1000), 1) AS avg_latency_ms, round(avg(CASE WHEN event_id % 3 = 0 THEN event_id % 10 END), 1) AS avg_click_rank FROM ev")
def search_kpis(spark, sf):
    e = rel.telemetry(spark, sf)
    s = e.select(F.floor(F.col("returned") / 100).alias("results"), F.floor(F.col("elapsed_us") / 1000).alias("latency_ms"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 10).alias("click_rank"))
    return telemetry.kpis(s)


# Traces and runtime captures

ZONES_SQL = f"{rel.TRACE_SQL}, z AS (SELECT name, sum(total_ns) AS total_ns, CAST(sum(counts) AS BIGINT) AS counts, max(max_ns) AS max_ns, sum(total_ns) / sum(counts) / 1000 AS mean_us FROM tr GROUP BY 1)"


def _top(sort_by: str, key: str):
    def run(spark, sf):
        out = trace.top_zones(trace.zones(rel.trace(spark, sf)), sort_by, 8)
        return out.select("rank", "name", _r("total_ns", 2), "counts", _r("max_ns", 2), _r("mean_us"), _r("share_pct"))

    run.__name__ = f"trace_top_{sort_by}"
    query(f"""WITH {ZONES_SQL}, g AS (SELECT sum(total_ns) AS g FROM z) SELECT CAST(row_number() OVER (ORDER BY {key} DESC, name) AS INTEGER) AS rank, name, round(total_ns, 2) AS total_ns, counts, round(max_ns, 2) AS max_ns, round(mean_us, 6) AS mean_us, round(total_ns / g * 100, 6) AS share_pct FROM z, g QUALIFY rank <= 8""")(run)


for _s, _k in (("total", "z.total_ns"), ("mean", "z.mean_us"), ("max", "z.max_ns"), ("count", "z.counts")):
    _top(_s, _k)


@query(f"""WITH {rel.TRACE_SQL}, b AS (SELECT name, sum(total_ns) AS base_ns FROM tr WHERE l_orderkey % 2 = 0 AND name <> 'Brand#3' GROUP BY 1), c AS (SELECT name, sum(total_ns) AS current_ns FROM tr WHERE l_orderkey % 2 = 1 AND name <> 'Brand#5' GROUP BY 1),
  d AS (SELECT name, coalesce(base_ns, 0) AS base_ns, coalesce(current_ns, 0) AS current_ns, CASE WHEN base_ns IS NULL THEN 'new' WHEN current_ns IS NULL THEN 'gone' WHEN base_ns = current_ns THEN 'same' ELSE 'changed' END AS tag FROM b FULL JOIN c USING (name))
  SELECT name, tag, round(base_ns, 2) AS base_ns, round(current_ns, 2) AS current_ns, round(current_ns - base_ns, 2) AS delta_ns, round(CASE WHEN base_ns > 0 THEN (current_ns - base_ns) / base_ns * 100 END, 4) AS change_pct FROM d""")
def trace_diff(spark, sf):
    t = rel.trace(spark, sf)
    base = trace.zones(t.where((F.col("l_orderkey") % 2 == 0) & (F.col("name") != "Brand#3")))
    now = trace.zones(t.where((F.col("l_orderkey") % 2 == 1) & (F.col("name") != "Brand#5")))
    return trace.diff_zones(base, now).select("name", "tag", _r("base_ns", 2), _r("current_ns", 2), _r("delta_ns", 2), _r("change_pct", 4))


@query("""WITH m AS (SELECT date_trunc('day', ts) AS day, event_type AS name, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY 1, 2), b AS (SELECT name, value FROM m WHERE day = DATE '2024-01-02'), c AS (SELECT name, value FROM m WHERE day = DATE '2024-01-20' AND name <> 'view')
  SELECT name, coalesce(b.value, 0) AS base, coalesce(c.value, 0) AS current, coalesce(c.value, 0) - coalesce(b.value, 0) AS delta FROM b FULL JOIN c USING (name)""")
def snapshot_diff(spark, sf):
    m = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return runtime.diff_named(m.where("day = DATE '2024-01-02'"), m.where("day = DATE '2024-01-20' AND name != 'view'"))


LIMITS = [("view", 2000), ("click", 100), ("crash", 1)]


@query("""WITH m AS (SELECT event_type AS metric, count(*) AS value FROM events GROUP BY 1) SELECT metric, "limit", value, CASE WHEN value IS NULL THEN 'unavailable' WHEN value > "limit" THEN 'over' ELSE 'ok' END AS status, CASE WHEN value IS NULL THEN 0 ELSE greatest(value - "limit", 0) END AS excess FROM (VALUES """ + ", ".join(f"('{k}', {v})" for k, v in LIMITS) + """) AS l(metric, "limit") LEFT JOIN m USING (metric)""")
def budget_eval(spark, sf):
    lim = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v})" for k, v in LIMITS) + " AS l(metric, limit)")
    m = read(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return runtime.budget(lim, m)


@query(f"""WITH {rel.REGIONS_SQL}, s AS (SELECT name, CAST(sum("end" - start) AS BIGINT) AS bytes, count(*) AS regions FROM rg GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, name) AS rn FROM s)
  SELECT CASE WHEN rn <= 5 THEN name ELSE 'other' END AS name, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(regions) AS BIGINT) AS regions FROM r GROUP BY 1""")
def regions_top_other(spark, sf):
    r = rel.regions(spark, sf).withColumn("size", F.col("end") - F.col("start"))
    return runtime.top_other(r, "name", "size", 5)


@query(f"""WITH {rel.REGIONS_SQL} SELECT proc, start, "end", CASE WHEN lag("end") OVER w IS NULL THEN NULL ELSE greatest(start - lag("end") OVER w, 0) END AS gap FROM rg WINDOW w AS (PARTITION BY proc ORDER BY start, "end")""")
def segment_gaps(spark, sf):
    return runtime.gaps(rel.regions(spark, sf), ["proc"]).select("proc", "start", "end", "gap")


@query(f"""WITH {rel.REGIONS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY proc ORDER BY start, "end") AS rn, ceil(count(*) OVER (PARTITION BY proc) / 16) AS per FROM rg)
  SELECT proc, CAST(floor((rn - 1) / per) AS BIGINT) AS bucket, min(start) AS start, max("end") AS "end", CAST(sum("end" - start) AS BIGINT) AS bytes, count(*) AS regions, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind FROM o GROUP BY 1, 2""")
def segment_buckets(spark, sf):
    lines = read(spark, sf, "lineitem").count()  # from the files' footers; a line is a region at most
    return runtime.buckets(rel.regions(spark, sf), ["proc"], 16, rows=lines)


@query("SELECT CAST(l_partkey * 1237 // 4096 * 4096 AS BIGINT) AS page, count(*) AS samples, round(sum(l_quantity), 4) AS weight FROM lineitem GROUP BY 1")
def hot_pages(spark, sf):
    s = read(spark, sf, "lineitem").select((F.col("l_partkey") * 1237).alias("address"), F.col("l_quantity").alias("weight"))
    return runtime.hot_pages(s).select("page", "samples", _r("weight", 4))


@query("SELECT CAST(l_partkey * 1237 // 4096 * 4096 AS BIGINT) AS page, count(*) AS samples FROM lineitem GROUP BY 1 HAVING count(*) >= 20 ORDER BY samples DESC, page LIMIT 12")
def locality_hotspots(spark, sf):
    s = read(spark, sf, "lineitem").select((F.col("l_partkey") * 1237).alias("address"), F.col("l_quantity").alias("weight"))
    return runtime.hotspots(runtime.hot_pages(s), 20, 12).select("page", "samples")


@query("""WITH e AS (SELECT l_suppkey AS proc, l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity AS BIGINT) AS d FROM lineitem),
  r AS (SELECT proc, l_orderkey, l_linenumber, CAST(sum(d) OVER (PARTITION BY proc ORDER BY l_orderkey, l_linenumber, d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live, d FROM e)
  SELECT proc, l_orderkey, l_linenumber, live, max(live) OVER (PARTITION BY proc ORDER BY l_orderkey, l_linenumber, d ROWS UNBOUNDED PRECEDING) AS peak FROM r""")
def alloc_running_peak(spark, sf):
    e = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("proc"), "l_orderkey", "l_linenumber", (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity")).cast("long").alias("d"))
    return runtime.running_peak(e, ["proc"], ["l_orderkey", "l_linenumber", "d"], F.col("d")).select("proc", "l_orderkey", "l_linenumber", "live", "peak")


# Graphs


@query(f"WITH {rel.CALLS_SQL}, e AS (SELECT *, CAST(row_number() OVER (PARTITION BY caller ORDER BY n DESC, callee) AS INTEGER) AS line FROM edges) SELECT caller, caller AS rel, min(line) AS line, count(*) AS calls FROM e WHERE split_part(callee, '::', 2) = '19' AND split_part(caller, '::', 2) <> '19' GROUP BY 1, 2")
def callers(spark, sf):
    return graph.callers(rel.calls(spark, sf), "19")


@query(f"WITH {rel.CALLS_SQL} SELECT split_part(callee, '::', 2) AS callee, count(*) AS calls FROM edges WHERE split_part(caller, '::', 2) = '4' AND split_part(callee, '::', 2) <> '4' GROUP BY 1")
def callees(spark, sf):
    return graph.callees(rel.calls(spark, sf), "4")


@query(f"WITH {rel.CALLS_SQL} SELECT * FROM adj")
def adjacency(spark, sf):
    return graph.adjacency(rel.calls(spark, sf))


@query(f"""WITH RECURSIVE {rel.CALLS_SQL}, w AS (SELECT '0' AS node, 0 AS depth UNION SELECT callee, depth + 1 FROM w JOIN adj ON caller = node WHERE depth < 6)
  SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def call_path_bfs(spark, sf):
    return graph.reach(graph.adjacency(rel.calls(spark, sf)), "0", 6)


@query(f"""WITH RECURSIVE {rel.CALLS_SQL}, w AS (SELECT '0' AS node, ['0'] AS path UNION ALL SELECT callee, list_append(path, callee) FROM w JOIN adj ON caller = node WHERE len(path) < 8 AND NOT list_contains(path, callee)),
  f AS (SELECT node, min(len(path)) AS d FROM w GROUP BY 1), g AS (SELECT node AS g FROM f ORDER BY d DESC, node LIMIT 1), b AS (SELECT path FROM w, g WHERE node = g ORDER BY len(path), path LIMIT 1)
  SELECT CAST(unnest(range(len(path))) AS INTEGER) AS step, unnest(path) AS node FROM b""")
def call_path(spark, sf):
    adj = graph.adjacency(rel.calls(spark, sf))
    goal = graph.reach(adj, "0", 7).orderBy(F.desc("depth"), "node").first()["node"]  # the farthest one
    return graph.call_path(adj, "0", goal, 8)


_COUPLED = f"""{rel.CALLS_SQL}, m AS (SELECT 'n::' || n_nationkey AS name, r_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey),
  p AS (SELECT a.module AS "from", b.module AS "to", caller, callee, count(*) AS n FROM edges JOIN m a ON caller = a.name JOIN m b ON callee = b.name WHERE a.module <> b.module GROUP BY 1, 2, 3, 4),
  q AS (SELECT *, row_number() OVER (PARTITION BY "from", "to" ORDER BY caller, callee) AS r FROM p),
  cp AS (SELECT "from", "to", CAST(sum(n) AS BIGINT) AS edges, count(*) AS pairs, string_agg(caller || '->' || callee, ',' ORDER BY caller || '->' || callee) FILTER (r <= 4) AS samples FROM q GROUP BY 1, 2 HAVING sum(n) >= 2)"""


@query(f"WITH {_COUPLED} SELECT * FROM cp")
def module_coupling(spark, sf):
    return graph.coupling(rel.calls(spark, sf), rel.modules(spark, sf), least=2)


@query(f"""WITH {_COUPLED}, o AS (SELECT "from" AS module, CAST(sum(edges) AS BIGINT) AS outgoing FROM cp GROUP BY 1), i AS (SELECT "to" AS module, CAST(sum(edges) AS BIGINT) AS incoming FROM cp GROUP BY 1) SELECT module, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM o FULL JOIN i USING (module)""")
def module_degrees(spark, sf):
    return graph.degrees(graph.coupling(rel.calls(spark, sf), rel.modules(spark, sf), least=2))


@query(f"WITH {rel.CALLS_SQL}, f AS (SELECT callee, count(*) AS fan_in FROM adj GROUP BY 1) SELECT 'n::' || n_nationkey AS name, coalesce(fan_in, 0) AS fan_in FROM nation LEFT JOIN f ON callee = CAST(n_nationkey AS VARCHAR)")
def fan_in(spark, sf):
    return graph.fan_in(rel.modules(spark, sf).select("name"), rel.calls(spark, sf))


@query(f"""WITH {rel.CALLS_SQL} SELECT 'n::' || c_custkey AS name, 'n' AS rel, c_custkey AS line, c_nationkey = 0 AS caveat FROM customer
  WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT callee FROM adj) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""")
def dead_nodes(spark, sf):
    """Customers as definitions, urgent pending orders as their mentions."""
    c = read(spark, sf, "customer")
    defs = c.select(F.concat(F.lit("n::"), F.col("c_custkey")).alias("name"), F.lit("n").alias("rel"), F.col("c_custkey").alias("line"), (F.col("c_nationkey") == 0).alias("exported"), F.lit(0).alias("mtime_days"))
    occ = read(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("name"), F.lit("ref").alias("role"))
    return graph.dead(defs, rel.calls(spark, sf), occ).select("name", "rel", "line", "caveat")


@query("SELECT o_orderkey AS start, o_orderkey + n - 1 AS \"end\", CAST(n AS BIGINT) AS lines FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n >= 7 ORDER BY n DESC, o_orderkey LIMIT 30")
def big_items(spark, sf):
    s = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("start")).agg(F.count("*").alias("n")).select(F.lit("o").alias("rel"), "start", (F.col("start") + F.col("n") - 1).alias("end"))
    return graph.big(s, 7).select("start", "end", "lines")


@query("SELECT o_orderpriority AS name, count(*) FILTER (o_orderstatus = 'O') AS defs, count(*) FILTER (o_orderstatus = 'F') AS calls, count(*) FILTER (o_orderstatus = 'P') AS refs, count(*) AS total FROM orders GROUP BY 1")
def occurrence_pivot(spark, sf):
    role = F.when(F.col("o_orderstatus") == "O", "def").when(F.col("o_orderstatus") == "F", "call").when(F.col("o_orderstatus") == "P", "ref")
    return graph.occurrence_counts(read(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), role.alias("role")))


HREF_SQL = r"""h AS (SELECT 'p/' || page_id AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
  pg AS (SELECT 'p/' || page_id AS path FROM pages UNION SELECT DISTINCT trim(target, '/') FROM h WHERE length(target) <= 4),
  lk AS (SELECT source, target, CASE WHEN trim(target, '/') IN (SELECT path FROM pg) AND target LIKE '/%' THEN trim(target, '/') END AS resolved FROM (SELECT * FROM h WHERE regexp_matches(target, '^/[^#?/]+$')))"""


def _pages(spark, sf):
    p = read(spark, sf, "pages").select(F.concat(F.lit("p/"), F.col("page_id")).alias("source"), "html")
    links = p.select("source", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    paths = p.select(F.col("source").alias("path")).unionByName(links.where(F.length("target") <= 4).select(F.trim("target", F.lit("/")).alias("path"))).distinct()
    return graph.resolve_links(links.where(F.col("target").rlike("^/[^#?/]+$")), paths), paths


@query(f"WITH {HREF_SQL} SELECT source, target, count(*) AS n FROM lk WHERE resolved IS NULL GROUP BY 1, 2")
def link_garden_broken(spark, sf):
    resolved, paths = _pages(spark, sf)
    return graph.garden(resolved, paths)[0].groupBy("source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {HREF_SQL} SELECT path FROM pg WHERE path NOT IN (SELECT resolved FROM lk WHERE resolved IS NOT NULL)")
def link_garden_orphans(spark, sf):
    resolved, paths = _pages(spark, sf)
    return graph.garden(resolved, paths)[1].select("path")


@query(f"WITH {HREF_SQL} SELECT DISTINCT source, target FROM lk WHERE resolved = 'The'")
def backlinks(spark, sf):
    return graph.backlinks(_pages(spark, sf)[0], "The")


# Changes


@query("""WITH s AS (SELECT c_nationkey AS rel, c_custkey AS start, c_custkey + 9 AS "end" FROM customer), h AS (SELECT s_nationkey AS rel, s_suppkey * 13 AS first, s_suppkey * 13 + 4 AS last FROM supplier)
  SELECT rel, start, "end" FROM s WHERE EXISTS (SELECT 1 FROM h WHERE h.rel = s.rel AND start <= last AND "end" >= first)""")
def changed_spans(spark, sf):
    s = read(spark, sf, "customer").select(F.col("c_nationkey").alias("rel"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + 9).alias("end"))
    h = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("rel"), (F.col("s_suppkey") * 13).alias("first"), (F.col("s_suppkey") * 13 + 4).alias("last"))
    return change.overlapping(s, h)


@query("""WITH o AS (SELECT DISTINCT p_type AS rel, p_brand AS name, CAST(p_size AS VARCHAR) AS sig FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey, p_type AS rel, p_brand AS name, CAST(p_size AS VARCHAR) AS sig FROM part WHERE p_partkey % 2 = 1)
  SELECT p_partkey, CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.rel = n.rel AND o.name = n.name) THEN 'new' WHEN EXISTS (SELECT 1 FROM o WHERE o.rel = n.rel AND o.name = n.name AND o.sig = n.sig) THEN 'body' ELSE 'signature' END AS change FROM n""")
def change_class(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("rel"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("signature"))
    return change.classify(p.where("p_partkey % 2 = 1"), p.where("p_partkey % 2 = 0").drop("p_partkey")).select("p_partkey", "change")


@query("""SELECT rel, symbols, mentions FROM (SELECT l_suppkey AS rel, count(DISTINCT l_partkey) AS symbols, count(*) AS mentions FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 11) GROUP BY 1) ORDER BY symbols DESC, mentions DESC, rel LIMIT 40""")
def impact_rank(spark, sf):
    c = read(spark, sf, "part").where("p_size = 11").select(F.col("p_partkey").alias("name"))
    t = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rel"), F.col("l_partkey").alias("name"))
    return change.impact(c, t)


_SCOPES = [("core", "economy/"), ("core-red", "economy/red"), ("promo", "promo"), ("rest", "standard/small ring")]
_DIRTY = "d AS (SELECT DISTINCT lower(p_type) || '/' || p_name AS path FROM part), s(scope, prefix) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SCOPES) + ")"


def _scopes(spark, sf):
    d = read(spark, sf, "part").select(F.concat(F.lower("p_type"), F.lit("/"), F.col("p_name")).alias("path")).distinct()
    s = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SCOPES) + " AS s(scope, prefix)")
    return change.scopes(d, s)


@query(f"WITH {_DIRTY} SELECT scope, count(*) AS paths FROM d JOIN s ON starts_with(path, prefix) GROUP BY 1")
def scope_groups(spark, sf):
    return _scopes(spark, sf)[0].groupBy("scope").agg(F.count("*").alias("paths"))


@query(f"WITH {_DIRTY} SELECT path FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE starts_with(path, prefix))")
def scope_unscoped(spark, sf):
    return _scopes(spark, sf)[1]


# Records


@query(f"WITH {rel.BOARD_SQL} SELECT session, id, role FROM bd WHERE id > 2 AND lower(role) = 'user'")
def blackboard_read(spark, sf):
    return records.read_board(rel.board(spark, sf), since_id=2, role="USER").select("session", "id", "role")


@query(f"WITH {rel.BOARD_SQL} SELECT session, role, count(*) AS n FROM bd GROUP BY 1, 2")
def role_counts(spark, sf):
    return records.role_counts(rel.board(spark, sf))


@query(f"""WITH {rel.BOARD_SQL}, c AS (SELECT session, count(*) FILTER (role = 'assistant') AS critics, max(id) FILTER (role = 'assistant') AS last FROM bd GROUP BY 1)
  SELECT c.session, critics, CASE WHEN critics = 0 THEN 'no_critic' WHEN approved IS NULL THEN 'undecided' WHEN NOT approved THEN 'rejected' WHEN questions > 0 THEN 'approved_with_questions' ELSE 'approved' END AS state FROM c LEFT JOIN bd ON bd.session = c.session AND bd.id = last AND role = 'assistant'""")
def convergence(spark, sf):
    return records.convergence(rel.board(spark, sf), critic="assistant")


@query("""WITH t AS (SELECT doc_id, octet_length(encode(text)) // 4 AS size FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, sum(size) OVER (ORDER BY doc_id) AS used FROM t WHERE doc_id >= 30),
  o AS (SELECT min(rn) FILTER (used > 4000) AS cut FROM r) SELECT doc_id, CAST(rn + 30 AS INTEGER) AS rank, CAST(used AS BIGINT) AS used FROM r, o WHERE cut IS NULL OR rn < cut OR rn = 1""")
def token_budget_page(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", tx.approx_tokens(F.col("text")).alias("size"))
    return paging.budget_page(d, F.col("size"), ["doc_id"], 4000, offset=30).select("doc_id", "rank", "used")


@query(f"WITH {rel.DEFECTS_SQL} SELECT 'status' AS facet, status AS value, count(*) AS n FROM df GROUP BY 2 UNION ALL SELECT 'subsystem', subsystem, count(*) FROM df GROUP BY 2")
def defect_digest(spark, sf):
    return records.digest(rel.defects(spark, sf), "status", "subsystem")


@query(f"WITH {rel.DEFECTS_SQL} SELECT id, status, updated FROM df WHERE status <> 'done' ORDER BY CASE status WHEN 'eyeball_fail' THEN 0 WHEN 'open' THEN 1 ELSE 2 END, updated DESC, id LIMIT 25")
def defect_list(spark, sf):
    return records.list_defects(rel.defects(spark, sf), n=25).select("id", "status", "updated")


@query(f"WITH {rel.FRESH_SQL} SELECT freshness, count(*) AS n, min(age_days) AS youngest FROM fresh GROUP BY 1")
def freshness_bands(spark, sf):
    i = records.with_freshness(rel.ideas(spark, sf), F.lit(rel.TODAY).cast("date"))
    return i.groupBy("freshness").agg(F.count("*").alias("n"), F.min("age_days").alias("youngest"))


@query(f"""WITH {rel.FRESH_SQL} SELECT slug, freshness, age_days FROM fresh WHERE freshness IN ('due', 'stale', 'dormant') AND status NOT IN ('archived', 'implemented')
  ORDER BY CASE freshness WHEN 'dormant' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END DESC, age_days DESC, slug LIMIT 50""")
def review_queue(spark, sf):
    i = records.with_freshness(rel.ideas(spark, sf), F.lit(rel.TODAY).cast("date"))
    return records.review_queue(i).limit(50).select("slug", "freshness", "age_days")


@query(f"WITH {rel.FRESH_SQL} SELECT slug, age_days FROM fresh WHERE status IN ('seed', 'sprouted') ORDER BY age_days DESC, touched, slug LIMIT 3")
def stalest(spark, sf):
    return records.stalest(records.with_freshness(rel.ideas(spark, sf), F.lit(rel.TODAY).cast("date"))).select("slug", "age_days")


@query("""WITH f AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'fixed' END AS found FROM documents WHERE doc_id % 4 <> 0), t AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'accepted' WHEN quality = 1 THEN 'unreviewed' ELSE 'ignored' END AS state FROM labels)
  SELECT id, CASE WHEN found IS NULL THEN 'gone' ELSE coalesce(CASE WHEN state <> 'unreviewed' THEN state END, found) END AS status FROM f FULL JOIN t USING (id)""")
def triage_overlay(spark, sf):
    f = read(spark, sf, "documents").where("doc_id % 4 != 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "open").otherwise("fixed").alias("status"), F.lit("low").alias("severity"))
    t = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "accepted").when(F.col("quality") == 1, "unreviewed").otherwise("ignored").alias("state"))
    return records.triage_overlay(f, t).select("id", "status")


@query("""WITH o AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey = 1), n AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey = 2)
  SELECT id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'fixed' ELSE 'persisting' END AS state FROM o FULL JOIN n USING (id)""")
def run_compare(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_suppkey")
    return records.compare_runs(l.where("l_suppkey = 1"), l.where("l_suppkey = 2"))


@query(f"""WITH {rel.DEFECTS_SQL}, n AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'done' END AS status, updated + 1000 AS updated, CASE WHEN id % 3 = 0 THEN 'again ' || id END AS summary FROM df WHERE id % 2 = 0)
  SELECT df.id, coalesce(n.status, df.status) AS status, greatest(df.updated, coalesce(n.updated, 0)) AS updated, coalesce(n.summary, df.summary) AS summary FROM df LEFT JOIN n ON df.id = n.id ORDER BY 3 DESC, 1 LIMIT 200""")
def upsert_latest(spark, sf):
    d = rel.defects(spark, sf).select("id", "status", "updated", "summary")
    n = d.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "done").alias("status"), (F.col("updated") + 1000).alias("updated"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("again "), F.col("id"))).alias("summary"))
    return records.upsert(d, n, "id", "updated", retain=200)


@query(rf"""WITH {rel.DEFECTS_SQL}
  SELECT id, 'DEFECT [' || status || '] ' || id AS heading, 'Defect ' || id || ' (' || status || ') in ' || CASE WHEN subsystem = '5-LOW' THEN 'unspecified' ELSE subsystem END || ': ' || summary || chr(10) || CASE WHEN o_custkey % 2 = 0 THEN 'Acceptance:' || chr(10) || '- c' || o_custkey || chr(10) || '- d' || chr(10) ELSE '' END
    || CASE WHEN o_custkey % 3 = 0 THEN 'Evidence: e; f' || chr(10) ELSE '' END || CASE WHEN o_custkey % 5 = 0 THEN 'Anchors: g, h' || chr(10) ELSE '' END AS body, CASE status WHEN 'eyeball_fail' THEN 8.0 WHEN 'open' THEN 4.0 ELSE 2.0 END::DOUBLE AS boost
  FROM df WHERE status <> 'done'""")
def defect_chunks(spark, sf):
    some = lambda n, *items: F.when(F.col("o_custkey") % n == 0, F.array(*items)).otherwise(F.array().cast("array<string>"))
    lists = {"acceptance": some(2, F.concat(F.lit("c"), "o_custkey"), F.lit("d")), "evidence": some(3, F.lit("e"), F.lit("f")), "anchors": some(5, F.lit("g"), F.lit("h"))}
    d = rel.defects(spark, sf).withColumn("subsystem", F.when(F.col("subsystem") != "5-LOW", F.col("subsystem"))).withColumns(lists)
    return records.defect_chunks(d).select("id", "heading", "body", "boost")


@query(f"""WITH {rel.IDEAS_SQL} SELECT slug, CASE WHEN slug % 7 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN slug % 7 = 0 THEN '{rel.TODAY}' ELSE CAST(day AS VARCHAR) END AS touched, CASE WHEN slug % 7 = 0 THEN 'old' END AS archive_reason FROM idea""")
def idea_status(spark, sf):
    ideas = rel.ideas(spark, sf).withColumn("archive_reason", F.lit(None).cast("string"))
    out = records.set_idea_status(ideas, F.col("slug") % 7 == 0, "archived", rel.TODAY, " old ")
    return out.select("slug", "status", "touched", "archive_reason")


IDEA_TEXT_SQL = f"""{rel.FRESH_SQL}, full_idea AS (SELECT f.*, o_orderpriority AS title, 'order of customer ' || o_custkey || ' ' || o_orderpriority AS body, [lower(o_orderpriority), 'c' || o_custkey % 7] AS tags, f.slug % 4 = 0 AS bookmarked FROM fresh f JOIN orders ON f.slug = o_orderkey)"""


def _full_ideas(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("order of customer "), "o_custkey", F.lit(" "), "o_orderpriority").alias("body"), F.array(F.lower("o_orderpriority"), F.concat(F.lit("c"), F.col("o_custkey") % 7)).alias("tags"))
    ideas = records.with_freshness(rel.ideas(spark, sf), F.to_date(F.lit(rel.TODAY))).join(o, "slug")
    return ideas, ideas.where("slug % 4 = 0").select("slug", F.lit(5).cast("long").alias("at"))


@query(f"""WITH {IDEA_TEXT_SQL}, q AS (SELECT ['urgent', 'order', 'order', 'high'] AS q), t AS (SELECT *, list_filter(string_split_regex(lower(title || chr(10) || body), '[^a-z0-9]+'), lambda x: length(x) > 2) AS t FROM full_idea CROSS JOIN q),
  s AS (SELECT *, len(list_filter(q, lambda x: list_contains(t, x))) AS shared FROM t)
  SELECT slug, bookmarked, freshness, round(CASE WHEN len(t) = 0 THEN 0 ELSE shared::DOUBLE / (len(q) + len(t) - shared) END, 6) AS similarity FROM s WHERE list_contains(tags, 'c3')""")
def idea_hybrid(spark, sf):
    """All ideas of a tag by likeness to a query, with their bookmarks."""
    ideas, marks = _full_ideas(spark, sf)
    return records.list_ideas(ideas, marks, "Urgent order, order; high", semantic=True, tag="C3", n=None).select("slug", "bookmarked", "freshness", _r("similarity"))


@query(f"""WITH {IDEA_TEXT_SQL} SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM full_idea UNION ALL SELECT 'bookmarked', NULL, count(*) FROM full_idea WHERE bookmarked
  UNION ALL SELECT 'status', status, count(*) FROM full_idea GROUP BY 2 UNION ALL SELECT 'freshness', freshness, count(*) FROM full_idea GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(tags) AS tag FROM full_idea) GROUP BY 2""")
def idea_metrics(spark, sf):
    return records.idea_metrics(*_full_ideas(spark, sf))


@query("""WITH ids AS (SELECT o_orderkey AS slug, o_orderkey % 4 = 0 AS had, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS asked FROM orders)
  SELECT slug, CASE WHEN asked THEN 9 ELSE 5 END::BIGINT AS at FROM ids WHERE had <> asked""")
def idea_bookmarks(spark, sf):
    """Bookmarks turned over by requests, of which several may name one idea."""
    ideas, marks = _full_ideas(spark, sf)
    asked = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("slug"))
    return records.toggle_bookmarks(marks, ideas, asked, now=9)


@query(f"""WITH {rel.IDEAS_SQL} SELECT slug, CASE WHEN slug % 7 = 0 OR slug % 5 = 0 THEN '{rel.TODAY}' ELSE CAST(day AS VARCHAR) END AS touched, CASE WHEN slug % 7 = 0 THEN [o_orderstatus, 'Two'] ELSE ['old'] END AS tags, CASE WHEN slug % 5 = 0 THEN ['l' || o_custkey] ELSE [] END AS links FROM idea JOIN orders ON slug = o_orderkey""")
def idea_tags(spark, sf):
    """Tags with blanks, empty ones and ones that differ in case only, and links."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("slug"), "o_orderstatus", "o_custkey")
    ideas = rel.ideas(spark, sf).join(o, "slug").withColumns({"tags": F.array(F.lit("old")), "links": F.array().cast("array<string>")})
    given = F.array(F.concat(F.lit(" "), "o_orderstatus"), F.lit("  "), F.lit("Two"), F.lower("o_orderstatus"), F.lit("tWO "))
    out = records.set_idea_tags(ideas, F.col("slug") % 7 == 0, given, rel.TODAY)
    return records.set_idea_links(out, F.col("slug") % 5 == 0, F.array(F.concat(F.lit("l"), "o_custkey")), rel.TODAY).select("slug", "touched", "tags", "links")


@query("SELECT CAST(user_id AS VARCHAR) AS path, arg_min('b' || event_id, event_id) AS restore, arg_max('a' || event_id, event_id) AS expected, count(*) AS edits FROM events GROUP BY 1")
def undo_target(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("ord"), F.concat(F.lit("b"), F.col("event_id")).alias("before"), F.concat(F.lit("a"), F.col("event_id")).alias("after"))
    return records.undo_targets(e)


# Presence

FOLD_SQL = f"""{rel.JOURNAL_SQL}, st AS (SELECT agent_id, max(seq) AS s FROM jr WHERE kind = 'check_in' GROUP BY 1),
  ag AS (SELECT agent_id, arg_max(state, seq) FILTER (state IS NOT NULL) AS state, arg_max(note, seq) FILTER (note IS NOT NULL) AS note, arg_max(expires_at, seq) FILTER (expires_at IS NOT NULL) AS expires_at, max(seq) AS revision, max(ts) AS updated, count(*) AS events, arg_max(kind, seq) = 'check_out' AS checked_out FROM jr JOIN st USING (agent_id) WHERE seq >= s GROUP BY 1)"""
NOW = 1706600000


@query(f"WITH {FOLD_SQL} SELECT * FROM ag")
def presence_fold(spark, sf):
    return presence.fold(rel.journal(spark, sf), ["state", "note", "expires_at"])


@query(f"WITH {FOLD_SQL} SELECT count(*) AS agents, count(*) FILTER (checked_out) AS checked_out, count(*) FILTER (NOT checked_out AND expires_at <= {NOW}) AS stale, count(*) FILTER (NOT checked_out AND expires_at > {NOW}) AS active FROM ag")
def presence_counts(spark, sf):
    return presence.counts(presence.fold(rel.journal(spark, sf), ["state", "note", "expires_at"]), NOW)


@query(f"WITH {FOLD_SQL} SELECT * FROM ag")
def journal_compact(spark, sf):
    """The fold of a journal whose first half has become snapshots, and of these and a further quarter snapshots once more."""
    fields = ["state", "note", "expires_at"]
    j = rel.journal(spark, sf)
    most = j.agg(F.max("seq")).first()[0] or 0
    return presence.fold(presence.compact(presence.compact(j, fields, most // 2), fields, most * 3 // 4), fields)


@query(f"WITH {rel.JOURNAL_SQL} SELECT seq, agent_id FROM jr WHERE idempotency_key IS NULL OR seq IN (SELECT min(seq) FROM jr GROUP BY idempotency_key)")
def idempotent_first(spark, sf):
    return presence.idempotent(rel.journal(spark, sf)).select("seq", "agent_id")


@query(f"""WITH {rel.CLAIMS_SQL}, c AS (SELECT DISTINCT agent_id, path FROM cl)
  SELECT DISTINCT a.agent_id AS a, b.agent_id AS b, a.path AS path_a, b.path AS path_b FROM c a JOIN c b ON a.agent_id < b.agent_id AND (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/'))""")
def claim_overlap(spark, sf):
    return presence.path_overlaps(rel.claims(spark, sf).select("agent_id", "path").distinct())


@query(f"WITH {rel.CLAIMS_SQL}, c AS (SELECT DISTINCT agent_id, symbol FROM cl) SELECT a.agent_id AS a, b.agent_id AS b, a.symbol FROM c a JOIN c b ON a.symbol = b.symbol AND a.agent_id < b.agent_id")
def symbol_overlap(spark, sf):
    return presence.symbol_overlaps(rel.claims(spark, sf).select("agent_id", "symbol"))


@query(f"""WITH {rel.CLAIMS_SQL}, c AS (SELECT DISTINCT agent_id, path FROM cl), st AS (SELECT path AS "over", count(*) AS n, min(agent_id) AS least, max(agent_id) AS most FROM c GROUP BY 1),
  j AS (SELECT c.*, st.*, (c.agent_id, st."over") IN (SELECT (agent_id, path) FROM c) AS own FROM c JOIN st ON c.path = st."over" OR starts_with(c.path, st."over" || '/'))
  SELECT agent_id, path, "over", CASE WHEN own AND agent_id = least THEN most ELSE least END AS other, n - CAST(own AS BIGINT) AS others FROM j WHERE n > CAST(own AS BIGINT)""")
def claim_contest(spark, sf):
    """Who else claims each path or one above it, without all pairs."""
    return presence.path_contests(rel.claims(spark, sf).select("agent_id", "path"))


@query(f"""WITH {rel.CLAIMS_SQL}, c AS (SELECT DISTINCT agent_id, symbol FROM cl), w AS (SELECT *, count(*) OVER p AS n, min(agent_id) OVER p AS least, max(agent_id) OVER p AS most FROM c WINDOW p AS (PARTITION BY symbol))
  SELECT symbol, agent_id, CASE WHEN agent_id = least THEN most ELSE least END AS other, n - 1 AS others FROM w WHERE n > 1""")
def symbol_contest(spark, sf):
    return presence.symbol_contests(rel.claims(spark, sf).select("agent_id", "symbol"))


@query(f"""WITH {rel.CLAIMS_SQL}, c AS (SELECT DISTINCT agent_id, path FROM cl), d AS (SELECT DISTINCT 'a' || (l_partkey % 50 + 1) AS agent_id, lower(p_type) || '/' || p_name || l_partkey % 400 AS path FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1),
  x AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.agent_id = d.agent_id AND (c.path = d.path OR starts_with(d.path, c.path || '/'))))
  SELECT agent_id, path, CAST(greatest(count(*) OVER (PARTITION BY agent_id) - 8, 0) AS BIGINT) AS others FROM x QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY path) <= 8""")
def drift(spark, sf):
    d = read(spark, sf, "lineitem").where("l_linenumber = 1").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = d.select(F.concat(F.lit("a"), F.col("l_partkey") % 50 + 1).alias("agent_id"), F.concat(F.lower("p_type"), F.lit("/"), F.col("p_name"), F.col("l_partkey") % 400).alias("path"))
    return presence.drift(d, rel.claims(spark, sf).select("agent_id", "path"))


@query("""WITH a AS (SELECT CAST(s_suppkey AS VARCHAR) AS agent_id, CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE 'b' || s_nationkey % 3 END AS base_oid FROM supplier), f AS (SELECT min(agent_id) AS a, arg_min(base_oid, agent_id) AS base_a FROM a WHERE base_oid <> '')
  SELECT f.a, f.base_a, agent_id AS b, base_oid AS base_b FROM a, f WHERE base_oid <> '' AND base_oid <> base_a""")
def divergence(spark, sf):
    a = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("agent_id"), F.when(F.col("s_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit("b"), F.col("s_nationkey") % 3)).alias("base_oid"))
    return presence.divergent_pairs(a)


@query(f"""WITH {FOLD_SQL}, h AS (SELECT o_orderkey AS id, CAST(o_custkey % 170 AS VARCHAR) AS "from", CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 180 AS VARCHAR) END AS "to", CASE WHEN o_orderkey % 7 = 0 THEN 'accepted' ELSE 'offered' END AS status, {NOW} - o_orderkey * 20 AS created_at FROM orders)
  SELECT id, CASE WHEN h.status = 'accepted' THEN 'accepted' WHEN coalesce(f.checked_out, true) AND {NOW} - created_at >= 86400 AND (h."to" = '' OR coalesce(t.checked_out, true)) THEN 'orphaned' ELSE 'offered' END AS derived
  FROM h LEFT JOIN ag f ON h."from" = f.agent_id LEFT JOIN ag t ON h."to" = t.agent_id""")
def handoff_status(spark, sf):
    k = F.col("o_orderkey")
    h = read(spark, sf, "orders").select(k.alias("id"), (F.col("o_custkey") % 170).cast("string").alias("from"), F.when(k % 5 == 0, "").otherwise((k % 180).cast("string")).alias("to"), F.when(k % 7 == 0, "accepted").otherwise("offered").alias("status"), (F.lit(NOW) - k * 20).alias("created_at"))
    return presence.handoff_status(h, presence.fold(rel.journal(spark, sf), ["expires_at"]), NOW).select("id", "derived")


@query("""WITH w AS (SELECT conv_id AS episode_id, min(turn) + conv_id % 7 AS ts FROM conversations GROUP BY conv_id), n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, episode_id DESC) AS rn, count(*) OVER () AS n FROM w)
  SELECT episode_id, ts, rn <= least(greatest(ceil(n * 0.2), 1), n - 1) AS holdout FROM n""")
def holdout_split(spark, sf):
    w = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg((F.min("turn") + F.first("conv_id") % 7).alias("ts"))
    return presence.split_holdout(w)


# Decisions

_OPT = f"list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({STOP_SQL}))"
OPTIONS_SQL = f"""rq AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, {_OPT.format("coalesce(text || ' ', '') || 'which of the th er on'")} AS ctx FROM documents d),
  op(ord, option, descr) AS (VALUES (0, 'alpha', 'the of inea er on th'), (1, 'beta', 'de la que ion'), (2, 'gamma', 'der die und sch'), (3, 'delta', 'erly hath ion on')),
  tk AS (SELECT id, option, ord, ctx, {_OPT.format("option || ' ' || descr")} AS toks FROM rq, op),
  fr AS (SELECT id, option, ord, list_transform(toks, lambda t: len(list_filter(ctx, lambda c: c = t))) AS f, len(toks) AS n FROM tk),
  rs AS (SELECT id, option, ord, 0.5 + coalesce(list_sum(list_transform(list_filter(f, lambda x: x > 0), lambda x: 1 + ln(1 + x))), 0) + len(list_filter(f, lambda x: x > 0)) / greatest(n, 1) AS raw_score FROM fr),
  pr AS (SELECT *, exp(raw_score - max(raw_score) OVER (PARTITION BY id)) / sum(exp(raw_score)) OVER (PARTITION BY id) * exp(max(raw_score) OVER (PARTITION BY id)) AS probability FROM rs)"""


def _requests(spark, sf):
    options = "array(named_struct('id', 'alpha', 'description', 'the of inea er on th'), named_struct('id', 'beta', 'description', 'de la que ion'), named_struct('id', 'gamma', 'description', 'der die und sch'), named_struct('id', 'delta', 'description', 'erly hath ion on'))"
    return rel.spread(read(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("state"), F.lit("which of the th er on").alias("question"), F.expr(options).alias("options"))


@query(f"WITH {OPTIONS_SQL} SELECT id, option, round(raw_score, 6) AS raw_score, round(probability, 6) AS probability FROM pr")
def option_softmax(spark, sf):
    return decide.probabilities(decide.word_scores(_requests(spark, sf))).select("id", "option", _r("raw_score"), _r("probability"))


@query(f"""WITH {OPTIONS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY probability DESC, ord DESC) AS rn FROM pr)
  SELECT id, max(option) FILTER (rn = 1) AS chosen, round(max(probability), 6) AS probability, round(max(probability) - max(probability) FILTER (rn = 2), 6) AS margin FROM x GROUP BY 1""")
def top_margin(spark, sf):
    return decide.decide(_requests(spark, sf)).select("id", "chosen", _r("probability"), _r("margin"))


@query(f"WITH {OPTIONS_SQL} SELECT id, count(*) FILTER (1 - probability <= 0.65) AS set_size, count(*) FILTER (1 - probability <= 0.65) = 1 AS commit FROM pr GROUP BY 1")
def conformal_set(spark, sf):
    return decide.conformal(decide.probabilities(decide.word_scores(_requests(spark, sf))), 0.65)


@query(f"WITH {OPTIONS_SQL} SELECT id, option, round(raw_score, 6) AS raw_score FROM rs")
def debiased_scores(spark, sf):
    return decide.debiased(_requests(spark, sf)).select("id", "option", _r("raw_score"))


@query(f"""WITH {TOK_SQL}, {SCORE_SQL}, h AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM sc QUALIFY rn <= 30), m AS (SELECT max(score) AS m FROM h),
  x AS (SELECT doc_id, rn <= 5 AS head, CASE WHEN rn <= 5 THEN 0.55 * (1.0 / (1 + doc_id % 10)) + 0.45 * score / m ELSE score END AS score FROM h, m)
  SELECT doc_id AS chunk_id, head, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY head DESC, x.score DESC, doc_id) AS INTEGER) AS rank FROM x""")
def blend_head(spark, sf):
    hits = retrieval.search(rel.chunks(spark, sf), QUERY, k=30)
    probs = hits.select(F.col("chunk_id").alias("option"), (F.lit(1.0) / (1 + F.col("chunk_id") % 10)).alias("probability"))
    return decide.rank_hits(decide.blend(hits, probs, "chunk_id"), "chunk_id").select("chunk_id", "head", _r("score"), "rank")


@query("""SELECT doc_id, CASE WHEN n >= 1000 THEN 'big' ELSE 'small' END AS size, n AS tokens FROM (SELECT doc_id, CAST(octet_length(encode(text)) // 4 AS BIGINT) AS n FROM documents)""")
def token_sizes(spark, sf):
    n = tx.approx_tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.when(n >= 1000, "big").otherwise("small").alias("size"), n.alias("tokens"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-') AS s FROM documents)""")
def heading_slugs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.heading_slug(F.col("text")).alias("slug"))


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_LETTERS = lambda text: f"list_transform(string_split('{_ALPHABET}', ''), lambda x: CAST(length({text}) - length(replace({text}, x, '')) AS DOUBLE))"


def _letters(texts):
    """How often each letter is in a text: a small embedding that SQL knows too."""
    return texts.select("key", F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(x)))).cast("float") for x in _ALPHABET]).alias("vector"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents), k AS (SELECT text, bool_or(lang = 'en') AS warm FROM d GROUP BY 1), q AS (SELECT {_LETTERS("'" + QUERY + "'")} AS q),
  n AS (SELECT count(*) FILTER (warm) AS first_run, count(*) FILTER (NOT warm) AS second_run FROM k)
  SELECT doc_id, sha256(text) AS key, warm, first_run, second_run, 0::BIGINT AS third_run, round(CASE WHEN list_sum({_LETTERS('text')}) = 0 THEN 0 ELSE list_cosine_similarity({_LETTERS('text')}, q) END, 6) AS cosine FROM d JOIN k USING (text) CROSS JOIN q CROSS JOIN n""")
def vector_cache(spark, sf):
    """English documents fill the cache; then all of them do, which computes the texts that aren't there; then nothing is left to do."""
    path = shared_folder(spark, "vectors")
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("body"))
    first = vectorcache.fill(path, d.where("lang = 'en'"), "letters", _letters)
    before = vectorcache.cached(spark, path, "letters").select("key", F.lit(True).alias("warm"))
    second = vectorcache.fill(path, d, "letters", _letters)
    third = vectorcache.fill(path, d, "letters", _letters)
    probe = F.lit([float(QUERY.count(x)) for x in _ALPHABET])
    out = vectorcache.with_vectors(d, vectorcache.cached(spark, path, "letters")).join(before, "key", "left")
    runs = {n: F.lit(v).cast("long") for n, v in (("first_run", first), ("second_run", second), ("third_run", third))}
    return out.withColumns(runs).select("doc_id", "key", F.coalesce("warm", F.lit(False)).alias("warm"), *runs, F.round(vx.cosine(F.col("vector"), probe), 6).alias("cosine"))


@query("""SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 1) AS DOUBLE[])), 6) AS cosine FROM embeddings""")
def cosine_scan(spark, sf):
    e = read(spark, sf, "embeddings")
    probe = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 1").first().embedding])
    return e.select("vec_id", "label", F.round(vx.cosine(F.col("embedding"), probe), 6).alias("cosine"))


@query("""SELECT user_id, count(*) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20""")
def busiest_users(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.orderBy(F.desc("n"), "user_id").limit(20)


# Sources and streams


#: Sections of the files in f (path, content): headings outside fences of back-ticks, what stands before the first one, ordinals of equal slugs.
SECTIONS_SQL = r"""
  ln AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM f),
  mk AS (SELECT *, regexp_matches(line, '^ {0,3}```[^`]*$') AS mark FROM ln), fc AS (SELECT *, sum(CAST(mark AS INTEGER)) OVER (PARTITION BY path ORDER BY i) AS marks FROM mk),
  hd AS (SELECT *, NOT mark AND marks % 2 = 0 AND regexp_matches(line, '^ {0,3}#{1,6}([ \t]+.*)?$') AS head FROM fc), sx AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY path ORDER BY i) AS sec FROM hd),
  se AS (SELECT path, sec, min(i) AS start_line, max(i) AS end_line, coalesce(max(line) FILTER (head), '') AS top, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '') AS body FROM sx GROUP BY 1, 2),
  nm AS (SELECT *, length(regexp_extract(top, '^ {0,3}(#{1,6})', 1)) AS heading_level, trim(regexp_replace(regexp_replace(top, '^ {0,3}#{1,6}', ''), '([ \t]+#+)?[ \t]*$', '')) AS heading FROM se WHERE sec > 0 OR regexp_matches(body, '\S')),
  sl AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(heading), '[^\p{L}\p{N}_]+', '-', 'g'), '-'), ''), 'section') AS slug FROM nm), od AS (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY start_line) AS ordinal FROM sl)
  SELECT path, heading, CAST(heading_level AS INTEGER) AS heading_level, CASE WHEN ordinal = 1 THEN slug ELSE slug || '#' || ordinal END AS anchor, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line"""


@query(f"WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS content FROM documents), {SECTIONS_SQL} FROM od")
def md_sections(spark, sf):
    """The Markdown parser over every document as a file; headings are rare there, `md_outline` and tests/ have many."""
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("rel"), F.col("text").alias("content"))
    return files.sections(d).select("path", "heading", "heading_level", "anchor", "start_line", "end_line")


_TURN_SQL = """'## ' || coalesce(role, '') || CASE turn % 3 WHEN 1 THEN ' ##' ELSE '' END || chr(10) || coalesce(text, '') || CASE turn % 2 WHEN 1 THEN chr(10) || '```sql' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || '### Über ' || turn ELSE '' END"""


@query(f"""WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS path, 'before' || chr(10) || '# Chat ' || conv_id || chr(10) || string_agg({_TURN_SQL}, chr(10) ORDER BY turn, role, text) AS content FROM conversations GROUP BY 1, conv_id), {SECTIONS_SQL}, ordinal, trim(body, chr(10)) AS body FROM od""")
def md_outline(spark, sf):
    """Every conversation as a Markdown file: a heading a turn, many of them equal, with code blocks and headings below."""
    c = read(spark, sf, "conversations").withColumn("part", F.expr(_TURN_SQL.replace("chr(10)", "char(10)")))
    # A conversation is a file, so it is one row.
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "part"))), lambda x: x["part"])
    f = c.groupBy("conv_id").agg(F.array_join(turns, "\n").alias("turns"))
    f = f.select(F.col("conv_id").cast("string").alias("rel"), F.concat(F.lit("before\n# Chat "), "conv_id", F.lit("\n"), "turns").alias("content"))
    return files.sections(f).select("path", "heading", "heading_level", "anchor", "start_line", "end_line", F.col("ordinal").cast("long").alias("ordinal"), "body")


@query(r"SELECT CAST(page_id AS VARCHAR) AS rel, i AS line, href AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))) AS i FROM pages)".replace('\\"', '"'))
def page_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("rel"), F.posexplode(found).alias("line", "target")).withColumn("line", F.col("line").cast("long"))


def _events(spark, sf):
    from ..streaming import rollups

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return rollups, spark.readStream.schema(schema).format("parquet").load(f"{sf}/events.parque[t]")


def _name(what: str) -> str:
    import uuid

    return f"{what}_{uuid.uuid4().hex}"


@query("SELECT event_type AS tool, count(*) AS calls, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY 1")
def stream_rollup(spark, sf):
    rollups, e = _events(spark, sf)
    return rollups.drain(rollups.tool_rollup(e), _name("rollup")).select("tool", "calls", _r("total", 4), "peak")


@query("SELECT date_trunc('day', ts) AS start, event_type AS tool, count(*) AS calls FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-30' GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Closed windows only: the last day stays open until the watermark passes it."""
    rollups, e = _events(spark, sf)
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    return rollups.drain(rollups.windowed_rollup(e), _name("windows"), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "tool", "calls").where("start < TIMESTAMP_NTZ '2024-01-30'")


def _stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(f"""WITH {rel.JOURNAL_SQL}, k AS (SELECT *, max(CASE WHEN kind = 'check_in' THEN seq END) OVER w AS s FROM jr WINDOW w AS (PARTITION BY agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  o AS (SELECT *, min(CASE WHEN kind = 'check_out' THEN seq END) OVER (PARTITION BY agent_id, s) AS gone FROM k WHERE s IS NOT NULL), v AS (SELECT * FROM o WHERE gone IS NULL OR seq <= gone), l AS (SELECT agent_id, max(s) AS s FROM v GROUP BY 1)
  SELECT v.agent_id, arg_max(state, seq) FILTER (state IS NOT NULL) AS state, arg_max(note, seq) FILTER (note IS NOT NULL) AS note, max(seq) AS revision, count(*) AS events, arg_max(kind, seq) = 'check_out' AS checked_out FROM v JOIN l ON v.agent_id = l.agent_id AND v.s = l.s GROUP BY 1""")
def stream_presence(spark, sf):
    _stateful(spark)
    rollups, e = _events(spark, sf)
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "signup", "check_in").when(F.col("event_type") == "purchase", "check_out").otherwise("update")
    j = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("agent_id"), kind.alias("kind"), F.when(F.col("event_type").isin("signup", "click"), F.concat(F.lit("state"), F.col("event_id") % 4)).alias("state"), F.when(F.col("event_type") == "view", F.concat(F.lit("note"), F.col("event_id") % 7)).alias("note"), F.when(F.col("event_type") != "error", ts + 300).alias("expires_at"))
    out = rollups.drain(rollups.presence(j), _name("presence"), "update")
    return out.groupBy("agent_id").agg(F.max_by(F.struct("state", "note", "revision", "events", "checked_out"), "revision").alias("r")).select("agent_id", "r.*")


@query("""WITH e AS (SELECT user_id % 16 AS proc, event_id AS ord, event_id // 2 AS ptr, event_id % 2 = 0 AS a, CAST(floor(value) AS BIGINT) + 1 AS size FROM events),
  d AS (SELECT *, CASE WHEN a THEN size ELSE -coalesce(max(CASE WHEN a THEN size END) OVER (PARTITION BY proc, ptr), 0) END AS delta FROM e),
  r AS (SELECT proc, ord, sum(delta) OVER (PARTITION BY proc ORDER BY ord) AS live FROM d)
  SELECT proc, CAST(arg_max(live, ord) AS BIGINT) AS live, CAST(greatest(max(live), 0) AS BIGINT) AS peak FROM r GROUP BY 1""")
def stream_allocs(spark, sf):
    _stateful(spark)
    from ..streaming import rollups

    e = read(spark, sf, "events")
    a = e.select((F.col("user_id") % 16).alias("proc"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("F").alias("kind"), F.floor(F.col("event_id") / 2).cast("long").alias("ptr"), F.lit(None).cast("long").alias("new_ptr"), (F.floor("value") + 1).cast("long").alias("size"))
    return rollups.drain_in_order(a, "ord", rollups.allocations, _name("allocs"), "update", "proc").select("proc", "live", "peak")


#: Presence requests: a user's events, five users to a group; clients know the lease of their last check-in, if it was accepted.
REQUESTS_SQL = """e AS (SELECT event_id AS e, user_id AS u, event_type AS t, ts, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signed,
    max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id // 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_at FROM events),
  q AS (SELECT 'g' || (u // 5) AS grp, e AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS now, 'a' || u AS agent_id, CASE t WHEN 'signup' THEN 'check_in' WHEN 'purchase' THEN 'check_out' ELSE 'update' END AS kind,
    CASE WHEN e % 11 <> 0 AND (t <> 'signup' OR e % 3 = 0) THEN substr(md5('a' || u || '|' || signed), 1, 16) END AS lease_id, CASE WHEN e % 13 = 0 THEN e % 4 END AS expected_revision, e % 7 = 3 AS force,
    CASE WHEN e % 6 < 5 THEN ['live_code', 'suspended', 'checked_in', 'checked_out', 'away'][1 + e % 6] END AS state, CASE WHEN e % 3 = 0 THEN 3600 * (1 + e % 50) END AS ttl_secs, CASE WHEN e % 5 = 0 THEN e % 3 END AS dirty,
    CASE WHEN e % 4 = 1 THEN 'stash' END AS checkpoint, CASE WHEN e % 10 = 1 THEN 'lost' WHEN e % 2 = 0 THEN 'handed_off' END AS reason, CASE WHEN e % 4 = 0 THEN 'a' || (u // 5 * 5 + e % 5) WHEN e % 8 = 2 THEN '' END AS handoff_to,
    CASE WHEN t = 'signup' AND e % 2 = 0 THEN 'h' || left_at END AS handoff_id, CASE WHEN e % 9 = 0 THEN 'k' || (u % 5) || '-' || (e // 20000) END AS idempotency_key,
    row_number() OVER (PARTITION BY u // 5 ORDER BY e) AS n FROM e)"""


def presence_requests(e):
    """The requests of a frame of events, a stream or not, less what needs a window: signed and left_at are columns of it."""
    i, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    agent = F.concat(F.lit("a"), u)
    states = F.array(*[F.lit(x) for x in ("live_code", "suspended", "checked_in", "checked_out", "away")])
    return e.select(
        F.concat(F.lit("g"), F.floor(u / 5)).alias("grp"),
        i.alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("now"),
        agent.alias("agent_id"),
        F.when(t == "signup", "check_in").when(t == "purchase", "check_out").otherwise("update").alias("kind"),
        F.when((i % 11 != 0) & ((t != "signup") | (i % 3 == 0)), F.substring(F.md5(F.concat(agent, F.lit("|"), F.col("signed"))), 1, 16)).alias("lease_id"),
        F.when(i % 13 == 0, i % 4).alias("expected_revision"),
        (i % 7 == 3).alias("force"),
        F.when(i % 6 < 5, F.get(states, (i % 6).cast("int"))).alias("state"),
        F.when(i % 3 == 0, 3600 * (1 + i % 50)).alias("ttl_secs"),
        F.when(i % 5 == 0, i % 3).alias("dirty"),
        F.when(i % 4 == 1, "stash").alias("checkpoint"),
        F.when(i % 10 == 1, "lost").when(i % 2 == 0, "handed_off").alias("reason"),
        F.when(i % 4 == 0, F.concat(F.lit("a"), F.floor(u / 5) * 5 + i % 5)).when(i % 8 == 2, "").alias("handoff_to"),
        F.when((t == "signup") & (i % 2 == 0), F.concat(F.lit("h"), F.col("left_at"))).alias("handoff_id"),
        F.when(i % 9 == 0, F.concat(F.lit("k"), u % 5, F.lit("-"), F.floor(i / 20000))).alias("idempotency_key"),
    )


#: Each group's requests one after the other, with its state in maps.
_AGENT = "STRUCT(state VARCHAR, lease VARCHAR, revision BIGINT, ends BIGINT, ttl BIGINT, dirty BIGINT, checkpoint VARCHAR)"
_OFFER = "STRUCT(recipient VARCHAR, status VARCHAR)"


@query(f"""WITH RECURSIVE {REQUESTS_SQL},
  run AS (SELECT DISTINCT grp, 0::BIGINT AS n, MAP([]::VARCHAR[], []::{_AGENT}[]) AS agents, MAP([]::VARCHAR[], []::{_OFFER}[]) AS offers, MAP([]::VARCHAR[], []::BIGINT[]) AS keys,
      NULL::STRUCT(seq BIGINT, agent_id VARCHAR, kind VARCHAR, status VARCHAR, error VARCHAR, lease VARCHAR, revision BIGINT, state VARCHAR, expires_at BIGINT, handoff VARCHAR, repeats BIGINT, now BIGINT) AS v FROM q
    UNION ALL
    SELECT grp, n, CASE WHEN status = 'ok' THEN map_concat(agents, MAP([agent_id], [x])) ELSE agents END,
      CASE WHEN status = 'ok' AND kind = 'check_out' AND handoff_to IS NOT NULL THEN map_concat(offers, MAP(['h' || seq], [struct_pack(recipient := handoff_to, status := 'offered')]))
        WHEN status = 'ok' AND kind = 'check_in' AND handoff_id IS NOT NULL THEN map_concat(offers, MAP([handoff_id], [struct_pack(recipient := o.recipient, status := 'accepted')])) ELSE offers END,
      CASE WHEN status = 'ok' AND idempotency_key IS NOT NULL THEN map_concat(keys, MAP([idempotency_key], [seq])) ELSE keys END,
      struct_pack(seq := seq, agent_id := agent_id, kind := kind, status := status, error := CASE WHEN status = 'refused' THEN error END, lease := CASE WHEN status = 'ok' THEN x.lease END, revision := CASE WHEN status = 'ok' THEN x.revision END, state := CASE WHEN status = 'ok' THEN x.state END,
        expires_at := CASE WHEN status = 'ok' AND kind <> 'check_out' THEN x.ends END, handoff := CASE WHEN status = 'ok' AND kind = 'check_out' AND handoff_to IS NOT NULL THEN 'h' || seq END, repeats := CASE WHEN status = 'repeat' THEN rep END, now := now)
    FROM (SELECT *, CASE WHEN rep IS NOT NULL THEN 'repeat' WHEN kind = 'check_out' AND known AND NOT live THEN 'already' WHEN error IS NOT NULL THEN 'refused' ELSE 'ok' END AS status,
        {{'state': CASE kind WHEN 'check_in' THEN 'checked_in' WHEN 'update' THEN want ELSE 'checked_out' END, 'lease': CASE WHEN kind <> 'check_in' OR mine THEN a.lease ELSE substr(md5(agent_id || '|' || seq), 1, 16) END, 'revision': coalesce(a.revision, 0) + 1,
          'ends': CASE kind WHEN 'check_in' THEN now + coalesce(ttl_secs, 43200) WHEN 'update' THEN now + CASE WHEN want = 'suspended' THEN 604800 ELSE coalesce(ttl_secs, greatest(a.ttl, 43200)) END ELSE a.ends END,
          'ttl': CASE WHEN kind = 'check_in' THEN coalesce(ttl_secs, 43200) ELSE a.ttl END, 'dirty': CASE kind WHEN 'check_in' THEN coalesce(dirty, 0) WHEN 'update' THEN coalesce(dirty, a.dirty) ELSE 0 END, 'checkpoint': CASE WHEN kind = 'check_in' THEN checkpoint WHEN kind = 'update' THEN coalesce(checkpoint, a.checkpoint) ELSE a.checkpoint END}}::{_AGENT} AS x
      FROM (SELECT *, CASE kind WHEN 'check_in' THEN CASE WHEN live AND NOT mine AND now < a.ends AND NOT force THEN 'checked in' WHEN expected_revision <> coalesce(a.revision, 0) THEN 'revision conflict'
            WHEN handoff_id IS NULL THEN NULL WHEN o IS NULL THEN 'unknown handoff' WHEN o.status <> 'offered' THEN 'handoff not offered' WHEN o.recipient <> '' AND o.recipient <> agent_id THEN 'handoff is another''s' END
          ELSE CASE WHEN NOT known OR (kind = 'update' AND NOT live) THEN 'not checked in' WHEN lease_id IS NULL THEN 'lease required' WHEN lease_id <> a.lease THEN 'lease mismatch' WHEN expected_revision <> a.revision THEN 'revision conflict'
            WHEN kind = 'update' THEN CASE WHEN want = 'away' THEN 'unknown state' WHEN want = 'checked_out' THEN 'update can''t check out' WHEN want = 'suspended' AND coalesce(dirty, a.dirty) > 0 AND coalesce(checkpoint, a.checkpoint) IS NULL THEN 'checkpoint required' END
            WHEN reason = 'lost' THEN 'unknown reason' WHEN reason = 'handed_off' AND handoff_to IS NULL THEN 'handoff required' END END AS error
        FROM (SELECT *, a IS NOT NULL AS known, coalesce(a.state <> 'checked_out', false) AS live, coalesce(a.state <> 'checked_out' AND lease_id = a.lease, false) AS mine, coalesce(state, a.state) AS want
          FROM (SELECT q.*, run.agents, run.offers, run.keys, run.agents[q.agent_id] AS a, run.offers[q.handoff_id] AS o, run.keys[q.idempotency_key] AS rep FROM run JOIN q ON q.grp = run.grp AND q.n = run.n + 1)))))
  , ok AS (SELECT grp, v.*, lead(v.now) OVER (PARTITION BY grp, v.agent_id ORDER BY v.seq) AS next FROM run WHERE v.status = 'ok'),
  final AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
  SELECT grp, v.seq AS seq, v.agent_id AS agent_id, v.kind AS kind, v.status AS status, v.error AS error, v.lease AS lease, v.revision AS revision, v.state AS state, v.expires_at AS expires_at, v.handoff AS handoff, v.repeats AS repeats FROM run WHERE n > 0
  UNION ALL
  SELECT grp, NULL, agent_id, 'lease', 'expired', NULL, lease, revision, state, expires_at, NULL, NULL FROM ok, final WHERE kind <> 'check_out' AND (next >= expires_at OR (next IS NULL AND make_timestamp(expires_at * 1000000) <= mark))""")
def presence_gate(spark, sf):
    """All requests of all groups as a stream, several an agent, each judged after the one before it."""
    from ..streaming import gate, rollups

    _stateful(spark)
    mine = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(F.floor(F.col("user_id") / 5)).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    known = lambda kind, w: F.max(F.when(F.col("event_type") == kind, F.col("event_id"))).over(w)
    asked = stored(presence_requests(read(spark, sf, "events").withColumns({"signed": known("signup", mine), "left_at": known("purchase", group)})), "presence-requests")
    stream = spark.readStream.schema(asked.schema).parquet(asked.inputFiles()[0].rsplit("/", 1)[0])
    return rollups.drain(gate.judged(stream, ttl=43_200, suspend_ttl=604_800), _name("gate"), "append")


@query("""WITH s AS (SELECT 'h' || (user_id % 8) AS host, event_id AS seq, value, CAST(floor(value) AS BIGINT) % 3 AS m, event_id // 50 AS g FROM events),
  w AS (SELECT *, row_number() OVER w AS n, lag(seq, 119) OVER w AS old, first(seq) OVER w AS start, count(*) FILTER (value >= 25) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS hitches, lag(m) OVER w AS was, lag(g) OVER w AS had FROM s WINDOW w AS (PARTITION BY host ORDER BY seq))
  SELECT host, seq, value >= 25 AS hitch, CAST(least(n, 120) AS INTEGER) AS kept, coalesce(old, start) AS oldest_seq, CAST(hitches AS INTEGER) AS hitches, CASE WHEN was IS DISTINCT FROM m THEN CAST(m AS DOUBLE) END AS mode, had IS DISTINCT FROM g AS map_dirty, CASE WHEN had IS DISTINCT FROM g THEN 'r' || g END AS regions FROM w""")
def stream_timeline(spark, sf):
    """Events as samples of eight hosts: the last 120, hitches among them, and what changed."""
    from ..streaming import captures, rollups

    _stateful(spark)
    e = read(spark, sf, "events")
    metrics = F.create_map(F.lit("value"), F.col("value"), F.lit("mode"), (F.floor("value") % 3).cast("double"))
    samples = e.select(F.concat(F.lit("h"), F.col("user_id") % 8).alias("host"), F.col("event_id").alias("seq"), F.lit("sample").alias("kind"), F.col("value").alias("presented_ms"), metrics.alias("metrics"), F.concat(F.lit("r"), F.floor(F.col("event_id") / 50)).alias("regions"))
    out = rollups.drain_in_order(samples, "seq", captures.timeline, _name("timeline"))
    return out.select("host", "seq", "hitch", "kept", "oldest_seq", "hitches", F.try_element_at("changed", F.lit("mode")).alias("mode"), "map_dirty", "regions")


@query("""WITH s AS (SELECT user_id % 8 AS host, user_id AS pid, ts, event_id AS seq FROM events WHERE event_type <> 'error'), o AS (SELECT user_id % 8 AS host, CASE WHEN event_id % 2 = 0 THEN user_id END AS pid, ts AS received, event_id AS n FROM events WHERE event_type = 'error'),
  j AS (SELECT s.seq, s.pid, arg_max(o.n, o.received) AS n FROM s LEFT JOIN o ON s.host = o.host AND (o.pid IS NULL OR o.pid = s.pid) AND o.received <= s.ts AND o.received >= s.ts - INTERVAL 2 HOUR WHERE s.ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2)
  SELECT seq, coalesce('live ' || n, 'own') AS lifetime, n IS NOT NULL AS alloc_hooks, n IS NULL OR n % 3 <> 0 AS pmc, n % 5 AS overlay_dropped, n IS NOT NULL AS overlaid FROM j""")
def stream_overlays(spark, sf):
    """Errors as overlays of the other events of their host, half of them for one process only."""
    from ..streaming import captures

    rollups, e = _events(spark, sf)
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    n, host, none = F.col("event_id"), F.col("user_id") % 8, F.lit(None).cast("string")
    flags = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    snaps = e.where("event_type != 'error'").select(host.alias("host"), F.col("user_id").alias("pid"), "ts", n.alias("seq"), F.lit("own").alias("lifetime"), none.alias("locality"), flags(alloc_hooks=F.lit(False), pmc=F.lit(True)).alias("capabilities"), F.create_map().cast("map<string,string>").alias("quality"))
    overs = e.where("event_type = 'error'").select(host.alias("host"), F.when(n % 2 == 0, F.col("user_id")).alias("pid"), F.col("ts").alias("received"), F.concat(F.lit("live "), n).alias("lifetime"), none.alias("locality"), flags(alloc_hooks=F.lit(True), pmc=n % 3 != 0, other=F.lit(True)).alias("capabilities"), F.create_map(F.lit("lifetime"), F.lit("sampled")).alias("quality"), (n % 5).alias("dropped"), F.lit(1.0).alias("estimated_overhead_pct"))
    out = rollups.drain(captures.overlaid(snaps, overs, "2 HOURS"), _name("overlays"), "append").where("ts < TIMESTAMP '2024-01-29'")
    return out.select("seq", "lifetime", F.col("capabilities")["alloc_hooks"].alias("alloc_hooks"), F.col("capabilities")["pmc"].alias("pmc"), "overlay_dropped", "overlaid")


# Digests, presence requests and stores

STATUS_SQL = """st AS (SELECT p_size % 7 AS run, p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN '??' WHEN 1 THEN ' M' WHEN 2 THEN 'A ' WHEN 3 THEN 'D ' WHEN 4 THEN 'RM' ELSE 'UU' END AS code, lower(p_type) AS folder, p_name || p_partkey AS name FROM part)"""


@query(f"""WITH {STATUS_SQL}, k AS (SELECT run, ord, CASE trim(code) WHEN '??' THEN 'untracked ' || folder WHEN 'M' THEN 'modified' WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'RM' THEN 'renamed' ELSE 'other' END AS kind, CASE WHEN code <> '??' THEN folder || '/' || name END AS path FROM st),
  r AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY ord) AS rn FROM k)
  SELECT run, kind, count(*) AS n, coalesce(string_agg(path, chr(10) ORDER BY ord) FILTER (rn <= 40), '') AS paths, greatest(count(path) - 40, 0) AS more FROM r GROUP BY 1, 2""")
def digest_status(spark, sf):
    p = read(spark, sf, "part")
    code = F.element_at(F.lit(["??", " M", "A ", "D ", "RM", "UU"]), (F.col("p_partkey") % 6 + 1).cast("int"))
    lines = p.select((F.col("p_size") % 7).alias("run"), F.col("p_partkey").alias("ord"), F.concat(code, F.lit(" "), F.lower("p_type"), F.lit("/"), F.col("p_name"), F.col("p_partkey")).alias("text"))
    lines = lines.unionByName(lines.select("run", F.lit(0).cast("long").alias("ord"), F.lit("## main...origin/main").alias("text")).distinct())
    return digest.status(lines).withColumn("paths", F.array_join("paths", "\n"))


@query("SELECT o_custkey AS run, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS hash, o_orderpriority || ' ' || o_orderkey AS subject FROM orders WHERE o_orderkey % 9 <> 0")
def digest_log(spark, sf):
    """A customer's orders as its commits; every ninth has no subject."""
    o = read(spark, sf, "orders")
    subject = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("    "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey"))).otherwise(F.lit(""))
    parts = F.array(F.concat(F.lit("commit "), F.md5(F.col("o_orderkey").cast("string"))), F.lit("Author: someone"), F.lit("Date: today"), F.lit(""), subject)
    lines = o.select(F.col("o_custkey").alias("run"), "o_orderkey", F.posexplode(parts).alias("at", "text")).select("run", (F.col("o_orderkey") * 8 + F.col("at")).alias("ord"), "text")
    return digest.log(lines).select("run", "hash", "subject")


_TEST_LINES = "t AS (SELECT l_suppkey AS run, l_returnflag AS flag, l_linenumber AS line FROM lineitem)"


@query(f"WITH {_TEST_LINES} SELECT run, count(*) FILTER (flag = 'A') AS passed, count(*) FILTER (flag = 'R') AS failed, count(*) FILTER (flag = 'R' OR (flag = 'N' AND line = 1)) AS kept FROM t GROUP BY 1")
def digest_ctest(spark, sf):
    flag = F.col("l_returnflag")
    text = F.when(flag == "A", "1/9 Test #1: a ... Passed").when(flag == "R", "2/9 Test #2: b ...***Failed").when(F.col("l_linenumber") == 1, "90% tests passed").otherwise("Start 1: a")
    return digest.ctest(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), text.alias("text")))[0]


_RUN_SQL = "l AS (SELECT user_id % 50 AS run, event_id AS ord, CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'R' ELSE 'N' END AS flag FROM events)"


def _run_lines(spark, sf, a: str, r: str, n: str) -> DataFrame:
    """Users' events as lines of 50 runs: clicks, errors, and all others."""
    text = F.when(F.col("event_type") == "click", a).when(F.col("event_type") == "error", r).otherwise(n)
    return read(spark, sf, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_id").alias("ord"), text.alias("text"))


@query(f"""WITH {_RUN_SQL}, b AS (SELECT *, last_value(CASE WHEN flag <> 'N' THEN flag END IGNORE NULLS) OVER (PARTITION BY run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
  SELECT run, count(*) FILTER (flag = 'A') AS passed, count(*) FILTER (flag = 'R') AS failed, count(*) FILTER (flag = 'R' OR (flag = 'N' AND before = 'R')) AS kept FROM b GROUP BY 1""")
def digest_cargo_test(spark, sf):
    """Errors fail, clicks pass, other events are indented lines."""
    return digest.cargo_test(_run_lines(spark, sf, "test a ... ok", "test b ... FAILED", "    left: 1"))[0]


@query(f"""WITH {_RUN_SQL}, r AS (SELECT *, count(*) FILTER (flag = 'A') OVER (PARTITION BY run ORDER BY ord) AS file FROM l),
  c AS (SELECT *, count(*) FILTER (flag = 'R') OVER (PARTITION BY run, file ORDER BY ord) AS n FROM r)
  SELECT run, ord, CASE WHEN flag = 'A' THEN 'diff --git a b' WHEN n <= 1 THEN '+x' ELSE '…' END AS text FROM c WHERE flag = 'A' OR (flag = 'R' AND n <= 2)""")
def digest_diff(spark, sf):
    return digest.diff(_run_lines(spark, sf, "diff --git a b", "+x", " same"), cap=1)


@query(f"WITH {_RUN_SQL} SELECT run, ord FROM l WHERE flag <> 'N'")
def digest_build(spark, sf):
    return digest.build(_run_lines(spark, sf, "Finished dev", "ERROR: no", "Compiling x")).select("run", "ord")


ADMIT_SQL = """ag AS (SELECT 'c' || c_custkey AS agent_id, CASE c_custkey % 4 WHEN 0 THEN 'checked_out' WHEN 1 THEN 'suspended' ELSE 'checked_in' END AS state, 'L' || c_custkey % 3 AS lease, c_custkey % 5 AS revision, c_custkey % 11 * 100 AS expires_at, c_custkey % 2 AS dirty FROM customer),
  rq AS (SELECT o_orderkey AS ord, 'c' || (o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 10000000 ELSE 0 END) AS agent_id, CASE o_orderstatus WHEN 'O' THEN 'check_in' WHEN 'F' THEN 'update' ELSE 'check_out' END AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN 'L' || o_custkey % CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END END AS lease,
    CASE WHEN o_orderkey % 6 = 0 THEN o_custkey % 5 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END END AS expected, o_orderkey % 10 = 3 AS force, CASE o_orderkey % 8 WHEN 1 THEN 'suspended' WHEN 2 THEN 'checked_out' WHEN 3 THEN 'live_code' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 50 END AS ttl, CASE WHEN o_orderkey % 16 = 1 THEN 'stash' END AS checkpoint,
    CASE WHEN o_orderkey % 2 = 0 THEN 'handed_off' END AS reason, o_orderkey % 4 = 0 AS handoff, CASE WHEN o_orderkey % 15 = 0 THEN 'h' || o_orderkey % 4 END AS handoff_id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 13 = 0 ORDER BY o_orderkey) AS rn FROM orders),
  ho(handoff_id, recipient, offer) AS (VALUES ('h0', '', 'offered'), ('h1', 'c1', 'offered'), ('h2', '', 'accepted'))"""


@query(f"""WITH {ADMIT_SQL}, j AS (SELECT rq.*, ag.state AS now_state, ag.lease AS now_lease, ag.revision AS have, ag.expires_at AS until, ag.dirty, ho.offer, ho.recipient FROM rq LEFT JOIN ag USING (agent_id) LEFT JOIN ho USING (handoff_id)),
  e AS (SELECT *, CASE WHEN rn > 1 THEN NULL
    WHEN kind = 'check_in' THEN CASE WHEN now_state <> 'checked_out' AND lease IS DISTINCT FROM now_lease AND NOT (until > 0 AND 600 >= until) AND NOT force THEN 'checked in' WHEN expected <> coalesce(have, 0) THEN 'revision conflict'
      WHEN handoff_id IS NULL THEN NULL WHEN offer IS NULL THEN 'unknown handoff' WHEN offer <> 'offered' THEN 'handoff not offered' WHEN recipient <> '' AND recipient <> agent_id THEN 'handoff is another''s' END
    WHEN have IS NULL THEN 'not checked in' WHEN now_state = 'checked_out' THEN CASE WHEN kind = 'update' THEN 'not checked in' END
    WHEN lease IS NULL THEN 'lease required' WHEN lease <> now_lease THEN 'lease mismatch' WHEN expected <> have THEN 'revision conflict'
    WHEN kind = 'update' THEN CASE WHEN state = 'checked_out' THEN 'update can''t check out' WHEN coalesce(state, now_state) = 'suspended' AND dirty > 0 AND checkpoint IS NULL THEN 'checkpoint required' END
    WHEN reason = 'handed_off' AND NOT handoff THEN 'handoff required' END AS error FROM j),
  s AS (SELECT *, CASE WHEN rn > 1 THEN 'deferred' WHEN error IS NOT NULL THEN 'refused' WHEN kind = 'check_out' AND now_state = 'checked_out' THEN 'already' ELSE 'ok' END AS status FROM e)
  SELECT ord, agent_id, kind, status, error, CASE WHEN status = 'ok' THEN CASE WHEN kind <> 'check_in' OR (now_state <> 'checked_out' AND lease = now_lease) THEN now_lease ELSE substr(md5(agent_id || '|' || (coalesce(have, 0) + 1) || '|600'), 1, 16) END END AS lease,
    CASE WHEN status = 'ok' THEN coalesce(have, 0) + 1 END AS revision, CASE WHEN status = 'ok' AND kind <> 'check_out' THEN 600 + CASE WHEN kind = 'update' AND coalesce(state, now_state) = 'suspended' THEN 86400 ELSE coalesce(ttl, 300) END END AS expires_at FROM s""")
def presence_admit(spark, sf):
    """Customers as agents and orders as their requests; every thirteenth comes from a stranger."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    agents = read(spark, sf, "customer").select(F.concat(F.lit("c"), k).alias("agent_id"), F.when(k % 4 == 0, "checked_out").when(k % 4 == 1, "suspended").otherwise("checked_in").alias("state"), F.concat(F.lit("L"), k % 3).alias("lease_id"), (k % 5).alias("revision"), (k % 11 * 100).alias("expires_at"), F.lit(300).alias("ttl_secs"), (k % 2).alias("dirty"), F.lit(None).cast("string").alias("checkpoint"))
    cust = F.col("o_custkey")
    requests = read(spark, sf, "orders").select(
        o.alias("ord"),
        F.concat(F.lit("c"), cust + F.when(o % 13 == 0, 10_000_000).otherwise(0)).alias("agent_id"),
        F.when(F.col("o_orderstatus") == "O", "check_in").when(F.col("o_orderstatus") == "F", "update").otherwise("check_out").alias("kind"),
        F.when(o % 7 != 0, F.concat(F.lit("L"), cust % F.when(o % 5 == 0, 2).otherwise(3))).alias("lease_id"),
        F.when(o % 6 == 0, cust % 5 + F.when(o % 4 == 0, 1).otherwise(0)).alias("expected_revision"),
        (o % 10 == 3).alias("force"),
        F.when(o % 8 == 1, "suspended").when(o % 8 == 2, "checked_out").when(o % 8 == 3, "live_code").alias("state"),
        F.when(o % 3 == 0, 50).alias("ttl_secs"),
        F.lit(None).cast("long").alias("dirty"),
        F.when(o % 16 == 1, "stash").alias("checkpoint"),
        F.when(o % 2 == 0, "handed_off").alias("reason"),
        (o % 4 == 0).alias("handoff"),
        F.when(o % 15 == 0, F.concat(F.lit("h"), o % 4)).alias("handoff_id"),
    )
    handoffs = spark.sql("SELECT * FROM VALUES ('h0', '', 'offered'), ('h1', 'c1', 'offered'), ('h2', '', 'accepted') AS h(handoff_id, to, status)")
    return presence.admit(agents, requests, handoffs, now=600)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'source body: diff, patch' WHEN event_id % 4 = 1 THEN 'secret' END AS why FROM events""")
def payload_check(spark, sf):
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"patch": "x", "diff": "-----BEGIN y", "note": 1}').when(k == 1, '{"note": {"deep": ["-----BEGIN KEY"]}}').when(k == 2, '{"note": {"patch": "x"}}').otherwise("[]")
    return read(spark, sf, "events").select("event_id", presence.unsafe_payload(body).alias("why"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS used, CAST(p_size * 2 AS BIGINT) AS peak, CAST(p_partkey AS BIGINT) AS deep, CAST(NULL AS BIGINT) AS none FROM part")
def metric_pointers(spark, sf):
    """A part as a runtime snapshot in JSON."""
    pools = F.array(F.struct(F.lit("other").alias("name"), F.lit(1).alias("in_use"), F.lit(2).alias("peak")), F.struct(F.lit("heap").alias("name"), F.col("p_size").cast("int").alias("in_use"), (F.col("p_size") * 2).cast("int").alias("peak")))
    snap = F.to_json(F.struct(pools.alias("pools"), F.struct(F.array(F.lit(0), F.col("p_partkey")).alias("list")).alias("a/b"), F.col("p_brand").alias("label")))
    s = read(spark, sf, "part").select("p_partkey", snap.alias("s"))
    return s.select("p_partkey", runtime.metric(F.col("s"), "pools.heap").alias("used"), runtime.metric(F.col("s"), "pools.heap.peak").alias("peak"), runtime.metric(F.col("s"), "/a~1b/list/1").alias("deep"), runtime.metric(F.col("s"), "label").alias("none"))


@query("SELECT event_type AS mode, count(*) AS calls, count(*) FILTER (event_id % 3 = 0) AS board_calls, count(*) FILTER (event_id % 2 <> 0) AS fallback_calls, round(avg(event_id % 7), 6) AS ratio, round(avg(event_id % 5) FILTER (event_id % 4 <> 0), 6) AS \"precision\", count(*) FILTER (event_id % 4 <> 0) AS measured FROM events GROUP BY 1")
def optical_averages(spark, sf):
    e = F.col("event_id")
    calls = read(spark, sf, "events").select(F.col("event_type").alias("mode"), (e % 2 == 0).alias("used"), (e % 7).cast("double").alias("ratio"), F.when(e % 4 == 0, F.lit(float("nan"))).otherwise((e % 5).cast("double")).alias("precision"), (e % 3 == 0).alias("from_board"))
    return telemetry.averages(calls, "mode").withColumns({"ratio": F.round("ratio", 6), "precision": F.round("precision", 6)})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS mtime FROM orders ORDER BY mtime DESC, path LIMIT 100")
def recent_docs(spark, sf):
    files = rel.defects(spark, sf).select(F.col("id").cast("string").alias("path"), F.col("updated").alias("mtime"))
    return records.recent(files, 500)


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0)")
def manifest_outdated(spark, sf):
    """Orders as files: every fifth isn't in the manifest, every seventh is gone, every third has another time."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("path"))
    return records.outdated(o.where("path % 5 != 0").withColumn("mtime", F.lit(1)), o.where("path % 7 != 0").withColumn("mtime", F.when(F.col("path") % 3 == 0, 2).otherwise(1)))


# Source code: a part is a file in one of four languages.

_CODE = {
    "cpp": "/// {n}\nstruct P{k} : public B{s} {{\n  P{k}() {{ init{s}(); }}\n}};\nvoid P{k}::run() {{\n  T{s} v(make());\n  step<int>(v);\n  o.go{k}();\n}}\n",
    "rs": "/// {n}\nstruct P{k};\nimpl Tie for P{k} {{\n  fn run(&self) {{\n    fn inner() {{ deep{s}(); }}\n    inner();\n    self.x.go{k}();\n  }}\n}}\n",
    "ts": "/** {n} */\nclass P{k} extends B{s} {{\n  run = () => {{ this.go{k}(); }};\n  m() {{ new T(); step{s}(); }}\n}}\n",
    "cs": "/// {n}\nclass P{k} : B{s} {{\n  void Run() {{ var t = new T(); t.Go{k}(); }}\n  int N => Find{s}();\n}}\n",
}
CODE_SQL = "f AS (SELECT p_partkey AS k, p_size AS s, p_name AS n, ['cpp', 'rs', 'ts', 'cs'][1 + p_partkey % 4] AS ext, 'p' || p_partkey || '.' || ['cpp', 'rs', 'ts', 'cs'][1 + p_partkey % 4] AS rel FROM part)"


def code_files(spark, sf):
    k, texts = F.col("p_partkey"), []
    for text in _CODE.values():
        parts = F.lit(text.replace("{{", "{").replace("}}", "}"))
        for mark, value in (("{k}", k.cast("string")), ("{s}", F.col("p_size").cast("string")), ("{n}", F.col("p_name"))):
            parts = F.replace(parts, F.lit(mark), value)
        texts.append(parts)
    pick = (k % 4).cast("int")
    rel = F.concat(F.lit("p"), k, F.lit("."), F.get(F.array(*[F.lit(x) for x in _CODE]), pick))
    # Parsing a file takes longer than moving it, and a table of many small files may be one row group.
    part = read(spark, sf, "part").select("p_partkey", "p_size", "p_name").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select(rel.alias("rel"), F.get(F.array(*texts), pick).alias("content"))


@query(f"""WITH {CODE_SQL}, e AS (
  SELECT rel, 'P' || k || '::P' || k AS caller, 'init' || s AS callee, 3 AS line FROM f WHERE ext = 'cpp' UNION ALL SELECT rel, 'P' || k || '::run', 'make', 6 FROM f WHERE ext = 'cpp'
  UNION ALL SELECT rel, 'P' || k || '::run', 'step', 7 FROM f WHERE ext = 'cpp' UNION ALL SELECT rel, 'P' || k || '::run', 'go' || k, 8 FROM f WHERE ext = 'cpp'
  UNION ALL SELECT rel, 'P' || k || '::run::inner', 'deep' || s, 5 FROM f WHERE ext = 'rs' UNION ALL SELECT rel, 'P' || k || '::run', 'inner', 6 FROM f WHERE ext = 'rs' UNION ALL SELECT rel, 'P' || k || '::run', 'go' || k, 7 FROM f WHERE ext = 'rs'
  UNION ALL SELECT rel, 'P' || k || '::run', 'go' || k, 3 FROM f WHERE ext = 'ts' UNION ALL SELECT rel, 'P' || k || '::m', 'step' || s, 4 FROM f WHERE ext = 'ts'
  UNION ALL SELECT rel, 'P' || k || '::Run', 'Go' || k, 3 FROM f WHERE ext = 'cs' UNION ALL SELECT rel, 'P' || k || '::N', 'Find' || s, 4 FROM f WHERE ext = 'cs') SELECT * FROM e""")
def source_calls(spark, sf):
    return files.call_edges(code_files(spark, sf)).select("rel", "caller", "callee", "line")


@query(f"""WITH {CODE_SQL} SELECT rel, 'P' || k AS name, 'Record' AS kind, 2 AS line, n AS doc FROM f""")
def doc_comments(spark, sf):
    """The text of the comments above each documented definition."""
    return files.definitions(code_files(spark, sf)).where("doc IS NOT NULL").select("rel", "name", "kind", "line", "doc")


@query(f"""WITH {CODE_SQL}, o AS (SELECT 'B' || s AS name, 'ref' AS role FROM f WHERE ext <> 'rs' UNION ALL SELECT CASE ext WHEN 'cpp' THEN 'T' || s ELSE 'T' END, 'ref' FROM f WHERE ext <> 'rs'
  UNION ALL SELECT 'step' || CASE WHEN ext = 'ts' THEN CAST(s AS VARCHAR) ELSE '' END, 'call' FROM f WHERE ext IN ('cpp', 'ts') UNION ALL SELECT 'run', 'def' FROM f WHERE ext <> 'cs')
  SELECT name, role, count(*) AS n FROM o GROUP BY 1, 2""")
def source_roles(spark, sf):
    """How often bases, types, calls and methods occur, by role."""
    found = files.occurrences(code_files(spark, sf)).where(F.col("name").rlike("^([BT][0-9]*|step[0-9]*|run)$"))
    return found.groupBy("name", "role").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, i, 0 AS k, CASE WHEN i % 5 = 0 THEN 'gone' ELSE 'kept' END AS what FROM l UNION ALL SELECT doc_id, i, 1, 'fresh' FROM l WHERE i % 7 = 3),
  w AS (SELECT *, count(*) FILTER (what = 'kept') OVER b AS g, count(*) FILTER (what <> 'fresh') OVER b AS o, count(*) FILTER (what <> 'gone') OVER b AS n FROM s WINDOW b AS (PARTITION BY doc_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  h AS (SELECT doc_id, g, min(o) AS o, min(n) AS n, count(*) FILTER (what = 'gone') AS old_count, count(*) FILTER (what = 'fresh') AS new_count FROM w WHERE what <> 'kept' GROUP BY doc_id, g)
  SELECT doc_id, o + CASE WHEN old_count > 0 THEN 1 ELSE 0 END AS old_start, old_count, n + CASE WHEN new_count > 0 THEN 1 ELSE 0 END AS new_start, new_count FROM h""")
def line_diff(spark, sf):
    """Whole texts against versions without every fifth line and with a new one after some; lines are numbered, so that one
    shortest script is the only one."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat(i, F.lit(":"), x, F.lit("\n")))
    fresh = lambda x, i: F.filter(F.array(F.when((i + 1) % 5 != 0, x), F.when((i + 1) % 7 == 3, F.concat(F.lit("new "), i, F.lit("\n")))), lambda y: y.isNotNull())
    d = read(spark, sf, "documents").select("doc_id", numbered.alias("lines"))
    pairs = d.select("doc_id", F.array_join("lines", "").alias("old"), F.array_join(F.flatten(F.transform("lines", fresh)), "").alias("new"))
    return linediff.line_hunks(pairs)


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 2 ELSE 1 END AS mtime, line, CASE WHEN doc_id % 7 = 0 THEN 'new ' || body ELSE body END AS body
  FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM documents) WHERE doc_id % 11 <> 0 AND (doc_id % 5 <> 0 OR line = 0 OR doc_id % 7 = 0)""")
def index_sync(spark, sf):
    """Lines of all documents in an index: then every seventh document has other lines, every fifth only its first one, and every
    eleventh is gone."""
    from ..streaming.index import BucketIndex

    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body")).select("doc_id", F.lit(1).cast("long").alias("mtime"), "line", "body")
    index = BucketIndex(spark, shared_folder(spark, "index"), "doc_id", buckets=16)
    index.sync(lines)
    other, fewer = F.col("doc_id") % 7 == 0, F.col("doc_id") % 5 == 0
    later = lines.where("doc_id % 11 != 0").where(~fewer | other | (F.col("line") == 0)).withColumns({"mtime": F.when(other | fewer, F.lit(2)).otherwise(F.col("mtime")).cast("long"), "body": F.when(other, F.concat(F.lit("new "), "body")).otherwise(F.col("body"))})
    index.sync(later)
    return index.read(lines.schema)


@query("SELECT event_type, count(*) * 2 AS n, round(sum(value) * 2, 4) AS total FROM events GROUP BY 1")
def sink_append(spark, sf):
    """Events written as a version of a table, and once more as the next one, and read back."""
    from ..sources.versioned import VersionedDataSource

    spark.dataSource.register(VersionedDataSource)
    path = shared_folder(spark, "versioned").removeprefix("file://").removeprefix("file:")
    e = read(spark, sf, "events").select("event_id", "event_type", "value")
    e.write.format("versioned").mode("overwrite").save(path)
    e.write.format("versioned").mode("append").save(path)
    return spark.read.format("versioned").load(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Policies: views and clicks as decisions between three actions, three users to an episode.

@query("""WITH d AS (SELECT event_id AS e, user_id AS u, CAST(user_id // 3 AS VARCHAR) AS ep, CAST(floor(epoch(ts)) AS BIGINT) AS ts, 't' || (user_id // 3 % 4) AS task, value FROM events WHERE event_type IN ('view', 'click')),
  w AS (SELECT ep, arg_min(ts, e) AS ts, arg_min(task, e) AS task, bool_or(u % 50 = 0) AS open FROM d GROUP BY 1), n AS (SELECT count(*) AS n, max(task) AS last, count(DISTINCT task) AS tasks FROM w),
  h AS (SELECT w.*, n >= 2 AND row_number() OVER (ORDER BY ts DESC, ep DESC) <= greatest(1, least((n + 4) // 5, n - 1)) AS holdout, tasks > 1 AND task = last AS task_holdout FROM w, n),
  a AS (SELECT *, unnest(range(3)) AS k FROM d), b AS (SELECT *, e % 3 = k OR (e % 5 = 0 AND (e + 1) % 3 = k) AS taken, CASE WHEN (e + k) % 3 <> 0 THEN 1.0 ELSE 0 END + CASE WHEN (e + k) % 4 = 1 THEN 0.5 ELSE 0 END AS score FROM a),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY ep ORDER BY e) AS round, row_number() OVER (PARTITION BY e ORDER BY score DESC, k) AS best FROM b),
  p AS (SELECT 'solo' AS policy, * FROM r WHERE best = 1 AND round <= 16 UNION ALL SELECT 'same', * FROM r WHERE taken UNION ALL SELECT 'incumbent', * FROM r WHERE taken),
  s AS (SELECT p.*, unnest(list_filter(['all', CASE WHEN holdout THEN 'holdout' END, CASE WHEN task_holdout THEN 'task_holdout' END], lambda x: x IS NOT NULL)) AS part FROM p JOIN h USING (ep) WHERE NOT open),
  t AS (SELECT policy, part, count(*) FILTER (taken) AS inside, count(*) FILTER (NOT taken) AS outside, round(coalesce(sum(value) FILTER (taken AND e % 13 <> 0), 0), 4) AS cost, coalesce(max(e % 10) FILTER (taken AND e % 13 <> 0), 0) AS quality,
    min(e % 2) FILTER (taken AND e % 13 <> 0) AS correctness, min(e % 10) FILTER (taken AND e % 13 <> 0) AS score FROM s GROUP BY 1, 2),
  g AS (SELECT policy, part, unnest(['correctness', 'score']) AS metric, unnest([correctness, score]) AS least FROM t), i AS (SELECT part, metric, least AS bound FROM g WHERE policy = 'incumbent' AND part <> 'all' AND least IS NOT NULL),
  f AS (SELECT c.policy, string_agg(i.part || ':' || i.metric, ', ' ORDER BY i.part, i.metric) AS failed FROM (SELECT unnest(['solo', 'same']) AS policy) c CROSS JOIN i LEFT JOIN g ON g.policy = c.policy AND g.part = i.part AND g.metric = i.metric WHERE g.least IS NULL OR g.least < i.bound GROUP BY 1)
  SELECT c.policy, (SELECT count(*) FROM w) AS worlds, (SELECT count(*) FROM w WHERE open) AS censored, (SELECT count(*) FROM h WHERE holdout) AS holdout_worlds, (SELECT count(*) FROM h WHERE task_holdout) AS task_holdout_worlds,
    round(x.inside / (x.inside + x.outside), 6) AS support, coalesce(round(y.inside / (y.inside + y.outside), 6), 1.0) AS holdout_support, x.outside AS out_of_support, x.cost, CAST(x.quality AS DOUBLE) AS quality, z.cost AS incumbent_cost, CAST(z.quality AS DOUBLE) AS incumbent_quality,
    coalesce(f.failed, '') AS failed, coalesce(y.inside >= 0.7 * (y.inside + y.outside) AND y.outside = 0, true) AND f.failed IS NULL AS promotion_ok
  FROM (SELECT unnest(['solo', 'same']) AS policy) c JOIN t x ON x.policy = c.policy AND x.part = 'all' LEFT JOIN t y ON y.policy = c.policy AND y.part = 'holdout' JOIN t z ON z.policy = 'incumbent' AND z.part = 'all' LEFT JOIN f ON f.policy = c.policy""")
def policy_verdicts(spark, sf):
    """A policy that avoids overlaps and one that does what was done, against what was done."""
    e, u = F.col("event_id"), F.col("user_id")
    action = lambda k: F.struct(F.lit(f"a{k}").alias("id"), F.get(F.array(*[F.lit(x) for x in ("continue", "root", "handoff", "other")]), ((e + k) % 4).cast("int")).alias("kind"), F.array(F.lit(f"p{k}")).alias("paths"), F.array().cast("array<string>").alias("causal_parents"), ((e + k) % 3 == 0).alias("overlapping"))
    name = lambda c: F.concat(F.lit("a"), c % 3)
    events = read(spark, sf, "events").where("event_type IN ('view', 'click')")
    decisions = events.select(F.floor(u / 3).cast("string").alias("episode_id"), e.cast("string").alias("id"), e.alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), u.cast("string").alias("agent_id"), F.concat(F.lit("t"), F.floor(u / 3) % 4).alias("task"), F.array(*[action(k) for k in range(3)]).alias("legal"), F.when(e % 5 == 0, F.array(name(e), name(e + 1))).otherwise(F.array(name(e))).alias("selected"), "value")
    metrics = F.create_map(F.lit("cost"), F.col("value"), F.lit("score"), (F.col("seq") % 10).cast("double"), F.lit("correctness"), (F.col("seq") % 2).cast("double"))
    outcomes = decisions.select(F.col("id").alias("decision"), F.explode("selected").alias("action"), "seq", metrics.alias("metrics"), (F.col("seq") % 13 == 0).alias("censored"))
    agents = read(spark, sf, "events").select(u.cast("string").alias("agent_id"), (u % 50 != 0).alias("checked_out")).distinct()
    asked = [policy.Policy("solo", {"non_overlapping": 1.0, "root": 0.5}, max_batch=1), policy.Policy("same", max_batch=32, max_rounds=10_000, recorded=True)]
    out = policy.evaluate(asked, decisions.drop("value"), outcomes, agents, ["correctness", "score"])
    shown = ("policy", "worlds", "censored", "holdout_worlds", "task_holdout_worlds", "support", "holdout_support", "out_of_support", "cost", "quality", "incumbent_cost", "incumbent_quality", "failed", "promotion_ok")
    return out.withColumns({"support": F.round("support", 6), "holdout_support": F.round("holdout_support", 6), "cost": F.round("cost", 4), "incumbent_cost": F.round("incumbent_cost", 4), "failed": F.array_join("failed", ", ")}).select(*shown)


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_name AS n, p_partkey % 13 = 0 AS gone, p_partkey % 17 = 0 AS broken FROM part),
  c AS (SELECT *, unnest(range(5)) AS ord FROM p WHERE NOT gone AND NOT broken)
  SELECT k AS provider, 1000 - s * 10 <= 700 AS available, CASE WHEN 1000 - s * 10 > 700 THEN 'stale' END AS reason, CAST(1000 - s * 10 AS BIGINT) AS age_secs, CAST(ord AS INTEGER) AS ord, CASE WHEN ord = 0 THEN n WHEN ord = 1 THEN '—' END AS value, CASE WHEN ord = 0 THEN CAST(s AS VARCHAR) END AS detail,
    CASE ord WHEN 2 THEN '0|-|' || s || '.0|-;7|x|3.0|-' WHEN 3 THEN '-|a|' || s || '.0|-;-|?|0.0|-' WHEN 4 THEN '100|{"ts":100,"what":"z"}|-|15m' END AS series FROM c
  UNION ALL SELECT k, false, CASE WHEN gone THEN 'unavailable' ELSE 'parse error' END, NULL, NULL, NULL, NULL, NULL FROM p WHERE gone OR broken""")
def provider_cards(spark, sf):
    """Parts as providers: five cards of each one's document; some have none, or one that can't be read."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    lit = F.lit
    text = F.concat(lit('{"ts": '), size, lit('0, "name": '), F.to_json(F.array("p_name")), lit(', "deep": {"list": [{"n": '), size, lit('}]}, "spark": ['), size, lit(', {"ts": 7, "value": 3, "label": "x"}], "mix": [{"name": "a", "count": '), size, lit('}, {"label": 4}], "log": [{"ts": 100, "what": "z"}]}'))
    parts = read(spark, sf, "part")
    documents = parts.where(k % 13 != 0).select(k.cast("string").alias("sidecar"), F.when(k % 17 == 0, lit('{"ts": ')).otherwise(text).alias("content"), lit(0).cast("long").alias("mtime"))
    spec = [(0, "metric", "/name/0", "/deep/list/0/n", None), (1, "metric", "/not/there", None, None), (2, "sparkline", None, None, "/spark"), (3, "donut", None, None, "mix"), (4, "activity", None, None, "/log")]
    specs = parts.select(k.alias("provider"), k.cast("string").alias("sidecar"), lit(700).alias("stale_secs")).crossJoin(F.broadcast(spark.createDataFrame([(*s[:2], f"t{s[0]}", *s[2:]) for s in spec], "ord int, kind string, title string, value string, detail string, series string")))
    shown = F.array_join(F.transform("series", lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), lit("-")) for f in ("ts", "label", "value", "ago")])), ";")
    return providers.cards(specs, documents, 1000).select("provider", "available", "reason", "age_secs", "ord", "value", "detail", shown.alias("series"))


def plan_of(df: DataFrame) -> str:
    """The formatted physical plan, for tests and the bench."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


