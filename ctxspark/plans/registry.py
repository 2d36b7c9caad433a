"""Named tools and the functions that answer them. Relations come as DataFrames, arguments by keyword, results as DataFrames.

``run("call_path", adjacent=..., start=..., goal=...)`` calls a tool; ``tools()`` lists them all as a DataFrame.
Tools that need other machines, images or a live process have no function and say why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import change, decide, digest, graph, paging, policy, presence, records, retrieval, runtime, telemetry, trace
from ..sources import files, git
from ..streaming import gate


def symbol_context(spans: DataFrame, edges: DataFrame, fields: DataFrame, symbol: str) -> dict[str, DataFrame]:
    """A symbol's definitions, its callers and callees, and its layout if it is a record."""
    from pyspark.sql import functions as F

    from ..functions.text import segment

    return {"definitions": spans.where(segment(F.col("name")) == symbol), "callers": graph.callers(edges, symbol), "callees": graph.callees(edges, symbol), "layout": fields.where(F.col("type") == symbol)}


def batch_context(spans: DataFrame, edges: DataFrame, fields: DataFrame, symbols: list[str]) -> dict[str, dict[str, DataFrame]]:
    return {s: symbol_context(spans, edges, fields, s) for s in symbols}


def perf_triage(rows: DataFrame, occurrences: DataFrame, base: DataFrame | None = None, n: int = 12) -> dict[str, DataFrame]:
    """The largest zones (or the largest changes), the symbols they name, and the files that mention those."""
    z = trace.zones(rows)
    top = trace.diff_zones(trace.zones(base), z, n) if base is not None else trace.top_zones(z, n=n)
    named = top.select(trace.clean_zone(top["name"]).alias("name")).where("name != ''").distinct()
    return {"zones": top, "symbols": named, "mentions": change.impact(named, occurrences.select("rel", "name"))}


def diff_map(diff_lines: DataFrame, spans: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Functions that a diff touches, and whether they are new or changed in body or signature."""
    h = change.hunks(diff_lines)
    return change.classify(change.overlapping(spans, h.select("rel", "first", "last")), old)


def test_impact(diff_lines: DataFrame, spans: DataFrame, tests: DataFrame, old: DataFrame | None = None, n: int = 40) -> DataFrame:
    return change.impact(diff_map(diff_lines, spans, old), tests, n)


def index_health(files_: DataFrame, covered: DataFrame, cache_mtime, rebuild: int = 32) -> DataFrame:
    """Files outside coverage, files changed since the cache, and whether a rebuild is due."""
    from pyspark.sql import functions as F

    gaps = files_.join(covered.select("rel"), "rel", "left_anti").agg(F.count("*").alias("gaps"))
    new = files_.agg(F.count_if(F.col("mtime") > cache_mtime).alias("changed"), F.max("mtime").alias("newest"))
    return gaps.crossJoin(new).withColumns({"stale": F.col("changed") > 0, "rebuild": F.col("changed") > rebuild})


def integration_hooks(sections: DataFrame, query: str, n: int = 12) -> DataFrame:
    """Sections with every word of a query; if there are none, those with most of them."""
    from pyspark.sql import functions as F

    words = sorted({w for w in query.lower().split() if w})
    hits = sum((F.when(F.contains(F.lower(F.concat_ws("\n", "heading", "body")), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    got = sections.withColumn("hits", hits).where("hits > 0")
    every = got.where(F.col("hits") == len(words))
    return every if not every.isEmpty() else got.orderBy(F.desc("hits"), "path", "start_line").limit(n)


TOOLS: dict[str, Callable] = {
    "repo_map": files.symbol_map, "outline": files.definitions, "symbol_refs": graph.references, "symbol_resolve": graph.resolve_symbol, "call_graph": graph.callers, "call_path": graph.call_path,
    "symbol_context": symbol_context, "usage_examples": graph.usage_examples, "undocumented": graph.undocumented, "dead_code": graph.dead, "big_functions": graph.big,
    "symbol_diff": change.overlapping, "module_map": graph.coupling, "include_graph": graph.includers, "type_layout": files.fields, "diff_map": git.diff_map, "diff_hunks": diff_map, "test_map": graph.occurrence_counts,
    "batch_context": batch_context, "perf_triage": perf_triage, "test_impact": test_impact, "knowledge_search": retrieval.search_corpus, "knowledge_answer": retrieval.padded_answer, "knowledge_upsert": records.compose_note,
    "semantic_decide": decide.decide, "trace_summary": trace.top_zones, "runtime_snapshot": runtime.latest, "memory_diff": runtime.diff_named, "locality_hotspots": runtime.hotspots,
    "integration_hooks": integration_hooks, "index_stale": index_health, "index_health": index_health, "stats": telemetry.rollup_total, "board_post": records.cap_fields, "board_read": records.read_board,
    "board_status": records.convergence, "board_finalize": records.handoff, "session_handoff": records.handoff, "defect_upsert": records.upsert, "defect_list": records.list_defects, "idea_list": records.list_ideas,
    "idea_show": retrieval.similar, "idea_upsert": records.capture_idea, "idea_review": records.review_queue, "idea_touch": records.touch_ideas, "idea_status": records.set_idea_status, "idea_bookmark": records.toggle_bookmarks,
    "run_record": records.upsert, "run_history": records.run_history, "artifact_index": files.artifacts, "session_pressure": telemetry.pressure, "commit_scope": git.commit_scopes, "presence_status": presence.findings,
    "presence_advise": policy.advise, "presence_check_in": gate.judged, "presence_update": gate.judged, "presence_check_out": gate.judged, "doc_comment": graph.doc_comment, "continuation": paging.budget_page,
    "includees": graph.includees, "digest_status": digest.status, "digest_log": digest.log, "digest_diff": digest.diff, "digest_tests": digest.ctest, "digest_build": digest.build, "recent_docs": records.recent,
}

#: Tools without a function here, and why.
OUTSIDE = {
    "trace_profile": "not implemented: perf_triage and trace_summary give its parts",
    "decision_bridge": "a bridge to another program's library", "board_timeline": "draws images", "write_gate": "a switch of the host's write tools", "profile_upsert": "edits the host's configuration",
    "task_submit": "jobs on other machines", "task_status": "jobs on other machines", "task_fetch": "jobs on other machines", "task_cancel": "jobs on other machines", "worker_status": "jobs on other machines",
}


def run(tool: str, **args):
    if tool in OUTSIDE:
        raise NotImplementedError(f"{tool}: {OUTSIDE[tool]}")
    return TOOLS[tool](**args)


def tools(spark: SparkSession) -> DataFrame:
    rows = [(n, f"{f.__module__}.{f.__name__}", (f.__doc__ or "").strip().split("\n")[0]) for n, f in TOOLS.items()] + [(n, None, why) for n, why in OUTSIDE.items()]
    return spark.createDataFrame(rows, "tool string, function string, what string")
