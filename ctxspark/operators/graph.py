"""Call, module, include and link graphs over edge tables.

Edges have caller and callee (qualified by ``::``), and may have rel and line of the call site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, folder, segment
from ..storage import stored
from .ranking import ranked

#: Nodes of a search's level up to which they are numbered in one place.
WIDE = 100_000


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    """Who calls a symbol (by last segment, itself excepted), with the first call site of each."""
    e = edges.where((segment(F.col("callee")) == symbol) & (segment(F.col("caller")) != symbol))
    return e.groupBy("caller").agg(F.min(F.struct("rel", "line")).alias("s"), F.count("*").alias("calls")).select("caller", "s.rel", "s.line", "calls")


def callees(edges: DataFrame, symbol: str, sites: DataFrame | None = None) -> DataFrame:
    """Whom a symbol calls, itself excepted; with definition sites, the first of each (`?` and 0 if there is none)."""
    e = edges.where((segment(F.col("caller")) == symbol) & (segment(F.col("callee")) != symbol))
    out = e.groupBy(segment(F.col("callee")).alias("callee")).agg(F.count("*").alias("calls"))
    if sites is None:
        return out
    return out.join(first_sites(sites).withColumnRenamed("name", "callee"), "callee", "left").fillna({"rel": "?", "line": 0})


def first_sites(sites: DataFrame) -> DataFrame:
    """name (last segment), rel, line: where a name is first defined, by path and line."""
    return sites.groupBy(segment(F.col("name")).alias("name")).agg(F.min(F.struct("rel", "line")).alias("s")).select("name", "s.rel", "s.line")


def adjacency(edges: DataFrame) -> DataFrame:
    """Different edges between last segments, without loops."""
    return edges.select(segment(F.col("caller")).alias("caller"), segment(F.col("callee")).alias("callee")).where("caller != callee").distinct()


def call_path(adjacent: DataFrame, start: str, goal: str, max_depth: int = 8) -> DataFrame:
    """step, node of the shortest chain from start to goal; no rows if there is none within max_depth (1 to 64).

    Breadth-first: each level joins the frontier with the edges and leaves out what was seen. A node's parent is the one that
    a search in alphabetical order would find first. Only counts come to the driver; levels are tables in the shared folder.
    """
    spark, depth = adjacent.sparkSession, max(1, min(64, max_depth))
    cut = _cutter(spark)
    edges = cut(adjacent.select("caller", "callee"))
    frontier = spark.createDataFrame([(start, 1)], "node string, place long")
    seen = frontier.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    for level in range(1, depth + 1):
        if start == goal:
            break
        reached = edges.join(frontier, edges["caller"] == frontier["node"]).join(seen.select(F.col("node").alias("callee")), "callee", "left_anti")
        found = reached.groupBy("callee").agg(F.min(F.struct("place", F.col("caller").alias("parent"))).alias("p")).select(F.col("callee").alias("node"), "p.parent", F.col("p.place").alias("from"))
        found = cut(found)
        wide = found.count()
        if not wide:
            break
        seen = cut(seen.unionByName(found.select("node", "parent", F.lit(level).alias("depth"))))
        if not found.where(F.col("node") == goal).isEmpty():
            break
        # Places in the order of discovery; those of a wide level are taken by ranges.
        place = ranked(found, ["from", "node"]) if wide > WIDE else found.withColumn("rank", F.row_number().over(Window.orderBy("from", "node")))
        frontier = place.select("node", F.col("rank").cast("long").alias("place"))
    path, node = [], goal
    while node is not None:
        row = seen.where(F.col("node") == node).first()
        if row is None:
            return spark.createDataFrame([], "step int, node string")
        path.append(node)
        node = row.parent
    return spark.createDataFrame([(i, n) for i, n in enumerate(reversed(path))], "step int, node string")


def _cutter(spark):
    return lambda df: stored(df, "graph-level")


def reach(adjacent: DataFrame, start: str, max_depth: int = 8) -> DataFrame:
    """node, depth of everything within max_depth calls of start, itself at 0."""
    spark, cut = adjacent.sparkSession, _cutter(adjacent.sparkSession)
    edges = cut(adjacent)
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    frontier = seen.select("node")
    for level in range(1, max_depth + 1):
        frontier = cut(edges.join(frontier, edges["caller"] == frontier["node"]).select(F.col("callee").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier.withColumn("depth", F.lit(level))))
    return seen


def coupling(edges: DataFrame, modules: DataFrame, least: int = 1, samples: int = 4, focus: str | None = None) -> DataFrame:
    """from, to, edges, pairs: calls between different modules, with the first few pairs by name.

    modules: name, module. An edge belongs to no module if one of its ends doesn't. focus keeps edges that touch a module
    with that prefix. Pairs are made different before they are ranked, so no list grows with the calls.
    """
    m = modules.select("name", "module")
    e = edges.join(m.select(F.col("name").alias("caller"), F.col("module").alias("from")), "caller").join(m.select(F.col("name").alias("callee"), F.col("module").alias("to")), "callee").where(F.col("from") != F.col("to"))
    if focus:
        e = e.where(F.col("from").startswith(focus) | F.col("to").startswith(focus))
    pairs = e.groupBy("from", "to", "caller", "callee").agg(F.count("*").alias("n"))
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("from", "to").orderBy("caller", "callee")))
    shown = F.array_sort(F.collect_list(F.when(F.col("r") <= samples, F.concat_ws("->", "caller", "callee"))))
    return ranked.groupBy("from", "to").agg(F.sum("n").alias("edges"), F.count("*").alias("pairs"), F.array_join(shown, ",").alias("samples")).where(F.col("edges") >= least)


def degrees(coupled: DataFrame) -> DataFrame:
    """module, outgoing, incoming edges."""
    out = coupled.groupBy(F.col("from").alias("module")).agg(F.sum("edges").alias("outgoing"))
    into = coupled.groupBy(F.col("to").alias("module")).agg(F.sum("edges").alias("incoming"))
    return out.join(into, "module", "full_outer").fillna(0, ["outgoing", "incoming"])


def fan_in(defs: DataFrame, edges: DataFrame) -> DataFrame:
    """defs (name) with the number of different callers."""
    n = adjacency(edges).groupBy(F.col("callee").alias("_seg")).agg(F.count("*").alias("fan_in"))
    return defs.join(n, segment(F.col("name")) == F.col("_seg"), "left").drop("_seg").fillna(0, ["fan_in"])


def doc_comment(defs: DataFrame, symbol: str) -> DataFrame:
    """rel, name, line, signature and doc of the definitions of a name, alone or as the last part of a qualified one; those with a
    comment first."""
    short = F.element_at(F.split("name", "::"), -1)
    found = defs.where((F.col("name") == symbol) | (short == symbol))
    return found.select("rel", "name", "line", "signature", "doc").orderBy(F.col("doc").isNull(), "rel", "line")


def undocumented(defs: DataFrame, edges: DataFrame, include_private: bool = False, n: int = 40) -> DataFrame:
    """Definitions without a comment, most called first."""
    d = defs.where(~F.col("has_doc"))
    if not include_private:
        d = d.where(~segment(F.col("name")).startswith("_"))
    return fan_in(d, edges).orderBy(F.desc("fan_in"), "rel", "line").limit(n)


def dead(defs: DataFrame, edges: DataFrame, occurrences: DataFrame | None = None, generated: DataFrame | None = None, include_private: bool = False, today_days: int | None = None, stale_days: int = 90) -> DataFrame:
    """Definitions (name, rel, line, exported, mtime_days) that nobody calls or mentions, with caveats.

    A call counts by last segment, other mentions (role call or ref) by the full name or the segment. Names that only
    generated code mentions stay, marked `generated_only`.
    """
    seg = segment(F.col("name"))
    d = defs.withColumn("_seg", seg)
    if not include_private:
        d = d.where(~F.col("_seg").startswith("_"))
    d = d.join(adjacency(edges).select(F.col("callee").alias("_seg")).distinct(), "_seg", "left_anti")
    if occurrences is not None:
        said = occurrences.where("role IN ('call', 'ref')").select(F.col("name").alias("_n")).distinct()
        d = d.join(said.withColumnRenamed("_n", "_seg"), "_seg", "left_anti").join(said.withColumnRenamed("_n", "name"), "name", "left_anti")
    gen = F.lit(False)
    if generated is not None:
        d = d.join(generated.select(F.col("name").alias("_seg"), F.lit(True).alias("_gen")).distinct(), "_seg", "left")
        gen = F.coalesce("_gen", F.lit(False))
    entry = F.col("_seg").rlike(r"^(main|init|setup|run|handle_.*|on_.*|test_.*)$")
    old = F.lit(False) if today_days is None else F.coalesce(F.lit(today_days) - F.col("mtime_days") >= stale_days, F.lit(False))
    out = d.withColumns({"caveat": F.col("exported") | entry | gen, "stale": old, "generated_only": gen})
    return out.drop("_seg", "_gen").orderBy("caveat", F.desc("stale"), "rel", "line")


def big(spans: DataFrame, least: int, n: int = 30) -> DataFrame:
    """Functions of at least so many lines, longest first."""
    return spans.withColumn("lines", F.col("end") - F.col("start") + 1).where(F.col("lines") >= least).orderBy(F.desc("lines"), "rel", "start").limit(n)


def occurrence_counts(occ: DataFrame, by: str = "name") -> DataFrame:
    """def, call and ref counts by name or file, and their total."""
    return occ.groupBy(by).agg(*[F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("def", "call", "ref")], F.count("*").alias("total"))


def references(occ: DataFrame, symbol: str, n: int = 60) -> DataFrame:
    """Where a full name is defined, called and mentioned, in this order."""
    rank = F.when(F.col("role") == "def", 0).when(F.col("role") == "call", 1).otherwise(2)
    return occ.where(F.col("name") == symbol).orderBy(rank, "rel", "line").limit(n)


def usage_examples(occ: DataFrame, lines: DataFrame, symbol: str, n: int = 5, context: int = 2) -> DataFrame:
    """The first call sites with the lines around them: a join by file and line number, not by range."""
    site = occ.where((F.col("name") == symbol) & (F.col("role") == "call")).select("rel", F.col("line").alias("site")).distinct().orderBy("rel", "site").limit(n)
    near = site.withColumn("line", F.explode(F.sequence(F.col("site") - context, F.col("site") + context)))
    return near.join(lines, ["rel", "line"]).select("rel", "site", "line", "text")


def module_of(rel: Column, depth: int = 1) -> Column:
    return folder(rel, depth)


def includers(includes: DataFrame, header: str) -> DataFrame:
    """Files that include a header (rel, target, ord), by base name and then suffix; the first directive of each file."""
    name = header.rsplit("/", 1)[-1]
    target = F.col("target")
    hit = includes.where((basename(target) == name) & (target.endswith(header) | F.lit(header).endswith(target)))
    return hit.groupBy("rel").agg(F.min(F.struct("ord", "target")).alias("m")).select("rel", "m.target", "m.ord")


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links (source, target) with the path they lead to: the first of a few variants that exists, seen from the top and then
    from the source's folder; null if it is broken. A link to an anchor leads to its own page."""
    bare = F.trim(F.regexp_extract(F.col("target"), r"^([^#?]*)", 1))
    direct = F.regexp_replace(bare, "^/+", "")
    parent = F.regexp_replace(F.regexp_extract("source", r"^(.*/)?[^/]*$", 1), "/$", "")
    joined = F.when(parent == "", bare).otherwise(F.concat_ws("/", parent, bare))
    for _ in range(8):  # "a/../b" and "./b"
        joined = F.regexp_replace(F.regexp_replace(joined, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    variants = lambda p: [p, F.concat(p, F.lit(".md")), F.concat(p, F.lit("/README.md"))]
    tried = links.withColumn("_id", F.monotonically_increasing_id()).withColumn("_bare", bare)
    each = tried.select("_id", F.posexplode(F.array(*variants(direct), *variants(joined))).alias("prio", "path"))
    hit = each.join(paths.select("path").distinct(), "path").groupBy("_id").agg(F.min_by("path", "prio").alias("resolved"))
    return tried.join(hit, "_id", "left").withColumn("resolved", F.when(F.col("_bare") == "", F.col("source")).otherwise(F.col("resolved"))).drop("_id", "_bare")


def garden(resolved: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Broken links, orphans (pages nobody links to, README.md excepted), and inbound counts."""
    inbound = resolved.where("resolved IS NOT NULL").groupBy(F.col("resolved").alias("path")).agg(F.count("*").alias("inbound"))
    orphans = paths.where("path != 'README.md'").join(inbound, "path", "left_anti")
    return resolved.where("resolved IS NULL").drop("resolved"), orphans, inbound


def backlinks(resolved: DataFrame, path: str) -> DataFrame:
    return resolved.where(F.col("resolved") == path).select("source", "target").distinct()


def resolve_symbol(names: DataFrame, symbol: str, n: int = 8) -> DataFrame:
    """Names equal to a symbol's last segment, or else the nearest ones."""
    from ..functions.text import fuzzy_score, normal_symbol

    spark = names.sparkSession
    needle = spark.range(1).select(normal_symbol(F.lit(symbol))).first()[0]
    scored = names.select(segment(F.col("name")).alias("name")).distinct().withColumn("score", fuzzy_score(needle, F.col("name"))).where("score IS NOT NULL")
    exact = scored.where("score = 0")
    return exact if not exact.isEmpty() else scored.orderBy("score", "name").limit(n)


def includees(includes: DataFrame, rel: str) -> DataFrame:
    """What a file includes (target, ord), each target at its first directive, in order."""
    return includes.where(F.col("rel") == rel).groupBy("target").agg(F.min("ord").alias("ord")).orderBy("ord", "target")


def of_kind(definitions: DataFrame, *kinds: str) -> DataFrame:
    """Definitions of the given kinds, functions and records if none is given."""
    return definitions.where(F.col("kind").isin(*(kinds or ("function", "record"))))
