"""Stores of records: blackboard, defects, runs, ideas, findings and effects. Writes are new versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idea_slug, idea_tokens, looks_generated, overlap  # noqa: F401
from ..functions.vectors import freshness

#: The states of an idea, and what an unresolved defect's score is multiplied by in a search.
IDEA_STATUSES = ("seed", "sprouted", "planned", "implemented", "archived")
DEFECT_BOOSTS = {"eyeball_fail": 8.0, "open": 4.0, "gated": 2.0}


def upsert(table: DataFrame, new: DataFrame, key: str, order: str, retain: int | None = None) -> DataFrame:
    """Both tables with one row per key, the newest by `order`; null fields of it keep what was there before. `retain` keeps
    the newest so many rows of all."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    at = F.struct(order, "_new")
    pick = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    out = both.groupBy(key).agg(*[pick(c) for c in table.columns if c != key]).select(*table.columns)
    return out.orderBy(F.desc(order), key).limit(retain) if retain else out


def facet(table: DataFrame, **equal: str | None) -> DataFrame:
    """Rows whose columns equal the given values, in any case; None doesn't filter."""
    for c, v in equal.items():
        if v is not None:
            table = table.where(F.lower(F.col(c)) == v.lower())
    return table


def tagged(table: DataFrame, tag: str, column: str = "tags") -> DataFrame:
    return table.where(F.exists(column, lambda t: F.lower(t) == tag.lower()))


def free_text(table: DataFrame, query: str, *columns: str) -> DataFrame:
    return table.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def list_defects(defects: DataFrame, status: str | None = None, include_done: bool = False, n: int | None = None) -> DataFrame:
    """By status (failed by eye, open, gated, done), newest first, id; done ones only if asked for."""
    d = facet(defects, status=status)
    if not include_done and status is None:
        d = d.where("status != 'done'")
    rank = F.when(F.col("status") == "eyeball_fail", 0).when(F.col("status") == "open", 1).when(F.col("status") == "gated", 2).when(F.col("status") == "done", 3).otherwise(9)
    out = d.orderBy(rank, F.desc("updated"), "id")
    return out.limit(n) if n else out


def defect_boost(status: Column) -> Column:
    return F.when(status == "eyeball_fail", 8.0).when(status == "open", 4.0).when(status == "gated", 2.0).otherwise(1.0)


def digest(table: DataFrame, *facets: str) -> DataFrame:
    """facet, value, n for each facet, in one pass (an expansion into grouping sets)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("x")
    return table.select(each).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def tag_counts(table: DataFrame, column: str = "tags") -> DataFrame:
    return table.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def run_history(runs: DataFrame, status: str | None = None, tag: str | None = None, n: int = 20) -> DataFrame:
    r = facet(runs, status=status)
    r = tagged(r, tag) if tag else r
    return r.orderBy(F.desc("updated"), F.desc("id")).limit(n)


def missing_files(runs: DataFrame, files: DataFrame, column: str = "log_path") -> DataFrame:
    """Runs whose file isn't in the listing."""
    return runs.where(F.col(column) != "").join(files.select(F.col("path").alias(column)), column, "left_anti")


def with_freshness(ideas: DataFrame, today: Column) -> DataFrame:
    age, band = freshness(F.col("touched"), F.col("status"), today)
    return ideas.withColumns({"age_days": age, "freshness": band})


def review_queue(ideas: DataFrame) -> DataFrame:
    """Due, then stale, then dormant ideas that aren't finished, oldest first."""
    rank = F.when(F.col("freshness") == "dormant", 0).when(F.col("freshness") == "stale", 1).otherwise(2)
    keep = F.col("freshness").isin("due", "stale", "dormant") & ~F.col("status").isin("archived", "implemented")
    return ideas.where(keep).orderBy(F.desc(rank), F.desc("age_days"), "slug")


def stalest(ideas: DataFrame, n: int = 3) -> DataFrame:
    return ideas.where("status IN ('seed', 'sprouted')").orderBy(F.desc("age_days"), "touched", "slug").limit(n)


def capture_idea(ideas: DataFrame, title: str, body: str, tags: list[str], today: str) -> DataFrame:
    """ideas with one more: its slug comes from the title, with a number behind it if taken."""
    spark = ideas.sparkSession
    base = spark.range(1).select(idea_slug(F.lit(title))).first()[0]
    taken = {r.slug for r in ideas.where(F.col("slug").startswith(base)).select("slug").collect()}
    slug, k = base, 2
    while slug in taken:
        slug, k = f"{base}-{k}", k + 1
    row = spark.createDataFrame([(slug, title, body, "seed", today, tags)], "slug string, title string, body string, status string, touched string, tags array<string>")
    return ideas.unionByName(row, allowMissingColumns=True)


def touch_ideas(ideas: DataFrame, which: Column, today: str, **fields: Column) -> DataFrame:
    """ideas in which the chosen ones have today as their touched day and the given fields. Age and freshness follow from with_freshness."""
    today = F.lit(today).cast(ideas.schema["touched"].dataType)
    return ideas.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in ({"touched": today} | fields).items()})


def set_idea_status(ideas: DataFrame, which: Column, status: str, today: str, archive_reason: str | None = None) -> DataFrame:
    """Touched ideas with a new status; a reason is kept (trimmed) only for archived ones. ValueError for an unknown status."""
    if status not in IDEA_STATUSES:
        raise ValueError(f"status must be one of {', '.join(IDEA_STATUSES)}")
    reason = {"archive_reason": F.lit(archive_reason.strip())} if status == "archived" and archive_reason is not None else {}
    return touch_ideas(ideas, which, today, status=F.lit(status), **reason)


def set_idea_links(ideas: DataFrame, which: Column, links: Column, today: str) -> DataFrame:
    """Touched ideas with the given links in place of their own."""
    return touch_ideas(ideas, which, today, links=F.coalesce(links, F.array().cast("array<string>")))


def set_idea_tags(ideas: DataFrame, which: Column, tags: Column, today: str) -> DataFrame:
    """Touched ideas with the given tags, trimmed, without empty ones and without those that stand before in another case."""
    given = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    lower = F.transform(given, lambda t: F.lower(t))
    return touch_ideas(ideas, which, today, tags=F.filter(given, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1))


def toggle_bookmarks(bookmarks: DataFrame, ideas: DataFrame, slugs: DataFrame, now: int, on: bool | None = None) -> DataFrame:
    """bookmarks (slug, at) with those of the given slugs set, taken away, or turned over if `on` is None. A slug that is no idea's,
    or null, changes nothing; one given several times counts once."""
    asked = slugs.select("slug").distinct().join(ideas.select("slug").distinct(), "slug", "left_semi").withColumn("_asked", F.lit(True))
    both = bookmarks.groupBy("slug").agg(F.max("at").alias("at")).withColumn("_had", F.lit(True)).join(asked, "slug", "full_outer")
    want = F.col("_had").isNull() if on is None else F.lit(on)
    kept = F.when(F.col("_asked").isNull(), F.lit(True)).otherwise(want)
    return both.where(kept).select("slug", F.when(F.col("_asked").isNotNull(), F.lit(now)).otherwise(F.col("at")).cast("long").alias("at"))


def list_ideas(ideas: DataFrame, bookmarks: DataFrame, query: str = "", semantic: bool = False, status: str | None = None, freshness: str | None = None, tag: str | None = None, n: int | None = 15) -> DataFrame:
    """Ideas of a status, freshness and tag with `bookmarked`, in the order of their slugs, and only those with the query in slug, title or
    body. Or, if semantic, all of them with `similarity` to the query, the most alike first, then the last touched, then by slug."""
    out = facet(ideas, status=status, freshness=freshness)
    out = tagged(out, tag) if tag else out
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = ["slug"]
    if semantic and query:
        out = out.withColumn("similarity", overlap(idea_tokens(F.lit(query)), idea_tokens(F.concat_ws("\n", text("title"), text("body"))), "multiset"))
        order = [F.desc("similarity"), F.desc("touched"), "slug"]
    elif query:
        out = free_text(out, query, "slug", "title", "body")
    marked = bookmarks.select("slug").distinct().withColumn("_marked", F.lit(True))
    out = out.join(marked, "slug", "left").withColumn("bookmarked", F.coalesce("_marked", F.lit(False))).drop("_marked").orderBy(*order)
    return out.limit(n) if n else out


def idea_metrics(ideas: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """facet, value, n: how many ideas there are in all, bookmarked, of each status and freshness, and how often each tag is given."""
    marked = bookmarks.select("slug").distinct().withColumn("_marked", F.lit(True))
    none = F.lit(None).cast("string")
    one = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value")))
    whole = F.array(one("total", none), one("bookmarked", none, F.col("_marked").isNotNull()), one("status", F.col("status")), one("freshness", F.col("freshness")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: one("tag", t))
    each = F.explode(F.array_compact(F.concat(whole, tags))).alias("x")
    return ideas.join(marked, "slug", "left").select(each).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def defect_chunks(defects: DataFrame, path: str = "") -> DataFrame:
    """Unresolved defects as chunks of the search corpus: id, path, heading, body and the boost of their status. Of the array
    columns acceptance, evidence and anchors the filled ones have lines in the body; a missing or null column is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    items = lambda c: F.col(c) if c in defects.columns else F.lit(None).cast("array<string>")
    filled = lambda c, line: F.when(F.size(items(c)) > 0, line(items(c))).otherwise("")
    joined = lambda label, mark: lambda a: F.concat(F.lit(label), F.array_join(a, mark), F.lit("\n"))
    body = F.concat(
        F.lit("Defect "), text("id"), F.lit(" ("), text("status"), F.lit(") in "), F.coalesce(F.nullif(F.col("subsystem"), F.lit("")), F.lit("unspecified")), F.lit(": "), text("summary"), F.lit("\n"),
        filled("acceptance", joined("Acceptance:\n- ", "\n- ")), filled("evidence", joined("Evidence: ", "; ")), filled("anchors", joined("Anchors: ", ", ")),
    )
    boost = F.coalesce(*[F.when(F.col("status") == s, F.lit(b)) for s, b in DEFECT_BOOSTS.items()], F.lit(0.0))
    heading = F.concat(F.lit("DEFECT ["), text("status"), F.lit("] "), text("id"))
    return defects.where("status IS NULL OR status != 'done'").select("id", F.lit(path).alias("path"), heading.alias("heading"), body.alias("body"), boost.alias("boost"))


def read_board(entries: DataFrame, since_id: int | None = None, role: str | None = None, tag: str | None = None, recipient: str | None = None) -> DataFrame:
    """Blackboard entries after an id, of a role, with a tag, for a recipient (or for nobody in particular)."""
    e = facet(entries, role=role)
    e = e.where(F.col("id") > since_id) if since_id is not None else e
    e = tagged(e, tag) if tag else e
    return e.where((F.coalesce("handoff_to", F.lit("")) == "") | (F.lower("handoff_to") == recipient.lower())) if recipient else e


def role_counts(entries: DataFrame, by: str = "session") -> DataFrame:
    return entries.groupBy(by, "role").agg(F.count("*").alias("n"))


def convergence(entries: DataFrame, critic: str = "critic", by: str = "session") -> DataFrame:
    """What the last critic's entry says: no_critic, approved, approved_with_questions, rejected or undecided."""
    last = entries.groupBy(by).agg(F.max_by(F.struct("approved", "questions", F.lit(1).alias("one")), F.when(F.lower("role") == critic, F.col("id"))).alias("c"), F.count_if(F.lower("role") == critic).alias("critics"))
    c = F.col("c")
    state = F.when(F.col("critics") == 0, "no_critic").when(c["approved"].isNull(), "undecided").when(~c["approved"], "rejected").when(c["questions"] > 0, "approved_with_questions").otherwise("approved")
    return last.select(by, "critics", state.alias("state"))


def cap_fields(entries: DataFrame, items: str, cap: int, key: list[str]) -> DataFrame:
    """An entry's items as long as their tokens (a quarter of the bytes) fit in the cap; the rest is spilled (`kept`, `spilled`)."""
    cost = lambda x: F.floor(F.octet_length(x) / 4).cast("int")
    run = F.aggregate(F.col(items), F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), lambda s, x: F.when((s["used"] + cost(x) <= cap) & (s["n"] >= 0), F.struct((s["used"] + cost(x)).alias("used"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(cap + 1).alias("used"), s["n"].alias("n"))))
    return entries.withColumn("_n", run["n"]).withColumns({"kept": F.slice(F.col(items), F.lit(1), F.col("_n")), "spilled": F.slice(F.col(items), F.col("_n") + 1, F.greatest(F.size(items) - F.col("_n"), F.lit(0)))}).drop("_n")


def handoff(entries: DataFrame, arrays: list[str], by: str = "session") -> DataFrame:
    """The different values of array columns over a session, sorted."""
    return entries.groupBy(by).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays])


def triage_overlay(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings with their triage: its state counts unless it is unreviewed; triage without a finding stays as `gone`."""
    f = findings.select("id", F.col("status").alias("found"), "severity")
    t = triage.select("id", "state")
    status = F.when(F.col("found").isNull(), "gone").otherwise(F.coalesce(F.when(F.col("state") != "unreviewed", F.col("state")), F.col("found")))
    return f.join(t, "id", "full_outer").withColumn("status", status)


def status_matches(status: Column, wanted: str) -> Column:
    return status.isin("open", "unreviewed") if wanted == "open" else status == wanted


def compare_runs(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new, fixed and persisting findings."""
    o, n = old.select(F.col(key), F.lit(1).alias("_o")).distinct(), new.select(F.col(key), F.lit(1).alias("_n")).distinct()
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "fixed").otherwise("persisting")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def undo_targets(effects: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """path, restore (what it held before the first edit), expected (after the last), edits; with the files now, conflict if
    they aren't what the last edit left."""
    out = effects.groupBy("path").agg(F.min_by("before", "ord").alias("restore"), F.max_by("after", "ord").alias("expected"), F.count("*").alias("edits"))
    if now is None:
        return out
    return out.join(now.select("path", F.col("content").alias("_now")), "path", "left").withColumn("conflict", ~F.col("_now").eqNullSafe(F.col("expected"))).drop("_now")


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def compose_note(content: Column, heading: str, body: str, mode: str = "append") -> Column:
    """A Markdown text with a section added at the end (append) or its text replaced (replace); a missing section is added."""
    title = f"## {heading}"
    quoted = "\\Q" + heading + "\\E"
    section = rf"(?ms)^## {quoted}[ \t]*$.*?(?=^## |\z)"
    block = f"{title}\n\n{body}\n"
    added = F.concat(F.regexp_replace(content, r"\s*$", ""), F.lit("\n\n" + block))
    if mode == "append":
        return added
    return F.when(content.rlike(section), F.regexp_replace(content, section, F.lit(block.replace("\\", "\\\\").replace("$", "\\$")))).otherwise(added)


def recent(files: DataFrame, n: int = 20) -> DataFrame:
    """The newest files (path, mtime), 1 to 100 of them; ties by path."""
    return files.orderBy(F.desc("mtime"), "path").limit(min(max(n, 1), 100))


def outdated(manifest: DataFrame, files: DataFrame, by: str = "path", at: str = "mtime") -> DataFrame:
    """path and change: added, changed (another time than in the manifest) or removed."""
    m, f = manifest.select(by, F.col(at).alias("_old")), files.select(by, F.col(at).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return m.join(f, by, "full_outer").select(by, change.alias("change")).where("change IS NOT NULL")
