"""Presence of agents, folded from a journal of events, and what follows from it; and replay of recorded decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folders_above, paths_overlap
from .ranking import ranked

#: Keys under which a source body would be stored.
BODY_KEYS = ("patch", "diff", "source", "file_contents", "contents")


def idempotent(journal: DataFrame, key: str = "idempotency_key", order: str = "seq") -> DataFrame:
    """The first event of each key; events without a key all stay."""
    first = journal.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return journal.join(first, key, "left").where(F.col(key).isNull() | (F.col(order) == F.col("_first"))).drop("_first").select(*journal.columns)


#: Kinds of events that make an agent's state; others (decisions and their outcomes) are kept for replay.
BOARD = ("snapshot", "check_in", "update", "check_out")
FOLDED = "struct<events:long,checked_out:boolean>"


def fold(journal: DataFrame, fields: list[str], by: str = "agent_id", order: str = "seq") -> DataFrame:
    """The state of each agent after all its events (kind check_in, update, check_out, or snapshot of a compacted journal).

    A check-in begins anew: fields count from the last one on, or from a snapshot. A field that an event doesn't set (null) keeps
    its value. All is max_by over the sequence number, so it is aggregated before it is shuffled.
    """
    if "folded" not in journal.columns:
        journal = journal.withColumn("folded", F.lit(None).cast(FOLDED))
    journal = journal.where(F.col("kind").isin(*BOARD))
    starts = journal.where("kind IN ('check_in', 'snapshot')").groupBy(by).agg(F.max(order).alias("_start"))
    now = journal.join(starts, by).where(F.col(order) >= F.col("_start"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    left = (F.col("kind") == "check_out") | F.coalesce(F.col("folded.checked_out"), F.lit(False))
    return now.groupBy(by).agg(*[last(c) for c in fields], F.max(order).alias("revision"), F.max("ts").alias("updated"), F.sum(F.coalesce("folded.events", F.lit(1))).alias("events"), F.max_by(left, order).alias("checked_out"))


def compact(journal: DataFrame, fields: list[str], upto: int, by: str = "agent_id", order: str = "seq") -> DataFrame:
    """A journal whose events up to a sequence number are one snapshot an agent, with the later events and all events of other
    kinds as they were. `fold` gives the same of it as of the whole, whatever comes after; compacting again is the same as once."""
    if "folded" not in journal.columns:
        journal = journal.withColumn("folded", F.lit(None).cast(FOLDED))
    early = (F.col(order) <= upto) & F.col("kind").isin(*BOARD)
    state = fold(journal.where(early), fields, by, order)
    have = {by: F.col(by), order: F.col("revision"), "ts": F.col("updated"), "kind": F.lit("snapshot"), "folded": F.struct("events", "checked_out").cast(FOLDED)} | {c: F.col(c) for c in fields}
    snaps = state.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in journal.schema.fields])
    return snaps.unionByName(journal.where(~early))


def counts(agents: DataFrame, now: int) -> DataFrame:
    """How many agents are in each state, and how many leases have run out."""
    stale = ~F.col("checked_out") & (F.col("expires_at") <= now)
    return agents.agg(F.count("*").alias("agents"), F.count_if("checked_out").alias("checked_out"), F.count_if(stale).alias("stale"), F.count_if(~F.col("checked_out") & ~stale).alias("active"))


def path_overlaps(claims: DataFrame) -> DataFrame:
    """a, b, path_a, path_b: claims of different agents on overlapping paths. A path overlaps another exactly if it is among
    the other's folders, so this is an equi-join on folders."""
    up = claims.select(F.col("agent_id").alias("x"), F.col("path").alias("px"), F.explode(folders_above(F.col("path"))).alias("path"))
    hit = up.join(claims.select(F.col("agent_id").alias("y"), F.col("path")), "path").where("x != y")
    swap = F.col("x") > F.col("y")
    return hit.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("path")).otherwise(F.col("px")).alias("path_a"), F.when(swap, F.col("px")).otherwise(F.col("path")).alias("path_b")).distinct()


def symbol_overlaps(claims: DataFrame) -> DataFrame:
    """a, b, symbol claimed by both (claims: agent_id, symbol)."""
    l, r = claims.select(F.col("agent_id").alias("a"), "symbol").distinct(), claims.select(F.col("agent_id").alias("b"), "symbol").distinct()
    return l.join(r, "symbol").where("a < b").select("a", "b", "symbol")


def symbol_contests(claims: DataFrame) -> DataFrame:
    """symbol, agent_id, other, others: a row for each agent on a symbol that others claim too, with one of them (the least, or for
    the least agent the greatest) and how many there are. As many rows as claims, where all pairs of `symbol_overlaps` are
    quadratic; who meets whom follows from it, since all agents of a symbol do (claims: agent_id, symbol)."""
    each = claims.select("agent_id", "symbol").where("agent_id IS NOT NULL AND symbol IS NOT NULL").distinct()
    on = each.groupBy("symbol").agg(F.count("*").alias("_n"), F.min("agent_id").alias("_least"), F.max("agent_id").alias("_most")).where("_n > 1")
    other = F.when(F.col("agent_id") == F.col("_least"), F.col("_most")).otherwise(F.col("_least"))
    return each.join(on, "symbol").select("symbol", "agent_id", other.alias("other"), (F.col("_n") - 1).alias("others"))


def path_contests(claims: DataFrame) -> DataFrame:
    """agent_id, path, over, other, others: a row for each claim and each path at or above it that others claim, with one of them
    and how many there are. At most a row for each claim and folder above it; `path_overlaps` has all pairs of agents."""
    each = claims.select("agent_id", "path").where("agent_id IS NOT NULL AND path IS NOT NULL").distinct()
    on = each.groupBy(F.col("path").alias("over")).agg(F.count("*").alias("_n"), F.min("agent_id").alias("_least"), F.max("agent_id").alias("_most"))
    up = each.select("agent_id", "path", F.explode(folders_above(F.col("path"))).alias("over")).join(on, "over")
    mine = each.select("agent_id", F.col("path").alias("over"), F.lit(1).alias("_mine"))
    # Only an agent that claims the upper path itself is to be left out of its claimants; equal paths are known to be its own.
    own = up.join(mine, ["agent_id", "over"], "left").withColumn("others", F.col("_n") - F.coalesce("_mine", F.lit(0)))
    other = F.when(F.col("_mine").isNotNull() & (F.col("agent_id") == F.col("_least")), F.col("_most")).otherwise(F.col("_least"))
    return own.where("others > 0").select("agent_id", "path", "over", other.alias("other"), "others")


def drift(dirty: DataFrame, claims: DataFrame, cap: int = 8) -> DataFrame:
    """Dirty paths of an agent that no claim of its own covers, at most `cap` per agent with the number of the others."""
    up = dirty.select("agent_id", "path", F.explode(folders_above(F.col("path"))).alias("folder"))
    covered = up.join(claims.select("agent_id", F.col("path").alias("folder")).distinct(), ["agent_id", "folder"], "left_semi").select("agent_id", "path").distinct()
    out = dirty.select("agent_id", "path").distinct().join(covered, ["agent_id", "path"], "left_anti")
    w = Window.partitionBy("agent_id")
    return out.withColumns({"n": F.row_number().over(w.orderBy("path")), "others": F.greatest(F.count("*").over(w) - cap, F.lit(0))}).where(F.col("n") <= cap).drop("n")


def divergence(agents: DataFrame) -> DataFrame:
    """bases on which active agents work and how many; work diverges if there is more than one."""
    return agents.where("base_oid != ''").groupBy("base_oid").agg(F.count("*").alias("agents"))


def divergent_pairs(agents: DataFrame) -> DataFrame:
    """a, base_a, b, base_b: the least active agent, and every one whose base isn't that one's. Agents without a row share
    its base, so two agents diverge exactly if their bases here differ; there is at most a row an agent."""
    there = agents.where("base_oid != ''")
    first = there.agg(F.min(F.struct("agent_id", "base_oid")).alias("f")).select(F.col("f.agent_id").alias("a"), F.col("f.base_oid").alias("base_a"))
    return there.select(F.col("agent_id").alias("b"), F.col("base_oid").alias("base_b")).crossJoin(F.broadcast(first)).where("base_a != base_b").select("a", "base_a", "b", "base_b")


def handoff_status(handoffs: DataFrame, agents: DataFrame, now: int, orphan_secs: int = 86_400) -> DataFrame:
    """accepted, orphaned or offered: orphaned if it is old, its giver has left and nobody is there to take it."""
    f = agents.select(F.col("agent_id").alias("from"), F.col("checked_out").alias("_from"))
    t = agents.select(F.col("agent_id").alias("to"), F.col("checked_out").alias("_to"))
    gone = (F.coalesce("to", F.lit("")) == "") | F.coalesce("_to", F.lit(True))
    orphaned = F.coalesce("_from", F.lit(True)) & (F.lit(now) - F.col("created_at") >= orphan_secs) & gone
    status = F.when(F.col("status") == "accepted", "accepted").when(orphaned, "orphaned").otherwise("offered")
    return handoffs.join(f, "from", "left").join(t, "to", "left").withColumn("derived", status).drop("_from", "_to")


def retained(agents: DataFrame, handoffs: DataFrame, now: int, stale: int = 32) -> DataFrame:
    """Agents to keep: present ones, the newest stale ones, and checked-out ones that a handoff names."""
    named = handoffs.select(F.explode(F.array("from", "to")).alias("agent_id")).where("agent_id != ''").distinct()
    old = ~F.col("checked_out") & (F.col("expires_at") <= now)
    present = agents.where(~F.col("checked_out") & ~old)
    newest = agents.where(old).orderBy(F.desc("updated"), "agent_id").limit(stale)
    return present.unionByName(newest).unionByName(agents.where("checked_out").join(named, "agent_id", "left_semi"))


def _pairs(kind: str, contests: DataFrame, others: Column, own: Column) -> DataFrame:
    """Contests as findings: the two agents in order and what each of them claims."""
    swap = F.col("agent_id") < F.col("other")
    detail = F.when(swap, F.concat_ws(" ", own.cast("string"), others)).otherwise(F.concat_ws(" ", others, own.cast("string")))
    return contests.select(F.lit(kind).alias("kind"), F.least("agent_id", "other").alias("a"), F.greatest("agent_id", "other").alias("b"), detail.alias("detail")).distinct()


def findings(agents: DataFrame, claims: DataFrame, dirty: DataFrame, now: int) -> DataFrame:
    """kind, a, b, detail of all advisories: stale leases, drift, overlapping paths and symbols, divergent bases.

    Overlaps are given as `path_contests` and `symbol_contests`: everyone concerned has a row with one of the others, so that what
    many share makes as many rows as it has claims.
    """
    there = agents.where("NOT checked_out")
    active = there.where(F.col("expires_at") > now)
    none = F.lit(None).cast("string")
    of = lambda df: df.join(active.select("agent_id"), "agent_id", "left_semi")
    parts = [
        there.where(F.col("expires_at") <= now).select(F.lit("stale").alias("kind"), F.col("agent_id").alias("a"), none.alias("b"), F.lit("lease expired").alias("detail")),
        drift(of(dirty), of(claims)).select(F.lit("drift").alias("kind"), F.col("agent_id").alias("a"), none.alias("b"), F.col("path").alias("detail")),
        _pairs("path_overlap", path_contests(of(claims)), F.col("over"), F.col("path")),
        _pairs("symbol_overlap", symbol_contests(of(claims).select("agent_id", F.explode("symbols").alias("symbol"))), F.col("symbol"), F.lit(None)),
        divergent_pairs(active).select(F.lit("base_divergence").alias("kind"), "a", "b", F.concat_ws(" ", "base_a", "base_b").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def split_holdout(worlds: DataFrame, share: float = 0.2) -> DataFrame:
    """Worlds with holdout: the newest fifth (rounded up, at least one, never all) by ts and episode. One world is never held out."""
    n = worlds.count()
    held = 0 if n < 2 else min(max(1, -(-n * int(share * 100) // 100)), n - 1)
    out = ranked(worlds, [F.desc("ts"), F.desc("episode_id")])
    return out.withColumn("holdout", F.col("rank") <= held).drop("rank")


def replay(decisions: DataFrame, outcomes: DataFrame, prefer: dict[str, float], beta: float = 1.0, min_score: float = 0.0, max_batch: int = 4, max_rounds: int = 16, recorded: bool = False) -> DataFrame:
    """decision, action, supported and metrics of a policy over recorded decisions.

    The policy ranks a decision's legal actions by the weights of their features and takes independent ones greedily; that is
    sequential within a decision, so it is a fold over its actions. An episode ends where nothing is chosen. Missing lists are
    empty, and what isn't known to overlap doesn't.
    """
    listed = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    legal, selected = F.coalesce("legal", F.array()), listed(F.col("selected"), "array<string>")

    def score(x: Column) -> Column:
        hits = {"non_overlapping": ~F.coalesce(x["overlapping"], F.lit(False)), **{k: F.coalesce(x["kind"] == k, F.lit(False)) for k in ("continue", "root", "handoff")}}
        total = F.lit(0.0)
        for feature, weight in prefer.items():
            if feature in hits:
                total = total + F.when(hits[feature], float(weight)).otherwise(0.0)
        return total * float(beta)

    def over(p: Column, q: Column) -> Column:
        return (p == q) | F.startswith(p, F.concat(q, F.lit("/"))) | F.startswith(q, F.concat(p, F.lit("/")))

    def apart(x: Column, y: Column) -> Column:
        tied = F.array_contains(y["causal_parents"], x["id"]) | F.array_contains(x["causal_parents"], y["id"])
        return ~F.coalesce(tied, F.lit(False)) & ~F.exists(x["paths"], lambda p: F.coalesce(F.exists(y["paths"], lambda q: over(p, q)), F.lit(False)))

    if recorded:
        chosen = F.transform(F.filter(legal, lambda x: F.exists(selected, lambda s: s.eqNullSafe(x["id"]))), lambda x: x["id"])
    else:
        # Ordered by score, id and place; structs compare field by field.
        order = F.transform(legal, lambda x, i: F.struct((-score(x)).alias("rank"), x["id"].alias("id"), i.alias("at"), listed(x["paths"], "array<string>").alias("paths"), listed(x["causal_parents"], "array<string>").alias("causal_parents")))
        able = F.filter(F.array_sort(order), lambda x: -x["rank"] >= float(min_score))
        none = F.filter(able, lambda x: F.lit(False))
        take = lambda taken, x: F.when((F.size(taken) < max_batch) & F.forall(taken, lambda y: apart(y, x)), F.concat(taken, F.array(x))).otherwise(taken)
        chosen = F.transform(F.aggregate(able, none, take), lambda x: x["id"])

    got = decisions.select("episode_id", F.col("id").alias("decision"), "seq", chosen.alias("chosen"))
    w = Window.partitionBy("episode_id").orderBy("seq", "decision")
    ended = F.max((F.size("chosen") == 0).cast("int")).over(w)
    live = got.withColumns({"round": F.row_number().over(w), "ended": ended}).where((F.col("round") <= max_rounds) & (F.col("ended") == 0))
    acts = live.select("episode_id", "decision", F.explode("chosen").alias("action"))
    chosen = decisions.select(F.col("id").alias("decision"), F.explode("selected").alias("action")).distinct().withColumn("supported", F.lit(True))
    known = outcomes.groupBy("decision", "action").agg(F.max_by(F.struct("metrics", "censored"), "seq").alias("o"))
    played = acts.join(chosen, ["decision", "action"], "left").fillna(False, ["supported"]).join(known, ["decision", "action"], "left")
    return played.withColumn("metrics", F.when(F.col("supported") & ~F.coalesce(F.col("o.censored"), F.lit(False)), F.col("o.metrics"))).drop("o")


def replay_summary(played: DataFrame) -> DataFrame:
    """Support, sums of cost and conflicts, maxima of critical path and score."""
    m = lambda k: F.try_element_at("metrics", F.lit(k))
    support = F.when(F.count("*") == 0, F.lit(1.0)).otherwise(F.count_if("supported") / F.count("*"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return played.agg(support.alias("support"), F.count_if(~F.col("supported")).alias("out_of_support"), zero(F.sum(m("cost"))).alias("cost"), zero(F.sum(m("conflicts"))).alias("conflicts"), zero(F.max(m("critical_path"))).alias("critical_path"), zero(F.max(m("score"))).alias("quality"))


def gate_minima(played: DataFrame) -> DataFrame:
    return played.select(F.explode("metrics").alias("metric", "value")).groupBy("metric").agg(F.min("value").alias("least"))


def overlaps(a, b):
    return paths_overlap(a, b)


def unsafe_payload(body: Column) -> Column:
    """Why a JSON body isn't stored: a source body under a key at the top, or key material anywhere; null if it may be."""
    keys = F.array_intersect(F.json_object_keys(body), F.lit(list(BODY_KEYS)))
    return F.when(F.size(keys) > 0, F.concat(F.lit("source body: "), F.array_join(F.array_sort(keys), ", "))).when(F.contains(body, F.lit("-----BEGIN ")), F.lit("secret"))


def admit(agents: DataFrame, requests: DataFrame, handoffs: DataFrame, now: int, ttl: int = 300, suspend_ttl: int = 86_400) -> DataFrame:
    """What becomes of a batch of check-ins, updates and check-outs: ord, agent_id, kind, status, error, lease, revision, expires_at.

    agents: agent_id, state, lease_id, revision, expires_at, ttl_secs, dirty (how many paths), checkpoint. requests: ord,
    agent_id, kind, lease_id, expected_revision, force, state, ttl_secs, dirty, checkpoint, reason, handoff (whether it gives
    one), handoff_id (which it takes). handoffs: handoff_id, to, status. Status is ok, already (checked out before), refused, or
    deferred: an agent's later requests wait for the state after its first one, so a batch is judged by joins alone.
    """
    q = requests.join(requests.groupBy("agent_id").agg(F.min("ord").alias("_first")), "agent_id")
    a = agents.select("agent_id", *[F.col(c).alias(f"_{c}") for c in ("state", "lease_id", "revision", "expires_at", "ttl_secs", "dirty", "checkpoint")])
    h = handoffs.select("handoff_id", F.col("to").alias("_to"), F.col("status").alias("_offer"))
    j = q.join(a, "agent_id", "left").join(h, "handoff_id", "left")
    c = F.col
    known, gone = c("_revision").isNotNull(), c("_state") == "checked_out"
    live = known & ~gone
    mine = F.coalesce(c("lease_id") == c("_lease_id"), F.lit(False))
    expired = (c("_expires_at") > 0) & (F.lit(now) >= c("_expires_at"))
    conflict = F.coalesce(c("expected_revision") != F.coalesce("_revision", F.lit(0)), F.lit(False))
    taken = F.when(c("handoff_id").isNull(), None).when(c("_offer").isNull(), "unknown handoff").when(c("_offer") != "offered", "handoff not offered").when((c("_to") != "") & (c("_to") != c("agent_id")), "handoff is another's")
    to = F.coalesce("state", "_state")
    unsaved = (to == "suspended") & (F.coalesce("dirty", "_dirty", F.lit(0)) > 0) & (F.coalesce("checkpoint", "_checkpoint", F.lit("")) == "")
    lease = F.when(c("lease_id").isNull(), "lease required").when(~mine, "lease mismatch").when(conflict, "revision conflict")
    enter = F.when(live & ~mine & ~expired & ~F.coalesce("force", F.lit(False)), "checked in").when(conflict, "revision conflict").otherwise(taken)
    change = F.when(~live, "not checked in").when(lease.isNotNull(), lease).when(to == "checked_out", "update can't check out").when(unsaved, "checkpoint required")
    leave = F.when(~known, "not checked in").when(gone, None).when(lease.isNotNull(), lease).when((c("reason") == "handed_off") & ~F.coalesce("handoff", F.lit(False)), "handoff required")
    error = F.when(c("kind") == "check_in", enter).when(c("kind") == "update", change).when(c("kind") == "check_out", leave).otherwise("unknown kind")
    later = c("ord") > c("_first")
    out = j.withColumn("error", F.when(~later, error))
    state = F.when(later, "deferred").when(c("error").isNotNull(), "refused").when((c("kind") == "check_out") & gone, "already").otherwise("ok")
    out = out.withColumn("status", state)
    revision = F.coalesce("_revision", F.lit(0)) + 1
    fresh = (c("kind") == "check_in") & ~(live & mine)
    key = F.when(fresh, F.substring(F.md5(F.concat_ws("|", "agent_id", revision, F.lit(now))), 1, 16)).otherwise(c("_lease_id"))
    life = F.when((c("kind") == "update") & (to == "suspended"), suspend_ttl).when(c("kind") == "update", F.coalesce("ttl_secs", F.greatest("_ttl_secs", F.lit(ttl)))).otherwise(F.coalesce("ttl_secs", F.lit(ttl)))
    ok = c("status") == "ok"
    return out.select("ord", "agent_id", "kind", "status", "error", F.when(ok, key).alias("lease"), F.when(ok, revision).alias("revision"), F.when(ok & (c("kind") != "check_out"), F.lit(now) + F.greatest(life, F.lit(1))).alias("expires_at"))
