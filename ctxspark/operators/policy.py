"""Policies of choosing actions, judged on recorded decisions: worlds, gates, verdicts, promotion, and advice.

An episode's decisions are a world. A policy is replayed on closed worlds and compared with the incumbent (what was recorded) on all
of them, on the newest fifth, and on the tasks that were held out. A replay may only use outcomes of actions that were taken, so an
action that wasn't is out of support and earns nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import presence

#: What of an action a policy may prefer, how much support it needs to be promoted, and what both sides are compared by.
FEATURES = ("non_overlapping", "continue", "root", "handoff")
MIN_SUPPORT = 0.7
AXES = ("cost", "conflicts", "critical_path", "quality")


@dataclass(frozen=True)
class Policy:
    """Weights of features, and the least score, most actions of a decision and most decisions of an episode that are played."""

    id: str
    prefer: dict[str, float] = field(default_factory=dict)
    beta: float = 1.0
    min_score: float = 0.0
    max_batch: int = 4
    max_rounds: int = 16
    recorded: bool = False

    def __post_init__(self) -> None:
        unknown = set(self.prefer) - set(FEATURES)
        if unknown:
            raise ValueError(f"unknown feature {min(unknown)}")
        if self.beta <= 0 or self.max_batch < 1 or self.max_rounds < 1:
            raise ValueError("beta, max_batch and max_rounds must be positive")


INCUMBENT = Policy("incumbent", max_batch=32, max_rounds=10_000, recorded=True)


def worlds(decisions: DataFrame, agents: DataFrame) -> DataFrame:
    """episode_id, ts and task (of its first decision, and of the first that has one), open: whether an agent of it is still there.

    decisions: episode_id, id, seq, ts, agent_id, task, legal, selected. agents: agent_id, checked_out; one that isn't known is gone.
    """
    there = decisions.select("episode_id", "agent_id").distinct().join(agents.where("NOT checked_out").select("agent_id"), "agent_id", "left_semi").select("episode_id", F.lit(True).alias("open")).distinct()
    named = F.when(F.coalesce("task", F.lit("")) != "", F.col("seq"))
    first = decisions.groupBy("episode_id").agg(F.min_by("ts", "seq").alias("ts"), F.coalesce(F.min_by("task", named), F.lit("")).alias("task"))
    return first.join(there, "episode_id", "left").withColumn("open", F.coalesce("open", F.lit(False)))


def held_out(worlds_: DataFrame) -> DataFrame:
    """Worlds with holdout (the newest fifth) and task_holdout (the last task by name, if there are several)."""
    tasks = worlds_.where("task != ''").agg(F.min("task").alias("a"), F.max("task").alias("b")).select(F.when(F.col("a") != F.col("b"), F.col("b")).alias("_task"))
    return presence.split_holdout(worlds_).crossJoin(F.broadcast(tasks)).withColumn("task_holdout", F.coalesce(F.col("task") == F.col("_task"), F.lit(False))).drop("_task")


def played(policy: Policy, decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    p = policy
    return presence.replay(decisions, outcomes, p.prefer, p.beta, p.min_score, p.max_batch, p.max_rounds, p.recorded)


def _sets(actions: DataFrame, worlds_: DataFrame) -> DataFrame:
    """actions of closed worlds, once for each set (all, holdout, task_holdout) that their world is in."""
    sets = F.array_compact(F.array(F.lit("all"), F.when(F.col("holdout"), "holdout"), F.when(F.col("task_holdout"), "task_holdout")))
    return actions.join(worlds_.where("NOT open").select("episode_id", F.explode(sets).alias("set")), "episode_id")


def evaluate(policies: list[Policy], decisions: DataFrame, outcomes: DataFrame, agents: DataFrame, gates: list[str]) -> DataFrame:
    """A verdict a policy: worlds by set, support and actions out of support (all and of the holdout), the four axes of the
    policy and of the incumbent, the gates it fails (a metric whose least value is below the incumbent's, or that it has none
    of, in a holdout set), and promotion_ok: a holdout with enough support, nothing out of support in it, and no failed gate."""
    w = stored(held_out(worlds(decisions, agents)), "policy-worlds")
    sums, least = [], []
    for name, policy in [("incumbent", INCUMBENT), *((p.id, p) for p in policies)]:
        a = stored(_sets(played(policy, decisions, outcomes), w), "policy-played").withColumn("policy", F.lit(name))
        m = lambda k: F.try_element_at("metrics", F.lit(k))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        sums.append(a.groupBy("policy", "set").agg(F.count_if("supported").alias("inside"), F.count_if(~F.col("supported")).alias("outside"), zero(F.sum(m("cost"))).alias("cost"), zero(F.sum(m("conflicts"))).alias("conflicts"), zero(F.max(m("critical_path"))).alias("critical_path"), zero(F.max(m("score"))).alias("quality")))
        least.append(a.select("policy", "set", F.explode("metrics").alias("metric", "value")).where(F.col("metric").isin(gates)).groupBy("policy", "set", "metric").agg(F.min("value").alias("least")))
    sums, least = (stored(_union(parts), "policy-sums") for parts in (sums, least))

    mine = least.where("policy != 'incumbent'").select("policy", "set", "metric", "least")
    theirs = least.where("policy = 'incumbent' AND set != 'all'").select("set", "metric", F.col("least").alias("bound"))
    asked = F.array(*[F.lit(p.id) for p in policies]).cast("array<string>")  # as many as were asked about
    names = decisions.sparkSession.range(1).select(F.explode(asked).alias("policy"))
    compared = names.crossJoin(theirs).join(mine, ["policy", "set", "metric"], "left")
    failed = compared.where(F.col("least").isNull() | (F.col("least") + 1e-9 < F.col("bound"))).groupBy("policy").agg(F.array_sort(F.collect_set(F.concat_ws(":", "set", "metric"))).alias("failed"))

    counts = w.agg(F.count("*").alias("worlds"), F.count_if("open").alias("censored"), F.count_if("holdout").alias("holdout_worlds"), F.count_if("task_holdout").alias("task_holdout_worlds"))
    share = lambda c: F.when(c("inside") + c("outside") > 0, c("inside") / (c("inside") + c("outside"))).otherwise(1.0)
    of = lambda name, policy: sums.where((F.col("set") == name) & policy)
    cand = F.col("policy") != "incumbent"
    col = lambda suffix: lambda c: F.coalesce(F.col(c + suffix), F.lit(0))
    full = of("all", cand).select("policy", F.col("inside").alias("inside_all"), F.col("outside").alias("outside_all"), *AXES)
    hold = of("holdout", cand).select("policy", F.col("inside").alias("inside_hold"), F.col("outside").alias("outside_hold"))
    base = of("all", ~cand).select(*[F.col(c).alias(f"incumbent_{c}") for c in AXES])
    out = names.join(full, "policy", "left").join(hold, "policy", "left").join(failed, "policy", "left").crossJoin(counts).join(base, F.lit(True), "left")
    support, held = share(col("_all")), share(col("_hold"))
    none = F.array().cast("array<string>")
    out = out.withColumns({"support": support, "holdout_support": held, "out_of_support": F.coalesce("outside_all", F.lit(0)), "failed": F.coalesce("failed", none)} | {c: F.coalesce(c, F.lit(0.0)) for c in (*AXES, *(f"incumbent_{c}" for c in AXES))})
    ok = (F.col("holdout_worlds") > 0) & (F.col("holdout_support") + 1e-12 >= MIN_SUPPORT) & (F.coalesce("outside_hold", F.lit(0)) == 0) & (F.size("failed") == 0)
    return out.withColumn("promotion_ok", ok).select("policy", "worlds", "censored", "holdout_worlds", "task_holdout_worlds", "support", "holdout_support", "out_of_support", *AXES, *[f"incumbent_{c}" for c in AXES], "failed", "promotion_ok")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def promotions(verdicts: DataFrame, seq: int, ts: int) -> DataFrame:
    """Journal events (seq, ts, kind, id, support) that promote the policies that may be; the others get none."""
    n = F.row_number().over(Window.orderBy("policy"))  # a row a policy that was asked about
    return verdicts.where("promotion_ok").select((n + seq).cast("long").alias("seq"), F.lit(ts).cast("long").alias("ts"), F.lit("policy_promote").alias("kind"), F.col("policy").alias("id"), F.col("holdout_support").alias("support"))


def records(events: DataFrame) -> DataFrame:
    """id, support and status of every promoted policy after all events (policy_promote, policy_retire): the last promotion that
    wasn't retired since is active, if nothing was promoted after it; all others are retired."""
    up = events.where("kind = 'policy_promote'").groupBy("id").agg(F.max("seq").alias("up"), F.max_by("support", "seq").alias("support"))
    down = events.where("kind = 'policy_retire'").groupBy("id").agg(F.max("seq").alias("down"))
    last = F.broadcast(events.where("kind = 'policy_promote'").agg(F.max("seq").alias("last")))
    active = (F.col("up") == F.col("last")) & F.coalesce(F.col("down") < F.col("up"), F.lit(True))
    return up.join(down, "id", "left").crossJoin(last).select("id", "support", F.when(active, "active").otherwise("retired").alias("status"))


def advise(active: DataFrame, prefer: list[str], findings: DataFrame, handoffs: DataFrame) -> DataFrame:
    """kind, a, b, detail and confidence of what the active policy (a row of `records`, or none) says about findings and about
    handoffs (id, from, to, derived) that nobody took. It only reads."""
    wanted = ["stale"] + ["path_overlap", "symbol_overlap", "drift"] * ("non_overlapping" in prefer)
    found = findings.where(F.col("kind").isin(wanted)).select("kind", "a", "b", "detail")
    offered = handoffs.where((F.col("derived") == "offered") & F.lit("handoff" in prefer or not prefer)).select(F.lit("handoff").alias("kind"), F.col("from").alias("a"), F.nullif("to", F.lit("")).alias("b"), F.col("id").alias("detail"))
    policy = F.broadcast(active.where("status = 'active'").select(F.col("support").alias("confidence")).limit(1))
    return found.unionByName(offered).crossJoin(policy)
