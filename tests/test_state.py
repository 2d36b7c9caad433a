"""Records, presence, decisions and replay on small rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import decide, digest, graph, paging, presence, records, runtime, telemetry


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_call_path(spark):
    adj = rows(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e")], "caller string, callee string")
    path = lambda *x, **k: [r.node for r in graph.call_path(adj, *x, **k).orderBy("step").collect()]
    assert path("a", "e") == ["a", "b", "c", "e"]
    assert path("a", "a") == ["a"]
    assert path("e", "a") == []
    assert path("a", "e", max_depth=2) == []


def test_fold(spark):
    j = rows(spark, [(1, "x", 10, "check_in", "busy", "n1"), (2, "x", 11, "update", None, "n2"), (3, "x", 12, "check_out", None, None), (4, "y", 13, "update", "lost", None), (5, "z", 14, "check_in", "a", None), (6, "z", 15, "check_in", "b", None)], "seq long, agent_id string, ts long, kind string, state string, note string")
    got = {r.agent_id: (r.state, r.note, r.checked_out, r.revision) for r in presence.fold(j, ["state", "note"]).collect()}
    assert got == {"x": ("busy", "n2", True, 3), "z": ("b", None, False, 6)}


def test_findings(spark):
    agents = rows(spark, [("a", False, 100, "o1"), ("b", False, 100, "o2"), ("c", False, 5, "o3"), ("d", True, 100, "o4")], "agent_id string, checked_out boolean, expires_at long, base_oid string")
    claims = rows(spark, [("a", "src", ["f"]), ("b", "src/x.rs", ["f"]), ("c", "src", ["f"])], "agent_id string, path string, symbols array<string>")
    dirty = rows(spark, [("a", "src/y.rs"), ("a", "docs/z.md"), ("b", "srcs/q")], "agent_id string, path string")
    got = {(r.kind, r.a, r.b, r.detail) for r in presence.findings(agents, claims, dirty, 50).collect()}
    assert got == {("stale", "c", None, "lease expired"), ("drift", "a", None, "docs/z.md"), ("drift", "b", None, "srcs/q"), ("path_overlap", "a", "b", "src src/x.rs"), ("symbol_overlap", "a", "b", "f"), ("base_divergence", "a", "b", "o1 o2")}
    kept = presence.retained(agents.withColumn("updated", F.lit(1)), rows(spark, [("d", "")], "from string, to string"), 50)
    assert kept.count() == 4


def test_upsert_and_undo(spark):
    t = rows(spark, [("d1", "open", 1, "x"), ("d2", "gated", 2, "y")], "id string, status string, updated long, summary string")
    n = rows(spark, [("d1", "done", 5, None), ("d3", "open", 3, "z")], "id string, status string, updated long, summary string")
    got = {r.id: (r.status, r.updated, r.summary) for r in records.upsert(t, n, "id", "updated").collect()}
    assert got == {"d1": ("done", 5, "x"), "d2": ("gated", 2, "y"), "d3": ("open", 3, "z")}
    e = rows(spark, [("p", 1, "a", "b"), ("p", 2, "b", "c"), ("q", 3, None, "n")], "path string, ord int, before string, after string")
    now = rows(spark, [("p", "c"), ("q", "changed")], "path string, content string")
    assert {r.path: (r.restore, r.conflict) for r in records.undo_targets(e, now).collect()} == {"p": ("a", False), "q": (None, True)}


def test_board(spark):
    e = rows(spark, [("s", 1, "critic", False, 0), ("s", 2, "critic", True, 1), ("t", 1, "user", None, 0), ("u", 1, "critic", None, 0)], "session string, id int, role string, approved boolean, questions int")
    assert {r.session: r.state for r in records.convergence(e).collect()} == {"s": "approved_with_questions", "t": "no_critic", "u": "undecided"}
    x = rows(spark, [(1, ["aaaa" * 4, "bbbb" * 4, "c"])], "id int, items array<string>")
    r = records.cap_fields(x, "items", 5, ["id"]).first()
    assert len(r.kept) == 1 and len(r.spilled) == 2


def test_ideas(spark):
    ideas = rows(spark, [("big-box", "Big box", "b", "seed", "2024-01-01", ["t"])], "slug string, title string, body string, status string, touched string, tags array<string>")
    assert {r.slug for r in records.capture_idea(ideas, "Big Box", "again", [], "2024-02-01").collect()} == {"big-box", "big-box-2"}
    assert records.tagged(ideas, "T").count() == 1


def test_note(spark):
    text = "# T\n\n## A\n\nold\n\n## B\n\nkeep\n"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(records.compose_note(F.lit(text), "A", "new $1", "replace")) == "# T\n\n## A\n\nnew $1\n## B\n\nkeep\n"
    assert one(records.compose_note(F.lit(text), "C", "new")).endswith("\n\n## C\n\nnew\n")


def test_decide(spark):
    req = rows(spark, [("r", "fix the parser bug", "what next", [("parser", "fix parser"), ("docs", "write docs"), ("none", "")])], "id string, state string, question string, options array<struct<id:string,description:string>>")
    assert decide.decide(req).first().chosen == "parser"
    a = {(r.option, round(r.raw_score, 9)) for r in decide.word_scores(req).collect()}
    assert a == {(r.option, round(r.raw_score, 9)) for r in decide.debiased(req).collect()}
    tie = rows(spark, [("r", "", "", [("x", "q"), ("y", "q")])], "id string, state string, question string, options array<struct<id:string,description:string>>")
    assert decide.decide(tie).first().chosen == "y"


def test_replay(spark):
    legal = "array<struct<id:string,kind:string,paths:array<string>,causal_parents:array<string>,overlapping:boolean>>"
    d = rows(spark, [("e", "d1", 1, [("a", "root", ["src"], [], False), ("b", "continue", ["src/x"], [], False), ("c", "continue", ["docs"], [], True)], ["a", "c"]), ("e", "d2", 2, [], []), ("e", "d3", 3, [("z", "root", [], [], False)], ["z"])], f"episode_id string, id string, seq long, legal {legal}, selected array<string>")
    o = rows(spark, [("d1", "a", 1, {"cost": 2.0, "score": 1.0}, False), ("d1", "a", 2, {"cost": 3.0, "score": 5.0}, False)], "decision string, action string, seq long, metrics map<string,double>, censored boolean")
    played = presence.replay(d, o, {"root": 2.0, "continue": 1.0})
    assert {(r.decision, r.action, r.supported) for r in played.collect()} == {("d1", "a", True), ("d1", "c", True)}
    s = presence.replay_summary(played).first()
    assert (s.support, s.cost, s.quality) == (1.0, 3.0, 5.0)
    assert {r.metric: r.least for r in presence.gate_minima(played).collect()} == {"cost": 3.0, "score": 5.0}


@pytest.mark.parametrize("n, level", [(10, "low"), (85, "medium")])
def test_pressure(spark, n, level):
    e = spark.range(n).select(F.lit("ok").alias("outcome"))
    assert telemetry.pressure(e).first().level == level
    assert telemetry.pressure(e.limit(0)).first().level == "low"


def test_defect_chunks(spark):
    rows = [("d1", "open", "", "s", ["x", "y"], [], None), ("d2", "done", "ui", "s", [], [], []), ("d3", "odd", "ui", None, None, ["e"], ["a", "b"]), ("d4", None, None, "s", [], [], [])]
    d = spark.createDataFrame(rows, "id string, status string, subsystem string, summary string, acceptance array<string>, evidence array<string>, anchors array<string>")
    got = {r.id: (r.heading, r.body, r.boost) for r in records.defect_chunks(d).collect()}
    assert got == {
        "d1": ("DEFECT [open] d1", "Defect d1 (open) in unspecified: s\nAcceptance:\n- x\n- y\n", 4.0),
        "d3": ("DEFECT [odd] d3", "Defect d3 (odd) in ui: \nEvidence: e\nAnchors: a, b\n", 0.0),
        "d4": ("DEFECT [] d4", "Defect d4 () in unspecified: s\n", 0.0),
    }
    plain = records.defect_chunks(d.drop("acceptance", "evidence", "anchors")).collect()
    assert {r.body for r in plain} == {"Defect d1 (open) in unspecified: s\n", "Defect d3 (odd) in ui: \n", "Defect d4 () in unspecified: s\n"}


def test_idea_writes(spark):
    ideas = spark.createDataFrame([("a", "seed", "2024-01-01", None), ("b", "seed", "2024-01-02", "was")], "slug string, status string, touched string, archive_reason string")
    chosen = F.col("slug") == "b"
    assert [tuple(r) for r in records.touch_ideas(ideas, chosen, "2024-02-01").orderBy("slug").collect()] == [("a", "seed", "2024-01-01", None), ("b", "seed", "2024-02-01", "was")]
    assert tuple(records.set_idea_status(ideas, chosen, "archived", "2024-02-01", " no ").where(chosen).first()) == ("b", "archived", "2024-02-01", "no")
    assert tuple(records.set_idea_status(ideas, chosen, "sprouted", "2024-02-01", "no").where(chosen).first()) == ("b", "sprouted", "2024-02-01", "was")
    with pytest.raises(ValueError):
        records.set_idea_status(ideas, chosen, "lost", "2024-02-01")


def test_divergence_is_linear(spark):
    agents = spark.createDataFrame([("a", "o1"), ("b", "o2"), ("c", "o2"), ("d", "o1"), ("e", ""), ("f", "o3")], "agent_id string, base_oid string")
    assert sorted(tuple(r) for r in presence.divergent_pairs(agents).collect()) == [("a", "o1", "b", "o2"), ("a", "o1", "c", "o2"), ("a", "o1", "f", "o3")]
    assert presence.divergent_pairs(agents.where("base_oid = 'none'")).count() == 0


def test_budget_page_grows(spark):
    x = spark.range(500).selectExpr("id", "CAST(id >= 450 AS INT) AS size")
    got = [r.id for r in paging.budget_page(x, F.col("size"), ["id"], 3, offset=2, page=5).orderBy("id").collect()]
    assert got == list(range(2, 453))
    assert paging.budget_page(x.limit(0), F.col("size"), ["id"], 3).count() == 0


def output(spark, text):
    return rows(spark, [("r", i, t) for i, t in enumerate(text.split("\n"))], "run string, ord int, text string")


def test_digests(spark):
    short = output(spark, "## main...origin/main\n M a/b.py\n?? new/x.py\n?? new/y.py\n?? top\nR  old.py -> new.py\nMM c\n\nnothing here")
    got = {r.kind: (r.n, r.paths, r.more) for r in digest.status(short, cap=1).collect()}
    assert got == {"modified": (2, ["a/b.py"], 1), "untracked new": (2, [], 0), "untracked .": (1, [], 0), "renamed": (1, ["new.py"], 0)}
    long = output(spark, "On branch main\n\tmodified:   a.rs\n\tnew file:   b.rs\n\tdeleted:    c.rs")
    assert {(r.kind, r.path) for r in digest.status_lines(long).collect()} == {("modified", "a.rs"), ("added", "b.rs"), ("deleted", "c.rs")}
    log = output(spark, "commit 0123456789ab\nAuthor: x\nDate: y\n\n    First thing\n\n    body\ncommit fedcba9876\nMerge: a b\n\n    Second")
    assert [(r.hash, r.subject) for r in digest.log(log).orderBy("ord").collect()] == [("0123456", "First thing"), ("fedcba9", "Second")]
    assert [(r.hash, r.subject) for r in digest.log(output(spark, "0123456 one\nabcdef0 two\nno hash")).orderBy("ord").collect()] == [("0123456", "one"), ("abcdef0", "two")]
    assert digest.log(output(spark, "")).count() == 0
    lines = [r.text for r in digest.diff(output(spark, "diff --git a b\nindex 1\n--- a\n+++ b\n@@ -1 +1 @@\n same\n+1\n-2\n+3\n+4\ndiff --git c d\n+5"), cap=2).orderBy("ord").collect()]
    assert lines == ["diff --git a b", "index 1", "--- a", "+++ b", "@@ -1 +1 @@", "+1", "-2", "…", "diff --git c d", "+5"]
    counts, kept = digest.cargo_test(output(spark, "test a ... ok\n    lost\ntest b ... FAILED\n    why\n\tmore\nother\n    lost\ntest result: FAILED. 1 passed"))
    assert tuple(counts.first())[1:] == (1, 2, 4) and [r.ord for r in kept.orderBy("ord").collect()] == [2, 3, 4, 7]
    one = spark.range(1).select(digest.shorter(F.lit("ab"), F.lit("abc")).alias("a"), digest.shorter(F.lit(""), F.lit("abc")).alias("b"), digest.shorter(F.lit("abcd"), F.lit("abc")).alias("c")).first()
    assert tuple(one) == ("ab", "abc", "abc")


def test_admit(spark):
    agents = rows(spark, [("a", "checked_in", "L", 3, 100, 60, 1, None), ("b", "checked_out", "M", 5, 100, 60, 0, None)], "agent_id string, state string, lease_id string, revision int, expires_at int, ttl_secs int, dirty int, checkpoint string")
    handoffs = rows(spark, [("h", "z", "offered")], "handoff_id string, to string, status string")
    fields = "ord int, agent_id string, kind string, lease_id string, expected_revision int, force boolean, state string, ttl_secs int, dirty int, checkpoint string, reason string, handoff boolean, handoff_id string"

    def ask(agent, kind, lease=None, expected=None, force=None, state=None, ttl=None, dirty=None, checkpoint=None, reason=None, handoff=None, handoff_id=None, now=50):
        r = presence.admit(agents, rows(spark, [(1, agent, kind, lease, expected, force, state, ttl, dirty, checkpoint, reason, handoff, handoff_id)], fields), handoffs, now).first()
        return r.status, r.error, r.revision, r.expires_at

    assert ask("a", "check_in") == ("refused", "checked in", None, None)
    assert ask("a", "check_in", "L") == ("ok", None, 4, 350)
    assert ask("a", "check_in", now=100) == ("ok", None, 4, 400)
    assert ask("c", "check_in", expected=0, ttl=10) == ("ok", None, 1, 60)
    assert ask("c", "check_in", handoff_id="h") == ("refused", "handoff is another's", None, None)
    assert ask("z", "check_in", handoff_id="h") == ("ok", None, 1, 350)
    assert ask("a", "update", "L", state="suspended") == ("refused", "checkpoint required", None, None)
    assert ask("a", "update", "L", state="suspended", checkpoint="s") == ("ok", None, 4, 86_450)
    assert ask("a", "update", "L", expected=2) == ("refused", "revision conflict", None, None)
    assert ask("b", "update", "M") == ("refused", "not checked in", None, None)
    assert ask("b", "check_out", "M") == ("already", None, None, None)
    assert ask("a", "check_out", "L", reason="handed_off") == ("refused", "handoff required", None, None)
    assert ask("a", "check_out", "L") == ("ok", None, 4, None)


def test_includees_and_kinds(spark):
    i = rows(spark, [("a.c", "x.h", 2), ("a.c", "y.h", 1), ("a.c", "x.h", 5), ("b.c", "z.h", 1)], "rel string, target string, ord int")
    assert [tuple(r) for r in graph.includees(i, "a.c").collect()] == [("y.h", 1), ("x.h", 2)]
    d = rows(spark, [("f", "function"), ("r", "record"), ("m", "module")], "name string, kind string")
    assert {r.name for r in graph.of_kind(d).collect()} == {"f", "r"} and graph.of_kind(d, "module").count() == 1


def test_ranks_by_ranges(spark):
    import random

    from ctxspark.operators import ranking

    rng = random.Random(4)
    data = [(i, rng.randrange(50), rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(data, "id long, k long, n long").repartition(7)
    got = ranking.ranked(df, [F.desc("k"), "id"], F.coalesce("n", F.lit(0))).collect()
    total = 0
    for place, (i, k, n) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1):
        total += n or 0
        row = next(r for r in got if r.id == i)
        assert (row["rank"], row.used, row.k, row.n) == (place, total, k, n)
    assert ranking.ranked(df.limit(0), ["id"]).count() == 0


def test_wide_levels(spark, monkeypatch):
    from ctxspark.operators import graph

    edges = spark.createDataFrame([("s", f"m{i}") for i in range(30)] + [(f"m{i}", f"n{i % 3}") for i in range(30)] + [("n2", "goal"), ("n1", "goal")], "caller string, callee string")
    want = [r.node for r in graph.call_path(edges, "s", "goal").orderBy("step").collect()]
    monkeypatch.setattr(graph, "WIDE", 0)
    assert [r.node for r in graph.call_path(edges, "s", "goal").orderBy("step").collect()] == want and len(want) == 4


def test_a_log_is_read_in_one_pass(spark):
    """Against a plain reading of several runs, and with one shuffle of the lines, which leaves headers and blank lines out."""
    rng = random.Random(3)
    kinds = ["commit {:07x}89", "Author: x", "Date: y", "Merge: a", "", " \t", "    said {}", "{:07x} short {}", "plain {}", None]
    text = lambda k, i: None if k is None else k.format(*[rng.randrange(16**7) if ":07x" in k else i, i])
    lines = [(f"r{r}" if r else None, i, text(rng.choice(kinds), i)) for r in range(5) for i in range(80)]
    want, commit = [], {}
    for run, i, x in lines:
        if x is not None and re.match("commit [0-9a-f]{7}", x):
            commit[run] = x[7:14]
        elif x and not re.match("commit |Author:|Date:|Merge:", x) and x.strip(" \t\r"):
            if commit.get(run):
                want.append((run, i, commit.pop(run), x.strip(" \t\r")))
            elif re.match("[0-9a-f]{7} .", x):
                want.append((run, i, x[:7], x[8:]))
    df = digest.log(rows(spark, rng.sample(lines, len(lines)), "run string, ord int, text string"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and len(want) > 40
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_buckets_are_dealt_out_by_their_number(spark, monkeypatch):
    rng = random.Random(4)
    data = [(f"p{rng.randrange(30)}" if k % 40 else None, 10 * k, 10 * k + rng.randrange(9), rng.choice(["a", "a", "b", None])) for k in range(1500)]
    want = []
    for proc in {x[0] for x in data}:
        own = sorted(x for x in data if x[0] == proc)
        per = -(-len(own) // 4)
        for i in range(0, len(own), per):
            some, kinds = own[i : i + per], {x[3] for x in own[i : i + per]} - {None}
            want.append((proc, i // per, some[0][1], max(x[2] for x in some), sum(x[2] - x[1] for x in some), len(some), kinds.pop() if len(kinds) == 1 else "mixed"))
    df = rows(spark, data, "proc string, start long, end long, kind string")
    monkeypatch.setattr(runtime, "PART_ROWS", 100)
    got = runtime.buckets(df, ["proc"], 4, rows=1500)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) == sorted(map(tuple, runtime.buckets(df, ["proc"], 4).collect()), key=str)
    assert got.rdd.getNumPartitions() == 16
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Window [") == plan.count("Exchange ") == 1 and plan.count("Sort [") == 2


def test_replay_against_a_plain_fold_without_python(spark):
    rng = random.Random(8)
    paths, kinds = ["a", "a/b", "a/b/c", "ab", "b", ""], ["root", "continue", "handoff", "other", None]
    action = lambda i: (i, rng.choice(kinds), rng.sample(paths, rng.randrange(3)), rng.sample("uvwxyz", rng.randrange(2)), rng.choice([True, False, None]))
    d = [(f"e{k}", f"d{k}", k, [action(i) for i in rng.sample("uvwxyz", rng.randrange(1, 6))], rng.sample("uvwxyz", 2)) for k in range(120)]
    legal = "array<struct<id:string,kind:string,paths:array<string>,causal_parents:array<string>,overlapping:boolean>>"
    df = rows(spark, d, f"episode_id string, id string, seq long, legal {legal}, selected array<string>")
    o = rows(spark, [], "decision string, action string, seq long, metrics map<string,double>, censored boolean")
    over = lambda p, q: p == q or p.startswith(q + "/") or q.startswith(p + "/")
    apart = lambda x, y: x[0] not in y[3] and y[0] not in x[3] and not any(over(p, q) for p in x[2] for q in y[2])
    for prefer, beta, least, most in (({"root": 2.0, "non_overlapping": 1.5, "handoff": -1.0}, 0.5, 0.0, 4), ({"continue": 1.0}, 2.0, 1.0, 2), ({}, 1.0, 0.0, 4)):
        score = lambda x: beta * sum(w for f, w in prefer.items() if (not x[4] if f == "non_overlapping" else x[1] == f))  # noqa: E731, B023
        want = set()
        for _, name, _, acts, _ in d:
            taken = []
            for x in sorted(acts, key=lambda x: (-score(x), x[0])):
                if score(x) >= least and len(taken) < most and all(apart(y, x) for y in taken):
                    taken.append(x)
            want |= {(name, x[0]) for x in taken}
        played = presence.replay(df, o, prefer, beta, least, most)
        assert {(r.decision, r.action) for r in played.collect()} == want
    kept = presence.replay(df, o, {}, recorded=True)
    assert {(r.decision, r.action, r.supported) for r in kept.collect()} == {(x[1], a[0], True) for x in d for a in x[3] if a[0] in x[4]}
    assert all("Pandas" not in x._jdf.queryExecution().executedPlan().toString() for x in (played, kept))


DECIDED = "episode_id string, id string, seq long, ts long, agent_id string, task string, legal array<struct<id:string,kind:string,paths:array<string>,causal_parents:array<string>,overlapping:boolean>>, selected array<string>"


def policy_rows(spark, episodes):
    """Decisions between `keep` (which overlaps) and `leap`; of each episode: its agent, task, what was taken."""
    legal = [("keep", "continue", [], [], True), ("leap", "root", [], [], False)]
    d = [(f"e{i}", f"d{i}", i, i, agent, task, legal, taken) for i, (agent, task, taken) in enumerate(episodes)]
    o = [(f"d{i}", a, 1, {"correctness": 1.0 if a == "keep" else 0.0, "cost": 2.0, "secret": 9.0}, False) for i in range(len(episodes)) for a in ("keep", "leap")]
    return rows(spark, d, DECIDED), rows(spark, o, "decision string, action string, seq long, metrics map<string,double>, censored boolean")


def test_policy_gates(spark):
    from ctxspark.operators import policy

    asked = [policy.Policy("avoid", {"non_overlapping": 5.0}, max_batch=1), policy.Policy("as_was", recorded=True, max_batch=32, max_rounds=100)]
    agents = rows(spark, [("ana", True), ("ben", False)], "agent_id string, checked_out boolean")
    d, o = policy_rows(spark, [("ana", "t1", ["keep"])] * 6 + [("ben", "t1", ["keep"])])
    got = {r.policy: r for r in policy.evaluate(asked, d, o, agents, ["correctness"]).collect()}
    avoid, as_was = got["avoid"], got["as_was"]
    # What wasn't taken earns nothing, whatever its outcome was; the open episode isn't played.
    assert (avoid.support, avoid.out_of_support, avoid.cost, avoid.promotion_ok, avoid.censored) == (0.0, 6, 0.0, False, 1)
    assert avoid.failed == ["holdout:correctness"] and avoid.incumbent_cost == 12.0
    assert (as_was.support, as_was.holdout_worlds, as_was.failed, as_was.promotion_ok) == (1.0, 2, [], True)
    # One world alone is never held out, so nothing is promoted on it.
    d, o = policy_rows(spark, [("ana", "", ["keep"])])
    assert [r.promotion_ok for r in policy.evaluate(asked, d, o, agents, ["correctness"]).collect()] == [False, False]
    # A gate of the tasks that were held out counts too.
    d, o = policy_rows(spark, [("ana", "t1", ["leap"]), ("ana", "t2", ["keep", "leap"]), *[("ana", "t1", ["leap"])] * 3])
    worse = policy.evaluate([policy.Policy("keeps", {"continue": 1.0}, max_batch=1)], d, o, agents, ["correctness"]).first()
    assert worse.task_holdout_worlds == 1 and not worse.promotion_ok
    with pytest.raises(ValueError):
        policy.Policy("x", {"unknown": 1.0})


def test_promotion_and_advice(spark):
    from ctxspark.operators import policy

    verdicts = rows(spark, [("a", True, 0.9), ("b", False, 0.1), ("c", True, 0.8)], "policy string, promotion_ok boolean, holdout_support double")
    up = policy.promotions(verdicts, 10, 99)
    assert [(r.seq, r.id, r.support) for r in up.orderBy("seq").collect()] == [(11, "a", 0.9), (12, "c", 0.8)]
    status = lambda more: {r.id: r.status for r in policy.records(up.select("seq", "kind", "id", "support").unionByName(rows(spark, more, "seq long, kind string, id string, support double"))).collect()}
    assert status([]) == {"a": "retired", "c": "active"}
    assert status([(20, "policy_retire", "c", None)]) == {"a": "retired", "c": "retired"}
    assert status([(20, "policy_retire", "c", None), (21, "policy_promote", "c", 0.7)]) == {"a": "retired", "c": "active"}
    found = rows(spark, [("drift", "x", None, "p"), ("stale", "y", None, "q"), ("base_divergence", "x", "y", "r")], "kind string, a string, b string, detail string")
    offers = rows(spark, [("h1", "x", "", "offered"), ("h2", "x", "y", "accepted")], "id string, from string, to string, derived string")
    active = policy.records(up)
    said = lambda prefer, a=active: sorted((r.kind, r.detail, r.confidence) for r in policy.advise(a, prefer, found, offers).collect())
    assert said(["non_overlapping"]) == [("drift", "p", 0.8), ("stale", "q", 0.8)]
    assert said([]) == [("handoff", "h1", 0.8), ("stale", "q", 0.8)]
    assert said(["handoff"], active.where("status = 'retired'")) == []


def test_provider_cards(spark):
    from ctxspark.operators import providers

    specs = rows(spark, [("p", "a", 30, i, kind, f"t{i}", value, detail, series) for i, (kind, value, detail, series) in enumerate([("metric", "/x", "/on", None), ("metric", "/none", "/none", None), ("bar", None, None, "/x"), ("sparkline", None, None, "/s"), ("odd", None, None, "/s"), ("metric", None, None, None), ("activity", None, None, "/log")])] + [("q", "b", 30, 0, "metric", "t", "/x", None, None), ("q", "b", 30, 1, "metric", "t", "/y", None, None), ("r", "c", 30, 0, "metric", "t", "/x", None, None)], "provider string, sidecar string, stale_secs int, ord int, kind string, title string, value string, detail string, series string")
    docs = rows(spark, [("a", '{"x": {"y": [1]}, "on": true, "s": [1.5, "word", {"rtt_ms": 2}, null], "log": [{"ts": 10}, {"no": 1}]}', 90), ("c", "nonsense", 0)], "sidecar string, content string, mtime long")
    got = {(r.provider, r.ord): r for r in providers.cards(specs, docs, 100).collect()}
    assert set(got) == {("p", 0), ("p", 1), ("p", 2), ("p", 3), ("p", 6), ("q", None), ("r", None)}
    assert (got["p", 0].value, got["p", 0].detail, got["p", 0].available, got["p", 0].age_secs) == ('{"y":[1]}', "true", True, 10)
    assert (got["p", 1].value, got["p", 1].detail) == ("—", None) and got["p", 2].series == []
    assert [(x.ts, x.value) for x in got["p", 3].series] == [(0, 1.5), (1, 0.0), (2, 2.0), (3, 0.0)]
    assert [(x.ts, x.label, x.ago) for x in got["p", 6].series] == [(10, '{"ts":10}', "1m"), (None, '{"no":1}', None)]
    assert (got["q", None].reason, got["r", None].reason) == ("unavailable", "parse error")


def test_contests(spark):
    import itertools
    import random

    pick = random.Random(5)
    paths = ["a", "a/b", "a/b/c", "a/bc", "d", "d/e", "", "a/b/c/d"]
    cs = list({(f"x{pick.randrange(6)}", pick.choice(paths)) for _ in range(25)})
    claims = rows(spark, cs + cs[:3] + [(None, "a"), ("x1", None)], "agent_id string, path string")
    under = lambda p, q: p == q or p.startswith(q + "/")
    want = {}
    for (a, p), (b, q) in itertools.product(cs, cs):
        if a != b and under(p, q):
            want.setdefault((a, p, q), set()).add(b)
    got = {(r.agent_id, r.path, r.over): (r.other, r.others) for r in presence.path_contests(claims).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k][0] in v for k, v in want.items())
    # Equal strings above one another only: an empty path is a folder of nothing but itself and of what begins with a slash.
    symbols = rows(spark, [("p", "f"), ("q", "f"), ("q", "f"), ("r", "f"), ("p", "g"), (None, "g"), ("p", None), ("q", None)], "agent_id string, symbol string")
    assert {tuple(r) for r in presence.symbol_contests(symbols).collect()} == {("f", "p", "r", 2), ("f", "q", "p", 2), ("f", "r", "p", 2)}
    assert presence.path_contests(claims.limit(0)).count() == 0 and presence.symbol_contests(symbols.limit(0)).count() == 0


def test_findings_of_a_hot_symbol(spark):
    """Two hundred agents on one path and symbol: as many findings as agents, and nobody is left out."""
    n = 200
    agents = spark.range(n).select(F.format_string("a%03d", "id").alias("agent_id"), F.lit(False).alias("checked_out"), F.lit(100).cast("long").alias("expires_at"), F.lit("").alias("base_oid"))
    claims = agents.select("agent_id", F.lit("src").alias("path"), F.array(F.lit("f")).alias("symbols"))
    got = presence.findings(agents, claims, agents.select("agent_id", F.lit("src/x").alias("path")), 50).collect()
    for kind in ("path_overlap", "symbol_overlap"):
        mine = [r for r in got if r.kind == kind]
        assert len(mine) == n - 1 and {r.a for r in mine} | {r.b for r in mine} == {f"a{i:03d}" for i in range(n)}
    assert len(got) == 2 * (n - 1)


def test_idea_links_tags_and_bookmarks(spark):
    schema = "slug string, title string, body string, status string, freshness string, touched string, tags array<string>, links array<string>"
    ideas = rows(spark, [("a", "Red box", "one two", "seed", "due", "2024-01-01", ["T"], None), ("b", None, None, "seed", "fresh", "2024-01-02", None, None), ("c", "Blue box", "two", "archived", "due", "2024-01-03", ["t", "u"], ["x"])], schema)
    out = {r.slug: r for r in records.set_idea_tags(ideas, F.col("slug") == "b", F.array(F.lit(" K "), F.lit(""), F.lit("k"), F.lit("l")), "2024-05-05").collect()}
    assert out["b"].tags == ["K", "l"] and out["b"].touched == "2024-05-05" and out["a"].tags == ["T"] and out["a"].touched == "2024-01-01"
    out = {r.slug: r for r in records.set_idea_links(ideas, F.col("slug") == "c", F.lit(None).cast("array<string>"), "2024-05-05").collect()}
    assert out["c"].links == [] and out["a"].links is None
    marks = rows(spark, [("a", 1), ("c", 2), ("gone", 3)], "slug string, at long")
    ask = rows(spark, [("a",), ("a",), ("b",), ("nowhere",), (None,)], "slug string")
    turn = lambda on: {tuple(r) for r in records.toggle_bookmarks(marks, ideas, ask, 9, on).collect()}
    assert turn(None) == {("b", 9), ("c", 2), ("gone", 3)}
    assert turn(True) == {("a", 9), ("b", 9), ("c", 2), ("gone", 3)}
    assert turn(False) == {("c", 2), ("gone", 3)}
    listed = [(r.slug, round(r.similarity, 3), r.bookmarked) for r in records.list_ideas(ideas, marks, "two box", semantic=True).collect()]
    assert listed == [("c", 0.667, True), ("a", 0.5, True), ("b", 0.0, False)]
    assert [r.slug for r in records.list_ideas(ideas, marks, "BOX", tag="T", freshness="DUE").collect()] == ["a", "c"]
    assert [r.slug for r in records.list_ideas(ideas, marks, n=1).collect()] == ["a"]
    got = {(r.facet, r.value): r.n for r in records.idea_metrics(ideas, marks).collect()}
    assert got == {("total", None): 3, ("bookmarked", None): 2, ("status", "seed"): 2, ("status", "archived"): 1, ("freshness", "due"): 2, ("freshness", "fresh"): 1, ("tag", "T"): 1, ("tag", "t"): 1, ("tag", "u"): 1}
