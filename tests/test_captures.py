"""Timelines, captures and overlays of runtime snapshots, over several batches."""

import datetime as dt

import pytest

from ctxspark.plans import catalog
from ctxspark.streaming import captures, rollups

SNAP = "host string, pid long, ts timestamp, seq long, lifetime string, locality string, capabilities map<string,boolean>, quality map<string,string>"
OVER = "host string, pid long, received timestamp, lifetime string, locality string, capabilities map<string,boolean>, quality map<string,string>, dropped long, estimated_overhead_pct double"


def at(seconds):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=seconds)


def stream(spark, path, schema, batches):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def sample(seq, ms=1.0, metrics=None, regions="r", host="h", kind="sample"):
    return (host, seq, kind, ms, metrics or {}, regions)


def run(spark, path, batches, **limits):
    catalog._stateful(spark)
    out = rollups.drain(captures.timeline(stream(spark, path, captures.SAMPLE, batches), **limits), f"t{id(path)}", "append")
    return sorted(out.collect(), key=lambda r: (r.host, r.seq))


def test_timeline(spark, tmp_path):
    batches = [[sample(2, 25.0, {"rss": 12.0, "va": 1.0}), sample(1, None, {"rss": 10.0, "va": 1.0})], [sample(3, 24.9, {"rss": 12.0}, "s"), sample(4, 30.0, {"rss": 13.0, "va": 1.0}, "s"), sample(1, host="other")]]
    got = run(spark, tmp_path, batches, ring=3)
    h = [r for r in got if r.host == "h"]
    assert [(r.seq, r.hitch, r.kept, r.oldest_seq, r.hitches) for r in h] == [(1, False, 1, 1, 0), (2, True, 2, 1, 1), (3, False, 3, 1, 1), (4, True, 3, 2, 2)]
    assert [r.changed for r in h] == [{"rss": 10.0, "va": 1.0}, {"rss": 12.0}, {}, {"rss": 13.0, "va": 1.0}]
    assert [(r.map_dirty, r.regions) for r in h] == [(True, "r"), (False, None), (True, "s"), (False, None)]
    assert len(got) == 5


def test_captures(spark, tmp_path):
    on, off = (lambda s: sample(s, kind="capture_on")), (lambda s: sample(s, kind="capture_off"))
    batches = [[sample(1), on(2), sample(3), on(4), sample(5)], [sample(6), sample(7), on(8), sample(9), off(10), sample(11)], [on(12), sample(13), off(14), on(15), sample(16)]]
    got = {r.seq: (r.capture, r.capture_samples, r.truncated, r.captures) for r in run(spark, tmp_path, batches, capture_samples=3, captures=2)}
    none = (None, None, False)
    assert got == {1: (*none, 0), 3: (2, 1, False, 1), 5: (2, 2, False, 1), 6: (2, 3, True, 1), 7: (*none, 1), 9: (8, 1, False, 2), 11: (*none, 2), 13: (12, 1, False, 2), 16: (15, 1, False, 2)}


@pytest.mark.parametrize("one_batch", [True, False])
def test_overlays(spark, tmp_path, one_batch):
    snaps = [("h", 1, at(t), t, "own", "near", {"numa": True, "pmc": False}, {"rss": "exact"}) for t in (1, 4, 9, 20)] + [("g", 1, at(4), 4, None, None, None, None)]
    end = [("h", 1, at(10_000), 99, None, None, None, None)]
    over = lambda pid, t, name, **caps: ("h", pid, at(t), name, None, caps, {"life": "sampled"}, t, 0.5)
    overs = [over(1, 0, "old", pmc=True), over(1, 3, "new", alloc_hooks=True, numa=False), over(2, 4, "wrong process"), over(None, 8, "any")]
    late = [("x", 1, at(10_000), None, None, None, None, None, None)]
    s = stream(spark, tmp_path / "s", SNAP, [snaps + end] if one_batch else [snaps, end])
    o = stream(spark, tmp_path / "o", OVER, [overs + late] if one_batch else [overs, late])
    got = {(r.host, r.seq): r for r in rollups.drain(captures.overlaid(s, o), f"o{one_batch}", "append").collect() if r.seq != 99}
    assert {k: r.lifetime for k, r in got.items()} == {("h", 1): "old", ("h", 4): "new", ("h", 9): "any", ("h", 20): "own", ("g", 4): None}
    new = got["h", 4]
    # Sections that the overlay doesn't have stay, only switches are taken over, and qualities are added.
    assert (new.locality, new.capabilities, new.quality, new.overlay_dropped) == ("near", {"numa": True, "pmc": False, "alloc_hooks": True}, {"rss": "exact", "life": "sampled"}, 3)
    assert (got["h", 20].overlaid, got["h", 20].quality, got["h", 20].overlay_dropped) == (False, {"rss": "exact"}, None)


def test_overlays_need_no_pairs(spark, tmp_path):
    """Many overlays within the life of each snapshot: no join of all of them, and of equal times the greatest text."""
    snaps = [("h", t % 3, at(t / 100), t, "own", None, {}, {}) for t in range(1500)] + [("h", 1, at(10_000), 9999, None, None, None, None)]
    overs = [("h", None if t % 2 else t % 3, at(t / 100), f"live {t}{x}", None, {}, {}, t, 0.5) for t in range(1500) for x in "ba"] + [("x", 1, at(10_000), None, None, None, None, None, None)]
    out = captures.overlaid(stream(spark, tmp_path / "s", SNAP, [snaps]), stream(spark, tmp_path / "o", OVER, [overs]))
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    got = {r.seq: r.lifetime for r in rollups.drain(out, "pairs", "append").collect() if r.seq != 9999}
    want = {t: next((f"live {n}b" for n in range(t, max(t - 501, -1), -1) if n % 2 or n % 3 == t % 3), "own") for t in range(1500)}
    assert got == want


def test_allocations_without_a_bound(spark):
    """More live pointers than any bound was, over several batches in order, with frees of earlier batches' pointers."""
    catalog._stateful(spark)
    n = 120_000
    rows = spark.range(n + 10).selectExpr("0L AS proc", "id AS ord", f"CASE WHEN id < {n} THEN 'A' ELSE 'F' END AS kind", f"id % {n} AS ptr", "CAST(NULL AS LONG) AS new_ptr", "2L AS size")
    got = rollups.drain_in_order(rows, "ord", rollups.allocations, "unbounded", "update", "proc", most=60_000).collect()
    assert [tuple(r) for r in got] == [(0, 2 * (n - 10), 2 * n, n - 10, 0)]


def test_timeline_in_segments(spark):
    """Segments in order give the same updates as one batch."""
    catalog._stateful(spark)
    rows = spark.createDataFrame([sample(k * 7 % 300, float(k % 40), {"a": float(k % 3)}, f"r{k // 50}", f"h{k % 2}") for k in range(300)], captures.SAMPLE)
    one, many = (sorted(map(str, rollups.drain_in_order(rows, "seq", captures.timeline, "segments", most=m).collect())) for m in (1000, 80))
    assert one == many and len(one) == 300
