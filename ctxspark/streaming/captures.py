"""Runtime snapshots as streams: overlays merged within their life, a ring of the last samples with changes and hitches, and captures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: How long an overlay holds, samples of a timeline, milliseconds of a hitch, samples of a capture, and captures kept.
OVERLAY_LIFE = "5 seconds"
RING, HITCH_MS, CAPTURE_SAMPLES, CAPTURES = 120, 25.0, 1800, 16
#: Updates of a timeline that are passed on together.
CHUNK = 20_000
#: What an overlay replaces of a snapshot, and the capabilities that it may switch.
SECTIONS, SWITCHES = ("lifetime", "locality"), ("alloc_hooks", "pmc")


WAITING = pa.schema([("us", pa.int64()), ("pid", pa.string()), ("seq", pa.string()), ("body", pa.string()), ("overlay", pa.bool_())])


class Overlays(StatefulProcessor):
    """What a host's snapshots of one span of time are merged with: rows wait until the watermark has passed the span, then one
    walk over them in order finds the newest overlay for each, so the work doesn't grow with the overlays within its life."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.parts.exists():
            self.handle.registerTimer(-(-(key[1] + 1) * self.life // 1000))
        # Rows wait as Arrow batches: a state's value each would be a call each.
        for part in rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, WAITING) as out:
                out.write_batch(pa.RecordBatch.from_pandas(part[WAITING.names], WAITING, preserve_index=False))
            self.parts.appendValue((sink.getvalue().to_pybytes(),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = pa.concat_tables([pa.ipc.open_stream(p[0]).read_all() for p in self.parts.get()])
        self.parts.clear()
        # Of the same time overlays come first, in the order of their texts, since one received at the time of a snapshot counts.
        rows = sorted(zip(*[c.to_pylist() for c in waiting.columns]), key=lambda r: (r[0], not r[4], r[3] if r[4] else ""))
        newest, out, seen = {}, [], set()
        for place, (at, pid, seq, body, overlay) in enumerate(rows):
            if overlay:
                newest[pid] = (place, at, body)
            elif (at, pid, seq) not in seen:
                seen.add((at, pid, seq))
                found = max(newest.get(None, (-1, 0, None)), newest.get(pid, (-1, 0, None)))
                out.append((key[0], pid, at, seq, body, found[2] if found[1] >= at - self.life else None))
        if out:
            yield pd.DataFrame(out, columns=["host", "pid", "us", "seq", "s", "o"])

    def close(self) -> None:
        pass


def overlaid(snapshots: DataFrame, overlays: DataFrame, life: str = OVERLAY_LIFE, late: str = "10 seconds") -> DataFrame:
    """Snapshots with the newest overlay that was received at most `life` before. Both streams have watermarks and are dealt out by host
    and spans of `life`, an overlay to its own and the next one, so that a snapshot meets all that may count in one place and a
    span's state goes when the watermark has passed it. Needs the RocksDB state store; output mode append.

    snapshots: host, pid, ts, seq, lifetime, locality, capabilities (map<string,boolean>), quality (map<string,string>). overlays: host, pid
    (null: of any process of the host), received, and the same, with dropped and estimated_overhead_pct. An overlay of another
    process or an older one isn't merged; of overlays received at the same time the one with the greatest text as JSON is. Sections of
    the overlay replace the snapshot's, its switches and qualities are added.
    """
    spark = snapshots.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    span = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {life})").first()[0]
    mine = (*SECTIONS, "capabilities", "quality")
    theirs = (*mine, "dropped", "estimated_overhead_pct")

    def dealt(df: DataFrame, ts: str, seq: Column, columns: tuple[str, ...], overlay: bool) -> DataFrame:
        us = F.unix_micros(ts)
        first = F.expr(f"(unix_micros({ts}) - pmod(unix_micros({ts}), {span}L)) div {span}L")
        spans = F.explode(F.array(first, first + 1)) if overlay else first
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return df.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(ts).alias("at"), "host", spans.alias("span"), us.alias("us"), F.col("pid").cast("string").alias("pid"), seq.cast("string").alias("seq"), body.alias("body"), F.lit(overlay).alias("overlay"))

    rows = dealt(snapshots, "ts", F.col("seq"), mine, False).unionByName(dealt(overlays.where("host IS NOT NULL"), "received", F.lit(None), theirs, True))
    host, types = snapshots.schema["host"].dataType, {c: snapshots.schema[c].dataType for c in ("pid", "seq")}
    schema = T.StructType([T.StructField("host", host), *T.StructType.fromDDL("pid string, us long, seq string, s string, o string").fields])
    met = rows.groupBy("host", "span").transformWithStateInPandas(Overlays(span), schema, "append", "eventTime")
    typed = lambda df, columns: T.StructType([df.schema[c] for c in columns])
    newest = met.select("host", F.col("pid").cast(types["pid"]).alias("pid"), F.timestamp_micros("us").alias("ts"), F.col("seq").cast(types["seq"]).alias("seq"), F.from_json("s", typed(snapshots, mine)).alias("s"), F.from_json("o", typed(overlays, theirs)).alias("o"))
    kinds = {c: snapshots.schema[c].dataType for c in ("capabilities", "quality")}
    added = lambda c: F.map_zip_with(F.coalesce(f"s.{c}", F.create_map().cast(kinds[c])), F.coalesce(f"o.{c}", F.create_map().cast(kinds[c])), lambda k, a, b: F.coalesce(b, a))
    switched = F.map_filter(F.coalesce("o.capabilities", F.create_map().cast(kinds["capabilities"])), lambda k, v: k.isin(*SWITCHES))
    capabilities = F.map_zip_with(F.coalesce("s.capabilities", F.create_map().cast(kinds["capabilities"])), switched, lambda k, a, b: F.coalesce(b, a))
    return newest.select(
        "host", "pid", "ts", "seq",
        *[F.coalesce(f"o.{c}", f"s.{c}").alias(c) for c in SECTIONS],
        capabilities.alias("capabilities"), added("quality").alias("quality"),
        F.col("o.dropped").alias("overlay_dropped"), F.col("o.estimated_overhead_pct").alias("estimated_overhead_pct"), F.col("o").isNotNull().alias("overlaid"),
    )


SAMPLE = "host string, seq long, kind string, presented_ms double, metrics map<string,double>, regions string"
UPDATE = "host string, seq long, hitch boolean, kept int, oldest_seq long, hitches int, changed map<string,double>, map_dirty boolean, regions string, capture long, capture_samples int, truncated boolean, captures int"


class Timeline(StatefulProcessor):
    """The last samples of a host, and what each one changes: only metrics that differ from the sample before, and the regions only
    if they do. Rows of kind `capture_on` and `capture_off` begin and end a capture, which is known by the seq it began at and
    ends by itself when it is full; of captures only the newest are kept."""

    def __init__(self, ring: int = RING, hitch_ms: float = HITCH_MS, capture_samples: int = CAPTURE_SAMPLES, captures: int = CAPTURES):
        self.most, self.hitch_ms, self.capture_samples, self.captures = ring, hitch_ms, capture_samples, captures

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "seq long, hitch boolean")
        self.last = handle.getValueState("last", "metrics map<string,double>, regions string")
        self.kept = handle.getMapState("captures", "id long", "samples int, open boolean, truncated boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        metrics, regions = self.last.get() if self.last.exists() else ({}, None)
        metrics = dict(metrics or {})
        caps = {k[0]: list(v) for k, v in self.kept.iterator()} if self.kept.exists() else {}
        before, out = {k: tuple(v) for k, v in caps.items()}, []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            seq, now = int(r.seq), next((k for k, v in caps.items() if v[1]), None)
            if r.kind == "capture_on":
                if now is None:
                    while len(caps) >= self.captures:
                        del caps[min(caps)]
                    caps[seq] = [0, True, False]
                continue
            if r.kind == "capture_off":
                if now is not None:
                    caps[now][1] = False
                continue
            hitch = r.presented_ms == r.presented_ms and r.presented_ms is not None and r.presented_ms >= self.hitch_ms
            ring = [*ring, (seq, bool(hitch))][-self.most :]
            new = {k: float(v) for k, v in dict(r.metrics or {}).items() if v is not None}
            changed = {k: v for k, v in new.items() if metrics.get(k) != v}
            dirty, metrics, regions = r.regions != regions, new, r.regions
            full = False
            if now is not None:
                caps[now][0] += 1
                full = caps[now][0] >= self.capture_samples
                caps[now][1:] = [not full, full]
            if len(out) >= CHUNK:
                yield self._frame(out)
                out = []
            out.append((key[0], seq, bool(hitch), len(ring), ring[0][0], sum(h for _, h in ring), changed, dirty, regions if dirty else None, now, caps[now][0] if now is not None else None, full, len(caps)))
        self.ring.put(ring) if ring else None
        self.last.update((metrics, regions))
        for k in before.keys() - caps.keys():
            self.kept.removeKey((k,))
        for k, v in caps.items():
            if before.get(k) != tuple(v):
                self.kept.updateValue((k,), tuple(v))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["host", "seq", "hitch", "kept", "oldest_seq", "hitches", "changed", "map_dirty", "regions", "capture", "capture_samples", "truncated", "captures"]).astype({"capture": "Int64", "capture_samples": "Int32"})

    def close(self) -> None:
        pass


def timeline(samples: DataFrame, **limits) -> DataFrame:
    """A row for each sample of a stream (SAMPLE): an update for those who follow the host. Needs the RocksDB state store."""
    return samples.groupBy("host").transformWithStateInPandas(Timeline(**limits), UPDATE, "append", "none")
