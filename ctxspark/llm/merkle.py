"""Merkle manifest of a dataset with an external-memory node store.

Rows become leaf digests in one scan that leaves the texts behind. Leaves are sorted by (group, order) into runs, Parquet files
in the shared folder; a leaf's coordinate in its group is its place in its run and the number of the group's leaves in earlier
runs, so no group is ever in one task. A group's leaves are cut into chunks of FAN ** LEVELS coordinates. A task streams the
sorted leaves of its chunks, each level being made by reading the previous one in order, and its nodes go to Parquet partitioned
by level. The chunks' tops are the leaves of the next stage, until a chunk has the whole group; the groups' roots are then the
leaves of one more tree. Proofs come back the same way: a merge scan meets a chunk's leaves, its nodes by level and coordinate,
and the one proof of its top, and gives each leaf its siblings. What a task holds is a batch of rows and one chunk.

A proof is an array of steps from the leaf to the root, each with the digests left and right of the way (joined hex text). It is
folded and digested by built-in expressions.

Edge cases: a null value is `-`; null groups are one group, before all others; null order values come first; rows with equal
order values are ordered by their digests, equal rows get places of their own; a group of one leaf is its own root; a text of
any length is hashed whole; other columns are carried in a struct, so that no name clashes; no rows give no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, new_folder, texts, written

#: Nodes that become one, and levels of a chunk (729 leaves).
FAN, LEVELS = 3, 6
STEPS = "array<struct<left:string,right:string>>"
#: The level at which the proof of a chunk's top stands in the merge scan.
ABOVE = 127


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each as `-` if null and else its UTF-8 bytes' number, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof give."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _depth(leaves: int) -> int:
    d = 0
    while leaves > 1:
        leaves, d = -(-leaves // FAN), d + 1
    return d


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Sorted rows again, with the places of their chunks (first two columns), none of which is cut between two batches."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), list(zip(starts, starts[1:]))
        left = batch.slice(starts[-1])
    if left is not None:
        yield left, [(0, left.num_rows)]


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, the place in the group by the order columns (from 0), and size, the group's rows. The group isn't null."""
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    runs = tie.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    runs = written(runs.withColumn("_at", F.monotonically_increasing_id()), "leaf-runs")
    run = F.shiftrightunsigned("_at", 33)
    # A group has a row for each run that holds some of it.
    counts = runs.groupBy(F.col(group).alias("_group"), run.alias("_run")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    within = Window.partitionBy("_group")
    before = within.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_group", "_run", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"), F.sum("n").over(within).alias("size"))
    at = runs.withColumn("_run", run)
    joined = at.join(starts, (at[group] == starts["_group"]) & (at["_run"] == starts["_run"]))
    return joined.select(*[at[c] for c in rows.columns], (F.col("_start") + F.col("_at") - F.col("_first")).alias("pos"), "size")


class Forest:
    """A tree for each group. leaves: grp, pos, size, digest and others, which `proofs` gives back."""

    def __init__(self, leaves: DataFrame, levels: int = LEVELS, store: str | None = None):
        self.spark, self.levels, self.width = leaves.sparkSession, levels, FAN**levels
        self.store = store or new_folder(self.spark, "nodes")
        self.stages: list[tuple[DataFrame, DataFrame]] = []
        while True:
            leaves = written(leaves.withColumn("chunk", F.floor(F.col("pos") / self.width)), "chunked-leaves")
            nodes = self._raise(leaves)
            self.stages.append((leaves, nodes))
            most = leaves.agg(F.max("size")).first()[0] or 0
            if most <= self.width:
                break
            # A chunk of a group with several has all levels, so its top is the store's last level.
            tops = nodes.where(F.col("level") == levels).where(F.col("size") > self.width)
            leaves = tops.select("grp", F.col("chunk").alias("pos"), F.ceil(F.col("size") / self.width).cast("long").alias("size"), "digest")

    def _raise(self, leaves: DataFrame) -> DataFrame:
        """The chunks' nodes above the leaves: grp, chunk, size, level, idx (within the chunk), digest."""
        levels = self.levels

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, chunks in _whole_chunks(batches):
                digests, sizes, out = batch.column(4).to_pylist(), batch.column(3).to_pylist(), []
                for lo, hi in chunks:
                    now, size = digests[lo:hi], sizes[lo]
                    for level in range(1, min(levels, _depth(size)) + 1):
                        now = [_parent(now[i : i + FAN]) for i in range(0, len(now), FAN)]
                        out += [(lo, size, level, i, h) for i, h in enumerate(now)]
                at, size, level, idx, found = zip(*out) if out else [()] * 5
                keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(size, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(found, pa.string())], names=["grp", "chunk", "size", "level", "idx", "digest"])

        schema = "grp string, chunk long, size long, level int, idx long, digest string"
        sorted_ = leaves.select("grp", "chunk", "pos", "size", "digest").repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "pos")
        path = f"{self.store}/stage={len(self.stages)}"
        sorted_.mapInArrow(work, schema).write.partitionBy("level").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def roots(self) -> DataFrame:
        """grp and digest of every group's root."""
        found = []
        for leaves, nodes in self.stages:
            found.append(leaves.where("size = 1").select("grp", "digest"))
            found.append(nodes.where((F.col("size") > 1) & (F.col("size") <= self.width)).groupBy("grp").agg(F.max_by("digest", "level").alias("digest")))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def proofs(self, above: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
        """grp, pos, digest, the kept columns, proof, subroot (of the group) and root. above: grp, proof and root of each root
        in a tree over the groups."""
        roots = self.roots().withColumnRenamed("digest", "subroot")
        if above is None:
            single = roots.select("grp", "subroot", F.array().cast(STEPS).alias("proof"), F.col("subroot").alias("root"))
        else:
            single = roots.join(above, "grp").select("grp", "subroot", "proof", "root")
        upper = None
        for k in range(len(self.stages) - 1, -1, -1):
            leaves, nodes = self.stages[k]
            whole = leaves.where("pos = 0").where(F.col("size") <= self.width).select("grp", F.lit(0).cast("long").alias("chunk")).join(single, "grp")
            if upper is not None:
                whole = whole.unionByName(upper.select("grp", F.col("pos").alias("chunk"), "subroot", "proof", "root"))
            upper = self._descend(leaves, nodes, whole, (keep or []) if k == 0 else [])
            if k:
                upper = written(upper, "chunk-proofs")
        return upper

    def _descend(self, leaves: DataFrame, nodes: DataFrame, tops: DataFrame, keep: list[str]) -> DataFrame:
        """The merge scan of one stage: leaves with their way to the root."""
        none = {"idx": "long", "digest": "string", "proof": STEPS, "subroot": "string", "root": "string"} | {c: leaves.schema[c].dataType for c in keep}
        fill = lambda df, level, **have: df.select("grp", "chunk", F.lit(level).cast("int").alias("level") if isinstance(level, int) else level, *[have.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items()])
        rows = fill(leaves, 0, idx=F.pmod("pos", F.lit(self.width)), digest=F.col("digest"), **{c: F.col(c) for c in keep})
        rows = rows.unionByName(fill(nodes, F.col("level"), idx=F.col("idx"), digest=F.col("digest")))
        rows = rows.unionByName(fill(tops, ABOVE, **{c: F.col(c) for c in ("proof", "subroot", "root")}))
        rows = rows.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", F.desc("level"), "idx")
        width, schema = self.width, arrow_schema(rows, ["grp", *keep], f"pos long, digest string, proof {STEPS}, subroot string, root string")
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, chunks in _whole_chunks(batches):
                chunk, level, digests = (batch.column(k).to_pylist() for k in (1, 2, 4))
                top = {lo: (batch.column(5)[lo].as_py(), batch.column(6)[lo].as_py(), batch.column(7)[lo].as_py()) for lo, _ in chunks}
                at, pos, proofs, subroots, roots = [], [], [], [], []
                for lo, hi in chunks:
                    # The first row is the top's proof; nodes follow from the top down, each level in order, and then the leaves.
                    way, subroot, root = top[lo]
                    paths, i, first = [way], lo + 1, True
                    while i < hi:
                        j = i
                        while j < hi and level[j] == level[i]:
                            j += 1
                        steps = [way] if first else []  # the first level is the chunk's top itself
                        if not first:
                            for k in range(j - i):
                                run = i + k - k % FAN
                                steps.append([{"left": "".join(digests[run : i + k]), "right": "".join(digests[i + k + 1 : min(run + FAN, j)])}, *paths[k // FAN]])
                        if level[i] == 0:
                            at += range(i, j)
                            pos += [chunk[lo] * width + k for k in range(j - i)]
                            proofs += steps
                            subroots += [subroot] * (j - i)
                            roots += [root] * (j - i)
                        paths, i, first = steps, j, False
                where = pa.array(at, pa.int64())
                columns = [batch.column(k).take(where) for k in (0, *range(8, 8 + len(keep)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pos, pa.int64()), batch.column(4).take(where), pa.array(proofs, kind), pa.array(subroots, pa.string()), pa.array(roots, pa.string())], names=schema.names)

        return rows.mapInArrow(work, schema)


def manifest(rows: DataFrame, leaf: str = "leaf", group: str = "source", order: str = "doc_id", levels: int = LEVELS, store: str | None = None) -> DataFrame:
    """Every row as the struct `row`, with its leaf, pos in its group, proof, subroot and root.

    rows hold a leaf digest each (see `digest`); keep long texts out of them. The nodes are left in the folder `store`, by
    stage and level, below `groups` and `top`.
    """
    store = store or new_folder(rows.sparkSession, "manifest")
    # A key that isn't null and sorts as the groups do: nulls first, then by bytes.
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    leaves = rows.select(key.alias("grp"), F.col(f"`{order}`").alias("_order"), F.col(f"`{leaf}`").alias("digest"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    groups = Forest(placed(written(leaves, "leaves"), "grp", ["_order", "digest"]).drop("_order"), levels, f"{store}/groups")
    roots = written(groups.roots().select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), "subroots")
    top = Forest(placed(roots, "all", ["name"]).withColumnRenamed("all", "grp"), levels, f"{store}/top")
    above = written(top.proofs(keep=["name"]).select(F.col("name").alias("grp"), "proof", "root"), "above")
    return groups.proofs(above, ["row"]).select("row", F.col("digest").alias("leaf"), "pos", "proof", "subroot", "root")


def op11_merkle_dataset_manifest(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    of = lambda text: digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, of(F.replace("text", F.lit("\n"), F.lit(""))))
    out = manifest(docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), changed.alias("tampered")))
    folded = fold(F.coalesce("row.tampered", "leaf"), F.col("proof"))
    out = out.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a text of ASCII characters, a half byte at a time; its table follows from the polynomial.
_NIBBLES = [0] * 16
for _i in range(16):
    _x = _i
    for _ in range(4):
        _x = (_x >> 1) ^ (0xEDB88320 if _x & 1 else 0)
    _NIBBLES[_i] = _x


def crc32_sql(text: str) -> str:
    half = lambda x: f"xor(({x}) >> 4, {_NIBBLES}[(({x}) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(octet_length(encode({0})) || ':' || {0}, '-'))"
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (
  SELECT 0 AS lv, source, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lv + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lv, source, pos // 3, n),
subroots AS (SELECT lv AS depth, source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lv, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lv, pos // 3, n),
sides AS (
  SELECT a.lv, a.source, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM up a JOIN up b ON a.lv = b.lv AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lv, a.source, a.pos),
top_sides AS (
  SELECT a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM top a JOIN top b ON a.lv = b.lv AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lv, a.pos),
steps AS (
  SELECT p.r, s.lv AS k, s.lo, s.hi FROM placed p JOIN sides s ON p.source IS NOT DISTINCT FROM s.source AND p.pos // (3 ** s.lv)::BIGINT = s.pos
  UNION ALL
  SELECT p.r, u.depth + t.lv AS k, t.lo, t.hi FROM placed p JOIN subroots u ON p.source IS NOT DISTINCT FROM u.source JOIN top_sides t ON u.pos // (3 ** t.lv)::BIGINT = t.pos),
folded AS (
  SELECT r, 0 AS k, coalesce(tampered, leaf) AS h FROM d
  UNION ALL
  SELECT f.r, f.k + 1, sha256(s.lo || f.h || s.hi) FROM folded f JOIN steps s ON f.r = s.r AND f.k = s.k),
ends AS (SELECT r, arg_max(h, k) AS folded_root FROM folded GROUP BY r),
proofs AS (SELECT r, string_agg(lo || hi, '' ORDER BY k) AS siblings FROM steps GROUP BY r),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, u.subroot, root.root, sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN subroots u ON p.source IS NOT DISTINCT FROM u.source JOIN ends e USING (r) LEFT JOIN proofs q USING (r) CROSS JOIN root
"""
