"""The driver's tables as the relations that the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer parts than there are cores, dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks(spark, sf) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", "text", "lang", "source")).select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("body"), "lang", "source")


#: Telemetry: an event's type is the tool.
OUTCOME_SQL = "CASE WHEN event_type = 'error' THEN 'error' WHEN value < 1 THEN 'empty' WHEN value < 5 THEN 'low_yield' WHEN value > 150 THEN 'truncated' ELSE 'ok' END"
EVENTS_SQL = f"""ev AS (SELECT event_id, event_type AS tool, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(floor(value * 1000) AS BIGINT) AS elapsed_us,
  event_id % 1000 + 500 AS baseline, CAST(floor(value * 10) AS BIGINT) AS returned, {OUTCOME_SQL} AS outcome, CAST(user_id AS VARCHAR) AS workspace FROM events)"""


def telemetry(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("tool"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts"),
        F.floor(F.col("value") * 1000).cast("long").alias("elapsed_us"),
        (F.col("event_id") % 1000 + 500).alias("baseline"),
        F.floor(F.col("value") * 10).cast("long").alias("returned"),
        F.expr(OUTCOME_SQL).alias("outcome"),
        F.col("user_id").cast("string").alias("workspace"),
    )


#: Traces: a line's part brand is the zone, its price the time; odd and even order keys are two captures.
TRACE_SQL = "tr AS (SELECT p_brand AS name, CAST(l_extendedprice AS DOUBLE) AS total_ns, 1 AS counts, CAST(l_extendedprice AS DOUBLE) AS max_ns, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)"


def trace(spark, sf) -> DataFrame:
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    part = read(spark, sf, "part").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("name"), F.col("l_extendedprice").cast("double").alias("total_ns"), F.lit(1).cast("long").alias("counts"), F.col("l_extendedprice").cast("double").alias("max_ns"), "l_orderkey")


#: Calls: customer's nation calls supplier's nation over a line, for each caller's most called.
CALLS_SQL = """raw AS (SELECT 'n::' || c.c_nationkey AS caller, 'n::' || s.s_nationkey AS callee, o_orderkey, l_linenumber FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey JOIN supplier s ON l_suppkey = s.s_suppkey),
  agg AS (SELECT caller, callee, count(*) AS n FROM raw GROUP BY 1, 2),
  edges AS (SELECT caller, callee, n FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY n DESC, callee) AS r FROM agg) WHERE r <= 3),
  adj AS (SELECT DISTINCT split_part(caller, '::', 2) AS caller, split_part(callee, '::', 2) AS callee FROM edges WHERE split_part(caller, '::', 2) <> split_part(callee, '::', 2))"""


def calls(spark, sf) -> DataFrame:
    """caller, callee, n, rel, line: each caller's three most frequent callees."""
    from pyspark.sql import Window

    line = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    raw = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    agg = raw.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("n::"), F.col("c_nationkey")).alias("caller"), F.concat(F.lit("n::"), F.col("s_nationkey")).alias("callee"), "n")
    r = F.row_number().over(Window.partitionBy("caller").orderBy(F.desc("n"), "callee"))
    return agg.withColumn("r", r).where("r <= 3").select("caller", "callee", "n", F.col("caller").alias("rel"), F.col("r").alias("line"))


def modules(spark, sf) -> DataFrame:
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("n::"), F.col("n_nationkey")).alias("name"), F.col("r_name").alias("module"))


#: Memory regions: a line is a region from quantity and price; a part's type is the mapping's kind.
REGIONS_SQL = "rg AS (SELECT p_type AS kind, p_brand AS name, l_orderkey * 1000 + l_linenumber * 100 AS start, l_orderkey * 1000 + l_linenumber * 100 + CAST(floor(l_quantity) AS BIGINT) AS \"end\", l_suppkey AS proc, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)"


def regions(spark, sf) -> DataFrame:
    line, part = read(spark, sf, "lineitem"), read(spark, sf, "part")
    start = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("kind"), F.col("p_brand").alias("name"), start.alias("start"), (start + F.floor("l_quantity").cast("long")).alias("end"), F.col("l_suppkey").alias("proc"), "l_orderkey", "l_linenumber", "l_partkey")


#: Blackboard: a conversation is a session.
BOARD_SQL = "bd AS (SELECT conv_id AS session, turn AS id, role, coalesce(text, '') AS summary, CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) % 3 <> 0 END AS approved, length(coalesce(text, '')) % 2 AS questions FROM conversations)"


def board(spark, sf) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), "role", t.alias("summary"), F.when(F.col("role") == "assistant", F.length(t) % 3 != 0).alias("approved"), (F.length(t) % 2).alias("questions"))


#: Defects: an order's status, priority and day.
DEFECTS_SQL = "df AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'gated' ELSE 'eyeball_fail' END END AS status, o_orderpriority AS subsystem, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS updated, 'defect ' || o_orderkey AS summary, o_custkey FROM orders)"


def defects(spark, sf) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 2 == 0, "gated").otherwise("eyeball_fail")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("subsystem"), F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("long").alias("updated"), F.concat(F.lit("defect "), F.col("o_orderkey")).alias("summary"), "o_custkey")


#: Ideas: an order's day is when it was touched; today is fixed.
TODAY = "1998-12-01"
IDEAS_SQL = "idea AS (SELECT o_orderkey AS slug, CASE o_orderkey % 5 WHEN 0 THEN 'seed' WHEN 1 THEN 'sprouted' WHEN 2 THEN 'growing' WHEN 3 THEN 'archived' ELSE 'implemented' END AS status, CAST(o_orderdate AS DATE) AS day FROM orders)"
FRESH_SQL = f"""{IDEAS_SQL}, fr AS (SELECT *, greatest(date_diff('day', day, DATE '{TODAY}'), 0) AS age_days FROM idea),
  fresh AS (SELECT slug, status, CAST(age_days AS INTEGER) AS age_days, CASE WHEN age_days < 14 THEN 'fresh' WHEN age_days < 30 THEN 'due' WHEN age_days >= 90 AND status IN ('seed', 'sprouted') THEN 'dormant' ELSE 'stale' END AS freshness, CAST(day AS VARCHAR) AS touched FROM fr)"""


def ideas(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 5
    status = F.when(k == 0, "seed").when(k == 1, "sprouted").when(k == 2, "growing").when(k == 3, "archived").otherwise("implemented")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("slug"), status.alias("status"), F.to_date("o_orderdate").cast("string").alias("touched"))


#: Presence journal: a user's events; signups are check-ins, purchases check-outs, a click sets the state, a view the value.
JOURNAL_SQL = """jr AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS agent_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  CASE event_type WHEN 'signup' THEN 'check_in' WHEN 'purchase' THEN 'check_out' ELSE 'update' END AS kind,
  CASE WHEN event_type IN ('signup', 'click') THEN 'state' || event_id % 4 END AS state,
  CASE WHEN event_type = 'view' THEN 'note' || event_id % 7 END AS note,
  CASE WHEN event_type <> 'error' THEN CAST(floor(epoch(ts)) AS BIGINT) + 300 END AS expires_at,
  CASE WHEN event_id % 3 = 0 THEN 'k' || CAST(event_id // 9 AS VARCHAR) END AS idempotency_key FROM events)"""


def journal(spark, sf) -> DataFrame:
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    kind = F.when(F.col("event_type") == "signup", "check_in").when(F.col("event_type") == "purchase", "check_out").otherwise("update")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("agent_id"),
        ts.alias("ts"),
        kind.alias("kind"),
        F.when(F.col("event_type").isin("signup", "click"), F.concat(F.lit("state"), F.col("event_id") % 4)).alias("state"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("note"), F.col("event_id") % 7)).alias("note"),
        F.when(F.col("event_type") != "error", ts + 300).alias("expires_at"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), F.floor(F.col("event_id") / 9))).alias("idempotency_key"),
    )


#: Claims: a part is an agent's path; types are folders.
CLAIMS_SQL = "cl AS (SELECT DISTINCT 'a' || p_size AS agent_id, CASE WHEN p_partkey % 17 = 0 THEN lower(p_type) ELSE lower(p_type) || '/' || p_name || p_partkey % 400 END AS path, p_brand AS symbol FROM part)"


def claims(spark, sf) -> DataFrame:
    path = F.when(F.col("p_partkey") % 17 == 0, F.lower("p_type")).otherwise(F.concat(F.lower("p_type"), F.lit("/"), F.col("p_name"), F.col("p_partkey") % 400))
    return read(spark, sf, "part").select(F.concat(F.lit("a"), F.col("p_size")).alias("agent_id"), path.alias("path"), F.col("p_brand").alias("symbol")).distinct()
