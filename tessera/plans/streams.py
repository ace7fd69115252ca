"""Registered streaming queries: drained with an available-now trigger, they equal their batch twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.sources.scratch import scratch
from tessera.sources.tables import load
from tessera.streaming import effects, events, latches

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M6: daily windows over the event stream."""
    return events.drained(events.daily_counts(events.read_events(spark, f"{sf_dir}/events.parquet")), "complete", "event_windows")


@_R.query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: every event delivered twice, consumed once."""
    stream = events.read_events(spark, f"{sf_dir}/events.parquet")
    return events.drained(events.once(stream.unionByName(stream)).select("event_id", "user_id", "event_type"), "append", "stream_dedupe")


@_R.query("""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
  g AS (SELECT event_id, user_id, event_type, ts, rn, ts AS kept_ts, true AS accepted FROM o WHERE rn = 1
        UNION ALL SELECT o.event_id, o.user_id, o.event_type, o.ts, o.rn, CASE WHEN o.ts - g.kept_ts > INTERVAL 24 HOUR THEN o.ts ELSE g.kept_ts END, o.ts - g.kept_ts > INTERVAL 24 HOUR
        FROM g JOIN o ON o.user_id = g.user_id AND o.event_type = g.event_type AND o.rn = g.rn + 1)
SELECT event_id, user_id, event_type FROM g WHERE accepted
""")
def stream_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the 24-hour gap as a stream with state."""
    return events.drained(events.accepted(events.read_events(spark, f"{sf_dir}/events.parquet")), "append", "stream_accepted")


@_R.query("""
SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'feed' END AS source, CASE WHEN value > 50 THEN 'k' || (props->>'$.k') END AS campaign, kind FROM events, (SELECT unnest(['visit', 'page_view']) AS kind) WHERE event_type IN ('view', 'click')
""")
def click_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and page views out of the event stream, appended."""
    stream = events.read_events(spark, f"{sf_dir}/events.parquet").filter("event_type IN ('view', 'click')")
    url = F.concat(F.lit("/p/1?a=b"), F.when(F.col("event_type") == "view", "&utm_source=feed").otherwise(""), F.when(F.col("value") > 50, F.concat(F.lit("&utm_campaign=k"), F.get_json_object("props", "$.k"))).otherwise(""), F.lit("#x"))
    return events.drained(events.visits(stream.withColumn("url", url)), "append", "click_stream")


@_R.query("SELECT event_type <> 'error' AS readable, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1")
def corrupt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: a stream of JSON lines, some of them broken; these are kept apart and end nothing."""
    stream = events.read_events(spark, f"{sf_dir}/events.parquet")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    lines = stream.select(F.when(F.col("event_type") == "error", F.concat(F.lit("{oops"), line)).otherwise(line).alias("line"))
    rows = events.drained(events.parsed(lines, "event_id bigint, user_id bigint, event_type string"), "append", "corrupt_events")
    return rows.groupBy((~F.col("corrupt")).alias("readable")).agg(F.count("*").alias("n"), F.sum("row.event_id").alias("ids"))


@_R.query("""
SELECT event_id, event_type <> 'error' OR event_id % 2 = 0 AS processed, CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'no such subscription: ' || event_id ELSE '' END AS error FROM events
""")
def exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered in waves, each of them twice, take effect once; those that fail are kept and tried again."""
    rows, waves = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), scratch(spark, "waves")
    rows.select("*", F.explode(F.array(F.pmod("event_id", F.lit(3)), F.pmod("event_id", F.lit(3)) + 1)).alias("wave")).write.partitionBy("wave").parquet(waves)
    error = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 1), F.concat(F.lit("no such subscription: "), F.col("event_id")))
    error = error.when((F.col("event_type") == "error") & (F.col("attempts") == 0), "temporary failure")
    ledger = effects.Ledger(spark, scratch(spark, "ledger"), "event_id", "ts", lambda batch: batch.withColumn("error", error))
    stream = spark.readStream.schema(spark.read.parquet(waves).schema).option("maxFilesPerTrigger", 64).parquet(waves)
    effects.run(stream.drop("wave"), ledger, scratch(spark, "ledger-state"))
    ledger.retry()
    return effects.states(ledger)


_RUNNING = """
 o AS (SELECT *, row_number() OVER w AS rn, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY rn) AS session FROM o),
 m AS (SELECT *, count(*) OVER w AS n, sum(value) OVER w AS total FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY rn))"""


@_R.query(f"WITH {_RUNNING} SELECT user_id, event_id, n AS events FROM m WHERE n >= 3 AND total / n >= 55 QUALIFY row_number() OVER (PARTITION BY user_id, session ORDER BY rn) = 1")
def latched_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: users' first events whose mean is over 55, told once until they have been silent for twelve hours."""
    stream = events.read_events(spark, f"{sf_dir}/events.parquet")
    with latches.typed_state(spark):
        return events.drained(latches.told(stream, latches.Latch(55.0, 3, 12 * 3_600_000)), "append", "latched_alarms")


@_R.query("""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  g AS (SELECT event_id, user_id, ts, rn, ts AS kept_ts, true AS accepted FROM o WHERE rn = 1
        UNION ALL SELECT o.event_id, o.user_id, o.ts, o.rn, CASE WHEN o.ts - g.kept_ts > INTERVAL 6 HOUR THEN o.ts ELSE g.kept_ts END, o.ts - g.kept_ts > INTERVAL 6 HOUR FROM g JOIN o ON o.user_id = g.user_id AND o.rn = g.rn + 1)
SELECT user_id, event_id, 1::BIGINT AS events FROM g WHERE accepted
""")
def expiring_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: users' events over six hours after the last accepted one, by state that expires."""
    stream = events.read_events(spark, f"{sf_dir}/events.parquet")
    with latches.typed_state(spark):
        return events.drained(latches.told(stream, latches.Gap(6 * 3_600_000)), "append", "expiring_gap")
