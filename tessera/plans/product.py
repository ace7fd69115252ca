"""Product analytics over ``events`` (visits) and ``orders`` (leads)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.dates import micros
from tessera.functions.numbers import safe_percentage
from tessera.plans.registry import Registry
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def _zero(c: str):
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)


def _days_back(events: DataFrame, days: int) -> Column:
    """The time ``days`` before the newest event, read first: as a constant it reaches the scan, which then skips what is older."""
    bound = events.agg((F.max("ts") - F.expr(f"INTERVAL {days} DAYS")).cast("string")).first()[0]
    return F.lit(bound).cast(events.schema["ts"].dataType)


@_R.query("""
WITH v AS (SELECT user_id AS entity, count(*) AS views FROM events
           WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1),
     l AS (SELECT o_custkey AS entity, count(*) AS leads, count(*) FILTER (o_orderstatus = 'O') AS new_leads,
                  count(*) FILTER (o_orderstatus = 'F') AS qualified, max(o_orderdate) AS last_lead
           FROM orders GROUP BY 1)
SELECT c_custkey AS entity, coalesce(views, 0) AS views, coalesce(leads, 0) AS leads,
       coalesce(new_leads, 0) AS new_leads, coalesce(qualified, 0) AS qualified, last_lead,
       CASE WHEN coalesce(views, 0) = 0 THEN 0.0 ELSE round_even(coalesce(leads, 0) / views * 100, 2) END AS conversion
FROM customer LEFT JOIN v ON v.entity = c_custkey LEFT JOIN l ON l.entity = c_custkey
WHERE views IS NOT NULL OR leads IS NOT NULL
""")
def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, leads, qualified leads and conversion of each entity; either side may be missing."""
    events = load(spark, sf_dir, "events")
    views = (
        events.filter((F.col("event_type") == "view") & (F.col("ts") >= _days_back(events, 30)))
        .groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("views"))
    )
    leads = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.count("*").alias("leads"),
        F.count_if(F.col("o_orderstatus") == "O").alias("new_leads"),
        F.count_if(F.col("o_orderstatus") == "F").alias("qualified"),
        F.max("o_orderdate").alias("last_lead"),
    )
    who = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    return (
        who.join(views, "entity", "left").join(leads, "entity", "left")
        .filter("views IS NOT NULL OR leads IS NOT NULL")
        .select("entity", _zero("views"), _zero("leads"), _zero("new_leads"), _zero("qualified"), "last_lead")
        .withColumn("conversion", safe_percentage(F.col("leads"), F.col("views")))
    )


@_R.query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of each status."""
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@_R.query("""
WITH s AS (SELECT CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS src FROM orders)
SELECT CASE WHEN src IS NULL OR src = '' THEN 'Direct/unknown' ELSE src END AS label, src IS NULL AS missing, count(*) AS n
FROM s GROUP BY src
""")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of each source, grouped before blanks are relabelled: null and empty stay two rows."""
    src = F.expr("CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END")
    n = load(spark, sf_dir, "orders").groupBy(src.alias("src")).agg(F.count("*").alias("n"))
    label = F.when(F.col("src").isNull() | (F.col("src") == ""), "Direct/unknown").otherwise(F.col("src"))
    return n.select(label.alias("label"), F.col("src").isNull().alias("missing"), "n")


@_R.query("""
SELECT n_name AS city, count(*) AS leads FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY leads DESC, city LIMIT 12
""")
def city_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the twelve places with most leads; counted by customer before the dimensions are joined."""
    by = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    where = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = by.join(where, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("city"))
    return rows.agg(F.sum("n").alias("leads")).orderBy(F.col("leads").desc(), "city").limit(12)


@_R.query("""
WITH b AS (SELECT CASE WHEN o_totalprice IS NULL THEN 5 WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 1
                       WHEN o_totalprice < 250000 THEN 2 WHEN o_totalprice < 500000 THEN 3 ELSE 4 END AS ordinal FROM orders)
SELECT ordinal, ['<50k', '50k-100k', '100k-250k', '250k-500k', '500k+', 'Unknown'][ordinal + 1] AS bucket, count(*) AS n
FROM b GROUP BY ordinal
""")
def budget_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-open budget buckets; empty ones do not appear."""
    names = ["<50k", "50k-100k", "100k-250k", "250k-500k", "500k+", "Unknown"]
    price = F.col("o_totalprice")
    ordinal = F.when(price.isNull(), 5)
    for i, edge in enumerate((50_000, 100_000, 250_000, 500_000)):
        ordinal = ordinal.when(price < edge, i)
    rows = load(spark, sf_dir, "orders").groupBy(ordinal.otherwise(4).alias("ordinal")).agg(F.count("*").alias("n"))
    return rows.select("ordinal", F.element_at(F.array(*map(F.lit, names)), F.col("ordinal") + 1).alias("bucket"), "n")


@_R.query("""
SELECT c_custkey AS entity, c_name AS name, count(*) AS leads FROM orders JOIN customer ON c_custkey = o_custkey
GROUP BY 1, 2 ORDER BY leads DESC, entity LIMIT 10
""")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten entities with most leads; names are joined to the ten only."""
    top = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("leads"))
    names = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    top = top.join(names.select("entity"), "entity", "left_semi").orderBy(F.col("leads").desc(), "entity").limit(10)
    return names.join(F.broadcast(top), "entity").select("entity", "name", "leads")


@_R.query("""
SELECT p_brand AS category, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
GROUP BY 1 ORDER BY n DESC, category LIMIT 10
""")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten categories with most rows."""
    by = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("r"))
    rows = by.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("category"))
    return rows.agg(F.sum("n").alias("n"), F.round(F.sum("r"), 2).alias("revenue")).orderBy(F.col("n").desc(), "category").limit(10)


@_R.query("""
SELECT r_name AS region, count(o_orderkey) AS leads FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of each region, regions without leads included."""
    by = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rows = (
        region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(by, F.col("o_custkey") == F.col("c_custkey"), "left")
    )
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("leads"))


@_R.query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS new_leads,
       count(*) FILTER (o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS last_30d,
       count(*) FILTER (o_orderstatus = 'F') AS qualified FROM orders
""")
def overview_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, new, recent and qualified leads in one pass."""
    orders = load(spark, sf_dir, "orders")
    as_of = orders.agg(F.max("o_orderdate").alias("as_of"))
    return orders.join(F.broadcast(as_of), how="cross").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("o_orderstatus") == "O").alias("new_leads"),
        F.count_if(F.expr("o_orderdate >= as_of - INTERVAL 30 DAYS")).alias("last_30d"),
        F.count_if(F.col("o_orderstatus") == "F").alias("qualified"),
    )


@_R.query("""
SELECT c_custkey AS entity, count(DISTINCT o_orderkey) AS lead_count, count(DISTINCT event_id) AS visit_count
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey GROUP BY 1
""")
def fanout_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts of 1:N children; each is aggregated before the join, so nothing fans out."""
    leads = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("lead_count"))
    visits = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("visit_count"))
    who = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    return who.join(leads, "entity", "left").join(visits, "entity", "left").select("entity", _zero("lead_count"), _zero("visit_count"))


@_R.query("""
SELECT l_suppkey AS workspace, count(DISTINCT l_orderkey) FILTER (l_linestatus = 'O') AS pending,
       count(DISTINCT l_orderkey) FILTER (l_linestatus = 'F') AS reviewed, count(DISTINCT l_partkey) AS documents
FROM lineitem GROUP BY 1
""")
def filtered_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional distinct counts in one pass."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("workspace")).agg(
        F.countDistinct(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey"))).alias("pending"),
        F.countDistinct(F.when(F.col("l_linestatus") == "F", F.col("l_orderkey"))).alias("reviewed"),
        F.countDistinct("l_partkey").alias("documents"),
    )


@_R.query("""
SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_acctbal > 5000) AS promoted,
       count(*) FILTER (c_mktsegment = 'BUILDING') AS verified FROM customer
""")
def management_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a management list."""
    return load(spark, sf_dir, "customer").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("c_acctbal") > 0).alias("active"),
        F.count_if(F.col("c_acctbal") > 5000).alias("promoted"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("verified"),
    )


@_R.query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
     v AS (SELECT event_id AS view_id, user_id, ts AS view_ts FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, arg_max(view_id, (view_ts, view_id)) AS view_id, max(view_ts) AS view_ts
FROM p LEFT JOIN v ON v.user_id = p.user_id AND (v.view_ts, v.view_id) < (p.ts, p.event_id) GROUP BY 1, 2
""")
def latest_visit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: each purchase's newest earlier view of the same user: one ordered window, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    view = F.last(F.when(F.col("event_type") == "view", F.struct("ts", "event_id")), ignorenulls=True).over(w)
    rows = load(spark, sf_dir, "events").filter("event_type IN ('view', 'purchase')").withColumn("v", view)
    return rows.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("v.event_id").alias("view_id"), F.col("v.ts").alias("view_ts"))


@_R.query("""
SELECT event_id, user_id, event_type, coalesce(ts - lag(ts) OVER w <= INTERVAL 24 HOUR, false) AS duplicate
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
""")
def recent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within 24 hours of the previous one of the same key."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w))
    rows = load(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", "event_type", F.coalesce(gap <= 86_400_000_000, F.lit(False)).alias("duplicate"))


@_R.query("""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
  g AS (SELECT event_id, user_id, event_type, ts, rn, ts AS kept_ts, true AS accepted FROM o WHERE rn = 1
        UNION ALL
        SELECT o.event_id, o.user_id, o.event_type, o.ts, o.rn,
               CASE WHEN o.ts - g.kept_ts > INTERVAL 24 HOUR THEN o.ts ELSE g.kept_ts END, o.ts - g.kept_ts > INTERVAL 24 HOUR
        FROM g JOIN o ON o.user_id = g.user_id AND o.event_type = g.event_type AND o.rn = g.rn + 1)
SELECT event_id, user_id, event_type, accepted FROM g
""")
def recent_duplicates_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: an event is accepted if it comes over 24 hours after the last accepted one of its key."""
    from tessera.operators.sequential import accept_after_gap

    return accept_after_gap(load(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 86_400).select(
        "event_id", "user_id", "event_type", "accepted"
    )


@_R.query("""
WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT day, n, users, sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::BIGINT AS n_7d,
       sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)::BIGINT AS n_30d FROM d
""")
def rolling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: days with their 7 and 30 day sums; the window runs over days, not events."""
    days = load(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    over = lambda k: Window.orderBy(F.unix_date("day")).rangeBetween(-k, 0)
    return days.select("day", "n", "users", F.sum("n").over(over(6)).alias("n_7d"), F.sum("n").over(over(29)).alias("n_30d"))


@_R.query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2
""")
def session_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: visits of a user no more than 30 minutes apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w))
    rows = load(spark, sf_dir, "events").withColumn("new", F.when(gap <= 1_800_000_000, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@_R.query("""
SELECT event_type, count(*) AS n FROM events, (SELECT max(ts) AS m FROM events) WHERE ts BETWEEN m - INTERVAL 7 DAY AND m GROUP BY 1
""")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, H8: events of the last seven days, both ends included."""
    events = load(spark, sf_dir, "events")
    rows = events.filter(F.col("ts") >= _days_back(events, 7))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))
