"""Back-office work: tabs and queues, gates on what is shown, heartbeats, change requests, and checks of what stages get.

``part`` rows are profiles, ``customer`` rows organisations, ``orders`` rows jobs and review fields, ``events`` heartbeats.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.plans.revenue import subscriptions
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

#: Tabs of the profile list and what each shows.
_TABS = {"active": "p_size > 5", "inactive": "p_size <= 5", "promoted": "p_type = 'PROMO'", "verified": "p_retailprice >= 1000"}


@_R.query("""
SELECT tab, p_partkey FROM (SELECT p_partkey, unnest(['active', 'inactive', 'promoted', 'verified']) AS tab, p_size, p_type, p_retailprice FROM part)
WHERE (tab = 'active' AND p_size > 5) OR (tab = 'inactive' AND p_size <= 5) OR (tab = 'promoted' AND p_type = 'PROMO') OR (tab = 'verified' AND p_retailprice >= 1000)
""")
def status_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles under each tab whose predicate they meet."""
    shown = F.array_compact(F.array(*[F.when(F.expr(test), tab) for tab, test in _TABS.items()]))
    return load(spark, sf_dir, "part").select(F.explode(shown).alias("tab"), "p_partkey")


@_R.query("SELECT d.doc_id, lang FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published articles only; the status reaches the scan."""
    status = load(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(status, "doc_id")


@_R.query("""
WITH s AS (SELECT l_suppkey AS org, l_orderkey, l_linenumber, l_shipdate <= TIMESTAMP '1998-06-01' AND l_shipdate + to_days(l_quantity::INT) >= TIMESTAMP '1998-06-01' AS active,
  CASE l_returnflag WHEN 'N' THEN l_extendedprice WHEN 'R' THEN l_extendedprice / 12 ELSE 0.0 END AS mrr, l_returnflag FROM lineitem)
SELECT l_orderkey, l_linenumber, round(mrr, 4) AS mrr FROM s WHERE active AND l_returnflag = 'N' AND mrr >= 20000
""")
def subscription_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions by their computed monthly revenue, interval and state; the conditions on columns reach the scan."""
    as_of = F.expr("TIMESTAMP '1998-06-01 00:00:00'")
    rows = subscriptions(spark, sf_dir).filter((F.col("starts_at") <= as_of) & (F.col("ends_at") >= as_of))
    rows = rows.filter((F.col("interval_") == "monthly") & (F.col("price") >= 20_000))
    return rows.select("l_orderkey", "l_linenumber", F.round("price", 4).alias("mrr"))


@_R.query("""
WITH j AS (SELECT user_id, max(ts) AS heartbeat, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1), n AS (SELECT max(ts) AS as_of FROM events)
SELECT user_id, CASE WHEN last_type = 'purchase' THEN 'done' WHEN heartbeat < as_of - INTERVAL 2 HOUR THEN 'failed' ELSE 'running' END AS state, CASE WHEN last_type <> 'purchase' AND heartbeat < as_of - INTERVAL 2 HOUR THEN 'heartbeat_timeout' END AS error_code FROM j, n
""")
def stale_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that still run but whose last heartbeat is over two hours old fail."""
    events = load(spark, sf_dir, "events")
    jobs = events.groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    jobs = jobs.crossJoin(F.broadcast(events.agg(F.max("ts").alias("as_of"))))  # one row
    stale = (F.col("last_type") != "purchase") & (F.col("heartbeat") < F.col("as_of") - F.expr("INTERVAL 2 HOURS"))
    state = F.when(F.col("last_type") == "purchase", "done").when(stale, "failed").otherwise("running")
    return jobs.select("user_id", state.alias("state"), F.when(stale, "heartbeat_timeout").alias("error_code"))


@_R.query("""
SELECT requested, p_partkey FROM part, (SELECT unnest([1, 2, 3]) AS requested) WHERE CASE WHEN p_size <= 15 THEN 1 WHEN p_size <= 35 THEN 2 ELSE 3 END <= requested
 AND (p_type <> 'SMALL' OR p_brand IN ('Brand#1', 'Brand#2')) AND p_name NOT LIKE 'old %'
""")
def applicable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for each requested depth: mandatory up to it, of the jurisdiction or of none, without personal data."""
    depth = F.when(F.col("p_size") <= 15, 1).when(F.col("p_size") <= 35, 2).otherwise(3)
    here = (F.col("p_type") != "SMALL") | F.col("p_brand").isin("Brand#1", "Brand#2")
    rows = load(spark, sf_dir, "part").filter(here & ~F.col("p_name").startswith("old "))
    return rows.select(F.explode(F.sequence(depth, F.lit(3))).alias("requested"), "p_partkey")


@_R.query("""
SELECT p_partkey, CASE WHEN l.n > 0 AND accepted > 0 THEN accepted_values ELSE [] END AS public_values, coalesce(l.n, 0) AS proposed FROM part LEFT JOIN
 (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS accepted, list_sort(list_distinct(list(l_quantity::INT) FILTER (l_returnflag = 'A'))) AS accepted_values FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey
""")
def gated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only accepted values are public; pending ones count, but are never shown."""
    values = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("int")))).alias("public_values"), F.count("*").alias("proposed")
    )
    rows = load(spark, sf_dir, "part").select("p_partkey").join(values, "p_partkey", "left")
    return rows.select("p_partkey", F.coalesce("public_values", F.array().cast("array<int>")).alias("public_values"), F.coalesce("proposed", F.lit(0)).alias("proposed"))


@_R.query("""
SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_retailprice END AS investment, p_type = 'PROMO' AND p_retailprice >= 1000 AS violates FROM part
""")
def demo_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo profiles never show measured numbers, and a verified one breaks the table's rule."""
    demo = F.col("p_type") == "PROMO"
    return load(spark, sf_dir, "part").select("p_partkey", F.when(~demo, F.col("p_retailprice")).alias("investment"), (demo & (F.col("p_retailprice") >= 1000)).alias("violates"))


@_R.query("""
WITH q AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'O' AND lower(o_orderpriority) LIKE '%i%')
SELECT o_custkey, o_orderkey, (r - 1) // 3 + 1 AS page, (n + 2) // 3 AS pages FROM q
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending review fields that match a text, in pages of three of each workspace."""
    mine = Window.partitionBy("o_custkey")
    rows = load(spark, sf_dir, "orders").filter("o_orderstatus = 'O' AND lower(o_orderpriority) LIKE '%i%'")
    rows = rows.withColumn("r", F.row_number().over(mine.orderBy("o_orderdate", "o_orderkey"))).withColumn("n", F.count("*").over(mine))
    return rows.select("o_custkey", "o_orderkey", F.expr("(r - 1) div 3 + 1").alias("page"), F.expr("(n + 2) div 3").alias("pages"))


@_R.query("""
WITH f AS (SELECT p_brand, 'franchise' AS kind, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size > 5),
 a AS (SELECT p_brand, 'article' AS kind, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r FROM part WHERE p_type = 'STANDARD'),
 l AS (SELECT p_brand, 'landing' AS kind, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part WHERE p_type = 'PROMO')
SELECT * FROM f UNION ALL SELECT * FROM a WHERE r <= 3 UNION ALL SELECT * FROM l WHERE r <= 3
""")
def category_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's active profiles, and its first three articles and landing pages."""
    part = load(spark, sf_dir, "part")

    def shelf(kind, test, most, *order):
        rows = part.filter(test).withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order)).cast("bigint"))
        rows = rows.filter(F.col("r") <= most) if most else rows
        return rows.select("p_brand", F.lit(kind).alias("kind"), F.col("p_partkey").alias("id"), "r")

    return (
        shelf("franchise", "p_size > 5", 0, F.col("p_retailprice").desc(), "p_partkey")
        .unionByName(shelf("article", "p_type = 'STANDARD'", 3, F.col("p_partkey").desc()))
        .unionByName(shelf("landing", "p_type = 'PROMO'", 3, "p_size", "p_partkey"))
    )


# ---- changes ----


@_R.query("""
WITH r AS (SELECT l_partkey AS k, arg_max(l_quantity::INT, (l_shipdate, l_orderkey, l_linenumber)) AS p_size, max(l_extendedprice) FILTER (l_returnflag = 'A') AS price FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT p_partkey, coalesce(r.p_size, part.p_size) AS p_size, round(coalesce(r.price, p_retailprice), 2) AS p_retailprice, CASE WHEN r.k IS NULL THEN 'unchanged' ELSE 'applied' END AS state FROM part LEFT JOIN r ON k = p_partkey
""")
def change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The editable columns of a profile as a request; approval writes what it holds, and keeps the rest."""
    latest = F.max_by(F.col("l_quantity").cast("int"), F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    price = F.max(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")))
    request = load(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(latest.alias("new_size"), price.alias("new_price"))
    rows = load(spark, sf_dir, "part").join(request.withColumn("asked", F.lit(True)), "p_partkey", "left")
    return rows.select(
        "p_partkey",
        F.coalesce("new_size", "p_size").alias("p_size"),
        F.round(F.coalesce("new_price", "p_retailprice"), 2).alias("p_retailprice"),
        F.when(F.col("asked"), "applied").otherwise("unchanged").alias("state"),
    )


@_R.query("""
WITH ref AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier)
SELECT c_custkey, coalesce(ref.name, c_name) AS name, CASE WHEN ref.k IS NULL THEN c_acctbal ELSE ref.balance END AS balance FROM customer LEFT JOIN ref ON k = c_custkey
WHERE NOT (ref.k IS NOT NULL AND c_mktsegment = 'HOUSEHOLD')
""")
def reference_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sourced values overwrite a profile and blank what they don't support; demo rows of sourced profiles go."""
    ref = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.lit(True).alias("sourced"))
    rows = load(spark, sf_dir, "customer")
    demo = rows.filter("c_mktsegment = 'HOUSEHOLD'").select("c_custkey").join(ref, "c_custkey", "left_semi")
    rows = rows.join(demo, "c_custkey", "left_anti").join(ref, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("name", "c_name").alias("name"), F.when(F.col("sourced"), F.col("balance")).otherwise(F.col("c_acctbal")).alias("balance"))


@_R.query("""
WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders)
SELECT o_custkey, o_orderkey, coalesce(was, 'new') AS from_status, o_orderstatus AS to_status, was = 'F' AS closed_before FROM t WHERE was IS DISTINCT FROM o_orderstatus
""")
def transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for every transition that changes the status."""
    was = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = load(spark, sf_dir, "orders").withColumn("was", was).filter(~F.col("was").eqNullSafe(F.col("o_orderstatus")))
    return rows.select("o_custkey", "o_orderkey", F.coalesce("was", F.lit("new")).alias("from_status"), F.col("o_orderstatus").alias("to_status"), (F.col("was") == "F").alias("closed_before"))


@_R.query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '5-LOW' ELSE o_orderpriority END AS priority FROM orders
""")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: columns rewritten where a condition holds, all other rows as they are."""
    late = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.expr("TIMESTAMP '1998-01-01 00:00:00'"))
    priority = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "5-LOW").otherwise(F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(late, "F").otherwise(F.col("o_orderstatus")).alias("status"), priority.alias("priority"))


@_R.query("""
WITH p AS (SELECT o_custkey AS org, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS raw, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS amount FROM orders GROUP BY 1)
SELECT org, CASE raw WHEN 'F' THEN 'active' WHEN 'O' THEN 'trialing' WHEN 'P' THEN 'past_due' ELSE 'unknown' END AS status, round(amount, 2) AS amount, CASE WHEN org % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS interval_ FROM p WHERE org IN (SELECT c_custkey FROM customer)
""")
def subscription_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider payloads parsed by a declared schema, statuses mapped, the owner checked, the newest of an organisation kept."""
    orders = load(spark, sf_dir, "orders")
    interval = F.when(F.col("o_custkey") % 2 == 0, "year").otherwise("month")
    body = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("amount"), interval.alias("interval")).alias("plan"))
    payloads = orders.select(F.to_json(body).alias("payload"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    row = F.from_json("payload", "customer long, status string, plan struct<amount: double, interval: string>")
    newest = payloads.select(row.alias("r"), "at").groupBy(F.col("r.customer").alias("org")).agg(F.max_by("r", "at").alias("r"))
    owned = newest.join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org")), "org", "left_semi")
    status = F.when(F.col("r.status") == "F", "active").when(F.col("r.status") == "O", "trialing").when(F.col("r.status") == "P", "past_due").otherwise("unknown")
    return owned.select("org", status.alias("status"), F.round("r.plan.amount", 2).alias("amount"), F.concat("r.plan.interval", F.lit("ly")).alias("interval_"))


# ---- checks before a stage runs: each row is a violation ----


@_R.query("""
SELECT 'duplicate_id' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'range', count(*) FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 50 OR l_discount NOT BETWEEN 0 AND 0.1
UNION ALL SELECT 'before_plan', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'metadata', count(*) FROM documents WHERE n_chars <> length(text)
""")
def stage_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, ranges, order in time and metadata that a stage's inputs have to agree on, as counts of violations."""
    lines = load(spark, sf_dir, "lineitem")
    rule = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    early = lines.join(load(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).filter("l_shipdate < o_orderdate")
    checks = {
        "duplicate_id": lines.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"),
        "range": lines.filter("NOT l_quantity BETWEEN 1 AND 50 OR l_discount NOT BETWEEN 0 AND 0.1"),
        "before_plan": early,
        "metadata": load(spark, sf_dir, "documents").filter(F.col("n_chars") != F.length("text")),
    }
    out = None
    for name, rows in checks.items():
        out = rule(rows, name) if out is None else out.unionByName(rule(rows, name))
    return out


@_R.query("""
WITH r AS (SELECT p_partkey, p_brand, p_name, count(*) OVER (PARTITION BY p_brand, p_name) AS same FROM part)
SELECT p_partkey, list_filter([CASE WHEN p_name NOT LIKE '% %' THEN 'identity' END, CASE WHEN same > 1 THEN 'alias_not_unique' END, CASE WHEN p_name LIKE 'old %' THEN 'excluded_field' END], lambda x: x IS NOT NULL) AS problems
FROM r WHERE p_name NOT LIKE '% %' OR same > 1 OR p_name LIKE 'old %'
""")
def profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that break a rule of identity, of aliases or of excluded names, with all that they break."""
    same = F.count("*").over(Window.partitionBy("p_brand", "p_name"))
    name = F.col("p_name")
    problems = F.array_compact(F.array(F.when(~name.contains(" "), "identity"), F.when(F.col("same") > 1, "alias_not_unique"), F.when(name.startswith("old "), "excluded_field")))
    return load(spark, sf_dir, "part").withColumn("same", same).select("p_partkey", problems.alias("problems")).filter(F.size("problems") > 0)


@_R.query("""
SELECT event_id, list_sort(list_filter(json_keys(doc), lambda k: k NOT IN ('k', 'kind'))) AS unknown, (doc->>'$.k')::BIGINT AS k FROM
 (SELECT event_id, CASE WHEN event_type = 'error' THEN json_merge_patch(props, '{"oops": 1, "kind": "e"}') ELSE json_merge_patch(props, '{"kind": "ok"}') END AS doc FROM events)
""")
def closed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: documents read by a declared schema, and the keys that it doesn't know."""
    extra = F.when(F.col("event_type") == "error", ', "oops": 1, "kind": "e"}').otherwise(', "kind": "ok"}')
    rows = load(spark, sf_dir, "events").select("event_id", F.concat(F.regexp_replace("props", r"\}\s*$", ""), extra).alias("doc"))
    unknown = F.array_sort(F.array_except(F.json_object_keys("doc"), F.array(F.lit("k"), F.lit("kind"))))
    return rows.select("event_id", unknown.alias("unknown"), F.from_json("doc", "k bigint, kind string")["k"].alias("k"))


@_R.query("""
WITH p AS (SELECT p_partkey, p_size > 45 AS protected_, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AS claimed, p_type = 'PROMO' AS promoted FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45))
SELECT array_to_string(list_filter([CASE WHEN protected_ THEN 'protected' END, CASE WHEN claimed THEN 'claimed' END, CASE WHEN promoted THEN 'promoted' END], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n FROM p GROUP BY 1
""")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles outside the snapshot by the reasons that keep them; no reason means that they would go."""
    lines = load(spark, sf_dir, "lineitem")
    part = load(spark, sf_dir, "part").join(lines.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    claimed = lines.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("claimed")).distinct()
    rows = part.join(claimed, "p_partkey", "left")
    reasons = F.array_compact(F.array(F.when(F.col("p_size") > 45, "protected"), F.when(F.col("claimed"), "claimed"), F.when(F.col("p_type") == "PROMO", "promoted")))
    return rows.groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count("*").alias("n"))


@_R.query("""
WITH lim AS (SELECT * FROM (VALUES ('1-URGENT', 3), ('2-HIGH', 2), ('3-MEDIUM', 1)) t(o_orderpriority, cap)), run AS (SELECT o_orderpriority, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-07-01') AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
 q AS (SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, q.o_orderpriority, place FROM q JOIN lim USING (o_orderpriority) LEFT JOIN run USING (o_orderpriority) WHERE place <= cap - least(cap - 1, coalesce(n, 0))
""")
def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest queued jobs of each campaign, as many as its free places; campaigns without a limit take none."""
    limits = spark.createDataFrame([("1-URGENT", 3), ("2-HIGH", 2), ("3-MEDIUM", 1)], "o_orderpriority string, cap int")
    orders = load(spark, sf_dir, "orders")
    recent = F.count_if(F.col("o_orderdate") >= F.expr("TIMESTAMP '2001-07-01 00:00:00'"))
    running = orders.filter("o_orderstatus = 'P'").groupBy("o_orderpriority").agg(recent.alias("n"))
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    # A rank filter that Spark applies before its exchange: no campaign has more free places than the highest limit.
    queued = orders.filter("o_orderstatus = 'O'").withColumn("place", place).filter("place <= 3")
    rows = queued.join(F.broadcast(limits), "o_orderpriority").join(running, "o_orderpriority", "left")
    return rows.filter("place <= cap - least(cap - 1, coalesce(n, 0))").select("o_orderkey", "o_orderpriority", F.col("place").cast("bigint").alias("place"))
