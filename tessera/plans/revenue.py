"""Revenue and sales analytics.

``lineitem`` rows are subscriptions (N monthly, R yearly, A manual), ``orders`` rows are revenue events
(F new, P churn, O renewal) and opportunities.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import safe_percentage
from tessera.plans.registry import Registry
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

_AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"
_SUBS = """
 (SELECT l_suppkey AS org, l_orderkey, l_linenumber, l_shipdate AS starts_at, l_shipdate + to_days(l_quantity::INT) AS ends_at,
         CASE l_returnflag WHEN 'N' THEN 'monthly' WHEN 'R' THEN 'yearly' ELSE '' END AS interval_,
         CASE l_returnflag WHEN 'N' THEN l_extendedprice WHEN 'R' THEN l_extendedprice / 12 ELSE 0.0 END AS price FROM lineitem) s
"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions with D12's monthly price."""
    price = F.expr("CASE l_returnflag WHEN 'N' THEN l_extendedprice WHEN 'R' THEN l_extendedprice / 12 ELSE 0.0D END")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("org"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("starts_at"),
        F.expr("l_shipdate + make_dt_interval(cast(l_quantity AS int))").alias("ends_at"),
        F.expr("CASE l_returnflag WHEN 'N' THEN 'monthly' WHEN 'R' THEN 'yearly' ELSE '' END").alias("interval_"),
        price.alias("price"),
    )


_ACTIVE = f"starts_at <= {_AS_OF} AND ends_at >= {_AS_OF}"


@_R.query(f"SELECT l_orderkey, l_linenumber, round(price, 4) AS mrr FROM {_SUBS} WHERE {_ACTIVE}")
def subscription_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly recurring revenue of each active subscription."""
    return subscriptions(spark, sf_dir).filter(_ACTIVE).select("l_orderkey", "l_linenumber", F.round("price", 4).alias("mrr"))


@_R.query(f"""
SELECT round(sum(price)::DECIMAL(38, 6), 2)::DOUBLE AS mrr, round((sum(price) * 12)::DECIMAL(38, 6), 2)::DOUBLE AS arr, count(*) AS active, count(DISTINCT org) FILTER (price > 0) AS paying,
 count(*) FILTER (interval_ = 'monthly') AS monthly, count(*) FILTER (interval_ = 'yearly') AS yearly, round((sum(price) / count(DISTINCT org) FILTER (price > 0))::DECIMAL(38, 6), 2)::DOUBLE AS arpa
FROM {_SUBS} WHERE {_ACTIVE}
""")
def mrr_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring revenue, paying organisations and revenue per account, in one aggregate.

    Money is rounded as a decimal, so that the last bits of a sum, which follow its order, never decide a half."""
    money = lambda x: F.round(x.cast("decimal(38,6)"), 2).cast("double")
    paying = F.countDistinct(F.when(F.col("price") > 0, F.col("org")))
    return subscriptions(spark, sf_dir).filter(_ACTIVE).agg(
        money(F.sum("price")).alias("mrr"),
        money(F.sum("price") * 12).alias("arr"),
        F.count("*").alias("active"),
        paying.alias("paying"),
        F.count_if(F.col("interval_") == "monthly").alias("monthly"),
        F.count_if(F.col("interval_") == "yearly").alias("yearly"),
        money(F.sum("price") / paying).alias("arpa"),
    )


@_R.query("""
SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS new_mrr,
 round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS churned_mrr, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) - coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS net_mrr
FROM orders GROUP BY 1
""")
def mrr_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, churned and net revenue of each month."""
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return load(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(
        F.round(part("F"), 2).alias("new_mrr"), F.round(part("P"), 2).alias("churned_mrr"), F.round(zero(part("F")) - zero(part("P")), 2).alias("net_mrr")
    )


@_R.query(f"""
SELECT CASE WHEN interval_ = '' THEN 'monthly' ELSE interval_ END AS interval_, CASE WHEN {_ACTIVE} THEN 'active' WHEN starts_at > {_AS_OF} THEN 'trial' ELSE 'expired' END AS status, count(*) AS n
FROM {_SUBS} GROUP BY 1, 2
""")
def interval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions by status and interval; a blank interval counts as monthly."""
    status = F.expr(f"CASE WHEN {_ACTIVE} THEN 'active' WHEN starts_at > {_AS_OF} THEN 'trial' ELSE 'expired' END")
    kind = F.expr("coalesce(nullif(interval_, ''), 'monthly')")
    return subscriptions(spark, sf_dir).groupBy(kind.alias("interval_"), status.alias("status")).agg(F.count("*").alias("n"))


@_R.query(f"SELECT org, round(sum(price), 1) AS mrr FROM {_SUBS} WHERE {_ACTIVE} GROUP BY 1 ORDER BY mrr DESC, org LIMIT 10")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten organisations with most recurring revenue."""
    rows = subscriptions(spark, sf_dir).filter(_ACTIVE).groupBy("org").agg(F.round(F.sum("price"), 1).alias("mrr"))
    return rows.orderBy(F.col("mrr").desc(), "org").limit(10)


@_R.query(f"""
WITH m AS (SELECT (DATE '1998-06-01' + to_months(i::INT))::DATE AS month FROM generate_series(0, 11) t(i)),
 s AS (SELECT *, date_trunc('month', ends_at + INTERVAL 300 DAY) AS last_month FROM {_SUBS} WHERE {_ACTIVE})
SELECT month, round(sum(price), 2) AS expected_mrr, count(*) FILTER (last_month = month) AS endings, count(*) AS live FROM m JOIN s ON last_month >= month GROUP BY 1
""")
def mrr_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected revenue of twelve months. Each subscription is exploded to its own months only, after a
    pre-aggregate by last month, so the calendar never meets all subscriptions."""
    last = F.to_date(F.date_trunc("month", F.expr("ends_at + INTERVAL 300 DAYS")))
    rows = subscriptions(spark, sf_dir).filter(_ACTIVE).groupBy(last.alias("last_month")).agg(F.sum("price").alias("price"), F.count("*").alias("n"))
    until = F.least(F.col("last_month"), F.lit("1999-05-01").cast("date"))
    rows = rows.filter("last_month >= DATE '1998-06-01'").withColumn("month", F.explode(F.sequence(F.lit("1998-06-01").cast("date"), until, F.expr("INTERVAL 1 MONTH"))))
    return rows.groupBy("month").agg(
        F.round(F.sum("price"), 2).alias("expected_mrr"),
        F.coalesce(F.sum(F.when(F.col("last_month") == F.col("month"), F.col("n"))), F.lit(0)).alias("endings"),
        F.sum("n").alias("live"),
    )


@_R.query("""
WITH e AS (SELECT o_custkey AS org, o_orderdate AS ts, o_orderkey, o_orderstatus AS kind, o_totalprice AS amount FROM orders),
 c AS (SELECT org, min(ts) AS cohort_ts, arg_min(amount, (ts, o_orderkey)) AS start_mrr FROM e WHERE kind = 'F' GROUP BY 1),
 l AS (SELECT c.org, cohort_ts, start_mrr, coalesce(sum(amount) FILTER (kind = 'P' AND ts > cohort_ts), 0) AS lost, count(*) FILTER (kind = 'P' AND ts > cohort_ts) AS churns
       FROM c JOIN e ON e.org = c.org GROUP BY 1, 2, 3)
SELECT date_trunc('month', cohort_ts)::DATE AS cohort, count(*) AS started, count(*) FILTER (churns = 0) AS retained,
 CASE WHEN count(*) = 0 THEN 0.0 ELSE round_even(count(*) FILTER (churns = 0) / count(*) * 100, 2) END AS logo_retention,
 round(greatest(0, sum(start_mrr) - sum(lost)) / sum(start_mrr) * 100, 1) AS gross_retention
FROM l GROUP BY 1 ORDER BY cohort DESC LIMIT 12
""")
def retention_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logo and gross revenue retention of the newest twelve cohorts; the join is by organisation, after one aggregate each."""
    e = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("org"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("amount"))
    first = F.min_by("amount", F.struct("ts", "o_orderkey"))
    c = e.filter("kind = 'F'").groupBy("org").agg(F.min("ts").alias("cohort_ts"), first.alias("start_mrr"))
    churn = e.filter("kind = 'P'").select("org", "ts", "amount")
    lost = c.join(churn, "org", "left").groupBy("org", "cohort_ts", "start_mrr").agg(
        F.coalesce(F.sum(F.when(F.col("ts") > F.col("cohort_ts"), F.col("amount"))), F.lit(0.0)).alias("lost"), F.count_if(F.col("ts") > F.col("cohort_ts")).alias("churns")
    )
    rows = lost.groupBy(F.to_date(F.date_trunc("month", "cohort_ts")).alias("cohort")).agg(
        F.count("*").alias("started"), F.count_if(F.col("churns") == 0).alias("retained"), F.sum("start_mrr").alias("s"), F.sum("lost").alias("l")
    )
    gross = F.round(F.greatest(F.lit(0.0), F.col("s") - F.col("l")) / F.col("s") * 100, 1)
    rows = rows.select("cohort", "started", "retained", safe_percentage(F.col("retained"), F.col("started")).alias("logo_retention"), gross.alias("gross_retention"))
    return rows.orderBy(F.col("cohort").desc()).limit(12)


_PROB = "CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 10 ELSE o_orderkey % 10 * 10 END"


@_R.query(f"""
SELECT o_orderstatus AS stage, count(*) AS n, round(sum(o_totalprice), 2) AS expected, round(sum(o_totalprice * ({_PROB}) / 100), 2) AS weighted FROM orders GROUP BY 1
""")
def pipeline_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities, expected and weighted value of each stage."""
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("stage")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("expected"), F.round(F.sum(F.expr(f"o_totalprice * ({_PROB}) / 100")), 2).alias("weighted")
    )


@_R.query("""
SELECT o_orderpriority AS salesperson, count(*) AS n, round(sum(o_totalprice), 2) AS value_ FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1
""")
def salesperson_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities of each salesperson, unassigned ones left out."""
    rows = load(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'")
    return rows.groupBy(F.col("o_orderpriority").alias("salesperson")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value_"))


@_R.query(f"""
WITH o AS (SELECT *, (SELECT max(o_orderdate) FROM orders) AS now_ FROM orders)
SELECT count(*) FILTER (o_orderstatus <> 'F') AS open_, round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 2) AS pipeline,
 round(sum(o_totalprice * ({_PROB}) / 100) FILTER (o_orderstatus <> 'F'), 2) AS weighted, count(*) FILTER (o_orderstatus = 'F' AND o_orderdate >= date_trunc('month', now_)) AS won_this_month,
 count(*) FILTER (o_orderstatus = 'P') AS lost, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate < now_ - INTERVAL 365 DAY) AS overdue FROM o
""")
def sales_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of the sales dashboard in one aggregate."""
    orders = load(spark, sf_dir, "orders")
    rows = orders.join(F.broadcast(orders.agg(F.max("o_orderdate").alias("now_"))), how="cross")
    is_open = F.col("o_orderstatus") != "F"
    return rows.agg(
        F.count_if(is_open).alias("open_"),
        F.round(F.sum(F.when(is_open, F.col("o_totalprice"))), 2).alias("pipeline"),
        F.round(F.sum(F.when(is_open, F.expr(f"o_totalprice * ({_PROB}) / 100"))), 2).alias("weighted"),
        F.count_if(F.expr("o_orderstatus = 'F' AND o_orderdate >= date_trunc('month', now_)")).alias("won_this_month"),
        F.count_if(F.col("o_orderstatus") == "P").alias("lost"),
        F.count_if(F.expr("o_orderstatus = 'O' AND o_orderdate < now_ - INTERVAL 365 DAYS")).alias("overdue"),
    )


@_R.query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders
""")
def next_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: version numbers of each entity's releases and what each supersedes."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("version"), F.lag("o_orderkey").over(w).alias("supersedes"))


@_R.query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_new FROM orders GROUP BY 1
""")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest and first row of each key, without sorting."""
    at = F.struct("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("newest"), F.min_by("o_orderkey", at).alias("first_new"))


@_R.query("""
SELECT o_orderkey, last_day(o_orderdate) AS month_end, (o_orderdate + INTERVAL 1 MONTH)::DATE AS plus_month, date_trunc('month', o_orderdate + INTERVAL 1 MONTH)::DATE AS next_month,
 date_diff('day', date_trunc('month', o_orderdate), o_orderdate)::INT AS day_index FROM orders
""")
def month_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H7: month starts, added months with the day clamped."""
    d = F.to_date("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.last_day(d).alias("month_end"), F.add_months(d, 1).alias("plus_month"), F.trunc(F.add_months(d, 1), "MM").alias("next_month"), F.datediff(d, F.trunc(d, "MM")).alias("day_index")
    )
