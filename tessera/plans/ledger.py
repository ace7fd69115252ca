"""Cost, budget, benchmark and run analytics.

``conversations`` are runs (conv_id), their turns the rounds, roles the stages and text lengths the tokens; ``events`` are usage with a nullable cost.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import ratio, token_cost
from tessera.plans.registry import Registry
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

#: Prices of a million tokens. Example values of the rate card.
RATES = (("assistant", 10.0), ("user", 2.5))


@_R.query("""
SELECT conv_id, role, count(*) AS calls, sum(length(text))::BIGINT AS tokens, round(sum(round_even(length(text) * CASE role WHEN 'assistant' THEN 10.0 WHEN 'user' THEN 2.5 END / 1000000, 8)), 8) AS cost FROM conversations GROUP BY 1, 2
""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost by rate card; a model that the card lacks has no known cost."""
    rates = spark.createDataFrame(RATES, "role string, rate double")
    rows = load(spark, sf_dir, "conversations").join(F.broadcast(rates), "role", "left")
    return rows.groupBy("conv_id", "role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("tokens"), F.round(F.sum(token_cost(F.length("text"), F.col("rate"))), 8).alias("cost"))


@_R.query("""
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN round(sum(value), 2) END AS cost, count(*) FILTER (event_type = 'error') AS unknown,
 round(sum(value) FILTER (event_type <> 'error') + 0.5 * count(*) FILTER (event_type = 'error'), 2) AS with_reserve FROM events GROUP BY 1
""")
def cost_null_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total is unknown if any part is; with a reserve for each unknown part it is not."""
    cost = F.when(F.col("event_type") != "error", F.col("value"))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.when(F.count(cost) == F.count("*"), F.round(F.sum(cost), 2)).alias("cost"),
        (F.count("*") - F.count(cost)).alias("unknown"),
        F.round(F.sum(cost) + 0.5 * (F.count("*") - F.count(cost)), 2).alias("with_reserve"),
    )


_STATUSES = ("queued", "running", "completed", "failed", "cancelled", "stopped")
_STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END"


@_R.query(f"""
WITH dim AS (SELECT unnest({list(_STATUSES)}) AS status), c AS (SELECT {_STATUS} AS status, o_totalprice FROM orders)
SELECT dim.status, count(c.status) AS n, round(coalesce(avg(o_totalprice), 0), 2) AS mean_value FROM dim LEFT JOIN c USING (status) GROUP BY 1
""")
def campaign_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known status with its count, zero included."""
    dim = spark.createDataFrame([(s,) for s in _STATUSES], "status string")
    rows = load(spark, sf_dir, "orders").groupBy(F.expr(_STATUS).alias("status")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    return dim.join(rows, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.round(F.coalesce("m", F.lit(0.0)), 2).alias("mean_value"))


@_R.query("""
WITH a AS (SELECT o_custkey AS campaign, avg(o_totalprice) AS mean_cost, count(*) FILTER (o_orderstatus = 'P') AS unknown, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT campaign, array_to_string(list_filter([CASE WHEN mean_cost > 250000 THEN 'mean_cost' END, CASE WHEN total > 3000000 THEN 'budget' END, CASE WHEN unknown > 0 THEN 'unknown_cost' END], lambda x: x IS NOT NULL), ',') AS stops FROM a
""")
def monitoring_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop codes of each campaign."""
    a = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("campaign")).agg(F.avg("o_totalprice").alias("mean_cost"), F.count_if(F.col("o_orderstatus") == "P").alias("unknown"), F.sum("o_totalprice").alias("total"))
    codes = F.array(F.when(F.col("mean_cost") > 250_000, "mean_cost"), F.when(F.col("total") > 3_000_000, "budget"), F.when(F.col("unknown") > 0, "unknown_cost"))
    return a.select("campaign", F.array_join(F.array_compact(codes), ",").alias("stops"))


_ROUNDS = "(SELECT conv_id, turn, length(text) AS quality, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM conversations) r"


def _rounds(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = F.length("text").cast("bigint")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("quality"), (q - F.lag(q).over(w)).alias("delta"))


@_R.query(f"""
SELECT conv_id, turn, delta, CASE WHEN delta > 0 THEN 'progress' WHEN delta < 0 THEN 'regression' WHEN delta = 0 THEN 'none' ELSE 'first' END AS reason FROM {_ROUNDS}
""")
def round_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each round over the one before."""
    reason = F.when(F.col("delta") > 0, "progress").when(F.col("delta") < 0, "regression").when(F.col("delta") == 0, "none").otherwise("first")
    return _rounds(spark, sf_dir).select("conv_id", "turn", "delta", reason.alias("reason"))


@_R.query(f"""
WITH g AS (SELECT *, sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island, coalesce(delta, 0) <= 0 AS stalled FROM {_ROUNDS})
SELECT conv_id, turn, sum(stalled::INT) OVER (PARTITION BY conv_id, island ORDER BY turn)::BIGINT AS streak FROM g
""")
def stagnation_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds in a row without progress."""
    rows = _rounds(spark, sf_dir).withColumn("island", F.sum(F.when(F.col("delta") > 0, 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn")))
    stalled = F.when(F.coalesce("delta", F.lit(0)) <= 0, 1).otherwise(0)
    return rows.select("conv_id", "turn", F.sum(stalled).over(Window.partitionBy("conv_id", "island").orderBy("turn")).alias("streak"))


@_R.query("""
WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM conversations)
SELECT conv_id, turn, spent::BIGINT AS spent, spent >= 1500 AS stop, coalesce(bool_or(spent >= 1500) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS latched FROM c
""")
def running_cost_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop at the ceiling, and the alarm that stays once it was raised."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text").cast("bigint")).over(w).alias("spent"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("conv_id", "turn", "spent", (F.col("spent") >= 1500).alias("stop"), F.coalesce(F.bool_or(F.col("spent") >= 1500).over(before), F.lit(False)).alias("latched"))


_METRICS = """
 SELECT source AS brand, count(*) AS fields, count(quality) AS proposed, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 1 AND coalesce(toxic, 0) = 0) AS unchanged, count(*) FILTER (lang = 'en') AS with_metadata, sum(n_chars) / 100000.0 AS cost
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
"""


def _metrics(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy(F.col("source").alias("brand")).agg(
        F.count("*").alias("fields"),
        F.count("quality").alias("proposed"),
        F.count_if(F.col("quality") == 1).alias("accepted"),
        F.count_if((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("unchanged"),
        F.count_if(F.col("lang") == "en").alias("with_metadata"),
        (F.sum("n_chars") / 100_000).alias("cost"),
    )


@_R.query(f"""
WITH m AS ({_METRICS})
SELECT brand, proposed, accepted, CASE WHEN proposed = 0 THEN 0.0 ELSE round_even(accepted / proposed, 4) END AS acceptance, CASE WHEN proposed = 0 THEN 0.0 ELSE round_even(unchanged / proposed, 4) END AS unchanged_rate,
 round(accepted / cost, 2) AS per_cost, proposed >= 8 AS gate_proposals, coalesce(unchanged / nullif(proposed, 0), 0) >= 0.6 AS gate_unchanged, with_metadata = fields AS gate_metadata FROM m
""")
def benchmark_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, efficiency and gates of each brand."""
    m = _metrics(spark, sf_dir)
    return m.select(
        "brand", "proposed", "accepted",
        ratio(F.col("accepted"), F.col("proposed")).alias("acceptance"),
        ratio(F.col("unchanged"), F.col("proposed")).alias("unchanged_rate"),
        F.round(F.col("accepted") / F.col("cost"), 2).alias("per_cost"),
        (F.col("proposed") >= 8).alias("gate_proposals"),
        (F.when(F.col("proposed") > 0, F.col("unchanged") / F.col("proposed")).otherwise(0.0) >= 0.6).alias("gate_unchanged"),
        (F.col("with_metadata") == F.col("fields")).alias("gate_metadata"),
    )


_ISSUES = "list_filter([CASE WHEN proposed < 15 THEN 'few_proposals' END, CASE WHEN accepted * 2 < proposed THEN 'low_acceptance' END, CASE WHEN with_metadata < fields THEN 'missing_metadata' END], lambda x: x IS NOT NULL)"


def _issues(m):
    return m.select("brand", F.array_compact(F.array(
        F.when(F.col("proposed") < 15, "few_proposals"), F.when(F.col("accepted") * 2 < F.col("proposed"), "low_acceptance"), F.when(F.col("with_metadata") < F.col("fields"), "missing_metadata")
    )).alias("issues"))


@_R.query(f"WITH m AS ({_METRICS}) SELECT brand, array_to_string({_ISSUES}, ',') AS issues, len({_ISSUES}) = 0 AS ready FROM m")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue codes of each brand."""
    return _issues(_metrics(spark, sf_dir)).select("brand", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("ready"))


@_R.query(f"WITH m AS ({_METRICS}), i AS (SELECT unnest({_ISSUES}) AS issue FROM m) SELECT issue, count(*) AS n FROM i GROUP BY 1")
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each issue occurs."""
    return _issues(_metrics(spark, sf_dir)).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@_R.query("""
SELECT conv_id, CASE WHEN count(*) <= 2 THEN 'insufficient' WHEN count(*) < 8 OR max(turn) % 2 = 0 THEN 'partial' ELSE 'complete' END AS class FROM conversations GROUP BY 1
""")
def completion_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insufficient, partial or complete runs."""
    kind = F.when(F.count("*") <= 2, "insufficient").when((F.count("*") < 8) | (F.max("turn") % 2 == 0), "partial").otherwise("complete")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(kind.alias("class"))


@_R.query(f"""
SELECT campaign, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'queued') THEN 'queued' ELSE 'failed' END AS status, count(*) AS children FROM (SELECT o_custkey AS campaign, {_STATUS} AS status FROM orders) GROUP BY 1
""")
def campaign_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign's status from its children's, by precedence."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("campaign"), F.expr(_STATUS).alias("status"))
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("running"), "running").when(F.bool_and(F.col("status") == "completed"), "completed").when(has("queued"), "queued").otherwise("failed")
    return rows.groupBy("campaign").agg(status.alias("status"), F.count("*").alias("children"))


@_R.query("""
WITH q AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'), run AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
 r AS (SELECT q.*, row_number() OVER (PARTITION BY q.o_custkey ORDER BY o_orderdate, o_orderkey) AS place, greatest(0, 2 - coalesce(run.n, 0)) AS free FROM q LEFT JOIN run USING (o_custkey))
SELECT o_orderkey, o_custkey FROM r WHERE place <= free ORDER BY o_orderdate, o_orderkey LIMIT 20
""")
def fifo_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest queued jobs, no more of a campaign than it has free places."""
    orders = load(spark, sf_dir, "orders")
    run = orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = orders.filter("o_orderstatus = 'O'").withColumn("place", F.row_number().over(w)).filter("place <= 2").join(run, "o_custkey", "left")
    return rows.filter("place <= 2 - coalesce(n, 0)").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_custkey")


@_R.query("""
SELECT coalesce(o_orderpriority, 'all') AS decision, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM orders) * 100, 0) AS percent FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with their share, and all of them."""
    rows = load(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("o_orderpriority").isNull(), F.col("n"))).over(Window.partitionBy())
    return rows.select(F.coalesce("o_orderpriority", F.lit("all")).alias("decision"), "n", F.bround(F.col("n") / total * 100, 0).alias("percent"))


@_R.query("""
WITH RECURSIVE chain AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS parent, 0 AS depth, n_name AS path FROM nation WHERE n_nationkey = 0
 UNION ALL SELECT n.n_nationkey, (n.n_nationkey - 1) // 2, depth + 1, path || '>' || n.n_name FROM nation n JOIN chain c ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 2 = c.id)
SELECT id, depth, path FROM chain
""")
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17, L1: inheritance chains of a small tree, as a recursive relation."""
    return spark.sql(
        """
      WITH RECURSIVE chain(id, depth, path) AS (
        SELECT n_nationkey, 0, n_name FROM {nation} WHERE n_nationkey = 0
        UNION ALL
        SELECT n.n_nationkey, c.depth + 1, concat(c.path, '>', n.n_name) FROM {nation} n JOIN chain c ON n.n_nationkey > 0 AND (n.n_nationkey - 1) div 2 = c.id)
      SELECT id, depth, path FROM chain""",
        nation=load(spark, sf_dir, "nation"),
    )
