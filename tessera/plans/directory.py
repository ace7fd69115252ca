"""The directory: faceted filters, search, ranking, joins to plans and promotions.

``part`` is the directory (brand as category, size as payback, retail price as investment), ``lineitem``
its subscriptions, ``customer`` and ``supplier`` the tenants.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import relational as rel
from tessera.plans.registry import Registry
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

_AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"


@_R.query("""
SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#2', 'Brand#21', 'Brand#22')
AND p_retailprice <= 1500 AND p_size BETWEEN 5 AND 40 AND NOT (p_type LIKE 'PROMO%')
""")
def directory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional conjuncts folded into one filter, which the scan gets."""
    facets = {"p_brand": ["Brand#1", "Brand#11", "Brand#2", "Brand#21", "Brand#22"]}
    rows = rel.faceted(load(spark, sf_dir, "part"), facets)
    for cond in (F.col("p_retailprice") <= 1500, F.col("p_size").between(5, 40), ~F.col("p_type").startswith("PROMO")):
        rows = rows.filter(cond)
    return rows.select("p_partkey", "p_name")


@_R.query("""
SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_brand), '#2') OR contains(lower(p_type), 'steel')
""")
def directory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive containment in any of several columns."""
    q = rel.contains_any(["p_name"], "AR") | rel.contains_any(["p_brand"], "#2") | rel.contains_any(["p_type"], "Steel")
    return load(spark, sf_dir, "part").filter(q).select("p_partkey", "p_name", "p_brand")


_RANKING = """
WITH promo AS (SELECT l_partkey, max(l_quantity) AS priority FROM lineitem
               WHERE l_shipdate <= TIMESTAMP '1998-06-01 00:00:00' AND l_shipdate + INTERVAL 50 DAY >= TIMESTAMP '1998-06-01 00:00:00' GROUP BY 1)
SELECT p_partkey, p_name, priority IS NOT NULL AS promoted, coalesce(priority, 0.0) AS priority,
       CASE WHEN p_type LIKE 'PROMO%' THEN 0.0 ELSE p_retailprice END AS score
FROM part LEFT JOIN promo ON l_partkey = p_partkey
"""


def _ranked(spark, sf_dir):
    active = load(spark, sf_dir, "lineitem").filter(f"l_shipdate <= {_AS_OF} AND l_shipdate + INTERVAL 50 DAYS >= {_AS_OF}")
    promo = active.groupBy("l_partkey").agg(F.max("l_quantity").alias("priority"))
    rows = load(spark, sf_dir, "part").join(promo, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select(
        "p_partkey",
        "p_name",
        F.col("priority").isNotNull().alias("promoted"),
        F.coalesce("priority", F.lit(0.0)).alias("priority"),
        F.when(F.col("p_type").startswith("PROMO"), 0.0).otherwise(F.col("p_retailprice")).alias("score"),
    )


def _order():
    return F.col("promoted").desc(), F.col("priority").desc(), F.col("score").desc(), F.lower("p_name"), F.col("p_partkey")


@_R.query(f"SELECT * FROM ({_RANKING}) ORDER BY promoted DESC, priority DESC, score DESC, lower(p_name), p_partkey LIMIT 50")
def directory_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted first, then priority, score (0 for demo rows) and name."""
    return _ranked(spark, sf_dir).orderBy(*_order()).limit(50)


@_R.query(f"SELECT p_partkey, p_name FROM ({_RANKING}) ORDER BY promoted DESC, priority DESC, score DESC, lower(p_name), p_partkey LIMIT 15 OFFSET 30")
def directory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifteen, asked for as the ninth under a ceiling of three."""
    return rel.page(_ranked(spark, sf_dir), 9, 15, *_order(), ceiling=3).select("p_partkey", "p_name")


@_R.query("""
SELECT p_partkey, row_number() OVER (ORDER BY nullif(p_size, 1) DESC NULLS LAST, lower(p_name), p_partkey) AS place FROM part QUALIFY place <= 40
""")
def client_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks last in either direction."""
    size = F.expr("nullif(p_size, 1)")
    top = load(spark, sf_dir, "part").orderBy(size.desc_nulls_last(), F.lower("p_name"), "p_partkey").limit(40)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(size.desc_nulls_last(), F.lower("p_name"), "p_partkey")).alias("place"))


@_R.query("""
SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-01 00:00:00'
AND l_shipdate + to_days(l_quantity::INT) >= TIMESTAMP '1998-06-01 00:00:00' GROUP BY 1
""")
def validity_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions whose interval holds the given time; the start's filter reaches the scan."""
    rows = load(spark, sf_dir, "lineitem").withColumn("ends_at", F.expr("l_shipdate + make_dt_interval(cast(l_quantity AS int))"))
    return rows.filter(rel.valid_at("l_shipdate", "ends_at", F.expr(_AS_OF))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@_R.query("""
WITH p AS (SELECT p_partkey, nullif(p_retailprice, 901.0) AS low, CASE WHEN p_size > 45 THEN NULL ELSE p_retailprice + p_size * 10 END AS high FROM part)
SELECT p_partkey FROM p WHERE (low IS NULL OR low <= 1200) AND (high IS NULL OR high >= 1000)
""")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ranges that overlap a budget; an open end always does."""
    rows = load(spark, sf_dir, "part").withColumn("low", F.expr("nullif(p_retailprice, 901.0)"))
    rows = rows.withColumn("high", F.when(F.col("p_size") <= 45, F.col("p_retailprice") + F.col("p_size") * 10))
    return rows.filter(rel.overlaps("low", "high", F.lit(1000), F.lit(1200))).select("p_partkey")


@_R.query("""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS last_activity FROM orders)
SELECT o_orderkey FROM o WHERE o_orderstatus <> 'F' AND (last_activity < (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY OR last_activity IS NULL)
""")
def stale_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rows without recent activity, or with none at all."""
    orders = load(spark, sf_dir, "orders")
    as_of = orders.agg(F.max("o_orderdate").alias("as_of"))
    rows = orders.filter("o_orderstatus <> 'F'").withColumn("last_activity", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")))
    rows = rows.join(F.broadcast(as_of), how="cross")
    return rows.filter("last_activity < as_of - INTERVAL 14 DAYS OR last_activity IS NULL").select("o_orderkey")


@_R.query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_name < 'D' AND c_acctbal > 0)
""")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tenants that the user is an active member of."""
    member = load(spark, sf_dir, "customer").filter("c_acctbal > 0").join(load(spark, sf_dir, "nation").filter("n_name < 'D'"), F.col("n_nationkey") == F.col("c_nationkey"))
    orders = load(spark, sf_dir, "orders")
    return orders.join(member, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@_R.query("""
SELECT l_suppkey AS organization, CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) WHEN 1 THEN 'owner' WHEN 2 THEN 'admin' ELSE 'member' END AS role
FROM lineitem WHERE l_linenumber > 5 GROUP BY 1
""")
def role_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest role: owner over admin over member."""
    rank = F.expr("min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END)")
    rows = load(spark, sf_dir, "lineitem").filter("l_linenumber > 5").groupBy(F.col("l_suppkey").alias("organization")).agg(rank.alias("r"))
    return rows.select("organization", F.element_at(F.array(*map(F.lit, ("owner", "admin", "member"))), F.col("r")).alias("role"))


@_R.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a large order."""
    orders = load(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return load(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@_R.query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    orders = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return load(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


_PLANS = """
WITH own AS (SELECT l_partkey AS k, max(l_quantity) AS plan FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY 1),
     explicit AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'),
     org AS (SELECT l_suppkey AS s, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS plan FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1 GROUP BY 1)
SELECT p_partkey, CASE WHEN own.plan IS NOT NULL THEN own.plan WHEN explicit.k IS NOT NULL THEN 0.0 ELSE coalesce(org.plan, 0.0) END AS plan,
       CASE WHEN own.plan IS NOT NULL THEN 'own' WHEN explicit.k IS NOT NULL THEN 'free' WHEN org.plan IS NOT NULL THEN 'organization' ELSE 'free' END AS via
FROM part LEFT JOIN own ON own.k = p_partkey LEFT JOIN explicit ON explicit.k = p_partkey LEFT JOIN org ON org.s = p_partkey % 100
"""


def _plans(spark, sf_dir):
    lines, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    newest = F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    own = lines.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("own"), F.lit(True).alias("explicit"))
    org = lines.filter("l_returnflag = 'N' AND l_linenumber = 1").groupBy("l_suppkey").agg(newest.alias("org"))
    rows = part.join(own, F.col("l_partkey") == F.col("p_partkey"), "left").join(org, F.col("l_suppkey") == F.col("p_partkey") % 100, "left")
    free = F.col("explicit") & F.col("own").isNull()
    plan = F.when(F.col("own").isNotNull(), F.col("own")).when(free, 0.0).otherwise(F.coalesce("org", F.lit(0.0)))
    via = F.when(F.col("own").isNotNull(), "own").when(free, "free").when(F.col("org").isNotNull(), "organization").otherwise("free")
    return rows.select("p_partkey", plan.alias("plan"), via.alias("via"))


@_R.query(_PLANS)
def cascade_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the row's own active plan, else free if it ever had one, else its organisation's newest, else free."""
    return _plans(spark, sf_dir)


@_R.query(f"SELECT p_partkey, plan >= 25 AS can_publish, coalesce(nullif(plan, 0.0) >= 40, false) AS can_video, least(5, floor(plan / 10)::INT) AS gallery FROM ({_PLANS})")
def feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities of the resolved plan; no plan, no capability."""
    return _plans(spark, sf_dir).select(
        "p_partkey",
        (F.col("plan") >= 25).alias("can_publish"),
        F.expr("coalesce(nullif(plan, 0.0) >= 40, false)").alias("can_video"),
        F.expr("least(5, cast(floor(plan / 10) AS int))").alias("gallery"),
    )


@_R.query("""
SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_shipmode)), ',') AS kinds, max(l_quantity) AS priority, count(*) AS n
FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 'homepage' ELSE 'category' END || '-' || l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1
""")
def promotion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions of each row as a set of kinds and the highest priority."""
    kind = F.concat(F.when(F.col("l_linestatus") == "O", "homepage").otherwise("category"), F.lit("-"), F.col("l_returnflag"))
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"), F.max("l_quantity").alias("priority"), F.count("*").alias("n")
    )


@_R.query("""
SELECT p_partkey, p_name FROM part QUALIFY CASE WHEN bool_or(p_size = 50) OVER () THEN p_size = 50 ELSE true END ORDER BY p_retailprice DESC, p_partkey LIMIT 6
""")
def featured_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best featured rows, or of all rows where none is featured."""
    rows = load(spark, sf_dir, "part")
    any_ = rows.agg(F.coalesce(F.bool_or(F.col("p_size") == 50), F.lit(False)).alias("any"))
    rows = rows.join(F.broadcast(any_), how="cross").filter(~F.col("any") | (F.col("p_size") == 50))
    return rows.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(6).select("p_partkey", "p_name")


@_R.query("""
SELECT p_partkey, other, place FROM (SELECT a.p_partkey, b.p_partkey AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_retailprice DESC, b.p_partkey) AS place
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) WHERE place <= 3
""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three others of the same category: the category's four best are enough, so no pairs of rows are made."""
    part = load(spark, sf_dir, "part")
    best = rel.top_per_key(part, ["p_brand", "p_type"], 4, F.col("p_retailprice").desc(), F.col("p_partkey"))
    lists = best.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("p_partkey").alias("other")))).alias("best"))
    mine = part.join(lists, ["p_brand", "p_type"])
    others = F.slice(F.filter("best", lambda x: x["other"] != F.col("p_partkey")), 1, 3)
    return mine.select("p_partkey", F.posexplode(others).alias("pos", "o")).select("p_partkey", "o.other", (F.col("pos") + 1).cast("bigint").alias("place"))


@_R.query("""
SELECT pos, p_partkey, p_name FROM (SELECT min(pos) AS pos, k FROM (SELECT unnest([7, 3, 7, 11, 2, 5]) AS k, unnest([0, 1, 2, 3, 4, 5]) AS pos) GROUP BY k ORDER BY pos LIMIT 4) JOIN part ON p_partkey = k
""")
def compare_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for ids in their order, repeats dropped, four at most."""
    ids = F.slice(F.array_distinct(F.array(*map(F.lit, (7, 3, 7, 11, 2, 5)))), 1, 4)
    asked = spark.range(1).select(F.posexplode(F.transform(ids, lambda x: x.cast("bigint"))).alias("n", "k"))
    first = asked.withColumn("pos", F.expr("CAST(array_position(array(7, 3, 7, 11, 2, 5), cast(k AS int)) - 1 AS int)"))
    return load(spark, sf_dir, "part").join(F.broadcast(first), F.col("p_partkey") == F.col("k")).select("pos", "p_partkey", "p_name")


@_R.query("""
WITH sub AS (SELECT l_partkey, max(l_shipdate) AS started FROM lineitem GROUP BY 1), act AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N'),
pend AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY 1)
SELECT p_partkey, sub.started, coalesce(pend.n, 0) AS pending, CASE WHEN act.l_partkey IS NOT NULL THEN 'active' WHEN sub.started IS NOT NULL THEN 'expired' ELSE 'none' END AS mode
FROM part LEFT JOIN sub ON sub.l_partkey = p_partkey LEFT JOIN act ON act.l_partkey = p_partkey LEFT JOIN pend ON pend.l_partkey = p_partkey
""")
def dashboard_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription, active subscription and pending requests of each row: one aggregate instead of three maps."""
    by = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.max("l_shipdate").alias("started"),
        F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("active"),
        F.count_if(F.col("l_linenumber") == 7).alias("pending"),
    )
    rows = load(spark, sf_dir, "part").join(by, F.col("l_partkey") == F.col("p_partkey"), "left")
    mode = F.when(F.col("active"), "active").when(F.col("started").isNotNull(), "expired").otherwise("none")
    return rows.select("p_partkey", "started", F.coalesce("pending", F.lit(0)).cast("bigint").alias("pending"), mode.alias("mode"))


@_R.query("""
SELECT CASE WHEN p_retailprice <= 1000 THEN '1000' WHEN p_retailprice <= 1250 THEN '1250' WHEN p_retailprice <= 1500 THEN '1500' ELSE '2000+' END AS landing, count(*) AS n, min(p_partkey) AS first_key
FROM part GROUP BY 1
""")
def budget_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing pages of fixed ceilings, each row on the tightest."""
    price = F.col("p_retailprice")
    page = F.when(price <= 1000, "1000").when(price <= 1250, "1250").when(price <= 1500, "1500").otherwise("2000+")
    return load(spark, sf_dir, "part").groupBy(page.alias("landing")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@_R.query("""
SELECT 'supplier' AS kind, lower(s_name) AS loc FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'nation', lower(n_name) FROM nation UNION ALL SELECT 'region', lower(r_name) FROM region
""")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows of several kinds under one shape."""
    pick = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.lower(c).alias("loc"))
    return (
        pick(load(spark, sf_dir, "supplier").filter("s_acctbal > 0"), "supplier", "s_name")
        .unionByName(pick(load(spark, sf_dir, "nation"), "nation", "n_name"))
        .unionByName(pick(load(spark, sf_dir, "region"), "region", "r_name"))
    )


@_R.query("""
SELECT s_suppkey, n_name AS city, CASE WHEN s_acctbal < 0 THEN 'red' WHEN s_acctbal < 5000 THEN 'amber' ELSE 'green' END AS colour
FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def map_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers with a colour by rule."""
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    colour = F.when(F.col("s_acctbal") < 0, "red").when(F.col("s_acctbal") < 5000, "amber").otherwise("green")
    return rows.select("s_suppkey", F.col("n_name").alias("city"), colour.alias("colour"))


@_R.query("""
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey LEFT JOIN region r ON r_regionkey = n_regionkey
WHERE o_totalprice > 400000
""")
def fk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of foreign keys."""
    rows = load(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    rows = rows.join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@_R.query("""
SELECT o_custkey, string_agg(o_orderkey || ':' || lines, ',' ORDER BY o_orderkey) AS tree FROM
 (SELECT o_custkey, o_orderkey, string_agg(l_linenumber || '=' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1
""")
def nested_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children nested level by level, bottom up."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(line.alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws("=", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ";")
    rows = load(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", text.alias("lines"))
    tree = F.array_sort(F.collect_list(F.struct("o_orderkey", "lines")))
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(tree, lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["lines"])), ",").alias("tree"))


@_R.query("""
SELECT s_suppkey, regexp_full_match(s_name, '.*#0*[1-9]0*') AS round_name, c.n AS parts FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) c ON l_suppkey = s_suppkey
""")
def bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: many-to-many through a bridge, counted once each."""
    bridge = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("parts"))
    rows = load(spark, sf_dir, "supplier").join(bridge, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.select("s_suppkey", F.col("s_name").rlike("^.*#0*[1-9]0*$").alias("round_name"), "parts")
