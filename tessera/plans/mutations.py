"""Set operations, row mutation, event logs and validation.

A mutation is a plan from the old table and the change to the new table; a single writer overwrites.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import relational as rel
from tessera.plans.registry import Registry
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct union."""
    a = load(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@_R.query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retained without churned."""
    orders = load(spark, sf_dir, "orders")
    return orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).subtract(orders.filter("o_orderstatus = 'P'").select("o_custkey"))


@_R.query("SELECT user_id AS k FROM events INTERSECT SELECT o_custkey FROM orders")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys on both sides."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("k")).intersect(load(spark, sf_dir, "orders").select("o_custkey"))


@_R.query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
 f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT doc_id, coalesce(md5(string_agg(w, ' ' ORDER BY i)), md5('')) AS words, count(w) AS n FROM documents LEFT JOIN f USING (doc_id) GROUP BY 1
""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first occurrences in order, blanks dropped, as their digest and number."""
    from tessera.functions.text import ordered_distinct as distinct

    rows = load(spark, sf_dir, "documents").select("doc_id", distinct(F.split("text", " ")).alias("w"))
    return rows.select("doc_id", F.md5(F.array_join("w", " ").cast("binary")).alias("words"), F.size("w").cast("bigint").alias("n"))


@_R.query("""
SELECT k, coalesce(arg_max(v, t) FILTER (NOT old), arg_max(v, t) FILTER (old)) AS status, CASE WHEN bool_and(old) THEN 'inherited' ELSE 'observed' END AS origin
FROM (SELECT o_custkey AS k, o_orderstatus AS v, (o_orderdate, o_orderkey) AS t, o_orderdate < TIMESTAMP '2000-01-01' AS old FROM orders) GROUP BY 1
""")
def prior_delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta over the prior state; what was not seen again is inherited. The delta is what came since 2000."""
    orders = load(spark, sf_dir, "orders").withColumn("old", F.expr("o_orderdate < TIMESTAMP '2000-01-01 00:00:00'"))
    latest = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    state = lambda rows, name: rows.groupBy(F.col("o_custkey").alias("k")).agg(latest.alias(name))
    merged = state(orders.filter("old"), "prior").join(state(orders.filter("NOT old"), "delta"), "k", "full")
    return merged.select("k", F.coalesce("delta", "prior").alias("status"), F.when(F.col("delta").isNull(), "inherited").otherwise("observed").alias("origin"))


@_R.query("""
SELECT host, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, max(length(title)) AS longest, count(*) AS n FROM
 (SELECT regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^(www|m|blog)\\.', '') AS host, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) GROUP BY 1
""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records merged by identity; lists united, the longest title wins."""
    rows = load(spark, sf_dir, "pages").select(
        F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), r"^(www|m|blog)\.", "").alias("host"),
        F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("lang"),
        F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("n"),
    )
    return rows.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.max("n").cast("bigint").alias("longest"), F.count("*").alias("n"))


@_R.query("""
SELECT c_custkey AS k, CASE WHEN o.n IS NULL THEN c_acctbal ELSE round(o.n, 2) END AS value_ FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, O3: changed rows replace those of their key."""
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value_"))
    orders = load(spark, sf_dir, "orders").join(old.select("k"), F.col("o_custkey") == F.col("k"), "left_semi")
    return rel.upsert(old, orders.groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.max("o_totalprice"), 2).alias("value_")), ["k"])


@_R.query("SELECT c_custkey AS k, 'old' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal > 0")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows whose key is not there yet."""
    rows = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    old = rows.filter("c_acctbal > 0").select("k", F.lit("old").alias("origin"))
    return rel.insert_if_absent(old, rows.filter("c_mktsegment = 'BUILDING'").select("k", F.lit("new").alias("origin")), ["k"])


@_R.query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) OR p_size > 45")
def guarded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the snapshot go unless they are protected."""
    part = load(spark, sf_dir, "part")
    snapshot = load(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return rel.guarded_delete(part.select("p_partkey"), snapshot, part.filter("p_size > 45"), ["p_partkey"])


@_R.query("""
SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS transitions, string_agg(o_orderstatus, '>' ORDER BY o_orderdate, o_orderkey) AS log FROM orders GROUP BY 1
""")
def ordered_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State from the log of transitions."""
    at = F.struct("o_orderdate", "o_orderkey")
    log = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", at).alias("status"), F.count("*").alias("transitions"), F.array_join(log, ">").alias("log"))


@_R.query("""
SELECT l_suppkey AS org, min(l_shipdate) AS effective_at, 'new_subscription' AS event_type FROM lineitem WHERE l_suppkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
""")
def history_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each subscription without history."""
    known = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("org"))
    subs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("org")).agg(F.min("l_shipdate").alias("effective_at"))
    return subs.join(known, "org", "left_anti").withColumn("event_type", F.lit("new_subscription"))


@_R.query("""
WITH e AS (SELECT c_custkey AS id, c_custkey % 4 AS seen FROM customer), s AS (SELECT c_custkey AS id, c_custkey % 3 AS version FROM customer) SELECT e.id, seen, version FROM e JOIN s USING (id) WHERE seen <> version
""")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits whose version is not the stored one."""
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    edits, stored = rows.withColumn("seen", F.col("id") % 4), rows.withColumn("version", F.col("id") % 3)
    return edits.join(stored, "id").filter("seen <> version")


@_R.query("""
WITH f AS (SELECT o_orderkey, o_custkey, unnest([l1, l2]) AS target FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS l1, o_orderkey % 5 AS l2 FROM orders)) SELECT DISTINCT o_custkey, target FROM f
""")
def lead_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lead for each selected target, repeats skipped."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.explode(F.array(F.col("o_orderkey") % 7, F.col("o_orderkey") % 5)).alias("target"))
    return rows.distinct()


@_R.query("""
WITH n AS (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS slug, row_number() OVER (PARTITION BY regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') ORDER BY lower(p_name), p_partkey) AS n FROM part)
SELECT p_partkey, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM n
""")
def slug_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated slugs numbered by name."""
    from tessera.functions.text import slugify

    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", slugify(F.col("p_brand")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy(F.lower("p_name"), "p_partkey"))
    rows = rows.withColumn("n", n)
    return rows.select("p_partkey", F.when(F.col("n") > 1, F.concat("slug", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("slug")).alias("slug"))


@_R.query("""
SELECT o_custkey, attribute, arg_min(o_orderkey, (precedence, o_orderkey)) AS winner, count(*) - 1 AS virtual_ FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS attribute, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS precedence FROM orders) GROUP BY 1, 2
""")
def precedence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first decision of each attribute; the others become virtual."""
    rows = load(spark, sf_dir, "orders").withColumn("precedence", F.expr("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"))
    return rows.groupBy("o_custkey", F.col("o_orderpriority").alias("attribute")).agg(F.min_by("o_orderkey", F.struct("precedence", "o_orderkey")).alias("winner"), (F.count("*") - 1).alias("virtual_"))


@_R.query("""
SELECT conv_id, array_to_string((list(length(text) ORDER BY turn))[-3:], ',') AS last_three, CASE WHEN count(*) FILTER (role = 'system') = 1 THEN 'one' ELSE 'reject' END AS guard, (list(role ORDER BY turn))[-1] AS last_role FROM conversations GROUP BY 1
""")
def array_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists by key, bounded to their newest, exactly-one guards."""
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"), "role"))).alias("t"), F.count_if(F.col("role") == "system").alias("systems"))
    newest = F.slice("t", F.greatest(F.size("t") - 2, F.lit(1)), 3)
    return rows.select("conv_id", F.array_join(F.transform(newest, lambda x: x["n"].cast("string")), ",").alias("last_three"), F.when(F.col("systems") == 1, "one").otherwise("reject").alias("guard"), F.element_at("t", -1)["role"].alias("last_role"))


# ---- validation: every query returns its violations ----


@_R.query("""
SELECT 'unknown_customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'unknown_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'order_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def violations_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere."""
    t = lambda n: load(spark, sf_dir, n)

    def lost(rule, left, lk, right, rk):
        return t(left).join(t(right), F.col(lk) == F.col(rk), "left_anti").agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))

    labels, docs = t("labels").select("doc_id"), t("documents").select("doc_id")
    last = labels.join(docs, "doc_id", "left_anti").agg(F.lit("label_without_document").alias("rule"), F.count("*").alias("n"))
    return (
        lost("unknown_customer", "orders", "o_custkey", "customer", "c_custkey")
        .unionByName(lost("unknown_part", "lineitem", "l_partkey", "part", "p_partkey"))
        .unionByName(lost("order_without_lines", "orders", "o_orderkey", "lineitem", "l_orderkey"))
        .unionByName(last)
    )


@_R.query("""
SELECT 'duplicate_order' AS rule, count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'two_running', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_doc', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
""")
def violations_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, A10: keys that occur more than once, some only under a condition."""

    def twice(rule, df, key):
        return df.groupBy(key).count().filter("count > 1").agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))

    orders = load(spark, sf_dir, "orders")
    return (
        twice("duplicate_order", orders, "o_orderkey").unionByName(twice("two_running", orders.filter("o_orderstatus = 'P'"), "o_custkey"))
        .unionByName(twice("duplicate_doc", load(spark, sf_dir, "documents"), "doc_id"))
    )


_CHECKS = {
    "negative_price": "l_extendedprice < 0",
    "discount_range": "NOT l_discount BETWEEN 0 AND 0.1",
    "quantity_range": "NOT l_quantity BETWEEN 1 AND 50",
    "tax_missing": "l_tax IS NULL",
    "large_line": "l_extendedprice > 90000",
}


@_R.query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS n FROM lineitem" for k, v in _CHECKS.items()))
def violations_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row checks, all counted in one pass."""
    counts = load(spark, sf_dir, "lineitem").agg(*[F.count_if(F.expr(v)).alias(k) for k, v in _CHECKS.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, _CHECKS)), F.array(*_CHECKS))).alias("rule", "n"))


@_R.query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars <> length(text) THEN 'n_chars' END, CASE WHEN length(text) = 0 THEN 'empty' END, CASE WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'lang' END, CASE WHEN length(text) > 15000 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS codes FROM documents
WHERE n_chars <> length(text) OR length(text) = 0 OR lang NOT IN ('en', 'de', 'fr', 'es') OR length(text) > 15000
""")
def violations_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: invariants of documents, as codes."""
    codes = F.array_compact(F.array(
        F.when(F.col("n_chars") != F.length("text"), "n_chars"), F.when(F.length("text") == 0, "empty"), F.when(~F.col("lang").isin("en", "de", "fr", "es"), "lang"), F.when(F.length("text") > 15_000, "long")
    ))
    return load(spark, sf_dir, "documents").select("doc_id", codes.alias("c")).filter(F.size("c") > 0).select("doc_id", F.array_join("c", ",").alias("codes"))


@_R.query("SELECT r_name AS brand, n_name AS field, 'pending' AS status FROM region, nation")
def template_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank row for each brand and field: two small lists, the second of a fixed size."""
    fields = load(spark, sf_dir, "nation").select(F.col("n_name").alias("field"))
    return load(spark, sf_dir, "region").select(F.col("r_name").alias("brand")).crossJoin(F.broadcast(fields)).withColumn("status", F.lit("pending"))


@_R.query("""
WITH r AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS pos FROM conversations),
 a AS (SELECT * FROM r WHERE role = 'user'), b AS (SELECT * FROM r WHERE role = 'assistant')
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos, a.n AS asked, b.n AS answered, a.n IS NOT NULL AND b.n IS NOT NULL AS paired FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos
""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers side by side by position; ``paired`` is false where a list is shorter than the other."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn", "text")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "role", F.length("text").cast("bigint").alias("n"), F.row_number().over(w).cast("bigint").alias("pos"))
    a = rows.filter("role = 'user'").select("conv_id", "pos", F.col("n").alias("asked"))
    b = rows.filter("role = 'assistant'").select("conv_id", "pos", F.col("n").alias("answered"))
    return a.join(b, ["conv_id", "pos"], "full").withColumn("paired", F.col("asked").isNotNull() & F.col("answered").isNotNull())


@_R.query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) SELECT o_orderkey, CASE WHEN prev IS NULL THEN 'new' WHEN abs(o_totalprice - prev) < 5000 THEN 'carried' ELSE 'changed' END AS decision FROM v
""")
def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions carried over where the proposal hardly changed."""
    prev = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = load(spark, sf_dir, "orders").withColumn("prev", prev)
    decision = F.when(F.col("prev").isNull(), "new").when(F.abs(F.col("o_totalprice") - F.col("prev")) < 5000, "carried").otherwise("changed")
    return rows.select("o_orderkey", decision.alias("decision"))
