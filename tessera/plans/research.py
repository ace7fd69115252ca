"""Stages of the research flow as plans: planning, search, extraction, decisions, resolution, review, release and benchmarks.

``part`` rows are questions and fields, ``pages`` found sources, ``documents`` fetched ones, ``lineitem`` rows claims
(order the task, line the field, supplier the source, return flag the verdict), ``orders`` rows results of runs.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fields, web
from tessera.functions.evidence import pages_that_fit
from tessera.operators.rebasing import nearest_start
from tessera.plans import evidence
from tessera.plans.registry import Registry
from tessera.sources.scratch import written
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


# ---- plan ----


@_R.query("""
WITH q AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size <= 15 THEN 1 WHEN p_size <= 35 THEN 2 ELSE 3 END AS depth, CASE p_type WHEN 'PROMO' THEN 3 WHEN 'LARGE' THEN 2 ELSE 1 END AS rank, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AS known FROM part),
 t AS (SELECT requested, p_brand AS task, max(rank) AS priority, count(*) AS questions, count(*) FILTER (known) AS verify, list_sort(list(p_partkey) FILTER (NOT known)) AS collect_, list_sort(list(p_partkey)) AS all_ FROM q, (SELECT unnest([1, 2, 3]) AS requested) WHERE depth <= requested GROUP BY 1, 2)
SELECT requested, task, CASE priority WHEN 3 THEN 'critical' WHEN 2 THEN 'high' ELSE 'normal' END AS priority, questions, verify, md5(array_to_string(coalesce(collect_, []), ',')) AS collect_fields, lag(task) OVER (PARTITION BY requested ORDER BY all_[1]) AS depends_on FROM t
""")
def plan_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: tasks of each requested depth from the questions that apply, their highest priority, and what to collect and what to verify."""
    known = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("known")).distinct()
    depth = F.when(F.col("p_size") <= 15, 1).when(F.col("p_size") <= 35, 2).otherwise(3)
    rank = F.when(F.col("p_type") == "PROMO", 3).when(F.col("p_type") == "LARGE", 2).otherwise(1)
    rows = load(spark, sf_dir, "part").join(known, "p_partkey", "left")
    rows = rows.select(F.explode(F.sequence(depth, F.lit(3))).alias("requested"), F.col("p_brand").alias("task"), "p_partkey", "known", rank.alias("rank"))
    new = F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("p_partkey"))))
    tasks = rows.groupBy("requested", "task").agg(F.max("rank").alias("rank"), F.count("*").alias("questions"), F.count_if(F.col("known")).alias("verify"), new.alias("new"), F.min("p_partkey").alias("first"))
    before = F.lag("task").over(Window.partitionBy("requested").orderBy("first"))
    return tasks.select(
        "requested",
        "task",
        F.when(F.col("rank") == 3, "critical").when(F.col("rank") == 2, "high").otherwise("normal").alias("priority"),
        "questions",
        "verify",
        F.md5(F.array_join(F.col("new").cast("array<string>"), ",").cast("binary")).alias("collect_fields"),
        before.alias("depends_on"),
    )


@_R.query("""
SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS site, 12 AS seeds, 6 AS secure FROM pages GROUP BY 1
""")
def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: six paths of each site, with and without www., and as found, canonical and each once."""
    site = F.regexp_replace(web.host(F.col("url")), r"^www\.", "")
    rows = load(spark, sf_dir, "pages").select(site.alias("site")).distinct().withColumnRenamed("site", "s")
    rows = rows.select(F.col("s").alias("site"), F.explode(F.array("s", F.concat(F.lit("www."), "s"), F.concat(F.col("s"), F.lit(":443")))).alias("h"))
    path = F.explode(F.array(*map(F.lit, ("/", "/franchise", "/offer?utm_source=seed", "/contact#top", "/about", "/documents")))).alias("path")
    rows = rows.select("site", path, "h").select("site", web.canonical_url(F.concat(F.lit("HTTPS://"), "h", "path")).alias("url")).distinct()
    return rows.groupBy("site").agg(F.count("*").cast("int").alias("seeds"), F.count_if(~F.col("url").contains("//www.")).cast("int").alias("secure"))


#: Tasks of the router and their words.
_TASKS = {"cold": "cold widget ring plate", "hot": "hot widget rod gear", "promo": "promo plate gizmo widget", "old": "old bolt ring rod"}
_TASK_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in _TASKS.items())


@_R.query(f"""
WITH t AS (SELECT task, unnest(string_split(words, ' ')) AS term FROM (VALUES {_TASK_ROWS}) v(task, words)), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
 c AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS term FROM part),
 s AS (SELECT p_partkey, task, sum(CASE WHEN df = 1 THEN 4 WHEN df < 4 THEN 1 ELSE 0 END) AS score, count(*) AS terms FROM c JOIN t USING (term) JOIN df USING (term) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, task) AS place, coalesce(lead(score) OVER (PARTITION BY p_partkey ORDER BY score DESC, task), 0) AS next_ FROM s)
SELECT p_partkey, score::BIGINT AS score, CASE WHEN score >= 5 AND terms >= 2 AND score - next_ >= 4 THEN task END AS task,
 CASE WHEN score >= 5 AND terms >= 2 AND score - next_ >= 4 THEN 'unique_lexical_match' WHEN score > 0 AND score - next_ < 4 THEN 'ambiguous_scope' ELSE 'insufficient_lexical_evidence' END AS reason FROM r WHERE place = 1
""")
def candidate_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates go to the task whose rare words they share, if it leads the next one clearly."""
    tasks = spark.createDataFrame(list(_TASKS.items()), "task string, words string").select("task", F.explode(F.split("words", " ")).alias("term"))
    weights = tasks.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.when(F.col("df") == 1, 4).when(F.col("df") < len(_TASKS), 1).otherwise(0)
    # A few tasks of a few words: bounded by the plan, not by the candidates.
    terms = F.broadcast(tasks.join(weights, "term").select("task", "term", weight.alias("weight")))
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    hits = load(spark, sf_dir, "part").select("p_partkey", F.explode(words).alias("term")).join(terms, "term")
    scores = hits.groupBy("p_partkey", "task").agg(F.sum("weight").alias("score"), F.count("*").alias("terms"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "task", "score", "terms")))
    best = scores.groupBy("p_partkey").agg(ranked.alias("r")).select("p_partkey", F.col("r")[0].alias("b"), F.coalesce(F.get("r", F.lit(1))["score"], F.lit(0)).alias("next_"))
    lead = F.col("b.score") - F.col("next_")
    clear = (F.col("b.score") >= 5) & (F.col("b.terms") >= 2) & (lead >= 4)
    reason = F.when(clear, "unique_lexical_match").when((F.col("b.score") > 0) & (lead < 4), "ambiguous_scope").otherwise("insufficient_lexical_evidence")
    return best.select("p_partkey", F.col("b.score").alias("score"), F.when(clear, F.col("b.task")).alias("task"), reason.alias("reason"))


@_R.query("""
WITH p AS (SELECT regexp_extract(html, 'lang="([a-z]*)"', 1) AS task, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, url LIKE 'https%' AS secure, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS page FROM pages),
 t AS (SELECT task, count(DISTINCT page) AS sources, count(DISTINCT array_to_string(string_split(regexp_replace(host, '^www\\.', ''), '.')[-2:], '.')) AS domains, bool_or(secure) AS preferred FROM p GROUP BY 1)
SELECT task, sources, domains, list_filter([CASE WHEN sources < 20 THEN 'source_candidates:' || sources END, CASE WHEN NOT preferred THEN 'preferred_source_type_missing' END, CASE WHEN domains < 4 THEN 'independent_candidate_domains:' || domains END], lambda x: x IS NOT NULL) AS gaps,
 CASE WHEN sources = 0 THEN 'not_found' WHEN sources < 20 OR NOT preferred OR domains < 4 THEN 'partial' ELSE 'complete' END AS status FROM t
""")
def search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each task by canonical page, independent domains, and the gaps that remain."""
    page = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    rows = load(spark, sf_dir, "pages").select(F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("task"), page.alias("page"), web.registrable(web.host(F.col("url"))).alias("domain"), F.col("url").startswith("https").alias("secure"))
    t = rows.groupBy("task").agg(F.countDistinct("page").alias("sources"), F.countDistinct("domain").alias("domains"), F.bool_or("secure").alias("preferred"))
    gaps = F.array_compact(F.array(
        F.when(F.col("sources") < 20, F.concat(F.lit("source_candidates:"), F.col("sources").cast("string"))),
        F.when(~F.col("preferred"), "preferred_source_type_missing"),
        F.when(F.col("domains") < 4, F.concat(F.lit("independent_candidate_domains:"), F.col("domains").cast("string"))),
    ))
    t = t.select("task", "sources", "domains", gaps.alias("gaps"))
    return t.withColumn("status", F.when(F.col("sources") == 0, "not_found").when(F.size("gaps") > 0, "partial").otherwise("complete"))


# ---- sources ----

_WEIGHT = "CASE l_returnflag WHEN 'A' THEN 100 WHEN 'R' THEN 65 ELSE 25 END + CASE WHEN l_linestatus = 'O' THEN 70 ELSE 0 END + CASE WHEN l_discount >= 0.05 THEN 10 ELSE 0 END - CASE WHEN l_tax >= 0.06 THEN 20 ELSE 0 END"


@_R.query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, {_WEIGHT} + 2 * least(5, (SELECT count(DISTINCT x.l_returnflag) FROM lineitem x WHERE x.l_suppkey = l.l_suppkey)) AS score FROM lineitem l)
SELECT l_orderkey, l_linenumber, score::INT AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_suppkey) AS rank FROM s QUALIFY rank <= 3
""")
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sources of a task by evidence weight, seeds and breadth first, ties by order of input."""
    lines = load(spark, sf_dir, "lineitem")
    breadth = lines.groupBy("l_suppkey").agg(F.least(F.lit(5), F.countDistinct("l_returnflag")).alias("tasks"))
    score = (F.expr(_WEIGHT) + 2 * F.col("tasks")).cast("int")
    rows = lines.join(breadth, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", score.alias("score"))
    w = Window.partitionBy("l_orderkey").orderBy(F.col("score").desc(), "l_linenumber", "l_suppkey")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 3").drop("l_suppkey")


@_R.query("""
WITH p AS (SELECT page_id, url, regexp_extract(html, 'lang="([a-z]*)"', 1) AS role, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT role, arg_min(page_id, (contains(host, 'blog'), path NOT IN ('', '/'), length(url), page_id)) AS official, arg_min(page_id, (NOT contains(path, '/1'), length(path) - length(replace(path, '/', '')), length(url), page_id)) FILTER (contains(host, 'blog') OR contains(path, '/1')) AS offer FROM p GROUP BY 1
""")
def url_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One URL for each role: the plainest home page, and the shallowest page whose host or path has the role's word."""
    host, path = web.host(F.col("url")), web.part(F.col("url"), 5)
    home = F.struct(host.contains("blog"), ~path.isin("", "/"), F.length("url"), "page_id")
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    offer = F.struct(~path.contains("/1"), depth, F.length("url"), "page_id")
    meant = host.contains("blog") | path.contains("/1")
    rows = load(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("role"))
    return rows.agg(F.min_by("page_id", home).alias("official"), F.min_by(F.when(meant, F.col("page_id")), F.when(meant, offer)).alias("offer"))


@_R.query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS route FROM orders
""")
def route_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-ups in order: required first, then automated before derived before human ones."""
    required = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1)
    way = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    route = F.row_number().over(Window.partitionBy("o_custkey").orderBy(required, way, "o_orderkey")).cast("bigint")
    return load(spark, sf_dir, "orders").select("o_orderkey", route.alias("route"))


@_R.query("""
SELECT o_custkey, coalesce(arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F'), arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_totalprice > 200000)) AS source FROM orders GROUP BY 1
""")
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known source, else the first evidence."""
    at = F.struct("o_orderdate", "o_orderkey")
    first = lambda test: F.min_by("o_orderkey", F.when(F.expr(test), at))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(first("o_orderstatus = 'F'"), first("o_totalprice > 200000")).alias("source"))


@_R.query("""
WITH p AS (SELECT doc_id, text, generate_series(1, length(text) - 3) AS at_ FROM documents WHERE contains(text, ' de '))
SELECT doc_id, list_sort(list_transform(list_filter(at_, lambda i: text[i:i+3] = ' de '), lambda i: [abs(i - 1 - length(text) // 2), i - 1]))[1][2] AS start_ FROM p
""")
def nearest_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a quote's occurrences, the one nearest to where it stood (here the middle of the text).

    The one after the place and the one before it are searched, no others, so time grows with the text alone."""
    quote, middle = " de ", F.floor(F.length("text") / 2).cast("int")
    rows = load(spark, sf_dir, "documents").filter(F.col("text").contains(quote))
    return rows.select("doc_id", nearest_start(F.col("text"), F.lit(quote), middle).cast("bigint").alias("start_"))


_PAGES = """
WITH RECURSIVE g AS (SELECT doc_id, i AS page, regexp_replace(array_to_string(l[i * 10 + 1:i * 10 + 10], chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range((len(l) + 9) // 10)) AS i)),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, len(list_intersect(regexp_extract_all(replace(replace(strip_accents(lower(t)), 'ł', 'l'), 'ß', 'ss'), '[\\p{L}\\p{N}]+'), ['the', 'der', 'les', 'que'])) AS points FROM g WHERE t <> ''),
 e AS (SELECT doc_id, round_even(k * (n - 1) / greatest(least(n, 20) - 1, 1), 0)::BIGINT AS i FROM (SELECT DISTINCT doc_id, n FROM f), range(20) t(k) WHERE k < least(n, 20)),
 o AS MATERIALIZED (SELECT doc_id, page, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN points > 0 THEN 0 WHEN i = 0 THEN 1 WHEN (doc_id, i) IN (SELECT doc_id, i FROM e) THEN 2 ELSE 3 END, CASE WHEN points > 0 THEN -points ELSE 0 END, page) AS k FROM f),
 w AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS kept, 0::BIGINT AS used, false AS cut FROM documents
  UNION ALL SELECT doc_id, k, CASE WHEN takes THEN list_append(kept, page + 1) ELSE kept END, CASE WHEN takes THEN 3000 - room + length(piece) ELSE used END, cut OR takes AND length(t) > room FROM (
   SELECT *, room >= 10 AND used < 3000 AS takes, CASE WHEN length(t) <= room THEN t ELSE regexp_replace(substr(t, 1, room), '\\s+$', '') END AS piece FROM (
    SELECT o.doc_id, o.k, o.page, o.t, w.kept, w.used, w.cut, 3000 - used - length('[PDF page ' || (page + 1) || ']' || chr(10)) - CASE WHEN len(kept) > 0 THEN 3 ELSE 0 END AS room FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)))
SELECT doc_id, array_to_string(list_sort(kept), ',') AS pages, used::INTEGER AS chars, cut OR len(kept) < k AS truncated FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1
"""


@_R.query(_PAGES)
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document (its lines in tens) under 3,000 characters: relevant ones, the first, an even sample, the rest."""
    lines = F.split("text", "\n")
    groups = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(10))
    pages = F.transform(groups, lambda i: F.array_join(F.slice(lines, i + 1, 10), "\n"))
    # A generator keeps the pages from being cut out of the text again for each of their uses.
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.coalesce(pages, F.array().cast("array<string>")))).alias("pages"))
    picked = rows.select("doc_id", pages_that_fit(F.col("pages"), ["the", "der", "les", "que"], 3000).alias("p"))
    return picked.select("doc_id", F.array_join(F.col("p.pages").cast("array<string>"), ",").alias("pages"), "p.chars", "p.truncated")


# ---- extraction ----


@_R.query(f"""
WITH sel AS (SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10), s AS ({evidence._SCORED}),
 top AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 3) GROUP BY 1),
 q AS (SELECT d.doc_id, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1)
SELECT source, count(*) AS selected, count(l.doc_id) AS cached, coalesce(sum(top.n), 0)::BIGINT AS passages, coalesce(sum(q.n), 0)::BIGINT AS claims,
 CASE WHEN coalesce(sum(q.n), 0) > 0 THEN 'claims_found' WHEN coalesce(sum(top.n), 0) > 0 THEN 'no_claims' ELSE 'no_passages' END AS status
FROM sel LEFT JOIN labels l USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN q USING (doc_id) GROUP BY 1
""")
def extraction_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's sources selected, looked up in the cache, read as passages, and their grounded claims counted."""
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    chosen = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").withColumn("place", F.row_number().over(w)).filter("place <= 10")
    chosen = written(chosen, "chosen")
    hits = load(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit"))
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "pos")
    top = evidence.passage_scores(spark, sf_dir).join(chosen.select("doc_id"), "doc_id", "left_semi").withColumn("place", F.row_number().over(best)).filter("place <= 3").groupBy("doc_id").agg(F.count("*").alias("passages"))
    texts = load(spark, sf_dir, "documents").join(chosen.select("doc_id"), "doc_id", "left_semi")
    claims = evidence.grounded_quotes(texts, load(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.count("*").alias("claims"))
    rows = chosen.join(hits, "doc_id", "left").join(top, "doc_id", "left").join(claims, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    tasks = rows.groupBy("source").agg(F.count("*").alias("selected"), F.count("hit").alias("cached"), total("passages"), total("claims"))
    return tasks.withColumn("status", F.when(F.col("claims") > 0, "claims_found").when(F.col("passages") > 0, "no_claims").otherwise("no_passages"))


# ---- decisions ----


@_R.query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_discount, count(*) OVER (PARTITION BY l_partkey, l_quantity) AS same, p_name, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
 x AS (SELECT DISTINCT a.l_partkey FROM lineitem a JOIN (SELECT l_partkey, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) m USING (l_partkey) WHERE m.lo = 0 AND m.hi >= 0.08)
SELECT l_orderkey, l_linenumber, CASE WHEN p_type = 'SMALL' THEN 'rejected' WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_partkey IN (SELECT l_partkey FROM x) THEN 'needs_review' WHEN l_returnflag = 'A' AND l_discount < 0.01 THEN 'needs_review' WHEN l_returnflag = 'N' AND same >= 2 THEN 'accepted' WHEN l_returnflag = 'A' THEN 'accepted' ELSE 'needs_review' END AS decision,
 CASE WHEN p_type = 'SMALL' THEN 'unit_format' WHEN l_returnflag = 'R' THEN 'rejected_by_model' WHEN l_partkey IN (SELECT l_partkey FROM x) THEN 'contradicted' WHEN l_returnflag = 'A' AND l_discount < 0.01 THEN 'no_quantity' WHEN l_returnflag = 'N' AND same >= 2 THEN 'corroborated' WHEN l_returnflag = 'A' THEN 'supported' ELSE 'not_corroborated' END AS reason FROM c
""")
def decision_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claims' verdicts grounded by an ordered chain: contracts of fields, contradictions, missing quantities, corroboration."""
    lines = load(spark, sf_dir, "lineitem")
    same = lines.groupBy("l_partkey", "l_quantity").agg(F.count("*").alias("same"))
    spread = lines.filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))
    against = spread.filter("lo = 0 AND hi >= 0.08").select("l_partkey", F.lit(True).alias("contradicted"))
    fields = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = lines.join(same, ["l_partkey", "l_quantity"]).join(against, "l_partkey", "left").join(fields, "l_partkey")
    flag = F.col("l_returnflag")
    chain = [
        (F.col("p_type") == "SMALL", "rejected", "unit_format"),
        (flag == "R", "rejected", "rejected_by_model"),
        (F.col("contradicted"), "needs_review", "contradicted"),
        ((flag == "A") & (F.col("l_discount") < 0.01), "needs_review", "no_quantity"),
        ((flag == "N") & (F.col("same") >= 2), "accepted", "corroborated"),
        (flag == "A", "accepted", "supported"),
    ]

    def chained(which: int, last: str) -> Column:
        out = F.when(F.lit(False), "")
        for case in chain:
            out = out.when(case[0], case[which])
        return out.otherwise(last)

    return rows.select("l_orderkey", "l_linenumber", chained(1, "needs_review").alias("decision"), chained(2, "not_corroborated").alias("reason"))


_ACTION = "CASE WHEN accepted >= 2 THEN 'none' WHEN rejected > 0 AND accepted = 0 THEN 'search' WHEN pending > 0 THEN 'recheck' WHEN accepted = 1 THEN 'corroborate' ELSE 'human' END"


@_R.query(f"""
WITH t AS (SELECT l_orderkey AS task, l_returnflag, count(DISTINCT l_suppkey) AS sources, count(*) AS n FROM lineitem GROUP BY 1, 2),
 s AS (SELECT task, sum(n) FILTER (l_returnflag = 'A') AS a, sum(n) FILTER (l_returnflag = 'R') AS r, sum(n) FILTER (l_returnflag = 'N') AS p FROM t GROUP BY 1),
 d AS (SELECT l_orderkey AS task, count(DISTINCT l_suppkey) AS sources FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), f AS (SELECT task, coalesce(a, 0) AS accepted, coalesce(r, 0) AS rejected, coalesce(p, 0) AS pending, coalesce(d.sources, 0) AS sources FROM s LEFT JOIN d USING (task))
SELECT task, CASE WHEN accepted > 0 AND rejected + pending = 0 THEN 'complete' WHEN accepted > 0 THEN 'partial' WHEN pending > 0 THEN 'pending' ELSE 'unresolved' END AS status, {_ACTION} AS action, greatest(0, 2 - sources) AS source_deficit FROM f
""")
def task_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each task over its fields, the follow-up that it needs, and how many sources it lacks."""
    flag = F.col("l_returnflag")
    f = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(
        F.count_if(flag == "A").alias("accepted"), F.count_if(flag == "R").alias("rejected"), F.count_if(flag == "N").alias("pending"), F.countDistinct(F.when(flag == "A", F.col("l_suppkey"))).alias("sources")
    )
    status = F.when((F.col("accepted") > 0) & (F.col("rejected") + F.col("pending") == 0), "complete").when(F.col("accepted") > 0, "partial").when(F.col("pending") > 0, "pending").otherwise("unresolved")
    return f.select("task", status.alias("status"), F.expr(_ACTION).alias("action"), F.greatest(F.lit(0), 2 - F.col("sources")).alias("source_deficit"))


@_R.query("""
WITH i AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS seq FROM lineitem),
 g AS (SELECT l_suppkey, l_partkey, min(seq) AS first_ FROM i GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first_) AS place FROM g),
 k AS (SELECT i.* FROM i JOIN a USING (l_suppkey, l_partkey) WHERE place <= 12)
SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'extract' WHEN 'R' THEN 'search' ELSE 'check' END AS action, count(*) AS items, md5(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)) AS ids FROM k GROUP BY 1, 2
""")
def resolution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in sequence take ids until a supplier's cap of twelve; an id taken before is free. One batch an action.

    An item is granted just if its id is among the first twelve distinct ids, so the greedy walk is a rank, not a loop."""
    lines = load(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
    # Ids that are first asked for by lines of one number are taken in their own order, on every run.
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("first", "l_partkey"))
    granted = first.withColumn("place", place).filter("place <= 12").select("l_suppkey", "l_partkey")
    action = F.when(F.col("l_returnflag") == "A", "extract").when(F.col("l_returnflag") == "R", "search").otherwise("check")
    rows = lines.join(granted, ["l_suppkey", "l_partkey"]).groupBy("l_suppkey", action.alias("action"))
    ids = F.array_join(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return rows.agg(F.count("*").alias("items"), F.md5(ids.cast("binary")).alias("ids"))


@_R.query("""
SELECT l_orderkey, l_linenumber, CASE p_type WHEN 'PROMO' THEN 3 WHEN 'LARGE' THEN 2 END AS min_sources FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_brand = 'Brand#7'
""")
def policy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: a field's policy, only where it is of exactly this release."""
    policy = F.when(F.col("p_type") == "PROMO", 3).when(F.col("p_type") == "LARGE", 2)
    policies = load(spark, sf_dir, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("l_partkey"), policy.alias("min_sources"))
    return load(spark, sf_dir, "lineitem").join(policies, "l_partkey", "left").select("l_orderkey", "l_linenumber", "min_sources")


# ---- review and release ----


@_R.query("""
WITH k AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), l AS (SELECT o_custkey, o_orderpriority, o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1, 2, 3),
 p AS (SELECT o_custkey, o_orderpriority, max(v) FILTER (o_orderstatus = 'F') AS f, max(v) FILTER (o_orderstatus = 'O') AS o, max(v) FILTER (o_orderstatus = 'P') AS p FROM l GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, coalesce(f, o, p) AS proposal, CASE WHEN f IS NOT NULL THEN 'normalizer' WHEN o IS NOT NULL THEN 'checker' ELSE 'editorial' END AS origin, f IS NOT NULL AND o IS NOT NULL AND o > f AS superseded FROM k JOIN p USING (o_custkey, o_orderpriority)
""")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each task and field of the plan, its proposal from the best stage that has one, by a join on both keys."""
    orders, key = load(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]

    def stage(status: str, name: str) -> DataFrame:
        newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
        return orders.filter(F.col("o_orderstatus") == status).groupBy(*key).agg(newest.alias(name))

    rows = orders.select(*key).distinct()
    for status, name in (("F", "normalizer"), ("O", "checker"), ("P", "editorial")):
        rows = rows.join(stage(status, name), key, "left")
    origin = F.when(F.col("normalizer").isNotNull(), "normalizer").when(F.col("checker").isNotNull(), "checker").otherwise("editorial")
    late = F.coalesce(F.col("checker") > F.col("normalizer"), F.lit(False))
    return rows.select(*key, F.coalesce("normalizer", "checker", "editorial").alias("proposal"), origin.alias("origin"), late.alias("superseded"))


@_R.query("""
WITH w AS (SELECT o_custkey, o_orderstatus AS plan_run, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS evaluated, o_orderdate AS created FROM orders)
SELECT o_custkey, plan_run, o_orderkey FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey, plan_run ORDER BY evaluated DESC NULLS LAST, created DESC, o_orderkey DESC) = 1
""")
def effective_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the workspaces of one plan run, the one evaluated last, else created last."""
    evaluated = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    order = F.struct(evaluated.isNotNull(), evaluated, "o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("plan_run")).agg(F.max_by("o_orderkey", order).alias("o_orderkey"))


_GOLD = """
 (SELECT p_partkey, p_type, round(p_retailprice, 0) AS gold, p_size <= 25 AS public_, m.n, m.price FROM part LEFT JOIN
  (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS n, round(arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)), 0) AS price FROM lineitem GROUP BY 1) m ON l_partkey = p_partkey)"""
_STATE = "CASE WHEN NOT public_ THEN 'not_public' WHEN price IS NULL THEN 'pending' WHEN n = 0 THEN 'ready' WHEN price = gold THEN 'found' ELSE 'conflict' END"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    mine = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n"), F.round(F.min_by(F.col("l_extendedprice") / F.col("l_quantity"), at), 0).alias("price"))
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_type", F.round("p_retailprice", 0).alias("gold"), (F.col("p_size") <= 25).alias("public_"))
    return rows.join(mine, "p_partkey", "left").withColumn("state", F.expr(_STATE))


@_R.query(f"SELECT p_type, {_STATE} AS state, count(*) AS n FROM {_GOLD} GROUP BY 1, 2")
def promotion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference values of each kind by what promoting them would meet."""
    return _gold(spark, sf_dir).groupBy("p_type", "state").agg(F.count("*").alias("n"))


@_R.query(f"SELECT p_partkey, {_STATE} AS state, CASE {_STATE} WHEN 'ready' THEN [gold] WHEN 'conflict' THEN [price, gold] WHEN 'found' THEN [price] ELSE [] END AS proposals, {_STATE} = 'conflict' AS compare_ FROM {_GOLD}")
def gold_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference values staged: as the proposal where there is none, beside it for comparison where they differ."""
    own = F.when(F.col("state").isin("conflict", "found"), F.array("price")).otherwise(F.array().cast("array<double>"))
    proposals = F.when(F.col("state").isin("ready", "conflict"), F.array_append(own, F.col("gold"))).otherwise(own)
    return _gold(spark, sf_dir).select("p_partkey", "state", proposals.alias("proposals"), (F.col("state") == "conflict").alias("compare_"))


@_R.query("""
WITH grid AS (SELECT c_custkey, f FROM customer, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS f)), o AS (SELECT o_custkey, o_orderpriority, max(o_orderdate)::DATE AS as_of, count(*) AS n, bool_or(o_orderstatus = 'F') AS accepted FROM orders GROUP BY 1, 2)
SELECT c_custkey, f AS field, CASE WHEN n IS NULL THEN 'pending' WHEN accepted THEN 'found' ELSE 'not_public' END AS status, CASE WHEN accepted THEN as_of END AS valid_as_of FROM grid LEFT JOIN o ON o_custkey = c_custkey AND o_orderpriority = f
""")
def benchmark_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission row for every brand and field of the grid, whatever the campaign found."""
    fields = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    grid = load(spark, sf_dir, "customer").select("c_custkey", F.explode(fields).alias("field"))
    found = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("field")).agg(F.to_date(F.max("o_orderdate")).alias("as_of"), F.bool_or(F.col("o_orderstatus") == "F").alias("accepted"))
    status = F.when(F.col("accepted").isNull(), "pending").when(F.col("accepted"), "found").otherwise("not_public")
    return grid.join(found, ["c_custkey", "field"], "left").select("c_custkey", "field", status.alias("status"), F.when(F.col("accepted"), F.col("as_of")).alias("valid_as_of"))


@_R.query("SELECT o_custkey, max(o_orderdate)::DATE AS valid_as_of FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW')")
def latest_valid_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date that claims' texts name; what only looks like a date does not count."""
    text = F.concat(F.lit("As of "), F.when(F.col("o_orderpriority") == "5-LOW", "2024-02-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(" (was 1990-01-01, 1990-13-01)."))
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda d: d.try_cast("date"))
    newest = F.max(F.when(F.col("o_orderpriority") != "5-LOW", F.array_max(named)))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest.alias("valid_as_of"))


@_R.query("SELECT o_custkey, count(DISTINCT (o_orderpriority, o_orderstatus)) AS planned, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN (o_orderpriority, o_orderstatus) END) AS evaluated, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS populated FROM orders GROUP BY 1")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tasks and fields that were planned, evaluated and populated."""
    key, status = F.struct("o_orderpriority", "o_orderstatus"), F.col("o_orderstatus")
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.countDistinct(key).alias("planned"), F.countDistinct(F.when(status != "P", key)).alias("evaluated"), F.countDistinct(F.when(status == "F", F.col("o_orderpriority"))).alias("populated")
    )


@_R.query("SELECT conv_id, round(sum(length(text)) * 0.000002, 8) AS cost, sum(turn * 1.5) AS minutes, count(*) FILTER (role = 'assistant') AS jobs FROM conversations GROUP BY 1")
def continuation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and minutes of the jobs that went on from a plan run, out of their JSON results."""
    result = F.to_json(F.struct((F.length("text") * 2).alias("micros"), (F.col("turn") * F.lit(1.5)).alias("minutes")))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "role", F.from_json(result, "micros bigint, minutes double").alias("r"))
    cost = F.round(F.sum("r.micros") / 1_000_000, 8)
    return rows.groupBy("conv_id").agg(cost.alias("cost"), F.sum("r.minutes").alias("minutes"), F.count_if(F.col("role") == "assistant").alias("jobs"))


@_R.query("""
WITH p AS (SELECT regexp_extract(html, 'lang="([a-z]*)"', 1) AS field, url, url LIKE 'https%' AND length(url) < 60 AS valid FROM pages) SELECT field, count(DISTINCT CASE WHEN valid THEN url END) AS evidence, count(DISTINCT CASE WHEN valid THEN url END) >= 5 AS enough FROM p GROUP BY 1
""")
def evidence_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid evidence of each field by distinct URL, against the least that it needs."""
    valid = F.col("url").startswith("https") & (F.length("url") < 60)
    rows = load(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("field"))
    return rows.agg(F.countDistinct(F.when(valid, F.col("url"))).alias("evidence")).withColumn("enough", F.col("evidence") >= 5)


@_R.query("""
SELECT o_custkey, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) = ['1-URGENT', '2-HIGH'] AS same_scope, list_has_all(['1-URGENT', '2-HIGH', '3-MEDIUM'], list(DISTINCT o_orderpriority)) AS inside, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderpriority > '3-MEDIUM')) AS beyond FROM orders GROUP BY 1
""")
def scope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a run's fields against its scope: the same in order, inside it, and what lies beyond."""
    scope = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("t"))
    rows = rows.select("o_custkey", F.transform("t", lambda x: x["o_orderpriority"]).alias("fields"))
    beyond = F.array_sort(F.array_except("fields", scope))
    return rows.select("o_custkey", (F.col("fields") == F.slice(scope, 1, 2)).alias("same_scope"), (F.size(beyond) == 0).alias("inside"), F.when(F.size(beyond) > 0, beyond).alias("beyond"))


@_R.query("""
WITH m AS (SELECT l_linestatus, count(*) AS tasks, count(*) FILTER (l_returnflag = 'A') AS accepted, round(sum(l_extendedprice)::DECIMAL(38, 4), 2)::DOUBLE AS cost FROM lineitem GROUP BY 1),
 u AS (SELECT l_linestatus, unnest(['tasks', 'accepted', 'cost']) AS metric, unnest([tasks::DOUBLE, accepted::DOUBLE, cost]) AS v FROM m)
SELECT metric, max(v) FILTER (l_linestatus = 'O') AS direct, max(v) FILTER (l_linestatus = 'F') AS pipeline, round(max(v) FILTER (l_linestatus = 'O') / max(v) FILTER (l_linestatus = 'F'), 6) AS ratio FROM u GROUP BY 1
""")
def experiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods side by side, one row a metric."""
    cost = F.round(F.sum("l_extendedprice").cast("decimal(38,4)"), 2).cast("double")
    m = load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count("*").cast("double").alias("tasks"), F.count_if(F.col("l_returnflag") == "A").cast("double").alias("accepted"), cost.alias("cost"))
    u = m.unpivot("l_linestatus", ["tasks", "accepted", "cost"], "metric", "v")
    method = lambda status: F.max(F.when(F.col("l_linestatus") == status, F.col("v")))
    r = u.groupBy("metric").agg(method("O").alias("direct"), method("F").alias("pipeline"))
    return r.withColumn("ratio", F.round(F.col("direct") / F.col("pipeline"), 6))


@_R.query("""
SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS fields, CASE WHEN count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') >= 4 THEN 'skip_search' WHEN sum(o_totalprice) > 2500000 THEN 'stop_budget' ELSE 'paid_search' END AS route FROM orders GROUP BY 1
""")
def discovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid search is skipped where enough fields are actionable, and stopped where the budget is spent."""
    fields = F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(fields.alias("fields"), F.sum("o_totalprice").alias("spent"))
    route = F.when(F.col("fields") >= 4, "skip_search").when(F.col("spent") > 2_500_000, "stop_budget").otherwise("paid_search")
    return rows.select("o_custkey", "fields", route.alias("route"))


@_R.query("""
WITH r AS (SELECT conv_id, turn, role = 'assistant' AND length(text) < 400 AS passed FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (passed) AS at_, max(turn) AS last_ FROM r GROUP BY 1)
SELECT conv_id, least(coalesce(at_, last_), 3) AS rounds, CASE WHEN at_ <= 3 THEN 'passed' WHEN last_ > 3 THEN 'limit' ELSE 'exhausted' END AS outcome FROM f
""")
def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a repair loop up to the first that passes, three at most."""
    passed = (F.col("role") == "assistant") & (F.length("text") < 400)
    f = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.when(passed, F.col("turn"))).alias("at_"), F.max("turn").alias("last_"))
    outcome = F.when(F.col("at_") <= 3, "passed").when(F.col("last_") > 3, "limit").otherwise("exhausted")
    return f.select("conv_id", F.least(F.coalesce("at_", "last_"), F.lit(3)).alias("rounds"), outcome.alias("outcome"))


# ---- artifacts ----


@_R.query("""
SELECT o_orderkey, l_linenumber, l_suppkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber DESC) > 0 AND o_orderkey = first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS current_ FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def artifact_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested artifacts as JSON, parsed by a declared schema into fields and a bridge to sources; only the newest import of a brand is current."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("field"), F.array("l_suppkey").alias("citations"))).alias("fields"))
    body = F.struct("o_orderkey", F.col("o_custkey").alias("brand"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), "fields")
    artifacts = load(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.to_json(body).alias("json"))
    doc = F.from_json("json", "o_orderkey bigint, brand bigint, date string, fields array<struct<field: int, citations: array<bigint>>>", {"mode": "FAILFAST"})
    rows = artifacts.select(doc.alias("d")).select("d.*")
    newest = rows.groupBy("brand").agg(F.max_by("o_orderkey", F.struct("date", "o_orderkey")).alias("newest"))
    rows = rows.join(newest, "brand").select("o_orderkey", (F.col("o_orderkey") == F.col("newest")).alias("current_"), F.explode("fields").alias("f"))
    return rows.select("o_orderkey", F.col("f.field").alias("l_linenumber"), F.explode("f.citations").alias("source"), "current_")


@_R.query("""
SELECT regexp_replace(url, '[?#].*$', '') AS source, count(*) AS actions, arg_min(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), page_id) FILTER (trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> '') AS title FROM pages GROUP BY 1
""")
def provider_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's nested response flattened to actions and sources; of a source's titles the first that is one."""
    title = F.btrim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    found = F.struct(F.regexp_replace("url", "[?#].*$", "").alias("url"), title.alias("title"))
    responses = load(spark, sf_dir, "pages").select(F.to_json(F.struct("page_id", F.array(F.struct(F.lit("search").alias("type"), F.array(found).alias("sources"))).alias("output"))).alias("json"))
    doc = F.from_json("json", "page_id bigint, output array<struct<type: string, sources: array<struct<url: string, title: string>>>>")
    rows = responses.select(doc.alias("d")).select("d.page_id", F.explode_outer("d.output").alias("action")).select("page_id", F.explode_outer("action.sources").alias("s"))
    titled = F.col("s.title") != ""
    first = F.min_by(F.when(titled, F.col("s.title")), F.when(titled, F.col("page_id")))
    return rows.groupBy(F.col("s.url").alias("source")).agg(F.count("*").alias("actions"), first.alias("title"))


# ---- typed values ----

_TYPED = """
 (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'money' WHEN 'N' THEN 'integer' ELSE 'percentage' END AS kind,
   CASE WHEN l_linenumber = 7 THEN '07' ELSE concat(l_quantity::INT, CASE WHEN l_linenumber = 6 THEN '.5' ELSE '' END) END AS low, CASE WHEN l_linenumber = 3 THEN '60' WHEN l_linenumber = 4 THEN '1' END AS high,
   CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'PLN' WHEN l_linenumber = 5 THEN 'pln' WHEN l_returnflag = 'N' AND l_tax >= 0.08 THEN 'EUR' END AS currency, CASE WHEN l_linenumber = 3 AND l_discount < 0.08 THEN 'range' ELSE 'exact' END AS precision_, l_quantity FROM lineitem)"""


@_R.query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'invalid_numeric_format' WHEN currency = 'pln' THEN 'invalid_currency' WHEN l_linenumber = 4 AND l_quantity > 1 THEN 'descending_numeric_range'
 WHEN kind = 'integer' AND l_linenumber = 6 THEN 'non_integral_integer' WHEN kind = 'money' AND currency IS NULL THEN 'missing_money_currency' WHEN kind <> 'money' AND currency IS NOT NULL THEN 'unexpected_currency'
 WHEN l_linenumber = 3 AND precision_ = 'exact' THEN 'invalid_range_precision' END AS issue FROM {_TYPED} t
""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized values and the first rule that each breaks."""
    nothing = lambda kind: F.lit(None).cast(kind)
    low = F.expr("CASE WHEN l_linenumber = 7 THEN '07' ELSE concat(cast(l_quantity AS int), CASE WHEN l_linenumber = 6 THEN '.5' ELSE '' END) END")
    currency = F.expr("CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'PLN' WHEN l_linenumber = 5 THEN 'pln' WHEN l_returnflag = 'N' AND l_tax >= 0.08 THEN 'EUR' END")
    value = {
        "task_id": F.col("l_orderkey").cast("string"),
        "target_field": F.lit("fees.royalty"),
        "claim_ids": F.array(F.col("l_suppkey").cast("string")),
        "canonical_text": F.col("l_quantity").cast("string"),
        "unit": nothing("string"),
        "notes": F.lit(""),
        "value_type": F.expr("CASE l_returnflag WHEN 'A' THEN 'money' WHEN 'N' THEN 'integer' ELSE 'percentage' END"),
        "precision": F.expr("CASE WHEN l_linenumber = 3 AND l_discount < 0.08 THEN 'range' ELSE 'exact' END"),
        "number_min": low,
        "number_max": F.expr("CASE WHEN l_linenumber = 3 THEN '60' WHEN l_linenumber = 4 THEN '1' END"),
        "boolean_value": nothing("boolean"),
        "date_value": nothing("string"),
        "currency": currency,
    }
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fields.typed_issue(value).alias("issue"))


@_R.query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size <= 25 THEN p_size > 10 END AS flag, CASE WHEN p_type = 'LARGE' AND p_brand <> 'Brand#7' THEN round(p_retailprice, 2)::DOUBLE END AS number, CASE WHEN p_type = 'SMALL' AND p_size <= 40 THEN p_size END AS whole,
 CASE WHEN p_type NOT IN ('PROMO', 'LARGE', 'SMALL') THEN p_name END AS text, CASE WHEN p_type = 'PROMO' AND p_size > 25 THEN 'invalid_boolean_value' WHEN p_type = 'LARGE' AND p_brand = 'Brand#7' THEN 'unsupported_currency' WHEN p_type = 'SMALL' AND p_size > 40 THEN 'non_integral_value' END AS issue FROM part
""")
def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: values as their profile's typed columns, or the issue that keeps them out."""
    kind = F.expr("CASE p_type WHEN 'PROMO' THEN 'boolean' WHEN 'LARGE' THEN 'money' WHEN 'SMALL' THEN 'integer' ELSE 'text' END")
    word = F.when(F.col("p_size") > 25, "maybe").when(F.col("p_size") > 10, " Tak").otherwise("nie")
    price = F.translate(F.format_number("p_retailprice", 2), ",.", " ,")
    whole = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") > 40, ",5").otherwise(""))
    text = F.when(kind == "boolean", word).when(kind == "money", price).when(kind == "integer", whole).otherwise(F.col("p_name"))
    value = fields.typed_column(kind, text, F.when(F.col("p_brand") == "Brand#7", " eur").otherwise("pln"))
    rows = load(spark, sf_dir, "part").select("p_partkey", value.alias("v"))
    return rows.select("p_partkey", "v.flag", F.col("v.number").cast("double").alias("number"), "v.whole", "v.text", "v.issue")


# ---- merges, lineage and profiles ----


@_R.query("""
WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CASE WHEN url LIKE '%/en/%' THEN 'unknown' WHEN url LIKE 'https%' THEN 'official' ELSE 'industry' END AS kind, regexp_extract(html, 'lang="([a-z]*)"', 1) AS task, page_id FROM pages)
SELECT url, arg_max(title, (length(title), -page_id)) AS title, coalesce(arg_min(kind, page_id) FILTER (kind <> 'unknown'), 'unknown') AS kind, list_sort(list_distinct(list(task))) AS tasks FROM p GROUP BY 1
""")
def provider_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what several calls found under one URL: the longest title, the first kind that is known, all tasks."""
    kind = F.when(F.col("url").contains("/en/"), "unknown").when(F.col("url").startswith("https"), "official").otherwise("industry")
    rows = load(spark, sf_dir, "pages").select(
        F.regexp_replace("url", "[?#].*$", "").alias("u"), F.btrim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), kind.alias("kind"), F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("task"), "page_id"
    )
    known = F.min_by("kind", F.when(F.col("kind") != "unknown", F.col("page_id")))
    longest = F.max_by("title", F.struct(F.length("title"), -F.col("page_id")))
    return rows.groupBy(F.col("u").alias("url")).agg(longest.alias("title"), F.coalesce(known, F.lit("unknown")).alias("kind"), F.sort_array(F.collect_set("task")).alias("tasks"))


@_R.query("""
WITH p AS (SELECT o_custkey AS source, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS content, count(*) AS claims FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
 d AS (SELECT o_custkey AS source, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS content, count(*) AS claims FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT coalesce(p.source, d.source) AS source, CASE WHEN d.source IS NULL THEN 'preserved' WHEN p.source IS NULL THEN 'new' WHEN p.content = d.content THEN 'additive' ELSE 'replaced' END AS outcome,
 CASE WHEN d.source IS NULL THEN p.claims WHEN p.content = d.content THEN p.claims + d.claims ELSE d.claims END AS claims FROM p FULL JOIN d ON p.source = d.source
""")
def execution_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta over the prior run by source: same content adds to its claims, other content replaces them, the rest is preserved."""
    orders, since = load(spark, sf_dir, "orders"), F.expr("TIMESTAMP '1999-01-01 00:00:00'")

    def run(rows: DataFrame, name: str) -> DataFrame:
        content = F.sha2(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")), 256)
        return rows.groupBy(F.col("o_custkey").alias("source")).agg(content.alias(f"{name}_content"), F.count("*").alias(f"{name}_claims"))

    rows = run(orders.filter(F.col("o_orderdate") < since), "prior").join(run(orders.filter(F.col("o_orderdate") >= since), "delta"), "source", "full")
    same = F.col("prior_content") == F.col("delta_content")
    outcome = F.when(F.col("delta_content").isNull(), "preserved").when(F.col("prior_content").isNull(), "new").when(same, "additive").otherwise("replaced")
    claims = F.when(F.col("delta_content").isNull(), F.col("prior_claims")).when(same, F.col("prior_claims") + F.col("delta_claims")).otherwise(F.col("delta_claims"))
    return rows.select("source", outcome.alias("outcome"), claims.alias("claims"))


@_R.query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_tax >= 0.08 AND l_linestatus = 'F'")
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose plan, by id and hash, is not the one that exists."""
    # All rows of a plan meet by its id, each once: results go no second way by their hash, which is made after the exchange.
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus").repartition("l_orderkey")
    plans = orders.select("l_orderkey", F.sha2(F.concat_ws("|", "l_orderkey", "o_custkey", "o_orderstatus"), 256).alias("plan_sha256"))
    stale = ((F.col("l_tax") >= 0.08) & (F.col("l_linestatus") == "F")).alias("stale")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stale)
    results = lines.join(plans, "l_orderkey").select("l_orderkey", "l_linenumber", F.when(F.col("stale"), F.reverse("plan_sha256")).otherwise(F.col("plan_sha256")).alias("has"))
    exist = plans.withColumnRenamed("l_orderkey", "id")
    same = F.instr("has", F.col("plan_sha256")) == 1
    return results.join(exist, (F.col("l_orderkey") == F.col("id")) & same, "left_anti").select("l_orderkey", "l_linenumber")


@_R.query("""
WITH l AS (SELECT l_partkey AS field, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS rule, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS value_ FROM lineitem GROUP BY 1),
 p AS (SELECT p_brand, p_partkey, coalesce(rule, 'base') AS rule, CASE WHEN rule = 'A' THEN value_ ELSE p_size END AS value_ FROM part LEFT JOIN l ON field = p_partkey)
SELECT p_brand AS profile, count(*) AS fields, count(*) FILTER (rule = 'A') AS overridden, sha256(string_agg(p_partkey || '=' || value_, ',' ORDER BY p_partkey)) AS snapshot FROM p WHERE rule <> 'R' GROUP BY 1
""")
def profile_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: a profile's fields after all rules in order, the last one of a field wins: it sets, removes or keeps; and the hash of the result."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    last = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max_by(F.struct("l_returnflag", "l_suppkey"), at).alias("rule"))
    rows = load(spark, sf_dir, "part").join(last, "p_partkey", "left").filter(~F.coalesce(F.col("rule.l_returnflag") == "R", F.lit(False)))
    sets = F.coalesce(F.col("rule.l_returnflag") == "A", F.lit(False))
    value = F.when(sets, F.col("rule.l_suppkey")).otherwise(F.col("p_size"))
    each = F.array_sort(F.collect_list(F.struct("p_partkey", value.alias("value"))))
    lines = F.transform(each, lambda x: F.concat(x["p_partkey"].cast("string"), F.lit("="), x["value"].cast("string")))
    return rows.groupBy(F.col("p_brand").alias("profile")).agg(F.count("*").alias("fields"), F.count_if(sets).alias("overridden"), F.sha2(F.array_join(lines, ","), 256).alias("snapshot"))


@_R.query("SELECT o_orderpriority AS release, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'O') AS edited, count(*) FILTER (o_orderstatus = 'P') AS rejected, count(*) AS total FROM orders GROUP BY 1")
def release_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of each frozen release."""
    count = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("release")).agg(count("F", "accepted"), count("O", "edited"), count("P", "rejected"), F.count("*").alias("total"))
