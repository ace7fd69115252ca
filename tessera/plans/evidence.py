"""Documents to evidence to claims.

``documents`` are the documents, their lines the passages; ``labels`` are verdicts (quality: accepted, toxic:
unsafe), ``benchmark`` the reference values.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import evidence as ev
from tessera.functions.numbers import ratio
from tessera.operators.relational import top_per_key
from tessera.operators.sequential import take_while_fits
from tessera.plans.registry import Registry
from tessera.sources.scratch import scratch
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

_TERMS = ("the", "der", "les", "que", "and", "license")
_PASSAGES = "(SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS passage FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)) p"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G27, simple: one passage a line."""
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "passage"))


@_R.query(f"SELECT doc_id, count(*) AS n, max(length(passage)) AS longest, sum(length(trim(passage)))::BIGINT AS chars FROM {_PASSAGES} GROUP BY 1")
def passages_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each document."""
    return passages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("passage")).cast("bigint").alias("longest"), F.sum(F.length(F.trim("passage"))).alias("chars"))


@_R.query()
def passages_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and windows of short neighbours, with the page or the range that they stand at."""
    return load(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(ev.passage_ranges, "doc_id bigint, pos int, start_char int, end_char int, passage string, locator string")


@_R.query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents)
SELECT term, count(*) AS df FROM w GROUP BY 1
""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each term; terms are made distinct inside the document, before the exchange."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))
    return load(spark, sf_dir, "documents").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


_SCORED = f"""
WITH p AS (SELECT * FROM {_PASSAGES}), t AS (SELECT unnest({list(_TERMS)}) AS term),
 n AS (SELECT count(*) AS n FROM p), df AS (SELECT term, count(*) FILTER (contains(lower(passage), term)) AS df FROM p, t GROUP BY 1),
 s AS (SELECT doc_id, pos, passage, sum(CASE WHEN contains(lower(passage), term) THEN 1 + ln((n + 1) / (df + 1)) ELSE 0 END) AS raw, string_agg(CASE WHEN contains(lower(passage), term) THEN term END, ',' ORDER BY term) AS signature
       FROM p, df, n GROUP BY 1, 2, 3)
SELECT doc_id, pos, coalesce(signature, '') AS signature, round(raw - (
   CASE WHEN regexp_matches(f, 'administrator danych|adres e mail|adres e-mail|danych osobowych|inspektor ochrony danych|polityka prywatnosci|przetwarzanie danych|wycofanie zgody|wyrazam zgode|zgode na kierowanie') THEN 100 ELSE 0 END
   + CASE WHEN contains(f, 'automaty vendingowe') OR contains(f, 'menu') OR contains(f, 'newsletter') OR contains(f, 'zaakceptuj cookies') THEN 100 ELSE 0 END
   + CASE WHEN length(passage) <= 60 AND NOT regexp_matches(passage, '[0-9]') AND NOT contains(passage, ':') THEN 6 ELSE 0 END + CASE WHEN rtrim(passage) LIKE '%?' THEN 100 ELSE 0 END), 6) AS score
FROM (SELECT *, replace(strip_accents(lower(passage)), 'ł', 'l') AS f FROM s) WHERE raw > 0
"""


def _scored(spark, sf_dir):
    rows, low = passages(spark, sf_dir), F.lower("passage")
    bits = sum((F.when(low.contains(t), 1 << i).otherwise(0) for i, t in enumerate(_TERMS)), F.lit(0))
    rows = rows.select("doc_id", "pos", "passage", bits.alias("bits"))
    rows = rows.select("doc_id", "pos", "bits", F.when(F.col("bits") > 0, ev.boilerplate_penalty(F.col("passage"))).alias("penalty"))
    # Texts are split and searched once; frequencies and scores both read the marks, a few bytes a passage.
    path = scratch(spark, "marks")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    hit = [F.col("bits").bitwiseAND(1 << i) > 0 for i in range(len(_TERMS))]
    # Frequencies of the few query terms come from one aggregate, and go back as one row.
    df = rows.agg(F.count("*").alias("n"), *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(hit)])
    rows = rows.filter("bits > 0").crossJoin(F.broadcast(df))
    raw = sum((F.when(h, ev.idf(F.col(f"df{i}"), F.col("n"))).otherwise(0.0) for i, h in enumerate(hit)), F.lit(0.0))
    signature = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(h, t) for h, t in zip(hit, _TERMS, strict=True)]))), ",")
    return rows.select("doc_id", "pos", signature.alias("signature"), F.round(raw - F.col("penalty"), 6).alias("score"))


@_R.query(_SCORED)
def passage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-frequency score of the terms that a passage holds, less penalties."""
    return _scored(spark, sf_dir)


@_R.query(f"""
WITH s AS ({_SCORED}), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, signature ORDER BY score DESC, pos) AS r FROM s),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM d WHERE r <= 2)
SELECT doc_id, pos, rank, score FROM k WHERE rank <= 6
""")
def passage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six best passages of a document, no more than two with the same terms."""
    diverse = top_per_key(_scored(spark, sf_dir), ["doc_id", "signature"], 2, F.col("score").desc(), F.col("pos")).drop("rank")
    return top_per_key(diverse, ["doc_id"], 6, F.col("score").desc(), F.col("pos")).select("doc_id", "pos", F.col("rank").cast("bigint").alias("rank"), "score")


@_R.query(f"""
WITH s AS ({_SCORED}), r AS (SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS next_ FROM s)
SELECT doc_id, pos, CASE WHEN score >= 3 AND score - coalesce(next_, 0) >= 0.5 THEN 'assigned' ELSE 'unassigned' END AS decision FROM r WHERE place = 1
""")
def winner_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage, assigned only with a lead over the runner-up."""
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "pos")
    rows = _scored(spark, sf_dir).withColumn("next_", F.lead("score").over(w)).withColumn("place", F.row_number().over(w)).filter("place = 1")
    clear = (F.col("score") >= 3) & (F.col("score") - F.coalesce("next_", F.lit(0.0)) >= 0.5)
    return rows.select("doc_id", "pos", F.when(clear, "assigned").otherwise("unassigned").alias("decision"))


@_R.query()
def budget_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each source in rounds over its documents, each taken if it still fits 20,000 characters.

    ``take_while_fits`` first keeps what a budget can reach, exactly, so that a source's group stays bounded."""
    rows = passages(spark, sf_dir).filter("length(passage) > 0").withColumn("chars", F.length("passage"))
    rows = rows.join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("round", F.row_number().over(order)).select("source", "round", "doc_id", "pos", "chars")
    return take_while_fits(rows, ["source"], ["round", "doc_id", "pos"], "chars", 20_000)


def grounded_quotes(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start_char``: where each quote (``item_id, text``) first stands in each document.

    A document gives only the places where a window of a quote's head length may be a head (a bitmap of fixed size
    says so, never wrongly no). They meet the quotes by head in a hash-partitioned join without texts. A quote no
    longer than a head is then found; longer ones are compared whole, with the documents that still have a candidate."""
    quotes = benchmark.select("item_id", F.col("text").alias("quote")).filter("quote IS NOT NULL")
    quotes = quotes.withColumn("head", F.substring("quote", 1, ev.HEAD))
    docs = documents.select("doc_id", "text")
    # At most HEAD + 1 lengths and as many slots as the bitmap has, whatever the number of quotes.
    lengths = sorted(r[0] for r in quotes.select(F.length("head")).distinct().collect())
    slots = [r.slot for r in quotes.select("head").mapInArrow(ev.head_slots, "slot int").distinct().collect()]
    places = docs.mapInArrow(ev.head_places(lengths, slots), "doc_id bigint, at int, head string")
    found = places.join(quotes.select("item_id", "head", F.length("quote").alias("n")).hint("shuffle_merge"), "head")
    short = found.filter(F.col("n") <= ev.HEAD).select("doc_id", "item_id", "at")
    long_ = found.filter(F.col("n") > ev.HEAD).select("doc_id", "item_id", "at")
    long_ = long_.join(quotes.select("item_id", "quote").hint("shuffle_merge"), "item_id").join(docs.hint("shuffle_merge"), "doc_id")
    long_ = long_.filter(ev.grounded(F.col("quote"), F.col("text"), F.col("at"))).select("doc_id", "item_id", "at")
    return short.unionByName(long_).groupBy("doc_id", "item_id").agg(F.min("at").cast("bigint").alias("start_char"))


@_R.query("""
SELECT d.doc_id, strpos(d.text, b.text) - 1 AS start_char, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference passages found in documents at exact offsets, of any length."""
    return grounded_quotes(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_POLICY = "CASE WHEN source IN ('src0', 'src1') THEN 'registry' WHEN source IN ('src2', 'src3', 'src4') THEN 'official' WHEN source LIKE 'src1%' THEN 'news' ELSE 'unknown' END"
_RELIABILITY = "least(CASE kind WHEN 'registry' THEN 95 WHEN 'official' THEN 80 WHEN 'news' THEN 55 ELSE 30 END, CASE WHEN n_chars < 100 THEN 10 WHEN n_chars > 15000 THEN 70 ELSE 100 END)"


@_R.query(f"SELECT doc_id, kind, {_RELIABILITY} AS reliability, kind IN ('registry', 'news') AS independent FROM (SELECT *, {_POLICY} AS kind FROM documents)")
def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority, independence and capped reliability by kind of source."""
    rows = load(spark, sf_dir, "documents").withColumn("kind", F.expr(_POLICY))
    return rows.select("doc_id", "kind", F.expr(_RELIABILITY).alias("reliability"), F.col("kind").isin("registry", "news").alias("independent"))


_STATUS = """CASE WHEN n = 0 THEN 'no_claim' WHEN unsafe > 0 THEN 'conflict' WHEN accepted = 0 THEN 'rejected' WHEN accepted = 1 AND n > 1 THEN 'needs_corroboration' WHEN accepted < n THEN 'partial' ELSE 'verified' END"""
_FIELDS = "SELECT source, lang, count(quality) AS n, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (toxic = 1) AS unsafe FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"


def _fields(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source", "lang").agg(F.count("quality").alias("n"), F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("toxic") == 1).alias("unsafe"))


@_R.query(f"SELECT source, lang, n, accepted, {_STATUS} AS status FROM ({_FIELDS})")
def field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each field by an ordered chain of conditions."""
    return _fields(spark, sf_dir).select("source", "lang", "n", "accepted", F.expr(_STATUS).alias("status"))


@_R.query(f"""
WITH f AS (SELECT *, {_STATUS} AS status, CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END AS weight FROM ({_FIELDS}))
SELECT source, round(sum(weight * CASE status WHEN 'verified' THEN 100 WHEN 'partial' THEN 70 WHEN 'needs_corroboration' THEN 40 ELSE 0 END) / sum(weight), 4) AS coverage,
 least(30, 10 * count(*) FILTER (status = 'conflict'))::INT AS deduction, CASE WHEN sum(n) = 0 THEN 0.0 ELSE round_even(sum(accepted) / sum(n), 4) END AS acceptance FROM f GROUP BY 1
""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted coverage, deductions and acceptance of each source."""
    f = _fields(spark, sf_dir).withColumn("status", F.expr(_STATUS)).withColumn("weight", F.expr("CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END"))
    points = F.expr("CASE status WHEN 'verified' THEN 100 WHEN 'partial' THEN 70 WHEN 'needs_corroboration' THEN 40 ELSE 0 END")
    return f.groupBy("source").agg(
        F.round(F.sum(F.col("weight") * points) / F.sum("weight"), 4).alias("coverage"),
        F.least(F.lit(30), 10 * F.count_if(F.col("status") == "conflict")).cast("int").alias("deduction"),
        ratio(F.sum("accepted"), F.sum("n")).alias("acceptance"),
    )


@_R.query("""
WITH b AS (SELECT doc_id, sha256(lang || chr(31) || source || chr(31) || n_chars) AS fp, doc_id % 3 = 0 AS changed FROM documents)
SELECT b.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN changed THEN 'recompute' ELSE 'reuse' END AS action, CASE WHEN NOT changed THEN l.quality END AS inherited FROM b LEFT JOIN labels l ON l.doc_id = b.doc_id
""")
def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are inherited where the semantic fingerprint is unchanged."""
    docs = load(spark, sf_dir, "documents")
    fp = lambda n: F.sha2(F.concat_ws("\x1f", "lang", "source", n.cast("string")), 256)
    now = docs.select("doc_id", fp(F.col("n_chars")).alias("fp"))
    then = docs.select("doc_id", fp(F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("old_fp")).join(load(spark, sf_dir, "labels"), "doc_id")
    same = F.col("fp") == F.col("old_fp")
    action = F.when(F.col("old_fp").isNull(), "new").when(same, "reuse").otherwise("recompute")
    return now.join(then, "doc_id", "left").select("doc_id", action.alias("action"), F.when(same, F.col("quality")).alias("inherited"))


_KIND = "['text', 'integer', 'decimal', 'money', 'percentage', 'boolean', 'date', 'url'][p_partkey % 8 + 1]"
_VALUE = "CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN (p_size + (p_partkey % 3 = 0)::INT * 0.5)::DECIMAL(10,1)::VARCHAR WHEN 2 THEN p_retailprice::DECIMAL(12,2)::VARCHAR WHEN 3 THEN p_retailprice::DECIMAL(12,2)::VARCHAR WHEN 4 THEN (p_size * 3)::VARCHAR WHEN 5 THEN CASE WHEN p_size > 25 THEN 'tak' ELSE 'maybe' END WHEN 6 THEN '2024-01-' || lpad(p_size::VARCHAR, 2, '0') ELSE 'https://x' || CASE WHEN p_size > 10 THEN '.pl/' ELSE '/' END END"


@_R.query(f"""
WITH v AS (SELECT p_partkey, p_size, {_KIND} AS kind, {_VALUE} AS value_ FROM part)
SELECT p_partkey, kind, CASE WHEN trim(value_) = '' THEN 'empty' WHEN kind = 'integer' AND value_ NOT LIKE '%.0' THEN 'not_integral' WHEN kind = 'money' AND p_size < 20 THEN 'money_without_currency'
 WHEN kind = 'percentage' AND NOT value_::INT BETWEEN 0 AND 100 THEN 'percentage_out_of_range' WHEN kind = 'boolean' AND value_ <> 'tak' THEN 'not_boolean' WHEN kind = 'date' AND (p_size > 31) THEN 'not_a_date' WHEN kind = 'url' AND value_ = 'https://x/' THEN 'not_a_url' END AS problem FROM v
""")
def normalized_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values and the rule that each breaks."""
    kinds = ["text", "integer", "decimal", "money", "percentage", "boolean", "date", "url"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 8 + 1).cast("int"))
    value = F.expr("""CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN cast(cast(p_size + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0 END AS decimal(10,1)) AS string)
       WHEN 2 THEN cast(cast(p_retailprice AS decimal(12,2)) AS string) WHEN 3 THEN cast(cast(p_retailprice AS decimal(12,2)) AS string) WHEN 4 THEN cast(p_size * 3 AS string)
       WHEN 5 THEN CASE WHEN p_size > 25 THEN 'tak' ELSE 'maybe' END WHEN 6 THEN concat('2024-01-', lpad(cast(p_size AS string), 2, '0')) ELSE concat('https://x', CASE WHEN p_size > 10 THEN '.pl/' ELSE '/' END) END""")
    rows = load(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), value.alias("value_"), F.when(F.col("p_size") >= 20, "PLN").alias("currency"))
    return rows.select("p_partkey", "kind", ev.value_problem(F.col("kind"), F.col("value_"), F.col("currency")).alias("problem"))


@_R.query(f"""
SELECT source, lang, CASE WHEN status = 'verified' THEN 'accept' WHEN status IN ('no_claim', 'rejected') THEN 'gap' ELSE 'pending' END AS decision,
 CASE WHEN status = 'verified' THEN 'policy' WHEN status = 'conflict' THEN 'contradiction' WHEN status = 'needs_corroboration' THEN 'sources_below_minimum' ELSE status END AS reason FROM (SELECT *, {_STATUS} AS status FROM ({_FIELDS}))
""")
def auto_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept, gap or pending, with the reason."""
    rows = _fields(spark, sf_dir).withColumn("status", F.expr(_STATUS))
    status = F.col("status")
    decision = F.when(status == "verified", "accept").when(status.isin("no_claim", "rejected"), "gap").otherwise("pending")
    reason = F.when(status == "verified", "policy").when(status == "conflict", "contradiction").when(status == "needs_corroboration", "sources_below_minimum").otherwise(status)
    return rows.select("source", "lang", decision.alias("decision"), reason.alias("reason"))


@_R.query("""
WITH cur AS (SELECT p_partkey AS k, p_name AS name, p_size AS size_ FROM part), new AS (SELECT l_partkey AS k, max(l_quantity)::INT AS size_ FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), old AS (SELECT l_partkey AS k, max(l_linenumber) AS size_ FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT cur.k, name, coalesce(new.size_, old.size_, cur.size_)::INT AS size_, CASE WHEN new.k IS NOT NULL THEN 'new' WHEN old.k IS NOT NULL THEN 'restored' ELSE 'current' END AS origin FROM cur LEFT JOIN new USING (k) LEFT JOIN old USING (k)
""")
def release_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values over restored ones over the current."""
    both = load(spark, sf_dir, "lineitem").filter("l_returnflag IN ('R', 'A')").groupBy(F.col("l_partkey").alias("k")).agg(
        F.max(F.expr("CASE WHEN l_returnflag = 'R' THEN cast(l_quantity AS int) END")).alias("new"), F.max(F.expr("CASE WHEN l_returnflag = 'A' THEN l_linenumber END")).alias("old")
    )
    rows = load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k").join(both, "k", "left")
    origin = F.when(F.col("new").isNotNull(), "new").when(F.col("old").isNotNull(), "restored").otherwise("current")
    return rows.select("k", F.col("p_name").alias("name"), F.coalesce("new", "old", "p_size").cast("int").alias("size_"), origin.alias("origin"))


@_R.query("""
SELECT b.item_id, count(DISTINCT d.doc_id) AS matches FROM benchmark b LEFT JOIN documents d ON trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')) GROUP BY 1
""")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents equal to a reference value after canonical form; an equi-join on its hash."""
    from tessera.functions.text import canonical

    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("h"))
    gold = load(spark, sf_dir, "benchmark").select("item_id", F.sha2(canonical(F.col("text")), 256).alias("h"))
    return gold.join(docs, "h", "left").groupBy("item_id").agg(F.countDistinct("doc_id").alias("matches"))


@_R.query("""
SELECT conv_id, string_agg(role, '>' ORDER BY first_, role) AS roles, count(*) AS n FROM (SELECT conv_id, role, min(turn) AS first_ FROM conversations GROUP BY 1, 2) GROUP BY 1
""")
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of each claim, first seen first."""
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]))
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("roles"))
    return rows.select("conv_id", F.array_join("roles", ">").alias("roles"), F.size("roles").cast("bigint").alias("n"))


@_R.query("""
WITH s AS (SELECT doc_id, unnest([source, lang]) AS task FROM documents) SELECT task, count(*) AS n, min(doc_id) AS first_doc FROM s GROUP BY 1
""")
def array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that list a task, by exploding the list instead of a nested loop."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array("source", "lang")).alias("task"))
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@_R.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 THEN 'sufficient' ELSE 'insufficient' END AS verdict, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_extendedprice DESC, l_linenumber) AS rank FROM lineitem")
def source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a task by kind, then weight, then order of input."""
    w = Window.partitionBy("l_orderkey").orderBy(F.expr("CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END"), F.col("l_extendedprice").desc(), "l_linenumber")
    verdict = F.when(F.col("l_quantity") >= 10, "sufficient").otherwise("insufficient")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"), F.row_number().over(w).cast("bigint").alias("rank"))


@_R.query("""
WITH r AS (SELECT l_suppkey, l_partkey, l_extendedprice AS score, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn, l_orderkey, l_linenumber FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber FROM r QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY rn > 1, score DESC, l_orderkey, l_linenumber) <= 5
""")
def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each kind first, then the best of the rest, up to five."""
    best = Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    rows = load(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(best))
    order = (F.col("rn") > 1, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"))
    return top_per_key(rows, ["l_suppkey"], 5, *order).select("l_suppkey", "l_orderkey", "l_linenumber")
