"""Text, URL and JSON functions of the research flow: currencies, contracts of fields, routing of sources, keys and ids."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, keys, text, web
from tessera.functions import fields as fd
from tessera.plans.registry import Registry
from tessera.sources.tables import load

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN 'PLN' WHEN '3-MEDIUM' THEN 'USD' WHEN '5-LOW' THEN 'GBP' END AS currency FROM orders
""")
def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, signs and words of a currency as its code; none where the text names several."""
    amount = F.format_string("%.2f", "o_totalprice")
    written = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN ' €' WHEN '2-HIGH' THEN ' złotych' WHEN '3-MEDIUM' THEN ' usd netto' WHEN '5-LOW' THEN ' Pounds' ELSE ' CHF or CZK' END")
    return load(spark, sf_dir, "orders").select("o_orderkey", fd.currency(F.lit(None).cast("string"), F.concat(amount, written)).alias("currency"))


@_R.query("""
SELECT p_partkey, p_type = 'LARGE' OR p_type = 'SMALL' AS unit_format, p_type IN ('LARGE', 'PROMO') AS has_quantity FROM part
""")
def field_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of units need a word of the vocabulary, quantities a digit."""
    value = F.expr("CASE p_type WHEN 'LARGE' THEN concat('Multi-unit of ', p_size, ' shops') WHEN 'SMALL' THEN 'jeden  sklep' WHEN 'PROMO' THEN concat('fee ', p_size) ELSE p_name END")
    return load(spark, sf_dir, "part").select("p_partkey", fd.is_unit_format(value).alias("unit_format"), fd.has_digit(value).alias("has_quantity"))


@_R.query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' – ' || (p_size + 5) || ' PLN' WHEN 1 THEN p_size || ' %' WHEN 2 THEN CASE WHEN p_size > 25 THEN 'Tak' ELSE 'Nie' END ELSE p_name END AS shown FROM part
""")
def typed_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values as people read them: ranges with a suffix, words for yes and no, else the text."""
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'money' WHEN 1 THEN 'percentage' WHEN 2 THEN 'boolean' ELSE 'text' END")
    low, money = F.col("p_size").cast("string"), F.col("p_partkey") % 4 == 0
    high = F.when(money, (F.col("p_size") + 5).cast("string")).otherwise(low)
    shown = fd.display(kind, F.col("p_name"), low, high, F.when(money, "PLN"), F.col("p_size") > 25)
    return load(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"))


@_R.query("""
SELECT page_id, lang = 'en' AND page_id % 2 = 0 AS unrelated FROM (SELECT page_id, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang FROM pages)
""")
def promotional_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of contests and the like, unless the task itself is about promotion."""
    lang = F.regexp_extract("html", 'lang="([a-z]*)"', 1)
    path = F.when(lang == "en", "/summer/Konkurs-2024/").otherwise("/contests/plakaty/")
    task = F.when(F.col("page_id") % 2 == 0, "Who runs the shops?").otherwise("Which marketing campaign?")
    return load(spark, sf_dir, "pages").select("page_id", fd.unrelated_promotion(F.concat(F.lit("https://x.example"), path), task).alias("unrelated"))


@_R.query("""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'routing_lead' WHEN page_id % 4 = 1 THEN 'registry' WHEN page_id % 4 = 2 THEN 'legislative_project' ELSE 'government' END AS kind,
 CASE page_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'regulator' WHEN 2 THEN 'legal_document' ELSE 'routing_lead' END AS routed FROM pages
""")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of sources refined by their host and note, and the kind that an authority's URL tells."""
    which = F.col("page_id") % 4
    host = F.when(which == 0, "krs.example.com").when(which == 1, "uokik.gov.example").when(which == 2, "sejm.example").otherwise("imsig.gov.example")
    url = F.concat(F.lit("https://"), host, F.when(which == 2, "/Projekt-Ustawy/1").otherwise("/a"))
    claimed = F.when(which <= 1, "registry").otherwise("government")
    return load(spark, sf_dir, "pages").select("page_id", fd.refined_type(claimed, F.lit("Official page."), url).alias("kind"), fd.authority_type(url).alias("routed"))


@_R.query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'view' THEN 'timeout' END AS code, CASE WHEN event_type = 'error' THEN ['attempts/a-' || event_id || '.json', 'attempts/b.json'] ELSE [] END AS ledgers FROM events
""")
def log_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a log's tail that a retry can mend, by stable code, and the ledgers that it names."""
    log = F.expr("""CASE event_type WHEN 'error' THEN concat('x\nrequest failed (RateLimitError)\nFailure ledger: attempts/a-', event_id, '.json, attempts/b.json., notes/c.json, attempts/b.json')
        WHEN 'view' THEN 'stopped with timeout' WHEN 'click' THEN 'request failed (BadRequestError)' ELSE 'done' END""")
    return load(spark, sf_dir, "events").select("event_id", fd.transient_code(log).alias("code"), fd.ledger_paths(log).alias("ledgers"))


@_R.query("""
SELECT event_type, CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'view' THEN 'permission_denied' WHEN 'click' THEN 'provider_status_error' ELSE 'provider_exception' END AS code, count(*) AS n FROM events GROUP BY 1
""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions by their stable code."""
    name = F.expr("CASE event_type WHEN 'error' THEN 'RateLimitError' WHEN 'view' THEN 'PermissionDeniedError' WHEN 'click' THEN 'APIStatusError' ELSE 'KeyError' END")
    return load(spark, sf_dir, "events").groupBy("event_type", fd.exception_code(name).alias("code")).agg(F.count("*").alias("n"))


@_R.query("""
SELECT doc_id, md5(substr('Inherited from exact predecessor Searcher artifact. ' || text, 1, 1000)) AS note FROM documents
""")
def inherited_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that say once, and only once, that they are inherited."""
    once = fd.inherited_note(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(fd.inherited_note(F.concat(F.lit(fd.INHERITED), once)).cast("binary")).alias("note"))


@_R.query("""
SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'Registration number' ELSE upper(substr(split_part(n_name, '_', 1), 1, 1)) || substr(lower(split_part(n_name, '_', 1)), 2) || ' ' || split_part(n_name, '_', 2) END AS label FROM nation
""")
def humanized_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of fields: from the list of labels, else from the name."""
    field = F.when(F.col("n_regionkey") == 0, "franchisor.registration_id").otherwise(F.concat(F.lit("offer."), F.lower("n_name")))
    labels = spark.createDataFrame([("franchisor.registration_id", "Registration number")], "field string, label string")
    rows = load(spark, sf_dir, "nation").withColumn("field", field).join(F.broadcast(labels), "field", "left")
    return rows.select("n_nationkey", F.coalesce("label", text.humanize(F.col("field"))).alias("label"))


@_R.query(r"""
SELECT event_id, CASE WHEN ip <> '' THEN sha256(unhex(outer_) || unhex(sha256(unhex(inner_) || ip::BLOB))) ELSE '' END AS ip_hash FROM
 (SELECT event_id, CASE WHEN event_type <> 'error' THEN '10.0.' || user_id || '.7' ELSE '' END AS ip, '455355445342' || repeat('36', 58) AS inner_, '2F393F2E3928' || repeat('5C', 58) AS outer_ FROM events)
""")
def keyed_ip_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed hash of the first hop of a forwarded address; none for no address."""
    hops = F.when(F.col("event_type") != "error", F.concat(F.lit(" 10.0."), F.col("user_id").cast("string"), F.lit(".7 , 10.1.1.1"))).otherwise("")
    return load(spark, sf_dir, "events").select("event_id", keys.hmac_sha256(b"secret", keys.first_hop(hops)).alias("ip_hash"))


_SEQ = "SELECT p_partkey, p_size AS n, least(20, p_size) AS k FROM part"


@_R.query(f"SELECT p_partkey, list_transform(generate_series(0, k - 1), lambda i: round_even(i * (n - 1) / greatest(k - 1, 1), 0)::BIGINT) AS places FROM ({_SEQ})")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places spread evenly over a list, both ends among them."""
    return load(spark, sf_dir, "part").select("p_partkey", fd.even_places(F.col("p_size"), F.least(F.lit(20), F.col("p_size"))).alias("places"))


@_R.query("""
SELECT event_id, CASE WHEN epoch(ts)::BIGINT % 5 <> 0 THEN to_timestamp(epoch(ts)::BIGINT - 1 + 1)::TIMESTAMP END AS at_, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS iso FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events))
""")
def lenient_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4, H5: epoch seconds (0 is none) and ISO texts with or without a zone; what is no time is null."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    iso = F.when(F.col("event_type") == "error", "yesterday").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_type") == "view", "Z").otherwise("")))
    rows = load(spark, sf_dir, "events").select("event_id", F.when(seconds % 5 != 0, seconds).otherwise(0).alias("s"), iso.alias("iso"))
    utc = lambda c: c.cast("timestamp_ntz")
    return rows.select("event_id", utc(dates.from_epoch(F.col("s"))).alias("at_"), utc(dates.lenient_iso(F.col("iso"))).alias("iso"))


@_R.query("SELECT o_orderkey, round(o_totalprice::DECIMAL(18, 2) / 1000, 0)::INT AS score FROM orders")
def half_up_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole scores, halves up, on decimals."""
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice").cast("decimal(18,2)") / 1000, 0).cast("int").alias("score"))


# ---- JSON and ids ----


@_R.query("""
SELECT event_id, (props->>'$.k')::INT AS k, event_type <> 'error' AS found FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS props FROM events)
""")
def first_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON object in a text that has other words, braces among them, around it."""
    out = F.concat(F.lit("Done {not json} in 3 s: "), F.col("props"), F.lit(" {\"k\": -1} end"))
    rows = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "no { object").otherwise(out).alias("t"))
    found = fd.first_object(F.col("t"))
    return rows.select("event_id", F.get_json_object(found, "$.k").cast("int").alias("k"), found.isNotNull().alias("found"))


@_R.query("""
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}' || chr(10)) AS sha256 FROM part
""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with sorted keys, no blanks and a line's end, as its digest."""
    return load(spark, sf_dir, "part").select("p_partkey", F.sha2(fd.canonical_json(name=F.col("p_name"), size=F.col("p_size"), brand=F.col("p_brand")), 256).alias("sha256"))


_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/workspace")


@_R.query(f"""
WITH h AS (SELECT p_partkey, substr(sha1(unhex('{_SPACE.hex}') || (p_brand || ':' || p_partkey)::BLOB), 1, 32) AS h FROM part)
SELECT p_partkey, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS id FROM h
""")
def named_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of a name, the same on every run."""
    return load(spark, sf_dir, "part").select("p_partkey", keys.uuid5(_SPACE, F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string"))).alias("id"))


@_R.query("""
SELECT conv_id, list_sort(map_entries(map_from_entries(list((role, n) ORDER BY role)))) AS last_by_role FROM (SELECT conv_id, role, arg_max(length(text), turn) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1
""")
def last_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map by key in which a later row replaces an earlier one; the winner is chosen before rows are gathered."""
    last = load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.length("text").cast("bigint"), "turn").alias("n"))
    built = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return built.select("conv_id", F.array_sort(F.map_entries("m")).alias("last_by_role"))


@_R.query("""
WITH s AS (SELECT p_brand, list_sort(list_distinct(list(p_name))) AS s FROM part GROUP BY 1) SELECT p_brand, CASE WHEN length(array_to_string(s, '; ')) <= 120 THEN array_to_string(s, '; ') END AS joined, len(s) AS n FROM s
""")
def joined_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct snippets as one text where it stays within the limit, else none."""
    joined = F.array_join("s", "; ")
    rows = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("s"))
    return rows.select("p_brand", F.when(F.length(joined) <= 120, joined).alias("joined"), F.size("s").cast("bigint").alias("n"))


@_R.query("""
SELECT p_partkey, p_name || chr(10) || p_brand || CASE WHEN p_type = 'PROMO' THEN '' ELSE chr(10) || p_type END AS text FROM part
""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under public keys of a page's embedded JSON, each once, code and broken blocks aside."""
    blocks = F.expr("""array(
      to_json(named_struct('name', p_name, 'x', 'hidden', 'offers', array(named_struct('Price_Currency', p_brand, 'id', 'y')), 'text', 'f => 1')),
      '{broken', to_json(named_struct('title', p_name, 'label', CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_type END)))""")
    rows = load(spark, sf_dir, "part").select("p_partkey", blocks.alias("blocks"))
    return rows.select("p_partkey", web.embedded_text("blocks").alias("text"))


_STEMMED = "CASE WHEN length(w) < 5 THEN w ELSE coalesce(substr(w, 1, length(w) - length(list_filter(['owego', 'owej', 'ami', 'ach', 'ego', 'emu', 'owie', 'owa', 'owe', 'owy', 'ie', 'om', 'ow', 'a', 'e', 'y'], lambda e: ends_with(w, e) AND length(w) - length(e) >= 4)[1])), CASE WHEN length(w) >= 6 AND w LIKE '%s' THEN w[:-2] END, w) END"


@_R.query(f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(replace(replace(strip_accents(lower(text)), 'ł', 'l'), 'ß', 'ss'), '[a-z0-9]+'))) AS w FROM documents),
 t AS (SELECT DISTINCT doc_id, {_STEMMED} AS t FROM w), k AS (SELECT doc_id, t FROM t WHERE length(t) >= 3 AND t NOT IN ('about', 'also', 'and', 'are', 'brand', 'czy', 'dla', 'from', 'how', 'ich', 'jest', 'juz', 'lub', 'oraz', 'pod', 'przez', 'sie', 'that', 'the', 'this', 'under', 'what', 'which', 'with', 'zakresi')
  UNION SELECT doc_id, unnest(['ofert', 'model', 'umow', 'wspolprac']) FROM documents WHERE lang = 'en')
SELECT doc_id, count(*) AS n, md5(string_agg(t, ' ' ORDER BY t)) AS terms FROM k GROUP BY 1
""")
def task_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of a task's words without stop words, with the hints of its fields."""
    docs = load(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all(text.fold(F.col("text")), F.lit("([a-z0-9]+)"), F.lit(1)))
    # Stems of a text are made and told apart in its row; one row a text is exchanged, not one a word.
    stems = F.array_distinct(F.transform(words, text.stem))
    stems = docs.select("doc_id", F.filter(stems, lambda t: (F.length(t) >= 3) & ~t.isin(*text.stop_stems())).alias("t"))
    target = docs.select("doc_id", F.when(F.col("lang") == "en", "offer.unit_formats").otherwise("brand.name").alias("field"))
    hints = F.broadcast(spark.createDataFrame(text.field_hints(), "prefix string, t string"))
    hinted = target.join(hints, F.col("field").startswith(F.col("prefix"))).groupBy("doc_id").agg(F.collect_set("t").alias("t"))
    terms = stems.unionByName(hinted).groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("t")))).alias("t")).filter(F.size("t") > 0)
    return terms.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("terms"))
