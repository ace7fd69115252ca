"""Claims of a later run carried over to the earlier run's documents: quotes found again, ids made anew, repeats dropped."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.addresses import bound
from tessera.sources.scratch import written

#: Citations of a source that are looked up in one row beside its text; a source with more has several rows.
CHUNK = 1024


def stable_id(kind: str, *parts: Column) -> Column:
    """An id that depends on the parts alone: ``kind-`` and sixteen hexadecimal digits."""
    text = F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(text, 256), 1, 16))


def nearest_start(text: Column, quote: Column, near: Column) -> Column:
    """Where the occurrence of ``quote`` nearest to ``near`` starts (from 0), the earlier of two as near; null if there is none.

    The next one is searched from ``near`` on, the one before it backwards from there, so no occurrence is listed.
    """
    m = F.length(quote)

    def both(upto: Column) -> Column:
        back = F.call_function("locate", F.reverse(quote), F.reverse(upto))
        return F.struct(F.call_function("locate", quote, text, near + 1).alias("next"), back.alias("back"), F.length(upto).alias("n"))

    def closer(at: Column) -> Column:
        after, before = F.when(at["next"] > 0, at["next"] - 1), F.when(at["back"] > 0, at["n"] - m - at["back"] + 1)
        return F.when(before.isNull() | (after.isNotNull() & (after - near < near - before)), after).otherwise(before)

    # Each search is made once, however often its result is compared; a quote that is gone is sought once, not both ways.
    return F.when((m > 0) & text.contains(quote), bound(bound(F.substring(text, F.lit(1), near + m), both), closer))


def dealt(citations: DataFrame) -> tuple[DataFrame, bool]:
    """``citations`` with ``_part``, and whether any source has several parts: null unless it has more than ``CHUNK``, then parts of about that size."""
    many = citations.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
    many = written(many.select("source", F.ceil(F.col("n") / CHUNK).alias("_parts")), "many")
    if many.isEmpty():
        return citations.withColumn("_part", F.lit(None).cast("bigint")), False
    return citations.join(many, "source", "left").withColumn("_part", F.pmod(F.xxhash64("claim", "at"), "_parts")).drop("_parts"), True


def _found(citations: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """``claim, at, task, quote, same, tasks, document, digest, start``: each citation in its source's document, whose text is read once for ``CHUNK`` of them."""
    cited, parted = dealt(citations)
    rows = cited.groupBy("source", "_part").agg(F.collect_list(F.struct("claim", "at", "task", "quote", "near", "open")).alias("cited"))
    texts = documents.select("source", "document", "tasks", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    beside = lambda rows: rows.join(sources, "source", "left").join(texts, "source", "left")
    met = beside(rows.filter("_part IS NULL"))
    if parted:
        # A text goes on to the parts of its source, which different tasks search.
        met = met.unionByName(beside(rows.filter("_part IS NOT NULL")).repartition("source", "_part"))
    start = lambda c, t: F.when(c["open"] & t["same"], nearest_start(t["text"], c["quote"], c["near"]))
    hit = lambda c, t: F.struct(c["claim"].alias("claim"), c["at"].alias("at"), c["task"].alias("task"), c["quote"].alias("quote"), start(c, t).alias("start"))
    hits = bound(F.struct("text", F.coalesce("same", F.lit(False)).alias("same")), lambda t: F.transform("cited", lambda c: hit(c, t)))
    return met.select("document", "tasks", "digest", F.coalesce("same", F.lit(False)).alias("same"), F.explode(hits).alias("hit")).select("hit.*", "same", "tasks", "document", "digest")


def rebased(claims: DataFrame, prior: DataFrame, documents: DataFrame, additive: DataFrame) -> DataFrame:
    """``claim, outcome, claim_id, citations`` of each claim of the later run.

    ``claims``: claim (a number that orders them), task, field, value, citations (source, quote, near: where the later document had
    it; null for one that is lost). ``prior``: task, field, value, sources of the earlier run's claims. ``documents``: the
    earlier run's source, document, text, tasks. ``additive``: sources whose content is the same in both runs.

    ``outcome``: ``skipped`` without citations, with a lost one, or one of a source that is not additive; ``repeated`` if the earlier run, or a
    claim before this one that was carried over, has the same task, field, value and sources; ``discarded`` if any quote is
    no longer in its document, or that is not of the claim's task; else ``carried``, with citations at their new places and ids derived from these.
    """
    sources = additive.select("source").dropna().distinct().withColumn("same", F.lit(True))
    key = F.struct("task", "field", "value", F.array_sort(F.array_distinct(F.transform("citations", lambda c: c["source"]))).alias("sources"))
    old = F.to_json(F.struct("task", "field", "value", F.array_sort(F.array_distinct("sources")).alias("sources")), {"ignoreNullFields": "false"})
    whole = F.coalesce((F.size("citations") > 0) & ~F.exists("citations", lambda c: c["source"].isNull() | c["quote"].isNull()), F.lit(False))
    rows = claims.select("claim", "task", "field", "value", "citations", whole.alias("whole"), F.to_json(key, {"ignoreNullFields": "false"}).alias("key"))
    rows = written(rows.join(prior.select(old.alias("key")).distinct().withColumn("known", F.lit(True)), "key", "left"), "claims")
    # Quotes of known claims are not searched, but whether their sources are additive counts.
    cited = rows.filter("whole").select("claim", "task", F.col("known").isNull().alias("open"), F.posexplode("citations").alias("at", "c"))
    hits = _found(cited.select("claim", "at", "task", "open", "c.source", "c.quote", "c.near"), sources, documents)
    ok = F.col("start").isNotNull() & F.coalesce(F.array_contains("tasks", F.col("task")), F.lit(False))
    place = F.struct("at", "document", "digest", "start", "quote")
    anew = hits.groupBy("claim").agg(F.bool_and("same").alias("fit"), F.bool_and(ok).alias("ok"), F.collect_list(place).alias("found"))
    # Written, as both the first claim of a key and the claims after it need to know what was found.
    rows = written(rows.drop("citations", "whole").join(anew, "claim", "left").withColumn("fit", F.coalesce("fit", F.lit(False))), "rebased")
    # Claims of one key after the first that was carried over repeat it; those before it have lost a quote.
    carried = rows.filter("fit AND known IS NULL AND ok").groupBy("key").agg(F.min("claim").alias("first"))
    rows = rows.join(carried, "key", "left")
    outcome = F.when(~F.col("fit"), "skipped").when(F.col("known"), "repeated").when(F.col("claim") > F.col("first"), "repeated").when(F.col("ok"), "carried").otherwise("discarded")

    def placed(c: Column) -> Column:
        end = (c["start"] + F.length(c["quote"])).alias("end")
        passage = stable_id("passage", c["document"], F.col("task"), c["start"], end)
        citation = stable_id("citation", passage, c["document"], c["start"], end, c["quote"])
        return F.struct(citation.alias("citation_id"), passage.alias("passage_id"), c["document"].alias("document"), F.lower(F.hex(c["digest"])).alias("digest"), c["start"].alias("start"), end)

    is_new = F.col("outcome") == "carried"
    rows = rows.withColumn("outcome", outcome).withColumn("citations", F.when(is_new, F.transform(F.sort_array("found"), placed)))
    name = stable_id("claim", F.col("task"), F.col("field"), F.col("value"), F.to_json(F.transform("citations", lambda c: c["citation_id"])))
    return rows.select("claim", "outcome", F.when(is_new, name).alias("claim_id"), "citations")
