"""Quality rules: thresholds from mergeable quantile sketches for each language and source, in built-in functions alone."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, cut, met

#: Words of a document at least, and per cent of its words in repeated windows at most. Fixed by the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bits of a value that its sketch cell keeps, so a quantile is off by a sixteenth at most.
KEPT_BITS = 5
#: Documents that a group's own sketch needs; groups with fewer are judged by their language's, then by the whole corpus's.
LEAST_DOCS = 100
#: Fences reach so many times the distance from the median to the outer quartile, or to TOLERANCE of the median if that is more.
REACH = 6
#: What a document is measured by, ten thousandths of its words (``chars``: hundredths of a character a word), and the least distance.
MEASURES = {"chars": 25, "symbols": 100, "dup_lines": 100, "repeats": 500}
_SPACE_CHARS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in windows of three whose words come twice or more in the text.

    Where all windows' hashes differ, none comes twice; else equal windows are neighbours once they are sorted.
    """
    count = F.size(words)
    windows = lambda body: F.transform(F.slice(words, 1, count - 2), lambda w, i: body(w, F.get(words, i + 1), F.get(words, i + 2), i))

    def covered(placed: Column) -> Column:
        alike = lambda x, j: F.coalesce(F.get(placed, j)["w"] == x["w"], F.lit(False))
        twice = F.filter(placed, lambda x, j: ((j > 0) & alike(x, F.greatest(j - 1, F.lit(0)))) | alike(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + 2)))))

    placed = windows(lambda a, b, c, i: F.struct(F.concat_ws(" ", a, b, c).alias("w"), i.alias("i")))
    distinct = F.size(F.array_distinct(windows(lambda a, b, c, i: F.xxhash64(a, b, c))))
    return F.when(count < 3, F.lit(0)).when(distinct == count - 2, F.lit(0)).otherwise(let(F.sort_array(placed), covered))


def base(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, tag`` (a number of the row's own) and the base counts of every row, from its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(_SPACE_CHARS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = F.struct(of_words.alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"), of_lines.alias("n_dup_lines"))
    # A generator keeps the optimizer from computing the counts anew for each of their uses.
    rows = docs.select("doc_id", "lang", "source", F.monotonically_increasing_id().alias("tag"), F.inline(F.array(counts)))
    rows = rows.select("doc_id", "lang", "source", "tag", *[F.col(c).cast("bigint").alias(c.removeprefix("w.")) for c in ("w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` with a whole number for each of ``MEASURES``; null without words."""
    per = lambda n, scale: F.expr(f"CASE WHEN n_words > 0 THEN {scale} * {n} div n_words END")
    return rows.withColumns({"chars": per("word_chars", 100), "symbols": per("n_symbols", 10_000), "dup_lines": per("n_dup_lines", 10_000), "repeats": per("n_repeat_words", 10_000)})


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches of every measure: documents ``n`` of each key, measure and cell. Sketches merge by adding.

    A cell is a value's first ``KEPT_BITS`` bits, the rest zero, so a key has some hundred cells however many documents
    it has, and they are counted before they are exchanged.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    shift = F.greatest(F.length(F.bin("value")) - KEPT_BITS, F.lit(0))
    cell = F.expr("shiftleft(shiftright(value, shift), shift)")
    rows = rows.select(*keys, values.alias("m")).select(*keys, "m.*").withColumn("shift", shift)
    return rows.groupBy(*keys, "measure", cell.alias("cell")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer keys."""
    return sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``docs``, ``q1``, ``q2`` and ``q3`` of each key and measure: the cells where the ranks of the quartiles lie."""
    own = Window.partitionBy(*keys, "measure")
    rows = sketches.withColumn("upto", F.sum("n").over(own.orderBy("cell"))).withColumn("docs", F.sum("n").over(own))
    at = [F.min(F.when(4 * F.col("upto") >= q * F.col("docs"), F.col("cell"))).alias(f"q{q}") for q in (1, 2, 3)]
    return rows.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), *at)


def fences(passed: DataFrame) -> DataFrame:
    """``key`` of each language and source, and ``low_`` and ``high_`` of each measure.

    Fences lie around the median at ``REACH`` times the distance of the outer quartile, which is taken as the measure's
    least distance where it is smaller. A group with fewer than ``LEAST_DOCS`` documents has those of its language; a
    language with fewer, those of all.
    """
    groups = cut(sketch(passed, ["key", "tongue"]))
    tongues = merged(groups, ["tongue"])
    level = lambda rows, keys, name: quartiles(rows, keys).select(*keys, "measure", F.struct("docs", "q1", "q2", "q3").alias(name))
    own = level(groups, ["key", "tongue"], "own")
    found = own.join(level(tongues, ["tongue"], "of_tongue"), ["tongue", "measure"]).join(level(merged(tongues, []), [], "of_all"), "measure")
    by = F.when(F.col("own.docs") >= LEAST_DOCS, F.col("own")).when(F.col("of_tongue.docs") >= LEAST_DOCS, F.col("of_tongue")).otherwise(F.col("of_all"))
    least = F.element_at(F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair]), F.col("measure"))
    found = found.select("key", "measure", by.alias("q")).withColumn("least", least)
    low = F.expr(f"q.q2 - {REACH} * greatest(q.q2 - q.q1, least)")
    high = F.expr(f"q.q2 + {REACH} * greatest(q.q3 - q.q2, least)")
    pick = [F.max(F.when(F.col("measure") == m, x)).alias(f"{side}_{m}") for m in MEASURES for side, x in (("low", low), ("high", high))]
    return found.groupBy("key").agg(*pick)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of every row.

    Documents that pass the base rules are sketched by language and source; one of them is kept if all its measures
    lie inside its group's fences. Words are counted in the row, and nothing but counts is exchanged.

    Null text: no words, fails the base rules. Null language or source: a group of its own. Repeated rows are documents of their own, as are null
    doc_ids. Empty table: no rows. Other columns are ignored.
    """
    key, tongue = F.to_json(F.struct("lang", "source")), F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n"))
    rows = cut(measured(base(docs)).withColumn("key", key).withColumn("tongue", tongue).drop("lang", "source"))
    passed = rows.filter("NOT base_failed")
    inside = [F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")) for m in MEASURES]
    verdict = inside[0] & inside[1] & inside[2] & inside[3]
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = met(passed, fences(passed), "key", "tag").select(*columns, verdict.alias("kept"))
    return rows.filter("base_failed").select(*columns, F.lit(False).alias("kept")).unionByName(good)


_FENCES = ", ".join(f"max(CASE WHEN measure = '{m}' THEN q2 - {REACH} * greatest(q2 - q1, {x}) END) AS low_{m}, max(CASE WHEN measure = '{m}' THEN q2 + {REACH} * greatest(q3 - q2, {x}) END) AS high_{m}" for m, x in MEASURES.items())
_QUARTILES = ", ".join(f"min(CASE WHEN 4 * upto >= {q} * docs THEN cell END) AS q{q}" for q in (1, 2, 3))
_LEVEL = lambda name, keys: f"""{name} AS (SELECT {keys} measure, max(docs) AS docs, {_QUARTILES} FROM (SELECT {keys} measure, cell, sum(n) OVER (PARTITION BY {keys} measure ORDER BY cell) AS upto,
     sum(n) OVER (PARTITION BY {keys} measure) AS docs FROM (SELECT {keys} measure, cell, sum(n) AS n FROM sketch GROUP BY {keys} measure, cell)) GROUP BY {keys} measure)"""  # noqa: E731
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER () AS tag, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
     win AS (SELECT tag, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT tag, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
     twice AS (SELECT tag, i FROM win QUALIFY count(*) OVER (PARTITION BY tag, g) > 1),
     rep AS (SELECT tag, count(DISTINCT i + o) AS n FROM twice, range(3) r(o) GROUP BY tag),
     b AS (SELECT doc_id, lang, source, tag, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (tag)),
     j AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, 100 * word_chars // nullif(n_words, 0) AS chars,
                  10000 * n_symbols // nullif(n_words, 0) AS symbols, 10000 * n_dup_lines // nullif(n_words, 0) AS dup_lines, 10000 * n_repeat_words // nullif(n_words, 0) AS repeats FROM b),
     v AS (UNPIVOT (SELECT lang, source, {", ".join(MEASURES)} FROM j WHERE NOT base_failed) ON {", ".join(MEASURES)} INTO NAME measure VALUE v),
     sketch AS (SELECT lang, source, measure, (v >> s) << s AS cell, count(*) AS n FROM (SELECT *, greatest(length(bin(v)) - {KEPT_BITS}, 0) AS s FROM v) GROUP BY ALL),
     {_LEVEL("own", "lang, source,")}, {_LEVEL("tongue", "lang,")}, {_LEVEL("whole", "")},
     best AS (SELECT o.lang, o.source, measure, {", ".join(f"CASE WHEN o.docs >= {LEAST_DOCS} THEN o.q{q} WHEN t.docs >= {LEAST_DOCS} THEN t.q{q} ELSE a.q{q} END AS q{q}" for q in (1, 2, 3))}
              FROM own o JOIN tongue t USING (measure) JOIN whole a USING (measure) WHERE o.lang IS NOT DISTINCT FROM t.lang),
     fence AS (SELECT lang, source, {_FENCES} FROM best GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND
       coalesce({" AND ".join(f"{m} BETWEEN low_{m} AND high_{m}" for m in MEASURES)}, false) AS kept
FROM j LEFT JOIN fence f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source
"""
