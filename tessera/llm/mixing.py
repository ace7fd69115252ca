"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, n_words

#: Weights of the sources in order of their names, repeated; no source is taken more than EPOCHS times.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Documents of a source that one range of its random order holds on average.
RANGE_ROWS = 4096
#: Parts that each source's rows are dealt to where they meet its target.
SALTS = 64
_KEY_BITS = 60


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums over all rows before each one in ``order``: inside ranges of the order, plus the ranges before.

    Only the ranges' own sums meet in one task, and there are no more of them than shuffle partitions.
    """
    dealt = rows.select("*", *[v.alias(k) for k, v in sums.items()]).repartitionByRange(*order)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(k).alias(k) for k in sums])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.join(F.broadcast(ranges), "_range")
    total = [(F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.col(f"_{k}")).alias(k) for k in sums]
    return dealt.select(*rows.columns, *total)


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Target words of each source, from ``skey, source, source_size, docs`` (one row per source).

    Shares follow the weights; a source stops at ``epochs`` times its size and its excess is shared
    again by weight. Sources in order of cap over weight reach their caps first, so one pass of running
    sums finds the level at which the rest share: this is what resharing until none is above ends in.
    """
    named = running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = named.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * epochs)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = running(rows, [F.col("ratio"), F.col("skey")], {"caps": F.col("cap"), "weighed": F.col("weight")})
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weight"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    rows = rows.withColumn("level", (F.col("words") - F.col("caps")) / (F.col("all_weight") - F.col("weighed")))
    shared = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "skey", "level")))["level"]
    rows = rows.drop("level").crossJoin(F.broadcast(rows.agg(shared.alias("level"))))  # one row
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Words that the mix takes of each document: ``doc_id, size, source_size, target, taken``.

    Each document has a random place in its source, by a hash of doc_id, so reruns agree. The order is
    cut into ranges of about ``RANGE_ROWS`` documents, as many as a source needs, so that a source with
    a third of all rows is as parallel as the rest; sums of ranges give each range its offset, and a
    running sum inside the range the rest. Whole epochs are taken first; the last one is cut where the
    budget (the target, rounded) ends, so the document at the cut gives its first words only.

    Null text: size 0. Null source: a source of its own, after all others. Null doc_id: a place by the
    hash of null. Repeated rows are documents of their own. Empty table: no rows. Other columns are ignored.
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, _KEY_BITS // 4), 16, 10).cast("bigint")
    rows = cut(
        docs.select(
            "doc_id",
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("skey"),
            n_words(F.col("text")).alias("size"),
            key.alias("key"),
        )
    )
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = sizes.withColumn("source", F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")))
    plan = targets(sizes, weights, epochs).select(
        "skey",
        "source_size",
        "target",
        F.round("target").cast("bigint").alias("budget"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / RANGE_ROWS))).cast("int").alias("bits"),
    )
    # The number of sources has no bound, so nothing is broadcast; salts keep a source with a third of all rows apart.
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)).cast("int"))
    placed = rows.join(plan, ["skey", "salt"]).withColumn("range", F.expr(f"key div shiftleft(1L, {_KEY_BITS} - bits)"))
    ranges = placed.groupBy("skey", "range").agg(F.sum("size").alias("words"))
    offsets = ranges.select(
        "skey",
        "range",
        F.coalesce(
            F.sum("words").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("offset"),
    )
    inside = (
        Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rest = F.expr("budget - source_size * (budget div source_size)")
    last = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("start")))
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr("size * (budget div source_size)") + last)
    return (
        placed.join(offsets, ["skey", "range"])
        .withColumn("start", start)
        .select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("bigint").alias("taken"))
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
     s AS (SELECT source, sum(size)::DOUBLE AS source_size,
                  [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
           FROM d GROUP BY source),
     r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM s),
     v AS (SELECT *, ((SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER w, 0))
                     / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER w, 0)) AS level
           FROM r WINDOW w AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     t AS (SELECT source, source_size::BIGINT AS source_size,
                  least(cap, coalesce((SELECT arg_min(level, ratio) FROM v WHERE ratio > level) * weight, cap)) AS target
           FROM v),
     p AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
                  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size)
             + greatest(0, least(size, budget % source_size - start)) END)::BIGINT AS taken
FROM p
"""
