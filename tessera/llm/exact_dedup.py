"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations alone."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Leaf runs at least, and rows of a leaf run on average; runs are a power of two, and each round merges neighbours: 32 -> 16 -> ... -> 1.
RUNS, RUN_ROWS = 32, 1 << 22
#: A digest run's key. Equal texts agree in all three; the last two verify the first.
_KEY = ["sha", "n_bytes", "check"]


def folded(text: Column) -> Column:
    """What texts are compared by: each run of white space one space, null as empty."""
    # A lone space stays as it is, so only the other runs of white space need rewriting.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tag`` (a number of its own) and digest key of every row; a null text counts as empty."""
    return docs.select("doc_id", folded(F.col("text")).alias("t")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("tag"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def dealt(rows: DataFrame, runs: int) -> DataFrame:
    """``rows`` with their leaf ``run``, by a hash of the row's own number: equal texts and equal ids are in all runs alike."""
    return rows.withColumn("run", F.pmod(F.xxhash64("tag"), F.lit(runs)).cast("int"))


def leaves(rows: DataFrame) -> DataFrame:
    """``run``, digest key, ``first`` (order, doc_id and tag of the row that stays so far) and rows ``n``: a row per run and digest."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    return rows.groupBy("run", *_KEY).agg(F.min(first).alias("first"), F.count("*").alias("n"))


def merged(runs: DataFrame) -> DataFrame:
    """One round: neighbouring runs meet, sorted by digest, and a pass over that order keeps the first of equal digests.

    An exchange brings the pieces of two runs together by digest; sorting them is the multiway merge, and the
    window reads its order without a further sort. All of the digest key has to agree, not the digest alone.
    """
    met = runs.withColumn("run", (F.col("run") / 2).cast("int")).repartition("run", "sha")
    met = met.sortWithinPartitions("run", *_KEY, "first")
    ordered = Window.partitionBy("run", *_KEY).orderBy("first")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.withColumn("place", F.row_number().over(ordered)).withColumn("n", F.sum("n").over(whole))
    return met.filter("place = 1").drop("place")


def dedup(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Texts are equal when identical after each run of white space became one space. Rows are dealt
    to leaf runs, as many as the rows need, and a run has one row a digest, so one that a third of all rows
    share is a row a run. Binomial rounds merge neighbouring sorted runs, retaining at every level the
    smallest doc_id of each digest, verified by length and a second hash. Winners go down the same
    tree: first to the leaf runs, at most one row per run and digest, then to the run's documents.

    Null text: as empty. Null doc_id: never preferred, kept only where its whole group has none.
    Repeated rows of one doc_id: each is returned, each counts in group_size, and one of them at most is kept.
    Empty table: no rows. Other columns are ignored.
    """
    rows = cut(digest_rows(docs))
    runs = max(RUNS, 1 << (max(1, -(-rows.count() // RUN_ROWS)) - 1).bit_length())
    rows = dealt(rows, runs)
    leaf = level = leaves(rows)
    for _ in range(runs.bit_length() - 1):
        level = merged(level)
    winners = level.select(*_KEY, "first", "n")
    down = leaf.select("run", *_KEY).join(winners, _KEY)
    return rows.join(down, ["run", *_KEY]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("first.tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, 
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t JOIN g USING (t)
"""
