"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, SentencePiece encoding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that its predecessor kept; all but the
last return the columns of ``documents``. Every stage takes nulls in any column, empty and very long texts,
repeated rows and further columns, and gives no rows for an empty table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, sentencepiece_lattice, simhash, toxicity
from tessera.llm.common import cut

#: The classifiers are trained by numpy, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifiers do not reject.

    Null and empty texts hold no known word and stay. Repeated rows are each judged. Without a toxic label all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def _digest() -> Column:
    return F.sha2(exact_dedup.folded(F.col("text")), 256)


def _one_each(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``winners``: ``doc_id`` (null equals null), ``digest``, and the number ``n`` of such rows.

    Only rows that share both with another row are grouped; the least of them stays.
    """
    keys = winners.select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"), F.col("n").alias("_n"))
    rows = docs.withColumn("_digest", _digest())
    rows = rows.join(keys, rows["doc_id"].eqNullSafe(keys["_kept_id"]) & (rows["_digest"] == keys["_kept_digest"]))
    own = [docs[c] for c in docs.columns]
    repeated = rows.filter("_n > 1").groupBy("_kept_id", "_kept_digest").agg(F.min(F.struct(*own)).alias("_row"))
    return rows.filter("_n = 1").select(*own).unionByName(repeated.select("_row.*"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, one row with the smallest doc_id.

    Null text counts as empty. A null doc_id stays only where its whole group has none. Repeated rows of the winner: one stays.
    """
    kept = exact_dedup.dedup(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return _one_each(docs, kept.groupBy("doc_id", F.col("text_sha256").alias("digest")).agg(F.count("*").alias("n")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, one row with the smallest doc_id, and of its texts the least digest.

    Null and empty texts are one component. Null doc_ids as in exact dedup.
    """
    found = simhash.members(docs, key=_digest()).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    texts = found.groupBy("component", "doc_id", F.col("key").alias("digest")).agg(F.count("*").alias("n"))
    winners = texts.groupBy("component").agg(F.min(F.struct("doc_id", "digest", "n")).alias("w"))
    return _one_each(docs, winners.select("w.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole epochs, and the one that a cut goes through if half of it is in.

    Documents without a word have no share of a mix of words, and go. Null source: a source of its own. Rows of one
    doc_id are taken alike, as often as the one of them that is taken most.
    """
    taken = mixing.mix(docs).select(
        F.col("doc_id").alias("_taken_id"), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("_copies")
    )
    taken = taken.filter("_copies > 0").groupBy("_taken_id").agg(F.max("_copies").alias("_copies"))
    repeated = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_taken_id"]))
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document; none for null and empty texts. Repeated rows are each encoded."""
    return sentencepiece_lattice.encode(docs).select("doc_id", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
