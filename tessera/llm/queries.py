"""The registered queries of this subpackage: thin digests of the operators' results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, exact_dedup, langid, lexical, mixing, pseudo_likelihood, quality, sentencepiece_lattice, simhash, substring_dedup, toxicity, urlfilter, vafile


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return langid.language_id(_documents(spark, sf_dir)).withColumn("n_spans", F.size("spans")).drop("spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_dups(_documents(spark, sf_dir))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages removed from all documents."""
    found = substring_dedup.dedup(_documents(spark, sf_dir))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on all pages' URLs."""
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of all documents."""
    return pseudo_likelihood.pseudo_likelihood(_documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and what their ids decode to."""
    decoded = sentencepiece_lattice.decode(sentencepiece_lattice.encode(_documents(spark, sf_dir)))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup.dedup(_documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.mix(_documents(spark, sf_dir))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector, against all vectors."""
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op11_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds."""
    return vafile.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on all documents."""
    return quality.judged(_documents(spark, sf_dir))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_OPERATORS = (
    op1_toxicity, op2_langid, op3_simhash, op4_substring, op5_urlfilter, op6_pseudo_likelihood, op7_sentencepiece,
    op8_exact_dedup, op9_mixing, op10_ann, op11_vafile, op12_quality, op13_lexical,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_vafile": vafile.ORACLE,
    "op12_quality": quality.ORACLE,
    "op13_lexical": lexical.ORACLE,
}
