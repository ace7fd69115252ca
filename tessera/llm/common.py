"""What several operators share: words, folds, and cutting lineage in the cluster's shared folder."""

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words; everything else belongs to a word. Fixed by the contracts.
SPACE = r"[\x20\x09-\x0D]+"
#: Parts that the rows of one key are dealt to, see ``met``.
SALTS = 64
_SPACE_CHARS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or the one that the context was given; on one machine, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and given.isDefined():
        folder = given.get()
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later reads survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, for loops; its files stay unless ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def met(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``facts`` (one row a ``key``), where one key may hold a third of all rows.

    A key's rows are dealt to ``SALTS`` parts by a hash of ``by``. Facts go down to the parts that exist, of which
    each key has ``SALTS`` at most, and from a part to its rows. ``rows`` is read twice.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(key, "_part").agg(F.lit(1).alias("_one")).drop("_one").join(facts, key)
    return rows.join(parts, [key, "_part"]).drop("_part")


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def n_words(text: Column) -> Column:
    """Number of words in ``text``; 0 for null and for white space alone."""
    bare = F.btrim(text, F.lit(_SPACE_CHARS))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("bigint")


def slices(batches: Iterator[pa.RecordBatch], by: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``by`` column holds about ``most`` bytes (one row at least)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size) + 1
        yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 of a string column; None for null."""
    return batch.column(column).cast(pa.binary()).to_pylist()
