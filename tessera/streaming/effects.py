"""Events that take effect exactly once: numbered batches, a ledger of what has been processed, and failures that are tried again."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.artifacts import exists


class Ledger:
    """The ledger at ``target``, a shared folder that belongs to one stream's checkpoint.

    ``attempt`` turns rows into the same rows and ``error``: null where the effect has taken place, else why not. It sees
    ``attempts``, how often the row was tried before. What a batch did is written under its number, which counts only once the
    batch is committed: a batch that dies before is written over when it is run again, one that dies after is left out. So
    a row of ``effects`` is there once for each id, however often an event is delivered and a batch is run.
    """

    def __init__(self, spark: SparkSession, target: str, key: str, ts: str, attempt: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.target, self.key, self.ts, self.attempt = spark, target.rstrip("/"), key, ts, attempt

    def committed(self) -> int:
        """The last committed batch, -1 before the first; batches are committed in order."""
        if not exists(self.spark, f"{self.target}/commits"):
            return -1
        last = self.spark.read.schema("batch long").parquet(f"{self.target}/commits").agg(F.max("batch")).first()[0]
        return -1 if last is None else last

    def effects(self, last: int | None = None) -> DataFrame | None:
        """What has been processed: rows of committed batches."""
        last = self.committed() if last is None else last
        return None if last < 0 else self.spark.read.option("basePath", f"{self.target}/effects").parquet(f"{self.target}/effects").filter(F.col("batch") <= last)

    def failed(self, last: int | None = None) -> DataFrame | None:
        """What still waits, as of the last committed batch, with its ``error`` and ``attempts``."""
        last = self.committed() if last is None else last
        return None if last < 0 else self.spark.read.parquet(f"{self.target}/failed/{last}")

    def write(self, batch: DataFrame, number: int) -> None:
        """Tries a batch's rows and those that have failed, but none whose id has been processed.

        Of an id's deliveries in a batch the first by ``ts`` is tried, and it stands in for an earlier one that failed. The
        ledger is not shuffled: it is searched for the batch's ids, which Spark sends to it if they are small enough.
        """
        last, columns = self.committed(), [c for c in batch.columns]
        first = Window.partitionBy(self.key).orderBy(F.col(self.ts).asc_nulls_last(), F.xxhash64(*columns))
        new = batch.filter(F.col(self.key).isNotNull()).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*columns, F.lit(0).alias("attempts"))
        old = self.failed(last)
        if old is not None:
            tried = old.select(self.key, F.col("attempts").alias("_before"))
            again = old.join(new.select(self.key), self.key, "left_anti").select(*columns, "attempts")
            new = new.join(tried, self.key, "left").select(*columns, F.coalesce("_before", "attempts").alias("attempts")).unionByName(again)
            seen = self.effects(last).join(new.select(self.key), self.key, "left_semi").select(self.key)
            new = new.join(seen, self.key, "left_anti")
        path = f"{self.target}/tried/{number}"
        self.attempt(new).withColumn("attempts", F.col("attempts") + 1).write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path)
        rows.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{self.target}/effects/batch={number}")
        rows.filter("error IS NOT NULL").write.mode("overwrite").parquet(f"{self.target}/failed/{number}")

    def commit(self, number: int) -> None:
        """From now on the batch counts; Spark renames the file into place whole."""
        self.spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.target}/commits")

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number > self.committed():
            self.write(batch, number)
            self.commit(number)

    def retry(self) -> None:
        """Tries what has failed once more, as a batch of its own without new events; for a stream that has ended."""
        if (old := self.failed()) is not None:
            self(old.drop("error", "attempts").limit(0), self.committed() + 1)


def run(stream: DataFrame, ledger: Ledger, checkpoint: str) -> None:
    """Feeds the ledger all that the stream has."""
    stream.writeStream.foreachBatch(ledger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def states(ledger: Ledger) -> DataFrame:
    """Each event that was ever tried with ``processed`` and its last ``error``."""
    done, waits = ledger.effects(), ledger.failed()
    parts = [done.select(ledger.key, F.lit(True).alias("processed"), F.lit("").alias("error")), waits.select(ledger.key, F.lit(False).alias("processed"), F.substring("error", 1, 2000).alias("error"))]
    return reduce(DataFrame.unionByName, parts)
